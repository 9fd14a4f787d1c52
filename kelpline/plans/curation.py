"""Registered queries about videos: statistics, filters, pages, merges, slices, vectors and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kelpline.functions import text as T
from kelpline.operators import curation, vectors
from kelpline.sources import adapters as A
from kelpline.sources.session import with_checkpoints
from kelpline.streaming.windows import event_windows as windows_of

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


V = f"WITH {A.VIDEOS_SQL}"
VR = f"WITH {A.VIDEOS_SQL}, {A.REVIEWS_SQL}"


def terms_sql(column: str, terms: list[str]) -> str:
    """CASE expression for the first of the terms in a column."""
    q = lambda t: "'" + t.replace("'", "''") + "'"
    return "CASE " + " ".join(f"WHEN contains({column}, {q(t)}) THEN {q(t)}" for t in terms) + " END"


# Statistics


@query(
    V + " SELECT source_platform, label, count(*) AS n, avg(duration_sec) AS avg_duration, min(duration_sec) AS min_duration, max(duration_sec) AS max_duration,"
    " max(resolution_w) AS max_w, min(fps) AS min_fps, CAST(sum(file_size_bytes) AS BIGINT) AS bytes FROM v_videos WHERE status = 'filtered' AND duration_sec IS NOT NULL GROUP BY 1, 2"
)
def composition(spark, sf_dir):
    v = A.videos(spark, sf_dir).where("status = 'filtered' AND duration_sec IS NOT NULL")
    d = "duration_sec"
    return v.groupBy("source_platform", "label").agg(
        F.count("*").alias("n"), F.avg(d).alias("avg_duration"), F.min(d).alias("min_duration"), F.max(d).alias("max_duration"),
        F.max("resolution_w").alias("max_w"), F.min("fps").alias("min_fps"), F.sum("file_size_bytes").alias("bytes"),
    )


@query(V + " SELECT coalesce(label_source, '(null)') AS label_source, count(*) AS n, count(duration_sec) AS n_timed FROM v_videos GROUP BY 1 UNION ALL SELECT '(total)', count(*), count(duration_sec) FROM v_videos")
def label_source_stats(spark, sf_dir):
    key = F.coalesce("label_source", F.lit("(null)"))
    rolled = A.videos(spark, sf_dir).withColumn("k", key).rollup("k").agg(F.count("*").alias("n"), F.count("duration_sec").alias("n_timed"))
    return rolled.select(F.coalesce("k", F.lit("(total)")).alias("label_source"), "n", "n_timed")


@query(
    V + ", u AS (SELECT unnest(['label:' || label, 'status:' || status, 'source:' || coalesce(label_source, '(null)')]) AS bucket FROM v_videos) SELECT bucket, count(*) AS n FROM u GROUP BY 1"
)
def stats_overview(spark, sf_dir):
    # One pass: rows are counted by all three first, and these counts are summed by each.
    base = A.videos(spark, sf_dir).groupBy("label", "status", F.coalesce("label_source", F.lit("(null)")).alias("source")).count()
    buckets = F.array(*[F.concat(F.lit(f"{c}:"), F.col(c)) for c in ("label", "status", "source")])
    return base.select(F.explode(buckets).alias("bucket"), "count").groupBy("bucket").agg(F.sum("count").alias("n"))


@query(
    V + ", p AS (SELECT label, CASE WHEN content_tags LIKE '[%' AND starts_with(content_tags, '[\"' || source_platform || ':')"
    " THEN substr(json_extract_string(content_tags, '$[0]'), length(source_platform) + 2) ELSE source_platform END AS platform FROM v_videos)"
    " SELECT platform, label, count(*) AS n FROM p GROUP BY 1, 2"
)
def platform_label(spark, sf_dir):
    platform = T.umbrella_platform(F.col("source_platform"), F.col("content_tags"))
    return A.videos(spark, sf_dir).groupBy(platform.alias("platform"), "label").agg(F.count("*").alias("n"))


@query(V + " SELECT coalesce(strftime(published_at, '%Y-%m'), 'unknown') AS month, label, count(*) AS n FROM v_videos GROUP BY 1, 2")
def month_label(spark, sf_dir):
    month = F.coalesce(F.date_format("published_at", "yyyy-MM"), F.lit("unknown"))
    return A.videos(spark, sf_dir).groupBy(month.alias("month"), "label").agg(F.count("*").alias("n"))


@query(V + " SELECT claimed_generator, count(*) AS n FROM v_videos WHERE status <> 'excluded' AND claimed_generator IS NOT NULL AND claimed_generator <> '' GROUP BY 1")
def by_generator(spark, sf_dir):
    v = A.videos(spark, sf_dir).where("status <> 'excluded' AND claimed_generator IS NOT NULL AND claimed_generator <> ''")
    return v.groupBy("claimed_generator").agg(F.count("*").alias("n"))


@query(
    V + " SELECT count(*) AS n, count(*) FILTER (blob_url IS NULL) AS n_none, count(*) FILTER (starts_with(blob_url, 'file://')) AS n_local,"
    " count(*) FILTER (starts_with(blob_url, 'https://huggingface.co/')) AS n_remote,"
    " CAST(coalesce(sum(file_size_bytes) FILTER (starts_with(blob_url, 'file://')), 0) AS BIGINT) AS local_bytes FROM v_videos WHERE duplicate_of_id IS NULL"
)
def storage_stats(spark, sf_dir):
    url = F.col("blob_url")
    local = F.coalesce(url.startswith("file://"), F.lit(False))
    return A.videos(spark, sf_dir).where("duplicate_of_id IS NULL").agg(
        F.count("*").alias("n"), F.count_if(url.isNull()).alias("n_none"), F.count_if(local).alias("n_local"),
        F.count_if(url.startswith("https://huggingface.co/")).alias("n_remote"), F.coalesce(F.sum(F.when(local, F.col("file_size_bytes"))), F.lit(0)).alias("local_bytes"),
    )


@query(V + " SELECT count(*) FILTER (duplicate_of_id IS NULL) AS canonicals, count(duplicate_of_id) AS duplicates, count(caption_model) AS captioned FROM v_videos")
def dedup_stats(spark, sf_dir):
    return A.videos(spark, sf_dir).agg(
        F.count_if(F.col("duplicate_of_id").isNull()).alias("canonicals"), F.count("duplicate_of_id").alias("duplicates"), F.count("caption_model").alias("captioned")
    )


@query(
    V + ", f AS (SELECT CASE WHEN contains(lower(claimed_generator), 'kling') THEN 'kling' WHEN contains(lower(claimed_generator), 'sora') THEN 'sora'"
    " WHEN contains(lower(claimed_generator), 'veo') THEN 'veo' WHEN contains(lower(claimed_generator), 'runway') THEN 'runway' WHEN contains(lower(claimed_generator), 'pika') THEN 'pika'"
    " WHEN contains(lower(claimed_generator), 'modelscope') THEN 'modelscope' ELSE lower(claimed_generator) END AS family FROM v_videos WHERE claimed_generator <> '')"
    " SELECT family, count(*) AS n FROM f GROUP BY 1 ORDER BY n DESC, family LIMIT 5"
)
def top_families(spark, sf_dir):
    v = A.videos(spark, sf_dir).where("claimed_generator <> ''").groupBy("claimed_generator").count()
    return v.groupBy(T.family(F.col("claimed_generator")).alias("family")).agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "family").limit(5)


# Filters

QUALITY = {"min_resolution": 720, "min_short_edge": 400, "min_duration": 3, "max_duration": 300}
QUALITY_SQL = (
    "CASE WHEN file_size_bytes = 0 THEN 'corrupt' WHEN coalesce(resolution_w, 0) > 0 AND coalesce(resolution_h, 0) > 0 AND"
    " (greatest(resolution_w, resolution_h) < 720 OR least(resolution_w, resolution_h) < 400) THEN 'resolution'"
    " WHEN duration_sec < 3 OR duration_sec > 300 THEN 'duration' END"
)
TIER_SQL = "CASE label_source WHEN 'tier1_gallery' THEN 1 WHEN 'tier2_platform_tag' THEN 2 WHEN 'tier2_channel_whitelist' THEN 2 WHEN 'tier3_llm' THEN 3 END"
ALLOWED, BANNED = ["kling21", "sora2", "veo3", "runway-gen4"], ["pika1", "modelscope_t2v"]
VERDICT_SQL = (
    "CASE WHEN claimed_generator IS NULL THEN 'missing' WHEN claimed_generator IN ('pika1', 'modelscope_t2v') THEN 'blacklisted'"
    " WHEN claimed_generator IN ('kling21', 'sora2', 'veo3', 'runway-gen4') THEN 'whitelisted' ELSE 'unknown' END"
)


@query(V + f" SELECT id, {QUALITY_SQL} AS reason FROM v_videos")
def quality_verdict(spark, sf_dir):
    return A.videos(spark, sf_dir).select("id", curation.quality_reason(**QUALITY).alias("reason"))


@query(V + f" SELECT id, {TIER_SQL} AS tier, coalesce({TIER_SQL} IN (1, 2), false) AS kept FROM v_videos")
def tier_verdict(spark, sf_dir):
    tier = curation.tier_of(F.col("label_source"))
    return A.videos(spark, sf_dir).select("id", tier.alias("tier"), F.coalesce(tier.isin(1, 2), F.lit(False)).alias("kept"))


@query(V + f" SELECT id, {VERDICT_SQL} AS verdict, {VERDICT_SQL} <> 'blacklisted' AS lenient, {VERDICT_SQL} = 'whitelisted' AS strict FROM v_videos")
def whitelist_verdict(spark, sf_dir):
    verdict = curation.whitelist_verdict(F.col("claimed_generator"), ALLOWED, BANNED)
    return A.videos(spark, sf_dir).select(
        "id", verdict.alias("verdict"), curation.verdict_kept(verdict, False).alias("lenient"), curation.verdict_kept(verdict, True).alias("strict")
    )


@query(
    V + f", f AS (SELECT CASE WHEN {QUALITY_SQL} IS NOT NULL THEN 'quality' WHEN NOT coalesce({TIER_SQL} IN (1, 2), false) THEN 'tier'"
    f" WHEN {VERDICT_SQL} = 'blacklisted' THEN 'whitelist' ELSE 'kept' END AS stage FROM v_videos) SELECT stage, count(*) AS n FROM f GROUP BY 1"
)
def filter_chain(spark, sf_dir):
    stage = curation.reject_stage([1, 2], ALLOWED, BANNED, False, **QUALITY)
    return A.videos(spark, sf_dir).groupBy(F.coalesce(stage, F.lit("kept")).alias("stage")).agg(F.count("*").alias("n"))


#: What titles and tags are given besides, by id: each term of the rules, once in a title and once in a tag, and cases
#: in which one rule yields to another.  Written out here, so that the SQL owes nothing to the lists of the rules.
SAID = """vtuber vtube vup 虚拟主播 虚拟偶像 虚拟up主 虚拟youtuber 虚拟yt 管人痴 皮套 中之人 hololive a-soul asoul にじさんじ 彩虹社 neuro-sama vedal
东雪莲 東雪蓮 阿梓 嘉然 乃琳 贝拉 珈乐 向晚 嘉心糖 乃贝 鹿鸣 叶瞬光 neuro 夏色まつり 神楽めあ 月ノ美兎 月之美兔
教程 教学 入门 保姆级 手把手 教会你 一分钟教会 秒教会 使用方法 使用指南 AI教程 工作流 ComfyUI comfy_ui 整合包 一键包 一键整合 本地部署 免安装 附安装包
Tutorial step_by_step step-by-step how_to_use how_to_make how_to_create beginner walkthrough guide 入门教程 入门教学 跟我学 学习ai ai学习 学ai ai教学 sd教程
sd教学 sd学习 comfyui教程 comfyui教学 comfyui入门 工作流教程 提示词教学 从零开始的异世界_tutorial 从零开始的异世界_ai_cover
[Suno 【suno AI翻唱 ai歌手 ai配乐 AI_Cover ai歌曲 ai音乐生成 ai作曲 ai编曲 ai作词 ai写歌 ai原创歌曲 ai原创音乐 ai_cover_AI_MV ai翻唱_ai短剧
ai主播 ai女主播 ai男主播 ai数字人 ai虚拟主播 数字人主播 数字主播 ai数字分身 ai带货 ai播报 ai播音 ai新闻主播 ai直播间 数字分身 ai虚拟主播_数字人主播
换脸_pika ai换脸 roop_runway faceswap 翻唱_kling k-pop nothing""".split()
SAID_SQL = "[" + ", ".join("'" + x.replace("_", " ") + "'" for x in SAID) + "]"
SAID_SPARK = "array(" + ", ".join("'" + x.replace("_", " ") + "'" for x in SAID) + ")"
EXCLUSIONS_SQL = """
, t AS (
  SELECT id, source_platform, CASE WHEN (id // {n}) % 2 = 0 THEN concat(title, ' ', x[1 + id % {n}]) ELSE title END AS title,
    CASE WHEN id % 23 = 0 THEN NULL WHEN id % 29 = 0 THEN '{{bad' ELSE concat('["x","', CASE WHEN (id // {n}) % 2 = 1 THEN x[1 + id % {n}] ELSE '' END, '"]') END AS tags_json
  FROM v_videos, (SELECT {said} AS x)
), w AS (
  SELECT *, lower(title) AS low, CASE WHEN tags_json LIKE '[%' THEN lower(array_to_string(from_json(tags_json, '["VARCHAR"]'), chr(9))) ELSE lower(coalesce(tags_json, '')) END AS tags FROM t
), m AS (
  SELECT id, source_platform,
    list_filter(['vtuber','vtube','vup','虚拟主播','虚拟偶像','虚拟up主','虚拟youtuber','虚拟yt','管人痴','皮套','中之人','hololive','a-soul','asoul','にじさんじ','彩虹社','neuro-sama','vedal'], lambda k: contains(tags, k) OR contains(low, k))[1] AS vt,
    list_filter(['东雪莲','東雪蓮','阿梓','嘉然','乃琳','贝拉','珈乐','向晚','嘉心糖','乃贝','鹿鸣','叶瞬光','neuro','夏色まつり','神楽めあ','月ノ美兎','月之美兔'], lambda k: contains(tags, k) OR contains(low, k))[1] AS vn,
    contains(title, '从零开始的异世界') AS no_tut,
    list_filter(['教程','教学','入门','保姆级','手把手','教会你','一分钟教会','秒教会','使用方法','使用指南','ai教程','工作流','comfyui','comfy ui','整合包','一键包','一键整合','本地部署','免安装','附安装包','tutorial','step by step','step-by-step','how to use','how to make','how to create','beginner','walkthrough','guide'], lambda k: contains(low, k))[1] AS tut,
    list_filter(['教程','教学','入门教程','入门教学','保姆级','手把手','教会你','跟我学','学习ai','ai学习','学ai','ai教程','ai教学','sd教程','sd教学','sd学习','comfyui教程','comfyui教学','comfyui入门','工作流教程','提示词教学','tutorial','beginner','walkthrough'], lambda k: contains(tags, k))[1] AS tut_tag,
    len(list_filter(['ai电影','ai短片','ai动画','ai视频','ai剧集','ai仿真人','ai真人','ai短剧','ai长片','ai mv'], lambda k: contains(low, k))) > 0 AS no_music,
    list_filter(['[suno','【suno','ai翻唱','ai歌手','ai配乐','ai cover','ai歌曲','ai音乐生成','ai作曲','ai编曲','ai作词','ai写歌','ai原创歌曲','ai原创音乐'], lambda k: contains(low, k))[1] AS music,
    list_filter(['ai主播','ai女主播','ai男主播','ai数字人','ai虚拟主播','数字人主播','数字主播','ai数字分身','ai带货','ai播报','ai播音','ai新闻主播','ai直播间'], lambda k: contains(low, k))[1] AS anchor,
    list_filter(['ai主播','ai女主播','ai男主播','ai数字人','数字人主播','数字主播','数字分身','ai带货','ai播报','ai播音','ai新闻主播','ai虚拟主播'], lambda k: contains(tags, k))[1] AS anchor_tag,
    len(list_filter(['ai翻唱','ai歌手','ai配乐','ai歌曲','ai cover','sunoai','ai音乐征集大赛','全能音乐挑战赛','ai虚拟之声实验室','翻唱','古风翻唱','戏腔','说唱','中文说唱','嘻哈','hiphop','rap','kpop','k-pop','cover'], lambda k: contains(tags, k))) > 0 AS music_tag,
    len(list_filter(['换脸','ai换脸','换头','人脸替换','deepfacelab','deepfacelive','roop','faceswap','face swap','facefusion','insightface'], lambda k: contains(tags, k))) > 0 AS face_tag,
    len(list_filter(['换脸','换头','人脸替换','deepfacelab','deepfacelive','roop换脸','facefusion'], lambda k: contains(low, k))) > 0 AS face_title,
    len(list_filter(['pika','kling','可灵','runway','即梦','dreamina','hailuo','luma','dream machine','hunyuan','通义','万相','wan2','ai视频','ai动画','ai生成视频','视频生成'], lambda k: contains(tags, k))) > 0 AS tool FROM w
), r AS (
  SELECT id, source_platform, music_tag AND NOT tool AS music_only, face_tag AND NOT tool AS face_only, face_title, tut_tag IS NOT NULL AS tutorial, coalesce('vt_tag:' || vt, 'vt_name:' || vn,
    CASE WHEN NOT no_tut THEN coalesce('tut:' || tut, 'tut_tag:' || tut_tag) END, CASE WHEN NOT no_music THEN 'ai_music:' || music END, 'ai_anchor:' || anchor, 'ai_anchor_tag:' || anchor_tag) AS reason FROM m
)
""".format(n=len(SAID), said=SAID_SQL)


def said(spark, sf_dir):
    """Videos with the terms of SAID in their titles, or else in their tags."""
    n = len(SAID)
    word, turn = f"{SAID_SPARK}[CAST(id % {n} AS INT)]", f"(id div {n}) % 2"
    tags = f"CASE WHEN id % 23 = 0 THEN NULL WHEN id % 29 = 0 THEN '{{bad' ELSE concat('[\"x\",\"', CASE WHEN {turn} = 1 THEN {word} ELSE '' END, '\"]') END"
    return A.videos(spark, sf_dir).withColumn("title", F.expr(f"CASE WHEN {turn} = 0 THEN concat(title, ' ', {word}) ELSE title END")).withColumn("content_tags", F.expr(tags))


@query(V + EXCLUSIONS_SQL + "SELECT id, reason FROM r")
def exclusion_reason(spark, sf_dir):
    return said(spark, sf_dir).select("id", T.exclusion_reason(F.col("title"), F.col("content_tags")).alias("reason"))


@query(V + EXCLUSIONS_SQL + "SELECT split_part(reason, ':', 1) AS category, source_platform, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1, 2")
def exclusion_report(spark, sf_dir):
    v = said(spark, sf_dir).withColumn("reason", T.exclusion_reason(F.col("title"), F.col("content_tags"))).where("reason IS NOT NULL")
    return v.groupBy(F.split_part("reason", F.lit(":"), F.lit(1)).alias("category"), "source_platform").agg(F.count("*").alias("n"))


@query(V + EXCLUSIONS_SQL + "SELECT id, music_only, face_only, face_title, tutorial FROM r")
def tag_rules(spark, sf_dir):
    tags = F.coalesce(F.from_json("content_tags", "array<string>"), F.array(F.col("content_tags")))
    tags = F.filter(tags, lambda t: t.isNotNull())
    return said(spark, sf_dir).select(
        "id", T.tag_rule(tags, T.MUSIC_TAGS, T.TOOL_TAGS).alias("music_only"), T.tag_rule(tags, T.FACE_TAGS, T.TOOL_TAGS).alias("face_only"),
        T.any_term(F.lower("title"), T.FACE_TERMS).alias("face_title"), T.tags_any(tags, T.TUTORIAL_TAG_TERMS).alias("tutorial"),
    )


NAMES = ["sora", "Sora 1", "veo-3", "VEO 2", "kling 1.6", "Kling 2.1", "可灵2.1", "gen-3", "Runway", "svd", "wan 2.1", "MiniMax", "none"]
NAMED = "CASE d.doc_id % 13 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(NAMES)) + " END"


@query(
    f"WITH t AS (SELECT doc_id AS id, concat({NAMED.replace('d.', '')}, ' ', regexp_replace(substr(text, 1, 40), '[^ -~]', ' ', 'g')) AS title FROM documents)"
    " SELECT id, CASE " + " ".join(f"WHEN regexp_matches(title, '(?i){p}') THEN '{n}'" for p, n in T.GENERATOR_PATTERNS) + " END AS generator FROM t"
)
def extract_generator(spark, sf_dir):
    title = F.concat(F.expr(NAMED), F.lit(" "), F.regexp_replace(F.substring("text", 1, 40), "[^ -~]", " "))
    return A.table(spark, sf_dir, "documents").alias("d").select(F.col("doc_id").alias("id"), T.generator(title).alias("generator"))


CLOCK = "CASE id % 5 WHEN 0 THEN CAST(id AS STRING) WHEN 1 THEN concat(CAST(id AS STRING), ':05') WHEN 2 THEN concat('1:', CAST(id % 60 AS STRING), ':05') WHEN 3 THEN 'a:b' END"


@query(
    f"WITH t AS (SELECT id, {CLOCK} AS s FROM (SELECT doc_id AS id FROM documents)), p AS (SELECT *, string_split(s, ':') AS x FROM t) SELECT id, CASE len(x) WHEN 1 THEN CASE WHEN try_cast(s AS DOUBLE) > 0 THEN try_cast(s AS DOUBLE) END"
    " WHEN 2 THEN (try_cast(x[1] AS INT) * 60 + try_cast(x[2] AS INT))::DOUBLE WHEN 3 THEN (try_cast(x[1] AS INT) * 3600 + try_cast(x[2] AS INT) * 60 + try_cast(x[3] AS INT))::DOUBLE END AS seconds FROM p"
)
def parse_duration(spark, sf_dir):
    t = A.table(spark, sf_dir, "documents").selectExpr("doc_id AS id").withColumn("s", F.expr(CLOCK))
    return t.select("id", T.duration_seconds(F.col("s")).alias("seconds"))


@query("SELECT page_id, lower(split_part(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '/', 1)) AS domain, substr(sha1(url), 1, 16) AS source_id FROM pages")
def page_domain(spark, sf_dir):
    return A.table(spark, sf_dir, "pages").select("page_id", T.domain(F.col("url")).alias("domain"), F.substring(F.sha1("url"), 1, 16).alias("source_id"))


@query(
    "WITH x AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS url FROM pages) SELECT url, min(page_id) AS first_page, count(DISTINCT page_id) AS n_pages FROM x GROUP BY 1"
)
def page_links(spark, sf_dir):
    links = A.table(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))).alias("url"))
    return links.groupBy("url").agg(F.min("page_id").alias("first_page"), F.count("*").alias("n_pages"))


# Pages and queues


@query(V + " SELECT id, title, duration_sec, CAST(row_number() OVER (ORDER BY created_at DESC NULLS LAST, id) AS INTEGER) AS pos FROM v_videos WHERE status <> 'excluded' AND label = 'fake' QUALIFY pos BETWEEN 21 AND 40")
def list_videos_page(spark, sf_dir):
    rows = curation.page(curation.listed(A.videos(spark, sf_dir), label="fake"), "created_at", True, 2, 20)
    return rows.select("id", "title", "duration_sec", "pos")


@query(V + " SELECT id, title FROM v_videos WHERE status = 'reviewed' AND (title ILIKE '%the%' OR source_id ILIKE '%the%') AND duration_sec >= 10")
def search_videos(spark, sf_dir):
    return curation.listed(A.videos(spark, sf_dir), status="reviewed", q="the", shortest=10).select("id", "title")


SHOWCASE_TIER_SQL = (
    "CASE WHEN featured_at IS NOT NULL THEN 0 WHEN " + terms_sql("lower(title)", T.CARTOON_TERMS) + " IS NOT NULL OR " + terms_sql("lower(coalesce(content_tags, ''))", T.CARTOON_TERMS)
    + " IS NOT NULL THEN 3 WHEN claimed_generator IN (" + ", ".join(f"'{x}'" for x in T.TOP_GENERATORS) + ") THEN 1 WHEN claimed_generator IN (" + ", ".join(f"'{x}'" for x in T.BOTTOM_GENERATORS) + ") THEN 3 ELSE 2 END"
)


@query(
    V + f", s AS (SELECT id, {SHOWCASE_TIER_SQL} AS tier, featured_at, published_at, crawled_at FROM v_videos WHERE status <> 'excluded')"
    " SELECT id, tier, CAST(row_number() OVER (ORDER BY tier, featured_at DESC NULLS LAST, published_at DESC NULLS LAST, crawled_at DESC NULLS LAST, id) AS INTEGER) AS pos FROM s QUALIFY pos <= 50"
)
def showcase_page(spark, sf_dir):
    return curation.showcase(A.videos(spark, sf_dir), 50).select("id", "tier", "pos")


@query(V + " SELECT id, crawled_at FROM v_videos WHERE status <> 'excluded' AND blob_url IS NULL AND duplicate_of_id IS NULL AND caption_model IS NULL ORDER BY crawled_at NULLS FIRST, id LIMIT 30")
def pending(spark, sf_dir):
    return curation.pending(A.videos(spark, sf_dir), 30).select("id", "crawled_at")


@query(VR + " SELECT id FROM v_videos WHERE status <> 'excluded' AND id NOT IN (SELECT video_id FROM v_reviews) ORDER BY created_at NULLS FIRST, id LIMIT 1")
def next_review(spark, sf_dir):
    left = curation.unreviewed(A.videos(spark, sf_dir).where("status <> 'excluded'"), A.reviews(spark, sf_dir))
    return left.orderBy(F.col("created_at").asc_nulls_first(), "id").limit(1).select("id")


@query(
    V + ", p AS (SELECT source_platform, count(*) AS wanted FROM v_videos GROUP BY 1), q AS (SELECT *, sum(wanted) OVER (ORDER BY source_platform) AS upto FROM p)"
    " SELECT source_platform, CAST(greatest(0, least(wanted, 100 - (upto - wanted))) AS BIGINT) AS take FROM q"
)
def run_budget(spark, sf_dir):
    """How many rows each platform may add to a run of a hundred, in order of platforms."""
    p = A.videos(spark, sf_dir).groupBy("source_platform").agg(F.count("*").alias("wanted"))  # one row a platform
    upto = F.sum("wanted").over(Window.orderBy("source_platform"))
    return p.select("source_platform", F.greatest(F.lit(0), F.least("wanted", 100 - (upto - F.col("wanted")))).cast("bigint").alias("take"))


# Merges

BATCH = "CASE WHEN id % 3 = 0 THEN NULL ELSE concat('new ', title) END"


@query(
    V + f", o AS (SELECT id, title, published_at, status FROM v_videos WHERE id % 5 < 4), n AS (SELECT id, {BATCH} AS title, CASE WHEN id % 4 = 0 THEN published_at END AS published_at,"
    " CASE WHEN status IN ('filtered', 'excluded') THEN status ELSE 'filtered' END AS status FROM v_videos WHERE id % 5 IN (0, 1, 4))"
    " SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.title ELSE o.title END AS title, coalesce(n.published_at, o.published_at) AS published_at,"
    " CASE WHEN o.id IS NOT NULL THEN o.status ELSE n.status END AS status, CASE WHEN o.id IS NULL THEN 'inserted' WHEN n.id IS NOT NULL THEN 'updated' ELSE 'kept' END AS action"
    " FROM o FULL JOIN n ON o.id = n.id"
)
def import_upsert(spark, sf_dir):
    v = A.videos(spark, sf_dir).select("id", "title", "published_at", "status")
    new = v.where("id % 5 IN (0, 1, 4)").select(
        "id", F.expr(BATCH).alias("title"), F.expr("CASE WHEN id % 4 = 0 THEN published_at END").alias("published_at"),
        F.expr("CASE WHEN status IN ('filtered', 'excluded') THEN status ELSE 'filtered' END").alias("status"), F.col("id").alias("seq"),
    )
    return curation.upsert(v.where("id % 5 < 4"), new, ["id"], ["title"], ["published_at"], ["status"])


@query(V + " SELECT id, CASE WHEN id % 7 = 0 THEN 'patched' ELSE caption_model END AS caption_model, status FROM v_videos")
def patch_processed(spark, sf_dir):
    v = A.videos(spark, sf_dir).select("id", "caption_model", "status")
    return curation.patched(v, v.where("id % 7 = 0").select("id", F.lit("patched").alias("caption_model")), "id", ["caption_model"])


@query(V + " SELECT id, CASE WHEN duplicate_of_id % 10 <> 3 THEN duplicate_of_id END AS duplicate_of_id FROM v_videos WHERE id % 10 <> 3")
def delete_cascade(spark, sf_dir):
    v = A.videos(spark, sf_dir).select("id", "duplicate_of_id")
    return curation.without_videos(v, v.where("id % 10 = 3"))


@query(V + " SELECT CASE WHEN id % 10 = 7 THEN 'errata' ELSE 'manifest' END AS part, count(*) AS n FROM v_videos GROUP BY 1")
def opt_out(spark, sf_dir):
    v = A.videos(spark, sf_dir).select("id")
    gone = v.where("id % 10 = 7")
    left = v.join(gone, "id", "left_anti").select(F.lit("manifest").alias("part"))
    return left.union(gone.select(F.lit("errata"))).groupBy("part").agg(F.count("*").alias("n"))


@query("WITH f AS (SELECT page_id, url FROM pages) SELECT count(*) AS total, count(*) FILTER (page_id % 3 = 0) AS already, count(*) FILTER (page_id % 3 <> 0) AS added FROM f")
def resume_scores(spark, sf_dir):
    rows = A.table(spark, sf_dir, "pages").select("page_id")
    done = rows.where("page_id % 3 = 0")
    new = rows.join(done, "page_id", "left_anti").select(F.lit(1).alias("new"))
    return done.select(F.lit(0).alias("new")).union(new).agg(F.count("*").alias("total"), F.count_if(F.col("new") == 0).alias("already"), F.count_if(F.col("new") == 1).alias("added"))


# Slices

START, END = "2024-02-01", "2024-03-01"
FROZEN = (
    VR + ", d AS (SELECT video_id, arg_max(decision, review_no) AS decision FROM v_reviews GROUP BY 1), z AS (SELECT v.*, decision FROM v_videos v JOIN d ON d.video_id = v.id"
    f" WHERE coalesce(published_at, crawled_at) >= TIMESTAMP '{START}' AND coalesce(published_at, crawled_at) < TIMESTAMP '{END}' AND duplicate_of_id IS NULL AND status = 'reviewed')"
)


@query(FROZEN + " SELECT id, decision, coalesce(published_at, crawled_at) AS at FROM z")
def freeze_window(spark, sf_dir):
    z = curation.frozen(A.videos(spark, sf_dir), A.reviews(spark, sf_dir), START, END)
    return z.select("id", "decision", F.coalesce("published_at", "crawled_at").alias("at"))


@query(
    FROZEN + " SELECT 'decision' AS kind, decision AS name, count(*) AS n FROM z GROUP BY 2 UNION ALL SELECT 'platform', source_platform, count(*) FROM z WHERE decision = 'approved' GROUP BY 2"
    " UNION ALL SELECT 'generator', coalesce(nullif(claimed_generator, ''), 'unknown'), count(*) FROM z WHERE decision = 'approved' GROUP BY 2"
)
def slice_histograms(spark, sf_dir):
    return curation.slice_counts(curation.frozen(A.videos(spark, sf_dir), A.reviews(spark, sf_dir), START, END))


@query(
    FROZEN + " SELECT '2024.02' AS version, id, source_platform, source_id, label, coalesce(nullif(claimed_generator, ''), 'unknown') AS claimed_generator, decision, blob_url, 'unknown' AS source_license FROM z"
)
def manifest_rows(spark, sf_dir):
    return curation.manifest_rows(curation.frozen(A.videos(spark, sf_dir), A.reviews(spark, sf_dir), START, END), "2024.02")


@query(V + ", s AS (SELECT id, label, source_platform, row_number() OVER (PARTITION BY label, source_platform ORDER BY md5(concat('s1', CAST(id AS STRING))), id) AS p,"
       " greatest(1, round(count(*) OVER (PARTITION BY label, source_platform) * 0.2e0)) AS n FROM v_videos) SELECT id, CASE WHEN p <= n THEN 'test' ELSE 'train' END AS split FROM s")  # fmt: skip
def stratified_split(spark, sf_dir):
    return vectors.stratified_split(A.videos(with_checkpoints(spark), sf_dir), ["label", "source_platform"], 0.2, "s1").select("id", "split")


# Vectors and clusters


@query(
    f"WITH {A.PLANTED_SQL}, s AS (SELECT q.id AS query_id, x.id, list_sum(list_transform(list_zip(q.features, x.features), lambda p: p[1] * p[2])) AS sim FROM v_planted q JOIN v_planted x ON q.id <> x.id WHERE q.id % 20 = 0),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, id) AS rank FROM s) SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(sim, 6) AS sim FROM r WHERE rank <= 5"
)
def knn_topk(spark, sf_dir):
    rows = A.planted(spark, sf_dir)
    found = vectors.nearest(rows.where("id % 20 = 0"), rows, 5)
    return found.select("query_id", "rank", "id", F.round("sim", 6).alias("sim"))


@query(
    f"WITH {A.PHASH_SQL}, n AS (SELECT hash, min(id) AS id FROM v_phash GROUP BY 1) SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.hash, b.hash)) AS INTEGER) AS distance"
    " FROM n a JOIN n b ON a.id < b.id WHERE bit_count(xor(a.hash, b.hash)) <= 6"
)
def hamming_pairs(spark, sf_dir):
    return vectors.hamming_pairs(A.phash(spark, sf_dir).select("id", "hash"))


@query(
    f"WITH {A.PHASH_SQL}, n AS (SELECT hash, min(id) AS id FROM v_phash GROUP BY 1), h AS (SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON a.id < b.id WHERE bit_count(xor(a.hash, b.hash)) <= 6)"
    " SELECT h.a, h.b, round(list_sum(list_transform(list_zip(x.features, y.features), lambda p: p[1] * p[2]))"
    " / sqrt(list_sum(list_transform(x.features, lambda e: e * e)) * list_sum(list_transform(y.features, lambda e: e * e))), 6) AS cosine FROM h JOIN v_planted x ON x.id = a JOIN v_planted y ON y.id = b"
)
def similar_pairs(spark, sf_dir):
    f = A.planted(spark, sf_dir)
    pairs = vectors.hamming_pairs(A.phash(spark, sf_dir).select("id", "hash")).drop("distance")
    both = pairs.join(f.select(F.col("id").alias("a"), F.col("features").alias("x")), "a").join(f.select(F.col("id").alias("b"), F.col("features").alias("y")), "b")
    cosine = vectors.dot("x", "y") / F.sqrt(vectors.dot("x", "x") * vectors.dot("y", "y"))
    return both.select("a", "b", F.round(cosine, 6).alias("cosine"))


@query(
    V + ", d AS (SELECT duplicate_of_id AS canonical, source_platform AS p FROM v_videos WHERE duplicate_of_id IS NOT NULL), k AS (SELECT canonical, count(*) + 1 AS member_count FROM d GROUP BY 1),"
    " u AS (SELECT canonical, p FROM d UNION SELECT id, source_platform FROM v_videos) SELECT k.canonical, k.member_count, CAST(count(DISTINCT p) AS INTEGER) AS n_platforms FROM k JOIN u USING (canonical) GROUP BY 1, 2"
)
def clusters(spark, sf_dir):
    return vectors.clusters(A.videos(spark, sf_dir))


@query(
    V + ", g AS (SELECT *, coalesce(duplicate_of_id, id) AS grp FROM v_videos), r AS (SELECT grp, id, row_number() OVER (PARTITION BY grp ORDER BY coalesce(CAST(resolution_w AS BIGINT) * resolution_h, 0) DESC, coalesce(fps, 0) DESC,"
    " coalesce(duration_sec, 0) DESC, crawled_at ASC NULLS LAST, id) AS p FROM g) SELECT grp AS cluster, id AS canonical FROM r WHERE p = 1"
)
def canonical_pick(spark, sf_dir):
    v = A.videos(spark, sf_dir).withColumn("cluster", F.coalesce("duplicate_of_id", "id"))
    return vectors.canonical(v, "cluster").select("cluster", F.col("id").alias("canonical"))


@query(
    f"WITH {A.PLANTED_SQL}, a AS (SELECT (id % 1000000) % 12 AS cluster, coalesce(generator, 'none') AS g FROM v_planted), c AS (SELECT cluster, g, count(*) AS n FROM a GROUP BY 1, 2),"
    " b AS (SELECT cluster, max(n) AS best, sum(n) AS n FROM c GROUP BY 1) SELECT sum(best)::DOUBLE / sum(n)::DOUBLE AS purity, CAST(sum(n) AS BIGINT) AS n FROM b"
)
def purity(spark, sf_dir):
    rows = A.planted(spark, sf_dir).select((F.col("id") % 1000000 % 12).alias("cluster"), F.coalesce("generator", F.lit("none")).alias("g"))
    return vectors.purity(rows, "cluster", "g")


LINEAR = "0.5e0 * features[{0}] - 0.25e0 * features[{1}] + 0.125e0"


@query(f"WITH {A.PLANTED_SQL} SELECT id, round(1e0 / (1e0 + exp(-({LINEAR.format(1, 2)}))), 9) AS score FROM v_planted")
def linear_score(spark, sf_dir):
    """Fusion of two components with fixed weights, as a probability."""
    return A.planted(spark, sf_dir).select("id", F.round(F.expr(f"1e0 / (1e0 + exp(-({LINEAR.format(0, 1)})))"), 9).alias("score"))


# Streams


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = windows_of(e, "1 day")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(V + " SELECT date_trunc('month', coalesce(published_at, crawled_at)) AS month, count(*) AS n FROM v_videos WHERE coalesce(published_at, crawled_at) IS NOT NULL GROUP BY 1")
def month_windows(spark, sf_dir):
    at = F.date_trunc("month", F.coalesce("published_at", "crawled_at"))
    return A.videos(spark, sf_dir).groupBy(at.cast("timestamp_ntz").alias("month")).agg(F.count("*").alias("n")).where("month IS NOT NULL")
