"""Registered queries about harvested items, upkeep of the tables, and slices of scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kelpline.operators import crawl, curation, metrics
from kelpline.plans.evaluation import SCORED, auroc_sql, scored
from kelpline.plans.records import records
from kelpline.sources import adapters as A

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

# Harvested items

#: Uploads: a phrase before the text or none, a disclosure, a listed channel, a date.
UPLOAD = {
    "id": "doc_id",
    "said": "concat(CASE doc_id % 9 WHEN 0 THEN 'Made with SORA ' WHEN 1 THEN 'a #AIvideo ' WHEN 2 THEN 'AI生成 ' ELSE '' END, text)",
    "disclosed": "doc_id % 6 = 0",
    "listed": "doc_id % 4 = 1",
    "day": "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE concat('202401', substr(CAST(100 + doc_id % 28 + 1 AS STRING), 2, 2)) END",
}


@query(
    "WITH u AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in UPLOAD.items()) + " FROM documents), k AS (SELECT id, day, CASE WHEN disclosed THEN 'tier2_platform_tag' WHEN listed THEN 'tier2_channel_whitelist'"
    " WHEN contains(lower(said), 'made with sora') OR contains(lower(said), '#aivideo') OR contains(said, 'AI生成') OR contains(said, 'ai生成') OR contains(lower(said), 'aigc') THEN 'tier3_llm' END AS label_source FROM u)"
    " SELECT id, label_source, substr(day, 1, 4) || '-' || substr(day, 5, 2) || '-' || substr(day, 7, 2) AS published_at FROM k WHERE label_source IS NOT NULL"
)
def upload_records(spark, sf_dir):
    """Uploads that count as generated, and why, with their dates in ISO form; whole texts are looked through."""
    u = A.table(spark, sf_dir, "documents").select(*[F.expr(e).alias(n) for n, e in UPLOAD.items()])
    date = F.concat_ws("-", F.substring("day", 1, 4), F.substring("day", 5, 2), F.substring("day", 7, 2))
    why = crawl.channel_label_source(F.col("disclosed"), F.col("listed"), F.col("said"))
    return u.select("id", why.alias("label_source"), F.when(F.length("day") == 8, date).alias("published_at")).where("label_source IS NOT NULL")


@query(
    "WITH c AS (SELECT page_id, url AS page_url, concat('https://cdn.ex.org/', split_part(url, '/', 3), '.mp4') AS cdn_url FROM pages)"
    " SELECT substr(sha1(cdn_url), 1, 16) AS source_id, cdn_url AS source_url, arg_min(page_url, page_id) AS page_url, count(*) AS n_pages FROM c GROUP BY cdn_url"
)
def gallery_records(spark, sf_dir):
    """One record for each clip of a gallery; a host's pages show one clip here."""
    clip = F.concat(F.lit("https://cdn.ex.org/"), F.split_part("url", F.lit("/"), F.lit(3)), F.lit(".mp4"))
    return crawl.gallery_records(A.table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("page_url"), clip.alias("cdn_url")))


@query(
    "WITH c AS (SELECT doc_id AS id, doc_id % 50 AS a, doc_id % 50 + n_chars % 90 AS b, md5(concat('42:', CAST(doc_id AS VARCHAR))) AS o FROM documents), s AS (SELECT * FROM c ORDER BY o, id LIMIT 600)"
    " SELECT id, CAST(b - a AS DOUBLE) AS duration_sec FROM s WHERE b - a BETWEEN 3 AND 60 ORDER BY o, id LIMIT 200"
)
def clip_sample(spark, sf_dir):
    """A sample of clips by a seed (the sampling is the feature)."""
    clips = A.table(spark, sf_dir, "documents").selectExpr("doc_id AS id", "doc_id % 50 AS start_sec", "doc_id % 50 + n_chars % 90 AS end_sec")
    return crawl.clip_sample(clips, 200, 3, 60, 42).select("id", "duration_sec")


@query(
    "WITH f AS (SELECT doc_id AS id, i, CASE WHEN (doc_id + i) % 7 = 0 THEN NULL ELSE (doc_id * i) % 5 * 270 END AS height, CASE WHEN (doc_id + i) % 3 = 0 THEN 'image/gif' ELSE 'video/mp4' END AS file_type,"
    " concat('https://ex.org/', CAST(doc_id AS VARCHAR), '/', CAST(i AS VARCHAR)) AS link FROM documents, (SELECT unnest([1, 2, 3, 4]) AS i) WHERE i <= doc_id % 5),"
    " b AS (SELECT id, link, row_number() OVER (PARTITION BY id ORDER BY coalesce(height, 0) DESC, i DESC) AS n FROM f WHERE coalesce(height, 0) <= 720 AND file_type LIKE 'video/%')"
    " SELECT d.doc_id AS id, coalesce(b.link, f.link) AS link FROM documents d LEFT JOIN b ON b.id = d.doc_id AND n = 1 LEFT JOIN f ON f.id = d.doc_id AND f.i = 1"
)
def best_files(spark, sf_dir):
    """Of the files of an item the one to load; an item without files has none."""
    files = (
        "transform(slice(array(1, 2, 3, 4), 1, CAST(doc_id % 5 AS INT)), i -> named_struct('link', concat('https://ex.org/', CAST(doc_id AS STRING), '/', CAST(i AS STRING)),"
        " 'height', CASE WHEN (doc_id + i) % 7 = 0 THEN NULL ELSE CAST((doc_id * i) % 5 * 270 AS INT) END, 'file_type', CASE WHEN (doc_id + i) % 3 = 0 THEN 'image/gif' ELSE 'video/mp4' END))"
    )
    return A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.expr(files).alias("files")).select("id", crawl.best_file(F.col("files")).alias("link"))


#: Items of two lists of one platform as JSON.
ITEM = (
    "CASE WHEN doc_id % 2 = 0 THEN concat('{\"bvid\":\"BV', CAST(doc_id AS STRING), '\",\"title\":\"<em class=x>', source, '</em> &amp; ', lang, '\",\"tag\":\"', lang, '\",\"duration\":\"', CAST(doc_id % 9 AS STRING), ':05\",\"mid\":', CAST(doc_id % 13 AS STRING),"
    " ',\"author\":\"', source, '\",\"play\":', CAST(n_chars AS STRING), '}')"
    " ELSE concat('{\"title\":\"', lang, '\",\"desc\":\"', source, '\",\"duration\":', CAST(doc_id % 70 AS STRING), ',\"pubdate\":', CAST(1700000000 + doc_id AS STRING), ',\"tid\":', CAST(doc_id % 5 AS STRING), ',\"tname\":\"t\",\"owner\":{\"mid\":', CAST(doc_id % 13 AS STRING),"
    " ',\"name\":\"', source, '\"},\"stat\":{\"view\":', CAST(n_chars AS STRING), '}}') END"
)


@query(
    "SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN concat('BV', CAST(doc_id AS VARCHAR)) ELSE '' END AS bvid, CASE WHEN doc_id % 2 = 0 THEN concat(source, ' & ', lang) ELSE lang END AS title,"
    " CASE WHEN doc_id % 2 = 0 THEN '' ELSE source END AS description, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS tag_str,"
    " CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id % 9 * 60 + 5 AS DOUBLE) WHEN doc_id % 70 > 0 THEN CAST(doc_id % 70 AS DOUBLE) END AS duration_sec,"
    " CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1700000000 + doc_id END AS pubdate, CAST(doc_id % 13 AS VARCHAR) AS mid, source AS author, CASE WHEN doc_id % 2 = 1 THEN 't' END AS typename, CAST(n_chars AS VARCHAR) AS play,"
    " CASE WHEN doc_id % 2 = 0 THEN 'search' ELSE concat('newlist:rid=', CAST(doc_id % 5 AS VARCHAR)) END AS source FROM documents"
)
def list_items(spark, sf_dir):
    """Items of a search and of a list of newest uploads in one form."""
    raw = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.expr(ITEM).alias("raw"))
    one, two = crawl.search_item(F.col("raw")), crawl.newest_item(F.col("raw"))
    return raw.select("id", *[F.when(F.col("id") % 2 == 0, one[n]).otherwise(two[n]).alias(n) for n in one])


# Upkeep


@query(V + " SELECT id, source_platform, substr(blob_url, 8) AS local_path FROM v_videos WHERE duplicate_of_id IS NULL AND blob_url LIKE 'file://%' AND source_platform = 'bilibili'")
def benchmark_rows(spark, sf_dir):
    return curation.benchmark_rows(A.videos(spark, sf_dir), "bilibili").select("id", "source_platform", "local_path")


PARSED = "CASE WHEN json_valid(content_tags) THEN array_to_string(from_json(content_tags, '[\"VARCHAR\"]'), '|') END"


@query(V + f" SELECT id, source_id, source_platform, coalesce(title, '') AS title, '' AS description, label_source, claimed_generator, coalesce({PARSED}, '') AS content_tags, resolution_w, resolution_h, duration_sec, file_size_bytes FROM v_videos")
def filter_rows(spark, sf_dir):
    """What the filters are given of a video: no missing title or tags."""
    tags = F.coalesce(F.array_join(F.from_json("content_tags", "array<string>"), "|"), F.lit(""))
    v = A.videos(spark, sf_dir)
    return v.select(
        "id", "source_id", "source_platform", F.coalesce("title", F.lit("")).alias("title"), F.lit("").alias("description"), "label_source", "claimed_generator",
        tags.alias("content_tags"), "resolution_w", "resolution_h", "duration_sec", "file_size_bytes",
    )


@query(
    V + f" SELECT source_platform, source_id, title, label, label_source, claimed_generator, duration_sec, fps, {PARSED} AS content_tags, strftime(published_at, '%Y-%m-%dT%H:%M:%S') AS published_at, 'filtered' AS status,"
    " CASE WHEN id % 3 = 0 THEN to_base64(encode(title)) END AS thumbnail_b64 FROM v_videos"
)
def push_payloads(spark, sf_dir):
    """What a video is pushed with; pictures, here the bytes of titles, go as base64."""
    v = A.videos(spark, sf_dir)
    joined = records(v).select("id", "published_at", F.array_join("content_tags", "|").alias("content_tags"))
    picture = F.when(F.col("id") % 3 == 0, F.translate(F.base64(F.encode("title", "utf-8")), "\r\n", ""))
    rows = v.drop("published_at", "content_tags").join(joined, "id")
    return rows.select("source_platform", "source_id", "title", "label", "label_source", "claimed_generator", "duration_sec", "fps", "content_tags", "published_at", F.lit("filtered").alias("status"), picture.alias("thumbnail_b64"))


#: Names that reports show.
PLATFORM_NAMES = {"bilibili": "Bilibili", "reddit": "Reddit", "youtube": "YouTube", "showcase": "Showcase"}


@query(V + " SELECT CASE source_platform WHEN 'bilibili' THEN 'Bilibili' WHEN 'reddit' THEN 'Reddit' WHEN 'youtube' THEN 'YouTube' WHEN 'showcase' THEN 'Showcase' ELSE source_platform END AS platform, count(*) AS n FROM v_videos GROUP BY 1")
def platform_names(spark, sf_dir):
    names = F.create_map(*[F.lit(x) for pair in PLATFORM_NAMES.items() for x in pair])
    shown = F.coalesce(F.try_element_at(names, "source_platform"), "source_platform")
    return A.videos(spark, sf_dir).groupBy(shown.alias("platform")).agg(F.count("*").alias("n"))


RUN = "CASE o_orderstatus WHEN 'O' THEN 'done' WHEN 'P' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'running' ELSE 'cancelling' END ELSE 'failed' END"


@query(f"WITH r AS (SELECT o_orderkey AS id, o_custkey AS owner, {RUN} AS status FROM orders) SELECT owner, min(id) FILTER (status IN ('running', 'cancelling')) AS active_id, count(*) FILTER (status IN ('running', 'cancelling')) = 0 AS allowed FROM r GROUP BY 1")
def run_guard(spark, sf_dir):
    """Whether an owner may start a run, and the run that keeps it from that; runs are made of orders."""
    return curation.may_start(A.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_custkey AS owner", f"{RUN} AS status"), "owner")


@query(V + ", k AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY id % 3 = 0, crawled_at NULLS FIRST, id) AS n, first_value(id) OVER (PARTITION BY source_id ORDER BY id % 3 = 0, crawled_at NULLS FIRST, id) AS f FROM v_videos) SELECT id, CASE WHEN id % 3 = 0 THEN CASE WHEN n > 1 THEN f END ELSE duplicate_of_id END AS duplicate_of_id FROM k")
def recompute_dedup(spark, sf_dir):
    return curation.recomputed(A.videos(spark, sf_dir), F.expr("id % 3 = 0"))


@query(
    "WITH b AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings WHERE vec_id % 10 <> 9), u AS (SELECT vec_id, -CAST(embedding[1] AS DOUBLE) AS x FROM embeddings WHERE vec_id % 10 IN (8, 9))"
    " SELECT coalesce(u.vec_id, b.vec_id) AS id, CASE WHEN u.vec_id IS NOT NULL THEN u.x ELSE b.x END AS x FROM b FULL JOIN u ON u.vec_id = b.vec_id WHERE coalesce(u.vec_id, b.vec_id) % 7 <> 0"
)
def vector_upsert(spark, sf_dir):
    """Vectors after a batch replaced or added some and others were deleted."""
    e = A.table(spark, sf_dir, "embeddings").selectExpr("vec_id AS id", "CAST(embedding[0] AS DOUBLE) AS x")
    batch = e.where("id % 10 IN (8, 9)").selectExpr("id", "-x AS x")
    return e.where("id % 10 <> 9").join(batch, "id", "left_anti").union(batch).join(e.where("id % 7 = 0").select("id"), "id", "left_anti")


@query(V + ", g AS (SELECT coalesce(caption_model, 'none') AS caption_model, label_source AS embedding_model, min(crawled_at) AS created_at FROM v_videos WHERE label_source IS NOT NULL GROUP BY 1, 2), e AS (SELECT caption_model, embedding_model, TIMESTAMP '2023-01-01' AS created_at FROM g WHERE embedding_model = 'bogus') SELECT * FROM e UNION ALL SELECT * FROM g WHERE embedding_model <> 'bogus'")
def model_generations(spark, sf_dir):
    """Pairs of models as first seen; those that were registered before keep their time."""
    v = A.videos(spark, sf_dir).where("label_source IS NOT NULL")
    batch = v.select(F.coalesce("caption_model", F.lit("none")).alias("caption_model"), F.col("label_source").alias("embedding_model"), F.col("crawled_at").alias("created_at"))
    before = batch.where("embedding_model = 'bogus'").select("caption_model", "embedding_model", F.expr("TIMESTAMP_NTZ '2023-01-01' AS created_at")).distinct()
    return curation.first_inserts(before, batch, ["caption_model", "embedding_model"], "created_at")


@query(V + " SELECT id, CASE WHEN published_at IS NULL AND source_platform IN ('youtube', 'bilibili') AND id % 16 = 0 THEN created_at ELSE published_at END AS published_at FROM v_videos")
def backfill_published(spark, sf_dir):
    """Publication times where they were missing, of platforms that could be asked, from a table of answers."""
    v = A.videos(spark, sf_dir).select("id", "source_platform", "published_at", "created_at")
    answers = A.table(spark, sf_dir, "events").where("event_id % 16 = 0").selectExpr("event_id AS id", "ts AS published_at")
    return curation.backfilled(v, answers, ["youtube", "bilibili"]).select("id", "published_at")


@query(
    VR + ", f AS (SELECT video_id, min(review_no) AS review_no FROM v_reviews GROUP BY 1), k AS (SELECT id, date_trunc('month', published_at)::TIMESTAMP AS month, crawled_at + INTERVAL 10 DAY AS reviewed_at FROM v_videos JOIN f ON video_id = id WHERE duplicate_of_id IS NULL AND published_at IS NOT NULL)"
    " SELECT month, CASE WHEN reviewed_at < month + INTERVAL 60 DAY THEN 'sliced' ELSE 'late' END AS fate, count(*) AS n FROM k GROUP BY 1, 2"
)
def closed_windows(spark, sf_dir):
    """Reviewed rows by month: in the slice, frozen 60 days after the month began, or too late for it."""
    v = A.videos(spark, sf_dir)
    reviews = A.reviews(spark, sf_dir).join(v.select(F.col("id").alias("video_id"), "crawled_at"), "video_id")
    reviews = reviews.select("video_id", F.expr("crawled_at + INTERVAL '10' DAY").alias("reviewed_at"))
    return curation.closed_window_rows(v, reviews, F.expr("month + INTERVAL '60' DAY")).groupBy("month", "fate").agg(F.count("*").alias("n"))


@query(
    "WITH s AS (SELECT vec_id, label, embedding[1:8] AS e FROM embeddings), p AS (SELECT label, CAST(list_position(e, list_max(e)) - 1 AS BIGINT) AS best, CAST(list_max(e) AS DOUBLE) / list_sum(list_transform(e, lambda x: abs(CAST(x AS DOUBLE)))) AS conf FROM s)"
    " SELECT concat('f', CAST(k.f AS VARCHAR)) AS family, count(*) FILTER (label = k.f) AS n_labelled, count(*) FILTER (label >= 8 AND best = k.f AND conf >= 0.4) AS n_added FROM p JOIN (SELECT CAST(unnest(range(8)) AS BIGINT) AS f) k ON k.f = label OR (label >= 8 AND best = k.f) GROUP BY 1 HAVING count(*) FILTER (label = k.f) > 0"
)
def pseudo_labels(spark, sf_dir):
    """Pools of families: labelled rows, and rows without a label that a rule is sure of, for families with labelled rows."""
    e = A.table(spark, sf_dir, "embeddings").select("label", F.slice("embedding", 1, 8).alias("e"))
    best = F.array_position("e", F.array_max("e")) - 1
    total = F.aggregate("e", F.lit(0e0), lambda a, x: a + F.abs(x.cast("double")))
    sure = F.array_max("e").cast("double") / total >= 0.4
    family = F.when(F.col("label") < 8, F.col("label").cast("bigint")).when(sure, best.cast("bigint"))
    n = e.select(family.alias("f"), (F.col("label") < 8).alias("known")).where("f IS NOT NULL").groupBy("f")
    n = n.agg(F.count_if("known").alias("n_labelled"), F.count_if(~F.col("known")).alias("n_added")).where("n_labelled > 0")
    return n.select(F.concat(F.lit("f"), F.col("f").cast("string")).alias("family"), "n_labelled", "n_added")


# Slices of scores

S = f"WITH {A.SCORES_SQL}"


@query(
    S + ", o AS (SELECT detector, label, coalesce(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY detector ORDER BY score DESC, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM v_scores)"
    " SELECT detector, count(*) FILTER (label = 1) AS n_fake, count(*) FILTER (label = 0) AS n_real, CAST(sum(before) FILTER (label = 0) AS DOUBLE) / CAST(count(*) FILTER (label = 1) * count(*) FILTER (label = 0) AS DOUBLE) AS auroc FROM o GROUP BY 1"
)
def auroc_stable(spark, sf_dir):
    """AUROC by detector, equal scores in the order of rows."""
    return metrics.auroc_stable(A.scores(spark, sf_dir), ["detector"])


#: CTEs after f (detector, slice, pool, score of fakes): their table as slices_against_reals gives it.
AGAINST = (
    "q AS (SELECT detector, quantile_cont(score, 0.95) AS cut FROM x WHERE label = 0 GROUP BY 1), g AS (SELECT detector, source_platform AS pool, score FROM x WHERE label = 0 UNION ALL SELECT detector, 'global', score FROM x WHERE label = 0),"
    " w AS (SELECT detector, pool, count(*) AS n, count(*) FILTER (score >= 0.5) AS fp FROM g GROUP BY 1, 2),"
    " k AS (SELECT f.detector, slice, pool, count(*) AS p, count(*) FILTER (score >= 0.5) AS tp, count(*) FILTER (score >= cut) AS hit FROM f JOIN q ON q.detector = f.detector GROUP BY 1, 2, 3),"
    " m AS (SELECT k.detector, slice, k.pool, (tp / p::DOUBLE + (n - fp) / n::DOUBLE) / 2 AS bacc, CASE WHEN tp > 0 THEN 2e0 * tp / (tp + fp + p) ELSE 0e0 END AS f1, hit / p::DOUBLE AS tpr5 FROM k JOIN w ON w.detector = k.detector AND w.pool = k.pool),"
    " u AS (SELECT detector, slice, pool, score, 1 AS label FROM f UNION ALL SELECT k.detector, slice, k.pool, score, 0 FROM k JOIN g ON g.detector = k.detector AND g.pool = k.pool), "
    + auroc_sql("u", "detector, slice, pool", {"auroc": 2})
)
SHOWN = " SELECT r.detector, r.slice, r.pool, n_fake, n_real, auroc, bacc, f1, tpr5 FROM r JOIN m ON m.detector = r.detector AND m.slice = r.slice AND m.pool = r.pool"


def reals_of(counts):
    """Counts of reals by score, for the pools of each platform and of all."""
    own = counts.where("nr > 0").select("detector", F.col("source_platform").alias("pool"), "score", "nr")
    both = own.union(own.select("detector", F.lit("global"), "score", "nr"))
    return both.groupBy("detector", "pool", "score").agg(F.sum("nr").alias("nr"))


def counted(spark, sf_dir):
    """Fakes and reals by detector, platform, generator and score."""
    x = scored(spark, sf_dir).withColumn("generator", F.coalesce("generator", F.lit("_unlabeled")))
    return metrics.histogram(x, ["detector", "source_platform", "generator"])


@query(
    SCORED + ", c AS (SELECT detector, source_platform, CASE WHEN count(*) FILTER (label = 0) >= 30 THEN source_platform ELSE 'global' END AS pool FROM x GROUP BY 1, 2 HAVING count(*) FILTER (label = 1) >= 30),"
    " f AS (SELECT x.detector, x.source_platform AS slice, pool, score FROM x JOIN c ON c.detector = x.detector AND c.source_platform = x.source_platform WHERE label = 1), "
    + AGAINST.replace("c AS (SELECT *", "c2 AS (SELECT *").replace("FROM c GROUP", "FROM c2 GROUP") + SHOWN
)
def platform_metrics(spark, sf_dir):
    """Of platforms with 30 fakes: metrics against their own reals, if 30, or all; the 5 % cut is that of all reals."""
    counts = counted(spark, sf_dir)
    n = counts.groupBy("detector", "source_platform").agg(F.sum("nf").alias("f"), F.sum("nr").alias("r")).where("f >= 30")
    pool = n.select("detector", "source_platform", F.when(F.col("r") >= 30, F.col("source_platform")).otherwise("global").alias("pool"))
    fakes = counts.where("nf > 0").join(pool, ["detector", "source_platform"]).groupBy("detector", F.col("source_platform").alias("slice"), "pool", "score").agg(F.sum("nf").alias("nf"))
    return metrics.slices_against_reals(fakes, reals_of(counts), "detector")


@query(
    SCORED + ", z AS (SELECT detector, source_platform, coalesce(generator, '_unlabeled') AS generator, label, score FROM x), c AS (SELECT detector, generator, count(*) AS n FROM z WHERE label = 1 GROUP BY 1, 2),"
    " d AS (SELECT detector, source_platform, count(*) FILTER (label = 1) AS n, count(*) FILTER (label = 0) AS r FROM z GROUP BY 1, 2),"
    " f AS (SELECT detector, 'overall' AS slice, 'global' AS pool, score FROM z WHERE label = 1"
    " UNION ALL SELECT z.detector, concat('platform::', z.source_platform), CASE WHEN r > 0 THEN z.source_platform ELSE 'global' END, score FROM z JOIN d ON d.detector = z.detector AND d.source_platform = z.source_platform WHERE label = 1 AND n >= 10 AND z.source_platform IN ('bilibili', 'reddit', 'youtube')"
    " UNION ALL SELECT z.detector, CASE WHEN n >= 10 THEN concat('generator::', z.generator) ELSE 'generator::Other' END, 'global', score FROM z JOIN c ON c.detector = z.detector AND c.generator = z.generator WHERE label = 1"
    " UNION ALL SELECT detector, 'crosstab::bilibili, labelled', 'bilibili', score FROM z WHERE label = 1 AND source_platform = 'bilibili' AND generator <> '_unlabeled'), "
    + AGAINST.replace("c AS (SELECT *", "c2 AS (SELECT *").replace("FROM c GROUP", "FROM c2 GROUP")
    + ", o AS (SELECT detector, string_agg(concat(generator, ':', CAST(n AS VARCHAR)), ', ' ORDER BY n DESC, generator) AS members FROM c WHERE n < 10 GROUP BY 1)"
    + SHOWN.replace("tpr5 FROM", "tpr5, CASE WHEN r.slice = 'generator::Other' THEN members END AS members FROM") + " LEFT JOIN o ON o.detector = r.detector"
)
def slice_table(spark, sf_dir):
    """Metrics of all fakes, of platforms and generators with 10 of them, of the rest of the generators as one, and of one
    platform's fakes of known generators; every slice is taken from one table of counts."""
    counts = counted(spark, sf_dir)
    fakes = counts.where("nf > 0")
    own = counts.groupBy("detector", "source_platform").agg(F.sum("nf").alias("of_platform"), F.sum("nr").alias("reals"))
    gen = fakes.groupBy("detector", "generator").agg(F.sum("nf").alias("of_generator"))
    fakes = fakes.join(own, ["detector", "source_platform"]).join(gen, ["detector", "generator"])
    piece = lambda on, name, pool: F.when(on, F.struct(name.alias("slice"), pool.alias("pool")))
    every, p, g = F.lit("global"), F.col("source_platform"), F.col("generator")
    slices = F.array(
        piece(F.lit(True), F.lit("overall"), every),
        piece((F.col("of_platform") >= 10) & p.isin("bilibili", "reddit", "youtube"), F.concat(F.lit("platform::"), p), F.when(F.col("reals") > 0, p).otherwise(every)),
        piece(F.lit(True), F.concat(F.lit("generator::"), F.when(F.col("of_generator") >= 10, g).otherwise("Other")), every),
        piece((p == "bilibili") & (g != "_unlabeled"), F.lit("crosstab::bilibili, labelled"), p),
    )
    rows = fakes.withColumn("s", F.explode(F.array_compact(slices))).groupBy("detector", "s.slice", "s.pool", "score").agg(F.sum("nf").alias("nf"))
    # Generators are few: a rest of under ten fakes each is at most one short list for each detector.
    rest = gen.where("of_generator < 10").groupBy("detector").agg(F.sort_array(F.collect_list(F.struct((-F.col("of_generator")).alias("n"), "generator"))).alias("m"))
    names = F.array_join(F.transform("m", lambda x: F.concat(x["generator"], F.lit(":"), (-x["n"]).cast("string"))), ", ")
    out = metrics.slices_against_reals(rows, reals_of(counts), "detector").join(rest.select("detector", names.alias("members")), "detector", "left")
    return out.withColumn("members", F.when(F.col("slice") == "generator::Other", F.col("members")))


@query(
    SCORED + ", y AS (SELECT detector, source_platform AS slice, score, label FROM x WHERE detector IN ('click', 'view')), " + auroc_sql("y", "detector, slice", {"auroc": 2})
    + " SELECT a.slice, a.n_fake, a.auroc AS baseline, b.auroc AS new, b.auroc - a.auroc AS delta FROM r a JOIN r b ON b.slice = a.slice AND b.detector = 'click' WHERE a.detector = 'view' AND a.n_fake >= 10"
)
def baseline_delta(spark, sf_dir):
    """AUROC of a baseline and of a newer detector by platform, and the difference."""
    hist = metrics.histogram(scored(spark, sf_dir).where("detector IN ('click', 'view')"), ["detector", "source_platform"])
    r = metrics.auroc_of_histogram(hist, ["detector", "source_platform"], {"auroc": "fakes_first"})
    base = r.where("detector = 'view' AND n_fake >= 10").select(F.col("source_platform").alias("slice"), "n_fake", F.col("auroc").alias("baseline"))
    new = r.where("detector = 'click'").select(F.col("source_platform").alias("slice"), F.col("auroc").alias("new"))
    return base.join(new, "slice").withColumn("delta", F.col("new") - F.col("baseline"))


@query(
    SCORED + ", y AS (SELECT detector, CAST(CASE WHEN video_id % 10 < 1 THEN 1 WHEN video_id % 10 < 2 THEN 2 WHEN video_id % 10 < 5 THEN 3 ELSE 4 END AS INTEGER) AS step, score, label FROM x), " + auroc_sql("y", "detector, step", {"auroc": 2})
    + ", e AS (SELECT detector, step, auroc, max(auroc) FILTER (detector = 'view') OVER (PARTITION BY step) AS base FROM r)"
    " SELECT detector, step, (auroc - base) * 100 AS closed_pp, (auroc - lag(auroc) OVER (PARTITION BY detector ORDER BY step)) * 100 AS gain_pp FROM e"
)
def gap_closed(spark, sf_dir):
    """Of each step of a series the AUROC over a baseline's and over the step before, in points."""
    step = F.expr("CASE WHEN video_id % 10 < 1 THEN 1 WHEN video_id % 10 < 2 THEN 2 WHEN video_id % 10 < 5 THEN 3 ELSE 4 END")
    r = metrics.auroc(A.scores(spark, sf_dir).withColumn("step", step), ["detector", "step"])
    base = r.where("detector = 'view'").select("step", F.col("auroc").alias("base"))
    before = F.lag("auroc").over(Window.partitionBy("detector").orderBy("step"))
    return r.withColumn("gain_pp", (F.col("auroc") - before) * 100).join(base, "step", "left").select("detector", "step", ((F.col("auroc") - F.col("base")) * 100).alias("closed_pp"), "gain_pp")
