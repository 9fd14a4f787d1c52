"""Registered queries about API records, reviews, slices of scores and single values."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kelpline.functions import text as T
from kelpline.operators import metrics, selection
from kelpline.plans.evaluation import SCORED, auroc_sql, scored
from kelpline.sources import adapters as A
from kelpline.sources.session import with_checkpoints

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
S = f"WITH {A.SCORES_SQL}"

# API records

PLAIN = (
    "id", "source_platform", "source_id", "label", "label_source", "claimed_generator", "duration_sec", "resolution_w", "resolution_h", "fps",
    "file_size_bytes", "caption_model", "duplicate_of_id", "status",
)
TIMES = ("published_at", "crawled_at", "created_at", "featured_at")
#: Fields of a record that no given table stands for are null.
ABSENT = {"label_confidence": "double", "caption_text": "string", "has_watermark": "boolean", "storage_path": "string", "thumbnail_path": "string", "thumbnail_url": "string"}
URL = "CASE WHEN {0} LIKE 'https:%' THEN concat({0}, '.mp4') ELSE concat('https://ex.org/', source_platform, '/', source_id) END"
RECORD_SQL = (
    ", record AS (SELECT " + ", ".join(PLAIN) + ", " + URL.format("blob_url") + " AS source_url, "
    + ", ".join(f"CAST(NULL AS {t.replace('string', 'VARCHAR')}) AS {n}" for n, t in ABSENT.items()) + ", "
    + ", ".join(f"strftime({t}, '%Y-%m-%dT%H:%M:%S') AS {t}" for t in TIMES)
    + ", CASE WHEN json_valid(content_tags) THEN array_to_string(from_json(content_tags, '[\"VARCHAR\"]'), '|') END AS content_tags FROM v_videos)"
)


def records(videos):
    """Videos as API records: 26 fields, times in ISO form, tags parsed (bad JSON as null)."""
    times = [F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss").alias(t) for t in TIMES]
    tags = F.from_json("content_tags", "array<string>").alias("content_tags")
    return videos.select(*PLAIN, F.expr(URL.format("blob_url")).alias("source_url"), *[F.lit(None).cast(t).alias(n) for n, t in ABSENT.items()], *times, tags)


@query(V + RECORD_SQL + " SELECT * FROM record")
def video_records(spark, sf_dir):
    return records(A.videos(spark, sf_dir)).withColumn("content_tags", F.array_join("content_tags", "|"))


@query(
    f"WITH {A.VIDEOS_SQL}, {A.SCORES_SQL}" + RECORD_SQL + ", n AS (SELECT video_id, string_agg(concat(detector, '=', CAST(CAST(round(score * 1000) AS BIGINT) AS VARCHAR)), ',' ORDER BY detector, round(score * 1000), seq) AS scores"
    " FROM v_scores GROUP BY 1) SELECT id, source_platform, published_at, scores FROM record LEFT JOIN n ON video_id = id"
)
def video_details(spark, sf_dir):
    """Records with their scores nested."""
    one = F.struct("detector", F.round(F.col("score") * 1000).cast("bigint").alias("mille"), "seq")
    nested = A.scores(spark, sf_dir).groupBy("video_id").agg(F.sort_array(F.collect_list(one)).alias("s"))
    text = F.array_join(F.transform("s", lambda x: F.concat(x["detector"], F.lit("="), x["mille"].cast("string"))), ",")
    rows = records(A.videos(spark, sf_dir)).join(nested, F.col("video_id") == F.col("id"), "left")
    return rows.select("id", "source_platform", "published_at", text.alias("scores"))


@query(V + " SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 24.0)) AS BIGINT) AS pages FROM v_videos WHERE status <> 'excluded'")
def page_totals(spark, sf_dir):
    n = A.videos(spark, sf_dir).where("status <> 'excluded'").agg(F.count("*").alias("total"))
    return n.select("total", F.greatest(F.lit(1), F.ceil(F.col("total") / 24)).cast("bigint").alias("pages"))


@query(V + ", c AS (SELECT coalesce(duplicate_of_id, id) AS cluster_id, count(*) AS size, array_to_string(list(id ORDER BY id)[1:10], ',') AS members FROM v_videos GROUP BY 1) SELECT * FROM c WHERE size > 1 ORDER BY size DESC, cluster_id LIMIT 25")
def largest_clusters(spark, sf_dir):
    """The 25 largest clusters of copies, with their first ten members; members are numbered by a window, not gathered."""
    v = A.videos(spark, sf_dir).select("id", F.coalesce("duplicate_of_id", "id").alias("cluster_id"))
    top = v.groupBy("cluster_id").agg(F.count("*").alias("size")).where("size > 1").orderBy(F.desc("size"), "cluster_id").limit(25)
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy("id"))
    first = v.join(F.broadcast(top), "cluster_id").withColumn("place", place).where("place <= 10")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda i: i.cast("string")), ",")
    return first.groupBy("cluster_id", "size").agg(ids.alias("members"))


@query(
    V + ", b AS (SELECT source_platform, md5(source_id) AS ref, id FROM v_videos WHERE id % 3 = 0), o AS (SELECT source_platform, source_id, min(id) AS id FROM v_videos WHERE id % 3 <> 0 GROUP BY 1, 2),"
    " p AS (SELECT v.id, v.source_platform, w.source_id AS wanted FROM v_videos v LEFT JOIN v_videos w ON w.id = v.duplicate_of_id WHERE v.id % 3 = 0)"
    " SELECT p.id, o.id AS resolved FROM p LEFT JOIN o ON o.source_platform = p.source_platform AND o.source_id = p.wanted"
)
def duplicate_pointers(spark, sf_dir):
    """Pointers of a batch by platform and source_id, resolved against the rows before the batch."""
    v = A.videos(spark, sf_dir).select("id", "source_platform", "source_id", "duplicate_of_id")
    before = v.where("id % 3 <> 0").groupBy("source_platform", F.col("source_id").alias("wanted")).agg(F.min("id").alias("resolved"))
    named = v.select(F.col("id").alias("duplicate_of_id"), F.col("source_id").alias("wanted"))
    batch = v.where("id % 3 = 0").select("id", "source_platform", "duplicate_of_id").join(named, "duplicate_of_id", "left")
    return batch.join(before, ["source_platform", "wanted"], "left").select("id", "resolved")


# Reviews, slices, publishing


@query(VR + " SELECT v.id, CASE WHEN r.video_id IS NOT NULL THEN 'reviewed' ELSE v.status END AS status, coalesce(n, 0) AS reviews FROM v_videos v LEFT JOIN (SELECT video_id, count(*) AS n FROM v_reviews WHERE decision IN ('approved', 'rejected') GROUP BY 1) r ON r.video_id = v.id")
def reviewed_status(spark, sf_dir):
    """Videos after their reviews were added: repeated reviews count each, other decisions than the two do not."""
    n = A.reviews(spark, sf_dir).where("decision IN ('approved', 'rejected')").groupBy("video_id").agg(F.count("*").alias("n"))
    status = F.when(F.col("n").isNotNull(), "reviewed").otherwise(F.col("status"))
    return A.videos(spark, sf_dir).join(n, F.col("video_id") == F.col("id"), "left").select("id", status.alias("status"), F.coalesce("n", F.lit(0)).cast("bigint").alias("reviews"))


@query(VR + " SELECT v.id, r.decision, r.review_no FROM v_videos v JOIN v_reviews r ON r.video_id = v.id WHERE v.duplicate_of_id IS NULL")
def video_reviews(spark, sf_dir):
    """Canonical videos with each of their reviews: a video that was reviewed twice comes twice."""
    v = A.videos(spark, sf_dir).where("duplicate_of_id IS NULL").select("id")
    return v.join(A.reviews(spark, sf_dir), F.col("video_id") == F.col("id")).select("id", "decision", "review_no")


FROZEN = "coalesce(published_at, crawled_at) >= TIMESTAMP '2024-02-01' AND coalesce(published_at, crawled_at) < TIMESTAMP '2024-05-01' AND status = 'reviewed' AND duplicate_of_id IS NULL"


@query(
    V + f", w AS (SELECT *, coalesce({FROZEN}, false) AS inside FROM v_videos) SELECT id, CASE WHEN inside THEN 'sliced' ELSE status END AS status, CASE WHEN inside THEN '2024.04' END AS version,"
    " CASE WHEN inside THEN blob_url IS NULL OR NOT starts_with(blob_url, 'file://') END AS blocks_publishing FROM w"
)
def freeze_and_check(spark, sf_dir):
    """Videos after a window was frozen: status, version of the slice, and whether a row keeps it from being published."""
    v = A.videos(spark, sf_dir).withColumn("inside", F.coalesce(F.expr(FROZEN.replace("TIMESTAMP '", "TIMESTAMP_NTZ '")), F.lit(False)))
    inside, version = F.col("inside"), F.date_format(F.lit("2024-04-30").cast("date"), "yyyy.MM")
    blocks = F.col("blob_url").isNull() | ~F.col("blob_url").startswith("file://")
    return v.select("id", F.when(inside, "sliced").otherwise(F.col("status")).alias("status"), F.when(inside, version).alias("version"), F.when(inside, blocks).alias("blocks_publishing"))


@query(V + " SELECT id, regexp_replace(blob_url, '^file://blobs/', 'https://huggingface.co/datasets/org/set/resolve/main/data/') AS blob_url, 'https://huggingface.co/datasets/org/set/resolve/main/' || CAST(id AS VARCHAR) AS raw_url, blob_url LIKE 'https://huggingface.co/%' AS may_age FROM v_videos")
def published_urls(spark, sf_dir):
    """Blob addresses after publishing, addresses of files, and whether a local copy may go."""
    url = F.col("blob_url")
    new = F.when(url.startswith("file://blobs/"), T.raw_url(F.lit("org/set"), F.concat(F.lit("data/"), F.expr("substr(blob_url, 14)")))).otherwise(url)
    raw = T.raw_url(F.lit("org/set"), F.col("id").cast("string"))
    return A.videos(spark, sf_dir).select("id", new.alias("blob_url"), raw.alias("raw_url"), url.like("https://huggingface.co/%").alias("may_age"))


@query(V + " SELECT id, CASE WHEN id % 5 = 0 THEN CASE WHEN id % 10 = 0 THEN NULL ELSE TIMESTAMP '2024-06-01' END ELSE featured_at END AS featured_at, CASE WHEN id % 31 = 0 THEN 'excluded' ELSE status END AS status FROM v_videos")
def pins_and_exclusions(spark, sf_dir):
    """Pins set and taken away, and exclusions applied, by joins with the rows that name them."""
    v = A.videos(spark, sf_dir)
    pins = v.where("id % 5 = 0").select(F.col("id").alias("pin"), F.when(F.expr("id % 10 <> 0"), F.lit("2024-06-01").cast("timestamp_ntz")).alias("at"))
    out = v.where("id % 31 = 0").select(F.col("id").alias("gone"))
    rows = v.join(pins, v["id"] == pins["pin"], "left").join(out, v["id"] == out["gone"], "left")
    return rows.select("id", F.when(F.col("pin").isNotNull(), F.col("at")).otherwise(F.col("featured_at")).alias("featured_at"), F.when(F.col("gone").isNotNull(), "excluded").otherwise(F.col("status")).alias("status"))


# Scores


@query(f"WITH {A.VIDEOS_SQL}, {A.SCORES_SQL} SELECT seq, video_id, source_platform, claimed_generator FROM v_scores LEFT JOIN (SELECT * FROM v_videos WHERE id % 4 <> 1) v ON v.id = video_id")
def scores_with_metadata(spark, sf_dir):
    """Scores with what is known of their videos; scores of unknown videos stay."""
    v = A.videos(spark, sf_dir).where("id % 4 <> 1").select("id", "source_platform", "claimed_generator")
    return A.scores(spark, sf_dir).join(v, F.col("id") == F.col("video_id"), "left").select("seq", "video_id", "source_platform", "claimed_generator")


BUCKET_SQL = ", b AS (SELECT vec_id AS id, CASE WHEN d.id IS NULL THEN 'missing' WHEN d.label <> 'fake' THEN 'real' ELSE 'fake' END AS kind, CASE WHEN d.id IS NULL OR d.label <> 'fake' THEN '_' ELSE coalesce(nullif(d.claimed_generator, ''), 'unknown') END AS name FROM embeddings LEFT JOIN (SELECT * FROM v_videos WHERE id % 4 <> 1) d ON d.id = vec_id)"


def buckets(spark, sf_dir):
    """Feature ids in buckets: real, each generator of fakes, or missing."""
    v = A.videos(spark, sf_dir).where("id % 4 <> 1").select("id", "label", "claimed_generator")
    rows = A.features(spark, sf_dir).select("id").join(v, "id", "left")
    fake = F.col("label") == "fake"
    kind = F.when(F.col("label").isNull(), "missing").when(fake, "fake").otherwise("real")
    return rows.select("id", kind.alias("kind"), F.when(fake, F.coalesce(F.nullif("claimed_generator", F.lit("")), F.lit("unknown"))).otherwise("_").alias("name"))


@query(V + BUCKET_SQL + " SELECT kind, name, count(*) AS n FROM b GROUP BY 1, 2")
def feature_buckets(spark, sf_dir):
    return buckets(spark, sf_dir).groupBy("kind", "name").agg(F.count("*").alias("n"))


@query(
    V + BUCKET_SQL + ", r AS (SELECT *, row_number() OVER (PARTITION BY kind, name ORDER BY md5(concat('7:', CAST(id AS VARCHAR))), id) AS place, count(*) OVER (PARTITION BY kind, name) AS n FROM b)"
    " SELECT id, kind, name, frac FROM r, (VALUES (0.1), (0.25), (0.5)) f(frac0), LATERAL (SELECT CAST(frac0 AS DOUBLE) AS frac) WHERE place <= greatest(1, round_even(n * frac, 0))"
)
def stratified_subsample(spark, sf_dir):
    """Shares of each bucket, one row at least; a smaller share lies within a larger one."""
    rows = buckets(with_checkpoints(spark), sf_dir)
    fractions = F.array(F.lit(0.1), F.lit(0.25), F.lit(0.5))
    order = F.md5(F.concat(F.lit("7:"), F.col("id").cast("string")).cast("binary"))
    out = selection.placed(rows.withColumn("order", order), ["kind", "name"], ["order", "id"]).withColumn("frac", F.explode(fractions))
    return out.where(F.col("place") < F.greatest(F.lit(1), F.bround(F.col("size") * F.col("frac"), 0))).select("id", "kind", "name", "frac")


@query(
    S + ", c AS (SELECT detector, label, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS pred, count(*) AS n FROM v_scores GROUP BY 1, 2, 3),"
    " t AS (SELECT detector, label, n, pred, sum(n) OVER (PARTITION BY detector, label) AS of_true, sum(n) OVER (PARTITION BY detector, pred) AS of_pred FROM c),"
    " k AS (SELECT detector, label AS class, sum(n) FILTER (label = pred) AS hit, any_value(of_true) AS p, (SELECT sum(n) FROM c x WHERE x.detector = t.detector AND x.pred = t.label) AS q FROM t GROUP BY detector, label)"
    " SELECT detector, CAST(class AS INTEGER) AS class, coalesce(hit, 0) / p::DOUBLE AS recall, CASE WHEN q > 0 THEN coalesce(hit, 0) / q::DOUBLE ELSE 0 END AS \"precision\", 2e0 * coalesce(hit, 0) / (p + coalesce(q, 0)) AS f1 FROM k"
)
def class_report(spark, sf_dir):
    """Recall, precision and F1 of each class of each detector."""
    pred = F.when(F.col("score") >= 0.5, 1).otherwise(0)
    counts = A.scores(spark, sf_dir).groupBy("detector", "label", pred.alias("pred")).agg(F.count("*").alias("n"))
    each = F.array(*[F.struct(F.lit(k).alias("class"), F.when((F.col("label") == k) & (F.col("pred") == k), F.col("n")).otherwise(0).alias("hit"), F.when(F.col("label") == k, F.col("n")).otherwise(0).alias("p"), F.when(F.col("pred") == k, F.col("n")).otherwise(0).alias("q")) for k in (0, 1)])
    sums = counts.select("detector", F.explode(each).alias("x")).groupBy("detector", "x.class").agg(F.sum("x.hit").alias("hit"), F.sum("x.p").alias("p"), F.sum("x.q").alias("q")).where("p > 0")
    hit, p, q = (F.col(c) for c in ("hit", "p", "q"))
    return sums.select("detector", "class", (hit / p).alias("recall"), F.when(q > 0, hit / q).otherwise(0e0).alias("precision"), (2e0 * hit / (p + q)).alias("f1"))


@query(
    SCORED + ", q AS (SELECT detector, quantile_cont(score, 0.95) AS cut, count(*) FILTER (score >= 0.5) AS fp FROM x WHERE label = 0 GROUP BY 1),"
    " f AS (SELECT detector, concat('gen::', coalesce(generator, 'unknown')) AS slice, score, 10 AS least FROM x WHERE label = 1 UNION ALL SELECT detector, concat('plat::', source_platform), score, 30 FROM x WHERE label = 1),"
    " k AS (SELECT f.detector, slice, count(*) AS n, count(*) FILTER (score >= cut) AS hit, count(*) FILTER (score >= 0.5) AS tp, any_value(fp) AS fp FROM f JOIN q ON q.detector = f.detector GROUP BY 1, 2 HAVING count(*) >= any_value(least)),"
    " u AS (SELECT f.detector, f.slice, score, 1 AS label FROM f JOIN k ON k.detector = f.detector AND k.slice = f.slice UNION ALL SELECT k.detector, k.slice, score, 0 FROM k JOIN x ON x.detector = k.detector WHERE x.label = 0), "
    + auroc_sql("u", "detector, slice", {"auroc": 2})
    + " SELECT k.detector, k.slice, k.n, auroc, hit / k.n::DOUBLE AS tpr5, CASE WHEN tp > 0 THEN 2e0 * tp / (tp + fp + k.n) ELSE 0e0 END AS f1 FROM k JOIN r ON r.detector = k.detector AND r.slice = k.slice"
)
def slice_metrics(spark, sf_dir):
    """Of the fakes of each generator (10 at least) and platform (30 at least): AUROC against all reals of the detector, share
    over the 95 % quantile of reals, and F1 at 0.5 with all false positives.  Everything is taken from counts by score."""
    slices = F.array(F.struct(F.concat(F.lit("gen::"), F.coalesce("generator", F.lit("unknown"))).alias("slice"), F.lit(10).alias("least")), F.struct(F.concat(F.lit("plat::"), F.col("source_platform")).alias("slice"), F.lit(30).alias("least")))
    x = scored(spark, sf_dir)
    fakes = x.where("label = 1").select("detector", "score", F.explode(slices).alias("s")).groupBy("detector", "s.slice", "s.least", "score").agg(F.count("*").alias("nf"))
    reals = x.where("label = 0").groupBy("detector", "score").agg(F.count("*").alias("nr"))
    cut = reals.groupBy("detector").agg(F.percentile("score", F.lit(0.95), F.col("nr")).alias("cut"), F.sum(F.when(F.col("score") >= 0.5, F.col("nr")).otherwise(0)).alias("fp"))
    over = lambda c: F.sum(F.when(c, F.col("nf")).otherwise(0))
    k = fakes.join(cut, "detector").groupBy("detector", "slice", "least", "fp").agg(F.sum("nf").alias("n"), over(F.col("score") >= F.col("cut")).alias("hit"), over(F.col("score") >= 0.5).alias("tp"))
    k = k.where("n >= least").drop("least")
    pool = k.select("detector", "slice").join(reals, "detector").select("detector", "slice", "score", F.lit(0).cast("long").alias("nf"), "nr")
    some = fakes.join(k.select("detector", "slice"), ["detector", "slice"]).select("detector", "slice", "score", "nf", F.lit(0).cast("long").alias("nr"))
    hist = some.union(pool).groupBy("detector", "slice", "score").agg(F.sum("nf").alias("nf"), F.sum("nr").alias("nr"))
    area = metrics.auroc_of_histogram(hist, ["detector", "slice"], {"auroc": "fakes_first"}).select("detector", "slice", "auroc")
    f1 = F.when(F.col("tp") > 0, 2e0 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("n"))).otherwise(0e0)
    return k.join(area, ["detector", "slice"]).select("detector", "slice", "n", "auroc", (F.col("hit") / F.col("n")).alias("tpr5"), f1.alias("f1"))


@query(
    S + ", m AS (SELECT detector, label, CAST(video_id % 3 AS INTEGER) AS fold, avg(score) AS cell FROM v_scores WHERE video_id % 7 <> 2 GROUP BY 1, 2, 3), g AS (SELECT d.detector, f.fold, avg(cell) FILTER (label = 1) AS fake FROM (SELECT DISTINCT detector FROM m) d"
    " CROSS JOIN (VALUES (0), (1), (2), (3)) f(fold) LEFT JOIN m ON m.detector = d.detector AND m.fold = f.fold GROUP BY 1, 2) SELECT detector, round(max(fake) FILTER (fold = 0), 6) AS fold_0, round(max(fake) FILTER (fold = 1), 6) AS fold_1, round(max(fake) FILTER (fold = 2), 6) AS fold_2,"
    " round(max(fake) FILTER (fold = 3), 6) AS fold_3, round(avg(fake), 6) AS mean FROM g GROUP BY 1"
)
def fold_table(spark, sf_dir):
    """Mean score of fakes by detector and fold, and the mean over the cells that have one."""
    x = A.scores(spark, sf_dir).where("video_id % 7 <> 2 AND label = 1").withColumn("fold", F.expr("CAST(video_id % 3 AS INT)"))
    cells = x.groupBy("detector").pivot("fold", [0, 1, 2, 3]).agg(F.avg("score"))
    names = [f"fold_{k}" for k in range(4)]
    cells = cells.select("detector", *[F.col(str(k)).alias(n) for k, n in enumerate(names)])
    known = F.array_compact(F.array(*names))
    mean = F.aggregate(known, F.lit(0e0), lambda a, b: a + b) / F.size(known)
    return cells.select("detector", *[F.round(n, 6).alias(n) for n in names], F.round(mean, 6).alias("mean"))


@query(S + ", c AS (SELECT detector, median(score) AS cut FROM v_scores GROUP BY 1) SELECT v.detector, count(*) FILTER (label = 1 AND score > cut) AS tp, count(*) FILTER (label = 0 AND score > cut) AS fp, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM v_scores v JOIN c ON c.detector = v.detector GROUP BY 1")
def median_threshold(spark, sf_dir):
    """Counts over the median of a detector's scores, strictly over it."""
    counts = A.scores(spark, sf_dir).groupBy("detector", "score").agg(F.count_if(F.col("label") == 1).alias("nf"), F.count_if(F.col("label") == 0).alias("nr"))
    cut = counts.groupBy("detector").agg(F.percentile("score", F.lit(0.5), F.col("nf") + F.col("nr")).alias("cut"))
    over = F.col("score") > F.col("cut")
    sums = counts.join(cut, "detector").groupBy("detector")
    return sums.agg(F.sum(F.when(over, F.col("nf")).otherwise(0)).alias("tp"), F.sum(F.when(over, F.col("nr")).otherwise(0)).alias("fp"), F.sum("nf").alias("p"), F.sum("nr").alias("n"))


# Single values

ANSWER = "concat(CASE doc_id % 3 WHEN 0 THEN concat('```json', chr(10)) ELSE '' END, '{{\"is_ai\": ', CASE doc_id % 4 WHEN 1 THEN 'true' WHEN 3 THEN 'nope' ELSE 'false' END, '}}', CASE doc_id % 3 WHEN 0 THEN concat(chr(10), '```') ELSE '' END)"
ANSWER = ANSWER.replace("{{", "{").replace("}}", "}")


@query(
    f"WITH t AS (SELECT doc_id AS id, text, {ANSWER} AS answer, CASE doc_id % 4 WHEN 0 THEN '20240131' WHEN 1 THEN '20241399' WHEN 2 THEN '2024013' END AS day, n_chars FROM documents),"
    " a AS (SELECT *, CASE WHEN starts_with(answer, '```') THEN trim(array_to_string(list_filter(string_split(answer, chr(10)), lambda x: NOT starts_with(trim(x), '```')), chr(10))) ELSE answer END AS plain FROM t)"
    " SELECT id, substr(text, 1, 200) AS short, CASE WHEN json_valid(plain) THEN json_extract(plain, '$.is_ai')::BOOLEAN END AS is_ai, CASE WHEN length(day) = 8 THEN try_strptime(day, '%Y%m%d')::DATE END AS day,"
    " substr(sha1(text), 1, 12) AS key12, base64(encode(substr(text, 1, 8))) AS code, greatest(0.5::DOUBLE, n_chars / 2::DOUBLE) AS middle,"
    " CAST(least(greatest(n_chars - 1, 0), floor(n_chars * (CAST(id % 4 AS INTEGER) + 0.5) / 4)) AS INTEGER) AS frame FROM a"
)
def single_values(spark, sf_dir):
    """Cut texts, parsed answers, dates, digests, base64 and frame places."""
    t = A.table(spark, sf_dir, "documents").selectExpr("*", f"{ANSWER} AS answer", "CASE doc_id % 4 WHEN 0 THEN '20240131' WHEN 1 THEN '20241399' WHEN 2 THEN '2024013' END AS day")
    is_ai = F.get(F.from_json(F.concat(F.lit("["), T.unfenced(F.col("answer")), F.lit("]")), "array<struct<is_ai:boolean>>"), 0)["is_ai"]
    return t.select(
        F.col("doc_id").alias("id"), F.substring("text", 1, 200).alias("short"), is_ai.alias("is_ai"), T.compact_date(F.col("day")).alias("day"),
        F.substring(F.sha1(F.encode("text", "utf-8")), 1, 12).alias("key12"), F.base64(F.encode(F.substring("text", 1, 8), "utf-8")).alias("code"),
        T.middle_time(F.col("n_chars").cast("double")).alias("middle"), T.frame_index(F.col("n_chars").cast("int"), F.expr("CAST(doc_id % 4 AS INT)"), 4).alias("frame"),
    )


TITLED = "concat(CASE doc_id % 6 WHEN 0 THEN 'by <em class=\"k\">Sora</em> 2 &amp;lt; ' WHEN 1 THEN 'veo 3 &quot;x&quot; ' WHEN 2 THEN 'Seedance &#39;' WHEN 3 THEN '可灵 ' WHEN 4 THEN 'gen-mo ' ELSE '' END, regexp_replace({0}, '[^ -~]', ' '{1}))"


@query(
    "WITH t AS (SELECT doc_id AS id, " + TITLED.format("text", ", 'g'") + " AS title FROM documents) SELECT id, md5(replace(replace(replace(replace(replace(regexp_replace(title, '</?em[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')) AS cleaned,"
    " CASE WHEN regexp_matches(title, '(?i)sora\\s*2') THEN 'sora2' WHEN regexp_matches(title, '(?i)sora') THEN 'sora2' WHEN regexp_matches(title, '(?i)可灵|kling') THEN 'kling21' WHEN regexp_matches(title, '(?i)即梦|dreamina') THEN 'dreamina3'"
    " WHEN regexp_matches(title, '(?i)runway') THEN 'runway-gen4' WHEN regexp_matches(title, '(?i)veo\\s*3') THEN 'veo3' WHEN regexp_matches(title, '(?i)hailuo|海螺|minimax') THEN 'hailuo' WHEN regexp_matches(title, '(?i)pika') THEN 'pika2'"
    " WHEN regexp_matches(title, '(?i)luma|dream\\s*machine') THEN 'luma' WHEN regexp_matches(title, '(?i)hunyuan|混元') THEN 'hunyuan' WHEN regexp_matches(title, '(?i)通义万相|wanx|wan\\s*2') THEN 'wan21' WHEN regexp_matches(title, '(?i)stable\\s*video|svd') THEN 'stable_video_diffusion'"
    " WHEN regexp_matches(title, '(?i)seedance') THEN 'seedance' WHEN regexp_matches(title, '(?i)vidu') THEN 'vidu' WHEN regexp_matches(title, '(?i)pixverse') THEN 'pixverse' WHEN regexp_matches(title, '(?i)gen[\\s-]?mo') THEN 'genmo' END AS generator FROM t"
)
def short_video_titles(spark, sf_dir):
    """Titles cleaned, and their generators by one platform's patterns; whole texts count as titles."""
    t = A.table(spark, sf_dir, "documents").selectExpr("doc_id AS id", TITLED.format("text", "") + " AS title")
    return t.select("id", F.md5(F.encode(T.clean_title(F.col("title")), "utf-8")).alias("cleaned"), T.first_pattern(F.col("title"), T.SHORT_VIDEO_PATTERNS).alias("generator"))


@query(
    "SELECT page_id, contains(url, '/') OR contains(url, '..') OR contains(url, chr(92)) AS unsafe, CASE WHEN contains(lower(url), '.mp4') THEN url ELSE concat('https://ex.org/p/', CAST(page_id AS VARCHAR)) END AS source_url,"
    " CASE WHEN page_id % 2 = 0 THEN concat('https:', regexp_replace(url, '^https?:', '')) WHEN starts_with(url, 'http') THEN url END AS fixed FROM pages"
)
def page_urls(spark, sf_dir):
    """Names that leave their folder, direct addresses, and addresses without a scheme."""
    p = A.table(spark, sf_dir, "pages").withColumn("loose", F.expr("CASE WHEN page_id % 2 = 0 THEN regexp_replace(url, '^https?:', '') ELSE url END"))
    direct = F.when(F.lower("url").contains(".mp4"), F.col("url")).otherwise(F.concat(F.lit("https://ex.org/p/"), F.col("page_id").cast("string")))
    return p.select("page_id", (~T.safe_name(F.col("url"))).alias("unsafe"), direct.alias("source_url"), T.fixed_url(F.col("loose")).alias("fixed"))


@query("WITH e AS (SELECT event_type, event_id, value FROM events), w AS (SELECT *, lag(value) OVER o AS b, lead(value) OVER o AS a FROM e WINDOW o AS (PARTITION BY event_type, event_id // 1000 ORDER BY event_id)) SELECT event_id, CASE WHEN b IS NULL THEN a - value WHEN a IS NULL THEN value - b ELSE (a - b) / 2 END AS slope FROM w")
def central_difference(spark, sf_dir):
    """Differences in time, central inside of a series, one-sided at its ends; series are short runs of a type's events."""
    order = Window.partitionBy("event_type", F.expr("event_id div 1000")).orderBy("event_id")
    e = A.table(spark, sf_dir, "events").select("event_id", "value", F.lag("value").over(order).alias("b"), F.lead("value").over(order).alias("a"))
    value, a, b = F.col("value"), F.col("a"), F.col("b")
    return e.select("event_id", F.when(b.isNull(), a - value).when(a.isNull(), value - b).otherwise((a - b) / 2).alias("slope"))


@query(V + " SELECT id, published_at >= TIMESTAMP '2024-01-15' AND published_at <= TIMESTAMP '2024-06-15' AS in_time, duration_sec IS NULL OR duration_sec <= 60 AS fits, regexp_matches(lower(title), 'the|und|para') AS recalled FROM v_videos")
def crawl_gates(spark, sf_dir):
    """Publication dates between two bounds, lengths (unknown ones pass), and words that titles are looked up by."""
    at = F.col("published_at")
    inside = (at >= F.lit("2024-01-15").cast("timestamp_ntz")) & (at <= F.lit("2024-06-15").cast("timestamp_ntz"))
    short = F.col("duration_sec").isNull() | (F.col("duration_sec") <= 60)
    return A.videos(spark, sf_dir).select("id", inside.alias("in_time"), short.alias("fits"), T.any_term(F.lower("title"), ["the", "und", "para"]).alias("recalled"))
