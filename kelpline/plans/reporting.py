"""Registered reports, and what is kept of artefacts when their sources leave."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.functions import arrays
from kelpline.functions import text as T
from kelpline.operators import curation, metrics, reports
from kelpline.plans import records
from kelpline.plans.curation import terms_sql
from kelpline.plans.evaluation import ENSEMBLE, REFERENCE, SCORED, THRESHOLD, auroc_sql, scored
from kelpline.sources import adapters as A
from kelpline.sources.session import with_checkpoints

QUERIES: dict = {}
SQL: dict[str, str] = {}
V = f"WITH {A.VIDEOS_SQL}"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(
    f"WITH {A.SCORES_SQL}, " + auroc_sql("v_scores", "detector", {"auroc": 2}) + ", " + THRESHOLD.format(g="detector", s="v_scores")
    + ", k(detector, reference) AS (VALUES ('click', 0.9613e0), ('view', 0.9466e0), ('purchase', 0.954e0))"
    " SELECT detector, round(auroc, 4) AS auroc, round(bacc, 4) AS bacc, round(f1, 4) AS f1, reference, round(auroc - reference, 4) AS delta, n_fake + n_real AS n"
    " FROM r JOIN m USING (detector) LEFT JOIN k USING (detector)"
)
def gap_report(spark, sf_dir):
    """AUROC, balanced accuracy and F1 of each detector beside the reference's AUROC."""
    return reports.gaps(A.scores(spark, sf_dir), REFERENCE)


@query(
    ENSEMBLE.replace("WITH ", f"WITH {A.VIDEOS_SQL}, ", 1)
    + ", j AS (SELECT f.label AS label, conf < 0.6 AS hard, source_platform AS platform, coalesce(nullif(claimed_generator, ''), '_unlabeled') AS generator"
    " FROM f JOIN v_videos v ON concat(CAST(v.id AS STRING), '.mp4') = f.video),"
    " g AS (SELECT 'fake_hard_by_platform' AS name, platform AS value, hard, 1 AS least FROM j WHERE label = 1 UNION ALL SELECT 'fake_hard_by_generator', generator, hard, 50 FROM j WHERE label = 1"
    " UNION ALL SELECT 'real_hard_by_platform', platform, hard, 1 FROM j WHERE label = 0)"
    " SELECT name, value, count(*) FILTER (hard) AS hard, count(*) AS total, round(count(*) FILTER (hard) / count(*)::DOUBLE, 4) AS rate FROM g GROUP BY 1, 2 HAVING count(*) >= any_value(least)"
)
def hard_report(spark, sf_dir):
    """Hard fakes by platform and generator (of 50 fakes or more) and hard reals by platform."""
    v = A.videos(spark, sf_dir).select(
        F.concat(F.col("id").cast("string"), F.lit(".mp4")).alias("video"), F.col("source_platform").alias("platform"), F.nullif("claimed_generator", F.lit("")).alias("generator")
    )
    items = metrics.ensemble(A.scores(with_checkpoints(spark), sf_dir)).join(v, "video")
    groups = {"fake_hard_by_platform": (1, "platform", 1), "fake_hard_by_generator": (1, "generator", 50), "real_hard_by_platform": (0, "platform", 1)}
    return reports.hard_counts(items, groups)


@query(
    f"WITH {A.SCORES_SQL}, c AS (SELECT detector, label, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS pred FROM v_scores),"
    " k AS (SELECT c.detector AS detector, x.class AS class, count(*) FILTER (label = class AND pred = class) AS hit, count(*) FILTER (label = class) AS p, count(*) FILTER (pred = class) AS q"
    " FROM c, (VALUES (0), (1)) x(class) GROUP BY 1, 2)"
    " SELECT detector, round(avg(hit / p::DOUBLE), 9) AS macro_recall, round(avg(CASE WHEN q > 0 THEN hit / q::DOUBLE ELSE 0 END), 9) AS macro_precision, round(avg(2e0 * hit / (p + q)), 9) AS macro_f1, count(*) AS classes FROM k WHERE p > 0 GROUP BY 1"
)
def macro_report(spark, sf_dir):
    return reports.class_averages(records.class_report(spark, sf_dir))


RUNS_SQL = "r AS (SELECT o_orderkey AS id, concat('run-', CAST(o_orderkey AS STRING)) AS run_name, o_orderpriority AS flow_type, o_orderstatus AS status, o_orderdate AS created_at FROM orders)"


def runs(spark, sf_dir):
    return A.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "concat('run-', CAST(o_orderkey AS STRING)) AS run_name", "o_orderpriority AS flow_type", "o_orderstatus AS status", "o_orderdate AS created_at"
    )


@query(f"WITH {RUNS_SQL}, k AS (SELECT *, CAST(row_number() OVER (ORDER BY created_at DESC NULLS LAST, id DESC) AS INTEGER) AS place FROM r) SELECT *, place <= 5 AS in_brief FROM k WHERE place <= 20")
def recent_runs(spark, sf_dir):
    """The 20 latest runs, of which an overview names five."""
    return curation.recent(runs(spark, sf_dir), "created_at", "id", 20).withColumn("in_brief", F.col("place") <= 5)


@query(f"WITH {RUNS_SQL}, k AS (SELECT *, CAST(row_number() OVER (PARTITION BY flow_type ORDER BY created_at DESC NULLS LAST, id DESC) AS INTEGER) AS place FROM r) SELECT * FROM k WHERE place <= 5")
def recent_runs_by_flow(spark, sf_dir):
    return curation.recent(runs(spark, sf_dir), "created_at", "id", 5, "flow_type")


@query(
    SCORED + ", g AS (SELECT detector, coalesce(generator, '_unlabeled') AS generator, score FROM x WHERE label = 1),"
    " k AS (SELECT detector, generator FROM g GROUP BY ALL HAVING count(*) >= 5),"
    " u AS (SELECT g.detector, g.generator, score, 1 AS label FROM g JOIN k USING (detector, generator)"
    " UNION ALL SELECT x.detector, k.generator, x.score, 0 FROM x JOIN k ON k.detector = x.detector WHERE label = 0), "
    + auroc_sql("u", "detector, generator", {"auroc": 2})
    + " SELECT detector AS name, concat('{\"min_fake\":5,\"max_n_fake\":', max(n_fake), ',\"results\":[', string_agg(concat('{\"slice\":\"', generator, '\",\"n_fake\":', n_fake, ',\"n_real\":', n_real, ',\"auroc\":',"
    " CAST(CAST(auroc AS DECIMAL(5, 4)) AS STRING), '}'), ',' ORDER BY generator), ']}') AS document FROM r GROUP BY 1"
)
def result_documents(spark, sf_dir):
    """A JSON document for each detector with the AUROC of each generator of five fakes or more."""
    df = scored(with_checkpoints(spark), sf_dir).withColumn("generator", F.coalesce("generator", F.lit("_unlabeled")))
    return reports.documents(metrics.against_pool(df, "detector", "generator", 5), "generator", 5)


@query(
    V + ", b AS (SELECT DISTINCT event_id AS id FROM events WHERE event_type = 'purchase') SELECT v.id AS id, nullif(claimed_generator, '') AS generator, coalesce(source_platform, 'unknown') AS platform"
    " FROM v_videos v SEMI JOIN b ON b.id = v.id WHERE label = 'fake'"
)
def fakes_with_blobs(spark, sf_dir):
    """Fakes whose file is in the listing of a store."""
    path = F.concat(F.lit("store/blobs/"), F.col("event_id").cast("string"), F.lit(".mp4"))
    blobs = A.table(spark, sf_dir, "events").where("event_type = 'purchase'").select(T.file_stem(F.element_at(F.split(path, "/"), -1)).alias("id"))
    fakes = curation.with_blobs(A.videos(spark, sf_dir).where("label = 'fake'"), blobs)
    return fakes.select("id", F.nullif("claimed_generator", F.lit("")).alias("generator"), F.coalesce("source_platform", F.lit("unknown")).alias("platform"))


@query(
    V + ", d AS (SELECT id, crawled_at, CASE id % 7 WHEN 0 THEN strftime(published_at, '%Y-%m-%d') WHEN 1 THEN strftime(published_at, '%Y-%m-%dT%H:%M:%S+08:00') WHEN 2 THEN strftime(published_at, '%Y-%m-%dT%H:%M:%SZ')"
    " WHEN 3 THEN strftime(published_at, '%Y-%m-%d %H:%M:%S') WHEN 4 THEN strftime(published_at, '%Y-02-30T%H:%M:%S') WHEN 5 THEN strftime(published_at, '%Y/%m/%d') ELSE title END AS said FROM v_videos),"
    " p AS (SELECT id, crawled_at, epoch_us(TRY_CAST(CASE WHEN id % 7 = 1 THEN replace(said, '+08:00', '') WHEN id % 7 < 5 THEN said END AS TIMESTAMP)) - CASE WHEN id % 7 = 1 THEN 28800000000 ELSE 0 END AS published_us FROM d)"
    " SELECT id, published_us, published_us IS NULL OR published_us >= epoch_us(crawled_at) - 60 * 86400000000 AS fresh FROM p"
)
def fresh_publications(spark, sf_dir):
    """Times of publication of texts of many forms, and which are at most 60 days old when crawled; unknown ones are kept."""
    at = lambda form: F.date_format("published_at", form)
    forms = ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss'+08:00'", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy-'02-30T'HH:mm:ss", "yyyy/MM/dd")
    said = F.col("title")
    for i, form in enumerate(forms):
        said = F.when(F.col("id") % 7 == i, at(form)).otherwise(said)
    v = A.videos(spark, sf_dir).select("id", T.iso_micros(said).alias("published_us"), "crawled_at")
    now = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("crawled_at"))
    return v.select("id", "published_us", (F.col("published_us").isNull() | (F.col("published_us") >= T.age_cutoff(now, 60))).alias("fresh"))


@query(
    V + ", d AS (SELECT id, duration_sec AS d, CASE id % 6 WHEN 0 THEN 30000 / 1001::DOUBLE WHEN 1 THEN 25e0 WHEN 5 THEN 24e0 END AS fps, least(0.5, duration_sec * 0.1) AS eps FROM v_videos)"
    " SELECT d.id AS id, CAST(i AS INTEGER) AS sample, round(fps, 9) AS fps, round(eps + i * ((d - 2 * eps) / 7), 6) AS at FROM d, range(0, 8) t(i) WHERE d IS NOT NULL"
)
def sample_plan(spark, sf_dir):
    """The eight times at which frames of each video are taken, and its frame rate as a number."""
    rate = F.expr("CASE id % 6 WHEN 0 THEN '30000/1001' WHEN 1 THEN '25/1' WHEN 2 THEN '0/0' WHEN 3 THEN 'N/A' WHEN 5 THEN '48/2' END")
    v = A.videos(spark, sf_dir).where("duration_sec IS NOT NULL").select("id", F.round(T.frame_rate(rate), 9).alias("fps"), F.posexplode(T.sample_times(F.col("duration_sec"), 8)).alias("sample", "at"))
    return v.withColumn("at", F.round("at", 6))


WITHDRAWN_SQL = (
    V + ", q AS (SELECT DISTINCT source_platform, source_id FROM v_videos v JOIN labels l ON l.doc_id = v.id WHERE toxic = 1), o AS (SELECT DISTINCT v.id FROM v_videos v JOIN q USING (source_platform, source_id)),"
    " a AS (SELECT 'manifest' AS artefact, id FROM v_videos WHERE status = 'reviewed' UNION ALL SELECT concat('split_', label), id FROM v_videos)"
    " SELECT artefact, id, id NOT IN (SELECT id FROM o) AS kept, CASE WHEN id IN (SELECT id FROM o) THEN 'owner' END AS reason FROM a"
)


@query(WITHDRAWN_SQL)
def withdrawn_sources(spark, sf_dir):
    """What is left of a manifest and of all splits when the sources of toxic rows ask to leave, and the errata."""
    v = A.videos(spark, sf_dir).select("id", "source_platform", "source_id", "label", "status")
    toxic = A.table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    requests = v.join(toxic, "id", "left_semi").select("source_platform", "source_id", F.lit("owner").alias("reason"))
    artefacts = {"manifest": v.where("status = 'reviewed'").select("id")} | {f"split_{x}": v.where(F.col("label") == x).select("id") for x in ("fake", "real", "unknown")}
    left, errata = curation.withdrawn(artefacts, v, requests)
    kept = reduce(DataFrame.unionByName, [rows.select(F.lit(name).alias("artefact"), "id", F.lit(True).alias("kept"), F.lit(None).cast("string").alias("reason")) for name, rows in left.items()])
    return kept.unionByName(errata.select("artefact", "id", F.lit(False).alias("kept"), "reason"))


HARVESTED = T.HARVEST_TITLE_TERMS + T.HARVEST_AVATAR_NAMES + T.MUSIC_TERMS + T.FACE_TERMS
LISTED = ", ".join("'" + t.replace("'", "''") + "'" for t in HARVESTED)


@query(
    V + f", t AS (SELECT id, lower(CASE WHEN id % 3 = 0 THEN concat(title, ' ', upper([{LISTED}][id % {len(HARVESTED)} + 1])) ELSE title END) AS low FROM v_videos)"
    + " SELECT id, " + ", ".join(f"({terms_sql('low', terms)}) IS NOT NULL AS {name}" for name, terms in (("tutorial", T.HARVEST_TITLE_TERMS), ("avatar", T.HARVEST_AVATAR_NAMES), ("music", T.MUSIC_TERMS), ("face", T.FACE_TERMS))) + " FROM t"
)
def harvest_titles(spark, sf_dir):
    """Which of the lists of terms keep a title out while it is harvested; every third title holds a term."""
    word = F.expr(f"upper(array({LISTED})[CAST(id % {len(HARVESTED)} AS INT)])")
    low = F.lower(F.when(F.col("id") % 3 == 0, F.concat("title", F.lit(" "), word)).otherwise(F.col("title")))
    rules = {"tutorial": T.HARVEST_TITLE_TERMS, "avatar": T.HARVEST_AVATAR_NAMES, "music": T.MUSIC_TERMS, "face": T.FACE_TERMS}
    return A.videos(spark, sf_dir).select("id", low.alias("low")).select("id", *[T.any_term(F.col("low"), terms).alias(name) for name, terms in rules.items()])


@query(
    "WITH e AS (SELECT label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), n AS (SELECT label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e),"
    " p AS (SELECT label, unnest(range(0, len(v))) AS pos, unnest(v) / CASE WHEN norm > 0 THEN norm ELSE 1 END AS x FROM n), m AS (SELECT label, CAST(pos AS INTEGER) AS pos, avg(x) AS mean FROM p GROUP BY ALL)"
    " SELECT label, pos, round(mean, 9) AS mean, round(exp(mean) / sum(exp(mean)) OVER (PARTITION BY label), 9) AS share, round(ln(1 + abs(mean)), 9) AS log_size FROM m"
)
def pooled_features(spark, sf_dir):
    """Each label's mean of normalised vectors, as shares by softmax, and on a logarithmic scale."""
    unit = arrays.normalised(F.transform("embedding", lambda x: x.cast("double")))
    parts = A.table(spark, sf_dir, "embeddings").select("label", F.posexplode(unit).alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("x"))
    pooled = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("v"))
    each = pooled.select("label", F.posexplode(F.arrays_zip(F.col("v").alias("mean"), arrays.softmax(F.col("v")).alias("share"))).alias("pos", "p"))
    return each.select("label", "pos", F.round("p.mean", 9).alias("mean"), F.round("p.share", 9).alias("share"), F.round(F.log1p(F.abs("p.mean")), 9).alias("log_size"))


@query(
    f"WITH {A.PHASH_SQL} SELECT id, lower(hex(hash)) AS digits, hash AS number, CAST(bit_count(hash) AS INTEGER) AS bits FROM v_phash"
)
def hash_digits(spark, sf_dir):
    """Hashes as hexadecimal texts, read back as numbers, and the bits that are set."""
    digits = A.phash(spark, sf_dir).select("id", F.lower(F.hex("hash")).alias("digits"))
    number = arrays.hex_number(F.col("digits"))
    return digits.select("id", "digits", number.alias("number"), F.bit_count(number).alias("bits"))


@query("SELECT doc_id AS id, base64(encode(text)) AS sent, text AS text FROM documents")
def decoded_texts(spark, sf_dir):
    """Texts as base64 and decoded again."""
    sent = F.regexp_replace(F.base64(F.encode("text", "utf-8")), r"\s", "")
    return A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), sent.alias("sent")).withColumn("text", F.decode(F.unbase64("sent"), "utf-8"))
