"""Domain tables (videos, reviews, scores, features) derived from the given tables.

Columns are expressions that mean the same in Spark and in the SQL oracle, so each is written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIDEOS = {
    "id": "d.doc_id",
    "source_platform": "CASE WHEN d.doc_id % 7 < 4 THEN 'bilibili' WHEN d.doc_id % 7 = 4 THEN 'reddit' WHEN d.doc_id % 7 = 5 THEN 'youtube' ELSE 'showcase' END",
    "source_id": "substr(md5(d.text), 1, 16)",
    "title": "substr(d.text, 1, 60)",
    "label": "CASE WHEN l.quality = 0 OR l.toxic = 1 THEN 'fake' WHEN l.quality = 1 THEN 'real' ELSE 'unknown' END",
    "label_source": "CASE d.doc_id % 8 WHEN 0 THEN 'tier1_gallery' WHEN 1 THEN 'tier2_platform_tag' WHEN 2 THEN 'tier2_channel_whitelist'"
    " WHEN 3 THEN 'tier3_llm' WHEN 4 THEN 'tier1_dataset' WHEN 5 THEN 'tier1_platform_absence' WHEN 6 THEN 'bogus' END",
    "claimed_generator": "CASE d.doc_id % 9 WHEN 0 THEN 'kling21' WHEN 1 THEN 'sora2' WHEN 2 THEN 'veo3' WHEN 3 THEN 'runway-gen4' WHEN 4 THEN 'pika1'"
    " WHEN 5 THEN 'modelscope_t2v' WHEN 6 THEN 'Unlisted' WHEN 7 THEN '' END",
    "duration_sec": "CASE WHEN d.doc_id % 11 = 0 THEN NULL WHEN d.doc_id % 13 = 0 THEN 0e0 ELSE d.n_chars / 10e0 END",
    "resolution_w": "CASE WHEN d.doc_id % 10 <> 0 THEN CAST(160 * (1 + d.doc_id % 12) AS INT) END",
    "resolution_h": "CASE WHEN d.doc_id % 10 <> 0 THEN CAST(90 * (1 + d.doc_id % 11) AS INT) END",
    "fps": "CASE d.doc_id % 4 WHEN 0 THEN 24e0 WHEN 1 THEN 25e0 WHEN 2 THEN 30e0 END",
    "file_size_bytes": "CASE WHEN d.doc_id % 17 = 0 THEN 0 WHEN d.doc_id % 5 = 0 THEN NULL ELSE d.n_chars * 1000 END",
    "content_tags": "CASE WHEN d.doc_id % 6 = 0 THEN NULL WHEN d.doc_id % 19 = 0 THEN '{bad' ELSE concat('[\"', CASE WHEN d.doc_id % 7 < 4 THEN 'bilibili'"
    " WHEN d.doc_id % 7 = 4 THEN 'reddit' WHEN d.doc_id % 7 = 5 THEN 'youtube' ELSE 'showcase' END, ':', d.source, '\",\"lang:', d.lang, '\"]') END",
    "caption_model": "CASE WHEN d.doc_id % 3 <> 0 THEN 'stub-v1' END",
    "duplicate_of_id": "CASE WHEN c.first_id < d.doc_id THEN c.first_id END",
    "blob_url": "CASE WHEN d.doc_id % 4 = 0 THEN NULL WHEN d.doc_id % 4 = 2 THEN concat('https://huggingface.co/blobs/', CAST(d.doc_id AS STRING))"
    " ELSE concat('file://blobs/', CAST(d.doc_id AS STRING), '.mp4') END",
    "status": "CASE WHEN d.doc_id % 10 = 0 THEN 'excluded' WHEN d.doc_id % 10 < 4 THEN 'reviewed' ELSE 'filtered' END",
    "created_at": "e.ts",
    "crawled_at": "e.ts + INTERVAL '95' DAY",
    "published_at": "CASE WHEN d.doc_id % 8 <> 0 THEN e.ts + CAST(d.doc_id % 90 AS INT) * INTERVAL '1' DAY END",
    "featured_at": "CASE WHEN d.doc_id % 50 = 0 THEN e.ts END",
}
#: CTEs of the oracle with the same tables.
VIDEOS_SQL = (
    "v_videos AS (SELECT "
    + ", ".join(f"{e} AS {n}" for n, e in VIDEOS.items())
    + " FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN events e ON e.event_id = d.doc_id"
    " LEFT JOIN (SELECT md5(text) AS h, min(doc_id) AS first_id FROM documents GROUP BY 1) c ON c.h = md5(d.text))"
)
REVIEWS_SQL = (
    "v_reviews AS (SELECT doc_id AS video_id, CASE WHEN doc_id % 4 = 0 THEN 'rejected' ELSE 'approved' END AS decision, 1 AS review_no"
    " FROM documents WHERE doc_id % 10 BETWEEN 1 AND 3 UNION ALL SELECT doc_id, 'approved', 2 FROM documents WHERE doc_id % 10 BETWEEN 1 AND 3 AND doc_id % 97 = 1)"
)
SCORES_SQL = (
    "v_scores AS (SELECT e.event_id % n.n AS video_id, concat(CAST(e.event_id % n.n AS STRING), '.mp4') AS video, e.event_type AS detector,"
    " least(e.value, 100e0) / 100e0 AS score, e.event_id AS seq, CASE WHEN l.quality = 0 OR l.toxic = 1 THEN 1 ELSE 0 END AS label"
    " FROM events e CROSS JOIN (SELECT count(*) AS n FROM documents) n JOIN labels l ON l.doc_id = e.event_id % n.n)"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawled videos: documents with labels and events; equal texts point at the first.

    Of a text only its digest and its first 60 characters, the fixture's title, go into joins.
    """
    rows = table(spark, sf_dir, "documents")
    d = rows.selectExpr("doc_id", "lang", "source", "n_chars", "md5(text) AS digest", "substr(text, 1, 60) AS head").alias("d")
    first = rows.selectExpr("doc_id", "md5(text) AS h").groupBy("h").agg(F.min("doc_id").alias("first_id")).alias("c")
    l = table(spark, sf_dir, "labels").alias("l")
    e = table(spark, sf_dir, "events").select("event_id", "ts").alias("e")
    joined = d.join(l, F.expr("l.doc_id = d.doc_id"), "left").join(e, F.expr("e.event_id = d.doc_id"), "left")
    joined = joined.join(first, F.expr("c.h = d.digest"), "left")
    narrow = lambda x: x.replace("md5(d.text)", "d.digest").replace("substr(d.text, 1, 60)", "d.head")
    return joined.select(*[F.expr(narrow(x)).alias(n) for n, x in VIDEOS.items()])


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("doc_id % 10 BETWEEN 1 AND 3")
    one = d.selectExpr("doc_id AS video_id", "CASE WHEN doc_id % 4 = 0 THEN 'rejected' ELSE 'approved' END AS decision", "1 AS review_no")
    return one.union(d.where("doc_id % 97 = 1").selectExpr("doc_id", "'approved'", "2"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector scores of labelled videos (label 1: fake), several for some pairs of video and detector."""
    n = table(spark, sf_dir, "documents").count()
    e = table(spark, sf_dir, "events").withColumn("video_id", F.pmod("event_id", F.lit(n)))
    labels = table(spark, sf_dir, "labels").selectExpr("doc_id AS video_id", "CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END AS label")
    out = e.join(labels, "video_id")
    return out.selectExpr(
        "video_id", "concat(CAST(video_id AS STRING), '.mp4') AS video", "event_type AS detector",
        "least(value, 100e0) / 100e0 AS score", "event_id AS seq", "label",
    )


def big_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A larger table of scores, with many ties."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS video_id", "l_returnflag AS detector", "l_linestatus AS platform",
        "CASE WHEN l_linenumber > 3 THEN 1 ELSE 0 END AS label", "l_discount * 10 AS score",
    )


BIG_SCORES_SQL = (
    "v_bigscores AS (SELECT l_orderkey AS video_id, l_returnflag AS detector, l_linestatus AS platform,"
    " CASE WHEN l_linenumber > 3 THEN 1 ELSE 0 END AS label, l_discount * 10 AS score FROM lineitem)"
)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id AS id", "transform(embedding, x -> CAST(x AS DOUBLE)) AS features",
        "CASE WHEN label < 8 THEN concat('f', CAST(label AS STRING)) END AS generator", "label",
    )


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with near copies of every tenth row: four components set to zero."""
    f = features(spark, sf_dir)
    copy = f.where("id % 10 = 0").selectExpr(
        "id + 1000000 AS id", "transform(features, (x, i) -> CASE WHEN i < 4 THEN 0e0 ELSE x END) AS features", "generator", "label"
    )
    return f.union(copy)


PLANTED_SQL = (
    "v_features AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS features,"
    " CASE WHEN label < 8 THEN concat('f', CAST(label AS STRING)) END AS generator, label FROM embeddings),"
    " v_planted AS (SELECT * FROM v_features UNION ALL SELECT id + 1000000,"
    " list_transform(features, lambda x, i: CASE WHEN i <= 4 THEN 0e0 ELSE x END), generator, label FROM v_features WHERE id % 10 = 0)"
)


def phash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """62-bit perceptual hashes: the signs of the first components."""
    return planted(spark, sf_dir).selectExpr(
        "id", "aggregate(sequence(0, 61), 0L, (h, i) -> h + CASE WHEN features[i] > 0 THEN shiftleft(1L, i) ELSE 0L END) AS hash", "label"
    )


PHASH_SQL = (
    PLANTED_SQL + ", v_phash AS (SELECT id, CAST(list_sum(list_transform(range(0, 62),"
    " lambda i: CASE WHEN features[i + 1] > 0 THEN 1::BIGINT << i ELSE 0 END)) AS BIGINT) AS hash, label FROM v_planted)"
)
