"""Registered queries about harvested records, made from documents as JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpline.operators import crawl
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


#: A post of a platform: its own video, a repeated post's, a link, or none; label flags at two depths; a length or none.
RECORD = (
    "concat('{\"id\":', CAST(doc_id AS STRING), CASE doc_id % 5 WHEN 0 THEN ',\"media\":{\"reddit_video\":{\"fallback_url\":\"https://v.redd.it/own\"}}'"
    " WHEN 1 THEN ',\"crosspost\":{\"media\":{\"reddit_video\":{\"fallback_url\":\"https://v.redd.it/repeated\"}}}' WHEN 2 THEN ',\"url\":\"https://ex.org/a.MP4?x=1\"'"
    " WHEN 3 THEN ',\"url\":\"https://ex.org/a.html\"' ELSE ',\"url\":\"https://www.youtube.com/w\"' END,"
    " CASE doc_id % 7 WHEN 0 THEN ',\"aigc\":{\"label\":1}' WHEN 1 THEN ',\"aigc\":{\"label\":0}' WHEN 2 THEN ',\"is_ai\":true' WHEN 3 THEN ',\"is_ai\":false' ELSE '' END,"
    " CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat(',\"duration\":', CAST(doc_id % 90 AS STRING)) END, '}')"
)
RECORDS_SQL = f"WITH j AS (SELECT doc_id AS id, {RECORD} AS record, source FROM documents)"


def records(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").selectExpr("doc_id AS id", f"{RECORD} AS record", "source")


@query(
    RECORDS_SQL + " SELECT id, coalesce(json_extract_string(record, '$.media.reddit_video.fallback_url'), json_extract_string(record, '$.crosspost.media.reddit_video.fallback_url'),"
    " CASE WHEN regexp_matches(regexp_replace(lower(json_extract_string(record, '$.url')), '[?#].*$', ''), '\\.(mp4|webm|mov|gifv)$')"
    " OR contains(lower(json_extract_string(record, '$.url')), 'youtube.com') THEN json_extract_string(record, '$.url') END) AS video_url FROM j"
)
def post_video_url(spark, sf_dir):
    return records(spark, sf_dir).select("id", crawl.video_url(F.col("record")).alias("video_url"))


LABELLED = "(coalesce(json_extract_string(record, '$.aigc.label') NOT IN ('0', 'false', 'null', ''), false) OR coalesce(json_extract_string(record, '$.is_ai') NOT IN ('0', 'false', 'null', ''), false))"


@query(RECORDS_SQL + f", l AS (SELECT source, {LABELLED} AS labelled FROM j) SELECT source, count(*) FILTER (labelled) AS required, count(*) FILTER (NOT labelled) AS forbidden, count(*) AS skipped FROM l GROUP BY 1")
def platform_gate(spark, sf_dir):
    flag = crawl.any_flag(F.col("record"), ["$.aigc.label", "$.is_ai"])
    counts = [F.count_if(crawl.platform_gate(F.col("flag"), m)).alias(n) for m, n in (("require", "required"), ("forbid", "forbidden"), ("skip", "skipped"))]
    return records(spark, sf_dir).select("source", flag.alias("flag")).groupBy("source").agg(*counts)


@query(
    RECORDS_SQL + ", d AS (SELECT id, CAST(json_extract_string(record, '$.duration') AS DOUBLE) AS d FROM j)"
    " SELECT id, coalesce(d BETWEEN 5 AND 60, false) AS rejecting, coalesce(d BETWEEN 5 AND 60, true) AS passing, coalesce(d, 0) BETWEEN 0 AND 60 AS zeroing FROM d"
)
def duration_policies(spark, sf_dir):
    d = records(spark, sf_dir).select("id", F.get_json_object("record", "$.duration").try_cast("double").alias("d"))
    kept = lambda low, policy: crawl.duration_kept(F.col("d"), low, 60, policy)
    return d.select("id", kept(5, "reject").alias("rejecting"), kept(5, "pass").alias("passing"), kept(0, "zero").alias("zeroing"))


@query("WITH t AS (SELECT doc_id AS id, [upper(source), lang] AS tags FROM documents) SELECT id, list_has_any(list_transform(tags, lambda t: lower(t)), ['src1', 'src2', 'de']) AS gaming FROM t")
def gaming_tags(spark, sf_dir):
    t = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array(F.upper("source"), "lang").alias("tags"))
    return t.select("id", crawl.gaming(F.col("tags"), ["src1", "src2", "de"]).alias("gaming"))
