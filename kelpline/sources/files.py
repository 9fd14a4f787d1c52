"""Readers and writers of the file forms that scores, manifests, splits and annotations come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpline.functions import text as T

SCORE_FILE = "detector string, video string, label int, score double"
ANNOTATION_FILE = "label string, youtube_id string, time_start string, time_end string, split string"
MANIFEST_FILE = (
    "id string, source_platform string, source_url string, source_id string, label string, label_source string, claimed_generator string,"
    " duration_sec double, resolution_w int, resolution_h int, fps double, file_size_bytes bigint, blob_sha256 string, has_watermark boolean,"
    " title string, content_tags array<string>, published_at string, crawled_at string"
)


def read_scores(spark: SparkSession, path: str, skip_malformed: bool = True) -> DataFrame:
    """Scores from JSON lines of one or many files; rows without a detector take it from the name of their file.

    Malformed lines are skipped, or else end the read.
    """
    mode = "DROPMALFORMED" if skip_malformed else "FAILFAST"
    rows = spark.read.schema(SCORE_FILE).option("mode", mode).json(path)
    named = F.regexp_extract(F.input_file_name(), r"([^/]+)\.jsonl?$", 1)
    return rows.select(F.coalesce("detector", F.nullif(named, F.lit(""))).alias("detector"), "video", "label", "score", T.file_stem(F.col("video")).alias("video_id"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest of JSON lines; of lines with one id the one latest crawled counts."""
    rows = spark.read.schema(MANIFEST_FILE).option("mode", "DROPMALFORMED").json(path)
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.col("crawled_at").desc_nulls_last(), F.to_json(F.struct("*"))))
    return rows.withColumn("_n", last).where("_n = 1").drop("_n")


def read_annotations(spark: SparkSession, path: str, longest: float = 60.0) -> DataFrame:
    """Clips of a CSV with a header: rows whose times are no numbers, or that are too long or not positive, are left out."""
    rows = spark.read.schema(ANNOTATION_FILE).option("header", True).csv(path)
    start, end = F.col("time_start").try_cast("double"), F.col("time_end").try_cast("double")
    clips = rows.select("label", "youtube_id", start.alias("time_start"), end.alias("time_end"), (end - start).alias("duration"), "split")
    return clips.where((F.col("duration") > 0) & (F.col("duration") <= longest))


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """id, size and sha256 of the files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(T.file_stem(name).alias("id"), "path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def blob_names(spark: SparkSession, path: str) -> DataFrame:
    """path and id (the name without its ending) of the files under a path; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", T.file_stem(F.element_at(F.split("path", "/"), -1)).alias("id"))


def append_new(rows: DataFrame, path: str, schema: str, keys: list[str]) -> None:
    """Append the rows whose keys a Parquet folder does not have yet; running it again adds nothing."""
    spark = rows.sparkSession
    try:
        known = spark.read.schema(schema).parquet(path).select(*keys)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = rows.limit(0).select(*keys)
    rows.dropDuplicates(keys).join(known, keys, "left_anti").write.mode("append").parquet(path)


def write_split(rows: DataFrame, path: str) -> None:
    """JSON lines in one folder for each split."""
    rows.write.mode("overwrite").partitionBy("split").json(path)


def write_table(rows: DataFrame, path: str) -> None:
    """CSV with a header."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_manifest(entries: DataFrame, path: str) -> None:
    """A manifest as JSON lines, by version."""
    entries.write.mode("overwrite").partitionBy("version").json(path)


def write_documents(documents: DataFrame, path: str) -> None:
    """Result documents (name, document): a folder for each name, whose file holds its documents, one a line."""
    documents.select("name", "document").write.mode("overwrite").partitionBy("name").text(path)


def markdown(rows: DataFrame, most: int = 100) -> str:
    """A report of at most `most` rows as a Markdown table."""
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "-|" * len(rows.columns)]
    for row in rows.limit(most).collect():
        lines.append("| " + " | ".join("" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x) for x in row) + " |")
    return "\n".join(lines)
