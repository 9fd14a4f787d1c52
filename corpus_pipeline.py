"""A training corpus from documents: language ID, near-dedup, decontamination, surrogates for personal data, packing.

Each stage takes (spark, docs, sf_dir) and gives the next stage's documents, with the columns of documents; the last gives
the pieces of packed sequences.  Columns that docs has besides pass through; a stage's own columns don't.  Empty tables,
null texts and repeated rows are defined as in the operators; a null text has no language and goes in the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.llm import decontamination, language_id, near_dedup, packing, pii
from kelpline.llm.common import stored, table

#: A text is rejected if no language holds this share of its words: far under that of texts in two languages.
LEAST_SHARE = 0.3
BROADCAST_ROWS = 200_000


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs without the given rows (doc_id, which may be null, and digest), broadcast only if their count is small."""
    gone = stored(rows.select("doc_id", "digest").distinct(), "pipeline-gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.xxhash64("d.text") == F.col("g.digest"))
    return docs.alias("d").join(gone.alias("g"), same, "left_anti").select(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; rejected are texts without letters and texts of no language."""
    found = language_id.languages(docs, language_id.train(docs))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: of its least doc_id, without doc_id only if all are.  Of rows equal in doc_id and text one stays."""
    kept = _without(docs, near_dedup.one_of_each(docs.select("doc_id", "text")).where("NOT stays"))
    keys = kept.select("doc_id", F.xxhash64("text").alias("digest"))
    repeated = stored(keys.groupBy("doc_id", "digest").count().where("count > 1").select("doc_id", "digest"), "pipeline-repeated")
    if repeated.isEmpty():
        return kept
    same = F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.xxhash64("d.text") == F.col("r.digest"))
    again = kept.alias("d").join(repeated.alias("r"), same, "left_semi").select(*kept.columns).dropDuplicates(["doc_id", "text"])
    return _without(kept, repeated).union(again)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not contaminated by the benchmark; each text counts for itself, also without doc_id."""
    judged = decontamination.contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"), digests=True)
    return _without(docs, judged.where("contaminated"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; n_chars follows the new text."""
    new = pii.pseudonymized(docs)
    return new.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else new


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return packing.pack_sequences(docs.select("doc_id", "text"), 2048)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_personal_data),
    ("packing", pack),
]
#: Labels, sketches, surrogates and curve order are beyond SQL: tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
    return docs
