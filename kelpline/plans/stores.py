"""Registered queries on what is kept between runs: vector stores, and indexes within streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpline.operators.vector_store import VectorStore
from kelpline.plans.learning import NODES_SQL, fold_sql
from kelpline.sources import adapters as A
from kelpline.sources.session import new_folder, with_checkpoints
from kelpline.streaming import dedup

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(
    f"WITH {A.PLANTED_SQL}, b AS (SELECT id, features FROM v_planted WHERE id % 10 <> 9), u AS (SELECT id, list_transform(features, lambda x: x * -1.5e0) AS features FROM v_planted WHERE id % 10 IN (8, 9)),"
    " n AS (SELECT * FROM u UNION ALL SELECT * FROM b WHERE id % 10 <> 8), v AS (SELECT * FROM n WHERE id % 7 <> 0),"
    " s AS (SELECT q.id AS query_id, x.id, list_sum(list_transform(list_zip(q.features, x.features), lambda p: p[1] * p[2])) AS sim FROM v_planted q JOIN v x ON q.id <> x.id WHERE q.id % 20 = 0),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, id) AS rank FROM s) SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(sim, 6) AS sim FROM r WHERE rank <= 5"
)
def vector_store_search(spark, sf_dir):
    """The five nearest in a store after a batch put in new and changed vectors, others were deleted, and the store was compacted."""
    rows = A.planted(with_checkpoints(spark), sf_dir).select("id", "features")
    store = VectorStore.create(rows.where("id % 10 <> 9"), new_folder(spark, "vectors"))
    store.upsert(rows.where("id % 10 IN (8, 9)").select("id", F.transform("features", lambda x: x * -1.5).alias("features")), 1)
    store.delete(rows.where("id % 7 = 0").select("id"), 2)
    store.compact()
    found = store.search(rows.where("id % 20 = 0"), 5)
    return found.select("query_id", "rank", "id", F.round("sim", 6).alias("sim"))


@query(f"WITH RECURSIVE {A.PHASH_SQL}, k AS ({NODES_SQL}), {fold_sql()} SELECT k.id, t.duplicate_of_id FROM k LEFT JOIN t USING (id)")
def stream_dedup(spark, sf_dir):
    """Pointers of a stream that comes in two runs, originals and then copies, with the index of the first in its state.

    The pointers are those of a fold over all rows in the order of ids, which the SQL does: ids of copies are the larger ones.
    """
    folder, log, source = (new_folder(with_checkpoints(spark), f"stream-{x}") for x in ("tables", "log", "source"))
    hashes = A.phash(spark, sf_dir).groupBy("hash").agg(F.min("id").alias("id"))
    rows = hashes.select("id", F.col("id").alias("seq"), F.pmod("id", F.lit(7)).alias("quality"), "hash")
    for part in (rows.where("id < 1000000"), rows.where("id >= 1000000")):
        part.write.mode("append").parquet(source)
        dedup.dedup_stream(spark.readStream.schema(dedup.ROW).parquet(source), folder, log).awaitTermination()
    return dedup.pointers(spark, folder)
