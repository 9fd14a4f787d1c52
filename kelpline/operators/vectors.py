"""Vectors: nearest neighbours in blocks, bit hashes by bands, canonical rows, clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.operators import selection

ROWS_A_SHARD = 8192
QUERIES_A_BLOCK = 1024


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0e0), lambda s, x: s + x)


def nearest(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """query_id, id, sim and rank of the k rows most similar by inner product; a query's own id is left out.

    Queries are dealt in blocks and rows in shards of bounded size, and each pair of these is one task's group.
    """
    n, m = rows.count(), queries.count()
    shards, blocks = max(1, -(-n // ROWS_A_SHARD)), max(1, -(-m // QUERIES_A_BLOCK))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Both sides' keys are ints: cogroup does not cast them, and equal numbers of two types are dealt to different tasks.
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = queries.select("id", "features", dealt(blocks).alias("block"), each(shards).alias("shard"))
    right = rows.select("id", "features", dealt(shards).alias("shard"), each(blocks).alias("block"))

    def best(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if q.empty or x.empty:
            return pd.DataFrame({"query_id": [], "id": [], "sim": []})
        x = x.sort_values("id", ignore_index=True)
        ids, vectors = x["id"].to_numpy(), np.stack(x["features"])
        out = []
        for query_id, v in zip(q["id"], q["features"], strict=True):
            sims = np.zeros(len(ids))
            for j in range(vectors.shape[1]):  # in the order of components, so that sums round as elsewhere
                sims += vectors[:, j] * v[j]
            sims[ids == query_id] = -np.inf
            top = np.lexsort((ids, -sims))[:k]
            out.append(pd.DataFrame({"query_id": query_id, "id": ids[top], "sim": sims[top]}))
        return pd.concat(out).query("sim > -inf")

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(best, "query_id long, id long, sim double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def bands(hash_: str, most: int, bits: int) -> Column:
    """The most + 1 bands of a hash, as structs of band and key."""
    cuts = [bits * i // (most + 1) for i in range(most + 2)]
    return F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(hash_, cuts[i]).bitwiseAND((1 << (cuts[i + 1] - cuts[i])) - 1).alias("key")) for i in range(most + 1)])


def hamming_pairs(hashes: DataFrame, most: int = 6, bits: int = 62) -> DataFrame:
    """a < b and distance of distinct hashes at most `most` bits apart.

    Of most // 2 + 1 bands of two such hashes one differs in one bit at most (if all differed in two, there would be more than
    `most`).  So each hash is put under its bands and looked up under all that differ from its own in one bit or none: bands are
    twice as wide as those that must be equal, and a key holds far fewer rows.
    hashes: id, hash.  Equal hashes are one node, named by the least id.
    """
    nodes = hashes.groupBy("hash").agg(F.min("id").alias("id"))
    banded = nodes.select("id", "hash", F.explode(bands("hash", most // 2, bits)).alias("part")).select("id", "hash", "part.*")
    width = -(-bits // (most // 2 + 1))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k).cast("long") for k in range(width)])
    left = banded.select(F.col("id").alias("a"), F.col("hash").alias("x"), "band", F.explode(F.transform(flips, lambda bit: F.col("key").bitwiseXOR(bit))).alias("key"))
    right = banded.select(F.col("id").alias("b"), F.col("hash").alias("y"), "band", "key")
    distance = F.bit_count(F.col("x").bitwiseXOR(F.col("y")))
    return left.join(right, ["band", "key"]).where("a < b").select("a", "b", distance.alias("distance")).where(F.col("distance") <= most).distinct()


def canonical(rows: DataFrame, group: str) -> DataFrame:
    """The row of each group that stands for it: largest area, then frame rate, then duration, then earliest crawl."""
    area = F.coalesce(F.col("resolution_w").cast("long") * F.col("resolution_h"), F.lit(0))
    rank = [area.desc(), F.coalesce("fps", F.lit(0e0)).desc(), F.coalesce("duration_sec", F.lit(0e0)).desc(), F.col("crawled_at").asc_nulls_last(), F.col("id").asc()]
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*rank))).where("_n = 1").drop("_n")


def clusters(videos: DataFrame) -> DataFrame:
    """canonical, member_count and n_platforms of rows that others point at directly; pointers to no row are skipped."""
    dup = videos.where("duplicate_of_id IS NOT NULL").select(F.col("duplicate_of_id").alias("canonical"), "source_platform")
    own = videos.select(F.col("id").alias("canonical"), F.col("source_platform").alias("own_platform"))
    counts = dup.groupBy("canonical").agg(F.count("*").alias("n"), F.collect_set("source_platform").alias("platforms"))
    out = counts.join(own, "canonical")
    platforms = F.size(F.array_union("platforms", F.array("own_platform")))
    return out.select("canonical", (F.col("n") + 1).alias("member_count"), platforms.alias("n_platforms"))


def purity(rows: DataFrame, cluster: str, truth: str) -> DataFrame:
    """Share of rows that have their cluster's commonest label."""
    counts = rows.groupBy(cluster, truth).count()
    best = counts.groupBy(cluster).agg(F.max("count").alias("best"), F.sum("count").alias("n"))
    return best.agg((F.sum("best") / F.sum("n")).alias("purity"), F.sum("n").alias("n"))


def stratified_split(rows: DataFrame, strata: list[str], share: float, seed: str) -> DataFrame:
    """rows with split (test or train): of each stratum the first round(share * size), one at least, by keyed hash.

    Places come from ranges of (stratum, hash), so a stratum that holds most rows is dealt over many tasks.
    """
    order = F.md5(F.concat(F.lit(seed), F.col("id").cast("string")).cast("binary"))
    known = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in strata]  # nulls are a stratum of their own
    name = F.concat_ws("\0", *[F.concat(F.when(F.col(c).isNull(), "-").otherwise("+"), k) for c, k in zip(strata, known, strict=True)])
    ranked = selection.placed(rows.withColumn("_stratum", name).withColumn("_hash", order), ["_stratum"], ["_hash", "id"])
    n = F.greatest(F.lit(1), F.round(F.col("size") * share))
    return ranked.withColumn("split", F.when(F.col("place") < n, "test").otherwise("train")).drop("_stratum", "_hash", "place", "size")
