"""A table of vectors by pivot: upserts and deletions as changes, compaction of touched shards, exact search by bounds.

    path/pivots             shard, pivot: some of the first vectors, chosen once
    path/rows/shard=S       id, features, near (distance to the shard's pivot)
    path/changes/shard=S    the same and `at`, the number of the write; a row without features is a deletion

A vector lies in the shard of its nearest pivot.  A write appends changes: the new rows, and a deletion where a row was in another
shard before.  What holds is a row's last change, or its row.  `compact` rewrites the shards that have changes and no other;
changes of a shard are deleted after its rows are written, so a reader between the two sees the same rows.

Search is by inner product, over all rows.  A row x becomes (x, sqrt(B^2 - |x|^2)), with B the greatest length when the store was made
(a longer row gets (x, 0)), and a query q (q, 0): then the nearest of one length are those of greatest inner product, and the
triangle inequality holds, by which a row whose distance to its pivot differs too much from the query's is out.  First each query visits the shards whose pivots are
nearest, until they hold k rows; the k-th best of these is its bound.  Then it visits only shards, and there only compares with
rows, that the bound does not rule out.

A shard, however large, is cut into parts of about ROWS rows, small shards lie in bins of no more than ROWS rows together, and queries
in blocks of about QUERIES, so no task holds more than a bin and a block.  A query goes to a bin once, with the shards there that it
visits; mappers work on SLICE rows at a time, whose distances to all pivots they hold.  Pivots are at most MOST_PIVOTS vectors, which
tasks hold; all else is joined by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpline.sources.session import delete, exists

ROWS, QUERIES, MOST_PIVOTS, SLICE = 8192, 4096, 1024, 256
#: Distances are rounded; a bound within this much of one, for vectors of length 1, does not rule out.
SLACK = 1e-6
ROW = "id long, features array<double>, near double, shard int"
VISIT = "query_id long, q array<double>, bin int, shards array<int>, away array<double>, bounds array<double>"


def _lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with a last component that makes all as long as the longest."""
    return np.hstack([vectors, np.sqrt(np.maximum(longest**2 - (vectors**2).sum(axis=1), 0))[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * a @ b.T, 0))


def _slices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for at in range(0, len(f), SLICE):
            yield f.iloc[at : at + SLICE]


def _bins(sizes: dict[int, int]) -> dict[int, tuple[int, int]]:
    """The first bin of each shard and how many it has: bins of its own for one of more than ROWS rows, a part of one for others."""
    out: dict[int, tuple[int, int]] = {}
    new, held = 0, ROWS
    for shard in sorted(sizes):
        n, parts = sizes[shard], -(-sizes[shard] // ROWS)
        if parts > 1:
            out[shard], new = (new, parts), new + parts
        elif held + n > ROWS:
            out[shard], room, new, held = (new, 1), new, new + 1, n
        else:
            out[shard], held = (room, 1), held + n
    return out


def _square(vector: str) -> Column:
    return F.aggregate(vector, F.lit(0e0), lambda s, x: s + x * x)


@dataclass
class VectorStore:
    """Vectors (id long, features array<double>) under a path that all executors share."""

    spark: SparkSession
    path: str

    @classmethod
    def create(cls, rows: DataFrame, path: str, pivots: int | None = None) -> VectorStore:
        """A store of rows; pivots (default: the square root of their number) are the rows of the least hashes of id."""
        store, n = cls(rows.sparkSession, path), rows.count()
        longest = rows.agg(F.max(F.sqrt(_square("features")))).first()[0] or 1.0
        m = min(MOST_PIVOTS, pivots or max(1, int(n**0.5)))
        chosen = rows.select("features").orderBy(F.xxhash64("id"), "id").limit(m)
        place = F.row_number().over(Window.orderBy("features")) - 1  # at most MOST_PIVOTS rows
        chosen.select(place.alias("shard"), F.col("features").alias("pivot"), F.lit(float(longest)).alias("longest")).write.parquet(f"{path}/pivots")
        if n:
            store._placed(rows).select("id", "features", "near", "shard").repartition("shard").write.partitionBy("shard").parquet(f"{path}/rows")
        return store

    def _pivots(self) -> tuple[np.ndarray, float]:
        rows = self.spark.read.parquet(f"{self.path}/pivots").orderBy("shard").collect()
        return np.array([r.pivot for r in rows], float), rows[0].longest if rows else 1.0

    def _placed(self, rows: DataFrame) -> DataFrame:
        """rows with shard and near, the distance of the lifted vector to the lifted pivot."""
        pivots, longest = self._pivots()

        def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            lifted = _lifted(pivots, longest)
            for f in _slices(frames):
                d = _distances(_lifted(np.stack(f["features"]), longest), lifted)
                yield f.assign(near=d.min(axis=1), shard=d.argmin(axis=1).astype("int32"))

        if not len(pivots):
            raise ValueError(f"{self.path} has no pivots: it was made of no rows")
        return rows.select("id", "features").mapInPandas(place, ROW)

    def _changes(self) -> DataFrame:
        schema = "id long, features array<double>, near double, at long, shard int"
        if not exists(self.spark, f"{self.path}/changes"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/changes")

    def _base(self) -> DataFrame:
        if not exists(self.spark, f"{self.path}/rows"):
            return self.spark.createDataFrame([], ROW)
        return self.spark.read.schema(ROW).parquet(f"{self.path}/rows")

    def rows(self) -> DataFrame:
        """id, features, near and shard of the vectors that hold now."""
        changes = self._changes()
        last = changes.groupBy("shard", "id").agg(F.max_by(F.struct("features", "near"), "at").alias("row"))
        last = last.select("id", "row.features", "row.near", "shard").where("features IS NOT NULL")
        kept = self._base().join(changes.select("shard", "id").distinct(), ["shard", "id"], "left_anti").select("id", "features", "near", "shard")
        return kept.unionByName(last)

    def count(self) -> int:
        return self.rows().count()

    def _write(self, changes: DataFrame) -> None:
        changes.select("id", "features", "near", "at", "shard").repartition("shard").write.mode("append").partitionBy("shard").parquet(f"{self.path}/changes")

    def _shards_of(self, ids: DataFrame) -> DataFrame:
        return self.rows().select("id", "shard").join(ids.select("id").distinct(), "id", "left_semi")

    def upsert(self, batch: DataFrame, at: int) -> None:
        """Put vectors (id, features; one row an id) in the place of those of their ids; `at` grows from write to write.

        Repeating a write with the same number changes nothing.  Vectors of null or null components are left out.
        """
        some = batch.where("id IS NOT NULL AND features IS NOT NULL AND NOT exists(features, x -> x IS NULL OR isnan(x))")
        new = self._placed(some).withColumn("at", F.lit(at).cast("long")).checkpoint()
        moved = self._shards_of(new).join(new.select("id", F.col("shard").alias("to")), "id").where("shard <> to")
        gone = moved.select("id", F.lit(None).cast("array<double>").alias("features"), F.lit(None).cast("double").alias("near"), F.lit(at).cast("long").alias("at"), "shard")
        self._write(gone.unionByName(new, allowMissingColumns=True).checkpoint())

    def delete(self, ids: DataFrame, at: int) -> None:
        """Remove the vectors of ids (id)."""
        gone = self._shards_of(ids).select("id", F.lit(None).cast("array<double>").alias("features"), F.lit(None).cast("double").alias("near"), F.lit(at).cast("long").alias("at"), "shard")
        self._write(gone.checkpoint())

    def compact(self) -> list[int]:
        """Fold changes into the rows of their shards; returns these."""
        shards = [r.shard for r in self._changes().select("shard").distinct().orderBy("shard").collect()]  # at most MOST_PIVOTS
        if shards:
            new = self.rows().where(F.col("shard").isin(shards)).checkpoint()
            left = {r.shard for r in new.select("shard").distinct().collect()}
            new.select("id", "features", "near", "shard").repartition("shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(f"{self.path}/rows")
            for s in shards:
                if s not in left:
                    delete(self.spark, f"{self.path}/rows/shard={s}")
                delete(self.spark, f"{self.path}/changes/shard={s}")
        return shards

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, id, sim and rank of the k rows of greatest inner product; a query's own id is left out, ties to the less id."""
        found = self.visited(queries, k).where("id IS NOT NULL").select("query_id", "id", "sim").distinct()
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "id"))
        return found.withColumn("rank", place).where(F.col("rank") <= k)

    def compared(self, queries: DataFrame, k: int) -> int:
        """How many pairs of query and row a search computes."""
        return self.visited(queries, k).where("id IS NULL").agg(F.coalesce(F.sum("sim"), F.lit(0e0))).first()[0]

    def visited(self, queries: DataFrame, k: int) -> DataFrame:
        """The k best of every shard part that a query visits, and a row without id whose sim counts the rows it was compared with."""
        stats = self.rows().groupBy("shard").agg(F.count("*").alias("n"), F.max("near").alias("radius"), F.min("near").alias("inner"), F.max(_square("features")).alias("most"))
        stats = {r.shard: r for r in stats.collect()}  # at most MOST_PIVOTS
        queries = queries.select(F.col("id").alias("query_id"), F.col("features").alias("q"))
        if not stats:
            return self.spark.createDataFrame([], "query_id long, id long, sim double")
        asked = queries.mapInPandas(self._nearest_shards(stats, k), "query_id long, q array<double>, shards array<int>, away array<double>").checkpoint()
        blocks, bins = max(1, -(-asked.count() // QUERIES)), _bins({s: r.n for s, r in stats.items()})
        one = self._visit(asked.mapInPandas(_first_turn(bins), VISIT), bins, blocks, k).checkpoint()
        kth = F.sort_array(F.collect_list("sim"), asc=False)  # of a query: k of each bin of its first shards
        bounds = one.where("id IS NOT NULL").groupBy("query_id").agg(F.get(kth, F.lit(k - 1)).alias("least"))
        rest = asked.join(bounds, "query_id", "left").mapInPandas(self._second_turn(stats, bins), VISIT)
        return one.unionByName(self._visit(rest, bins, blocks, k))

    def _nearest_shards(self, stats: dict, k: int):
        """A mapper of queries to the nearest shards that hold k rows besides the query's own, and the distances of their pivots."""
        pivots, longest = self._pivots()
        shards = np.array(sorted(stats), "int32")
        sizes = np.array([stats[s].n for s in shards])

        def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            lifted = _lifted(pivots[shards], longest)
            for f in _slices(frames):
                q = np.stack(f["q"])
                d = _distances(np.hstack([q, np.zeros((len(q), 1))]), lifted)
                order = np.argsort(d, axis=1, kind="stable")
                visits = (np.cumsum(sizes[order], axis=1) - sizes[order] < k + 1).sum(axis=1)
                first = [order[i, :n] for i, n in enumerate(visits)]
                yield f.assign(shards=[shards[o] for o in first], away=[d[i, o] for i, o in enumerate(first)])

        return near

    def _second_turn(self, stats: dict, bins: dict):
        """A mapper of queries (with least, the k-th best of their first shards) to the bins of further shards that it does not rule out."""
        pivots, longest = self._pivots()
        shards = np.array(sorted(stats), "int32")
        inner, radius = (np.array([getattr(stats[s], name) for s in shards]) for name in ("inner", "radius"))
        most = np.array([max(stats[s].most, longest**2) for s in shards])

        def rows(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
            lifted = _lifted(pivots[shards], longest)
            for f in _slices(frames):
                q = np.stack(f["q"])
                d = _distances(np.hstack([q, np.zeros((len(q), 1))]), lifted)
                for query_id, v, seen, away, least in zip(f["query_id"], f["q"], f["shards"], d, f["least"].to_numpy(float, na_value=np.nan), strict=True):
                    # sim = (|q|^2 + |x|^2 - d^2) / 2 with the lengths of the lifted vectors, so a least sim is a greatest distance.
                    square = float(v @ v)
                    far = np.sqrt(np.maximum(square + most - 2 * least, 0)) + SLACK * (1 + square**0.5 + np.sqrt(most))
                    bounds = np.full(len(shards), np.inf) if np.isnan(least) else far
                    on = (away - radius <= bounds) & (inner - away <= bounds) & ~np.isin(shards, seen)
                    yield query_id, v, shards[on], away[on], bounds[on]

        return lambda frames: _dealt(rows(frames), bins)

    def _visit(self, ways: DataFrame, bins: dict, blocks: int, k: int) -> DataFrame:
        spans = self.spark.createDataFrame([(s, first, parts) for s, (first, parts) in bins.items()], "shard int, first int, parts int")
        bin_ = (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int")
        ways = ways.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).checkpoint()
        held = ways.select(F.col("bin").alias("of"), F.col("block").alias("asked")).distinct()
        rows = self.rows().join(F.broadcast(spans), "shard").select(bin_.alias("of"), "shard", "id", "features", "near").join(held, "of")

        def best(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(q) and len(x):
                x = x.sort_values(["shard", "near"], ignore_index=True)
                ids, near, columns = x["id"].to_numpy(), x["near"].to_numpy(), np.ascontiguousarray(np.stack(x["features"]).T)
                here, starts = np.unique(x["shard"].to_numpy(), return_index=True)
                ends = dict(zip(here.tolist(), zip(starts.tolist(), np.append(starts[1:], len(x)).tolist(), strict=True), strict=True))
                for query_id, v, shards, away, bounds in zip(q["query_id"], q["q"], q["shards"], q["away"], q["bounds"], strict=True):
                    spans: list[list[int]] = []
                    for shard, to_pivot, bound in zip(shards.tolist(), away.tolist(), bounds.tolist(), strict=True):
                        i, j = ends.get(shard, (0, 0))
                        if bound < np.inf:
                            # By the triangle inequality only rows about as far from the pivot can be within the bound.
                            i, j = (i + np.searchsorted(near[i:j], [to_pivot - bound, np.nextafter(to_pivot + bound, np.inf)])).tolist()
                        if spans and spans[-1][1] == i:
                            spans[-1][1] = j
                        elif i < j:
                            spans.append([i, j])
                    at = slice(*spans[0]) if len(spans) == 1 else np.concatenate([np.zeros(0, int), *[np.arange(i, j) for i, j in spans]])
                    those, some = ids[at], columns[:, at]
                    sims = np.zeros(len(those))
                    for c in range(len(some)):  # in the order of components, so that sums round as elsewhere
                        sims += some[c] * v[c]
                    sims[those == query_id] = -np.inf
                    top = np.flatnonzero(sims >= np.partition(sims, -k)[-k]) if len(sims) > k else np.arange(len(sims))
                    top = top[np.lexsort((those[top], -sims[top]))][:k]
                    top = top[sims[top] > -np.inf]
                    out += [(query_id, a, s) for a, s in zip(those[top].tolist(), sims[top].tolist(), strict=True)] + [(query_id, None, float(len(those)))]
            return pd.DataFrame(out, columns=["query_id", "id", "sim"], dtype=object).astype({"query_id": "int64", "id": "Int64", "sim": "float64"})

        told = ways.groupBy("bin", "block").cogroup(rows.groupBy("of", "asked"))
        return told.applyInPandas(best, "query_id long, id long, sim double")


def _first_turn(bins: dict):
    """A mapper of queries to the bins of the shards that they visit without a bound."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for f in frames:
            for query_id, v, shards, away in zip(f["query_id"], f["q"], f["shards"], f["away"], strict=True):
                yield query_id, v, shards, away, np.full(len(shards), np.inf)

    return lambda frames: _dealt(rows(frames), bins)


def _dealt(rows: Iterator[tuple], bins: dict, most: int = 4096) -> Iterator[pd.DataFrame]:
    """Frames of VISIT, of about `most` rows: each query once for a bin, with its shards there in order."""
    names, held = [f.split()[0] for f in VISIT.split(", ")], []
    for query_id, v, shards, away, bounds in rows:
        order = np.argsort(shards)
        first, parts = np.array([bins[s] for s in shards[order].tolist()], int).reshape(-1, 2).T
        which = np.repeat(order, parts)
        to = np.repeat(first, parts) + np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
        by = np.argsort(to, kind="stable")
        for some in np.split(by, np.flatnonzero(np.diff(to[by])) + 1) if len(by) else ():
            w = which[some]
            held.append((query_id, v, int(to[some[0]]), shards[w], away[w], bounds[w]))
        if len(held) >= most:
            yield pd.DataFrame(held, columns=names).astype({"bin": "int32"})
            held = []
    if held:
        yield pd.DataFrame(held, columns=names).astype({"bin": "int32"})
