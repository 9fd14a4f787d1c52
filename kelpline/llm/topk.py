"""Exact highest inner products by best-first search in M-trees.

Vectors are scaled to whole numbers.  For a query q and a vector x with squared norm at most M, the distance of (q, 0) and
(x, sqrt(M - |x|^2)) squares to |q|^2 + M - 2 q.x, so the nearest vectors in that metric are those with the highest inner
product.  Rows are dealt over shards of bounded size; each shard is an M-tree whose pages are rows of a stored table: a
page lists routing vectors with covering radii, or vectors, each with its distance to the page's own routing vector.
A search takes the page with the best bound next; stored distances and the triangle inequality rule out entries before
any product is computed.  Only bounds that are strictly worse end a search, so ties are exact.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpline.llm.common import stored

SHARD_ROWS = 16_384
QUERY_ROWS = 512
PAGE = 256
FANOUT = 8
PAGES = "dim int, shard int, page int, leaf boolean, ids binary, counts binary, vectors binary, lifts binary, radii binary, to_parent binary"


def whole_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v (array<long>): floor(scale * x) of each component; rows that take no part are left out.

    Left out are rows whose vec_id or vector is null, whose vector is empty or holds a null, NaN or infinite component.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)))
    rows = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.coalesce(finite, F.lit(False)))
    whole = F.transform(x, lambda c: F.floor(c * scale).cast("long"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def build_tree(ids: np.ndarray, vectors: np.ndarray, lifts: np.ndarray, seed: int = 1) -> list[tuple]:
    """Pages (page, leaf, ids, vectors, lifts, radii, distances to the page's routing vector); page 0 is the root.

    For a page of routing entries ids holds the numbers of their pages.
    """
    pages: list[tuple] = []
    rng = np.random.default_rng(seed)
    lifted = np.concatenate([vectors.astype(np.float64), lifts[:, None]], axis=1)

    def apart(rows: np.ndarray, center: int) -> np.ndarray:
        return np.sqrt(((lifted[rows] - lifted[center]) ** 2).sum(axis=1))

    def make(rows: np.ndarray, center: int) -> int:
        number = len(pages)
        pages.append(())
        if len(rows) <= PAGE:
            pages[number] = (number, True, ids[rows], vectors[rows], lifts[rows], np.zeros(len(rows)), apart(rows, center))
            return number
        pivots = rng.choice(rows, FANOUT, replace=False)
        owner = np.stack([apart(rows, p) for p in pivots], axis=1).argmin(axis=1)
        if np.bincount(owner, minlength=FANOUT).max() > 0.9 * len(rows):  # many equal vectors: deal them out evenly
            owner = np.arange(len(rows)) % FANOUT
        used = [k for k in range(FANOUT) if (owner == k).any()]
        children = [make(rows[owner == k], pivots[k]) for k in used]
        at = pivots[used]
        radii = np.array([apart(rows[owner == k], pivots[k]).max() for k in used])
        pages[number] = (number, False, np.array(children), vectors[at], lifts[at], radii, apart(at, center))
        return number

    make(np.arange(len(ids)), 0)
    return pages


def search_tree(pages: dict[int, tuple], query_id: int, query: np.ndarray, norm: float, k: int) -> list[tuple[int, int]]:
    """The k best (score, vec_id) of a tree, best first; norm is M.  pages: leaf, ids, counts (equal rows), vectors, lifts,
    radii, to_parent.  One row that equals the query in vec_id and vector is its own."""
    own = float(query @ query)
    slack = 1e-6 * (own + norm + 1)  # distances are rounded, products are not
    best: list[tuple[int, int]] = []  # heap of (score, -vec_id), the worst first
    heap: list[tuple[float, int, float]] = [(-np.inf, 0, np.nan)]
    while heap:
        bound, number, to_center = heapq.heappop(heap)
        if len(best) == k and -bound < best[0][0]:
            break
        leaf, ids, counts, vectors, lifts, radii, to_parent = pages[number]
        least = best[0][0] if len(best) == k else -np.inf
        near = np.arange(len(ids))
        if not np.isnan(to_center):
            gap = np.maximum(0.0, np.abs(to_parent - to_center) - radii)
            near = np.flatnonzero((own + norm - gap * gap) / 2 + slack >= least)
        scores = vectors[near] @ query
        if leaf:
            hits = near[scores >= least]
            for at, score, vec_id, count in zip(hits.tolist(), scores[scores >= least].tolist(), ids[hits].tolist(), counts[hits].tolist(), strict=True):
                own_row = vec_id == query_id and bool((vectors[at] == query).all())
                for _ in range(min(k, count - own_row)):
                    if len(best) < k:
                        heapq.heappush(best, (int(score), -vec_id))
                    elif (score, -vec_id) > best[0]:
                        heapq.heapreplace(best, (int(score), -vec_id))
            continue
        squares = (vectors[near].astype(np.float64) ** 2).sum(axis=1) + lifts[near] ** 2
        far = np.sqrt(np.maximum(0.0, own + squares - 2 * scores.astype(np.float64)))
        closest = np.maximum(0.0, far - radii[near])
        bounds = (own + norm - closest * closest) / 2 + slack
        for b, child, d in zip(bounds.tolist(), ids[near].tolist(), far.tolist(), strict=True):
            if b >= least:
                heapq.heappush(heap, (-b, child, d))
    return [(score, -negative) for score, negative in sorted(best, reverse=True)]


def _numbers(v: pd.Series, dim: int, top: int) -> np.ndarray:
    """Rows of whole numbers: doubles where all products are exact in them, else Python's integers."""
    exact = top * top * dim < 1 << 52
    return np.array(v.tolist(), dtype=np.float64 if exact else object)


def inner_product_top_k(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k rows of vectors with the highest inner products with each query.

    Both: vec_id and v (array<long>), as whole_vectors gives them.  Vectors are compared with queries of their length
    only; a query's own row is left out; ties go to the smaller vec_id; where fewer than k rows are left, all are given.
    Every row is a candidate, also those that share a vec_id or equal another; equal queries are answered once, different
    ones of one vec_id each.  Empty tables give no rows.
    """
    vectors = vectors.groupBy("vec_id", "v").agg(F.count("*").alias("count"))
    vectors = stored(vectors.withColumn("dim", F.size("v")), "topk-vectors")
    largest = F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))
    squares = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    # One row for each length of vector that occurs.
    spread = stored(
        vectors.groupBy("dim").agg(F.count("*").alias("n"), F.max(squares).alias("norm"), F.max(largest).alias("top")), "topk-spread"
    )
    shards = spread.select("dim", "norm", "top", F.ceil(F.col("n") / SHARD_ROWS).cast("int").alias("shards"))
    dealt = vectors.join(shards, "dim").withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.col("shards")).cast("int"))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id", ignore_index=True)
        counts = rows["count"].to_numpy(np.int64)
        dim, norm = int(rows["dim"][0]), float(rows["norm"][0])
        v = np.array(rows["v"].tolist(), np.int64)
        as_float = v.astype(np.float64)
        lifts = np.sqrt(np.maximum(0.0, norm - (as_float**2).sum(axis=1)))
        out = []
        for number, leaf, ids, vectors, lift, radii, away in build_tree(np.arange(len(rows)), v, lifts):
            # Leaves hold places of rows; routing entries hold pages.
            names, number_of = (rows["vec_id"].to_numpy(np.int64)[ids], counts[ids]) if leaf else (ids, np.ones(len(ids), np.int64))
            packed = [x.tobytes() for x in (names.astype("<i8"), number_of.astype("<i8"), vectors.astype("<i8"), lift, radii, away)]
            out.append((dim, int(rows["shard"][0]), number, leaf, *packed))
        return pd.DataFrame(out, columns=[c.split()[0] for c in PAGES.split(", ")])

    pages = stored(dealt.select("dim", "shard", "norm", "vec_id", "v", "count").groupBy("dim", "shard").applyInPandas(build, PAGES), "topk-pages")
    asked = stored(queries.select("vec_id", "v").distinct().withColumn("dim", F.size("v")), "topk-queries")
    blocks = asked.groupBy("dim").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks"))
    asked = asked.join(blocks, "dim").join(shards, "dim")
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks")).cast("int")).withColumn("query", F.xxhash64("v"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    asked = asked.select("dim", "shard", "block", "norm", "top", "vec_id", "query", "v")
    trees = pages.join(blocks, "dim").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def search(tree: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(tree) and len(block):
            dim, norm = int(block["dim"][0]), float(block["norm"][0])
            top = max(int(block["top"][0]), int(max(abs(x) for v in block["v"] for x in v)))
            exact = top * top * dim < 1 << 52
            pages = {}
            for p in tree.itertuples():
                v = np.frombuffer(p.vectors, "<i8").reshape(-1, dim)
                v = v.astype(np.float64) if exact else v.astype(object)
                arrays = (np.frombuffer(x) for x in (p.lifts, p.radii, p.to_parent))
                pages[p.page] = (p.leaf, np.frombuffer(p.ids, "<i8"), np.frombuffer(p.counts, "<i8"), v, *arrays)
            for query_id, query, q in zip(block["vec_id"].tolist(), block["query"].tolist(), _numbers(block["v"], dim, top), strict=True):
                out += [(query_id, query, vec_id, score) for score, vec_id in search_tree(pages, query_id, q, norm, k)]
        return pd.DataFrame(out, columns=["query_id", "query", "vec_id", "score"])

    found = asked.groupBy("dim", "shard", "block")
    found = trees.groupBy("dim", "shard", "block").cogroup(found).applyInPandas(search, "query_id long, query long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
