import os

import numpy as np
import pytest

from kelpline.operators import vector_store as S
from kelpline.sources.session import with_checkpoints

ROW = "id long, features array<double>"


def clustered(n, seed=3, dims=8, centers=20):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centers, dims)) * 4
    v = middle[rng.integers(0, centers, n)] + rng.normal(size=(n, dims)) * 0.2
    return {i: v[i].tolist() for i in range(n)}


def frame(spark, vectors):
    return spark.createDataFrame([(i, v) for i, v in vectors.items()], ROW)


def plain(vectors, queries, k):
    out = []
    for i, q in queries.items():
        sims = sorted(((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in vectors.items() if j != i))[:k]
        out += [(i, j, r + 1, round(-s, 9)) for r, (s, j) in enumerate(sims)]
    return sorted(out)


def found(store, spark, queries, k):
    return sorted((r.query_id, r.id, r["rank"], round(r.sim, 9)) for r in store.search(frame(spark, queries), k).collect())


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_search_after_writes_equals_brute_force(spark, tmp_path, monkeypatch):
    with_checkpoints(spark)
    monkeypatch.setattr(S, "ROWS", 40)  # so that shards have several parts
    vectors = clustered(600)
    vectors[600] = vectors[0]  # a tie
    store = S.VectorStore.create(frame(spark, vectors), str(tmp_path / "v"), pivots=24)
    queries = {i: vectors[i] for i in range(0, 600, 20)} | {10**6: [0.0] * 8, 10**6 + 1: (np.array(vectors[5]) * 30).tolist()}
    assert found(store, spark, queries, 5) == plain(vectors, queries, 5)
    assert store.compared(frame(spark, {i: v for i, v in queries.items() if i < 600}), 5) < 0.35 * 30 * 601
    # New, changed (one of them moves to another shard and back) and deleted vectors.
    new = {i: v for i, v in clustered(40, seed=9).items()} | {700 + i: v for i, v in clustered(15, seed=8).items()}
    for _ in range(2):  # a write that is repeated changes nothing
        store.upsert(frame(spark, new).union(spark.createDataFrame([(None, [1.0] * 8), (900, None), (901, [None] * 8)], ROW)), 1)
    first = {7: vectors[7]}
    store.upsert(frame(spark, first), 2)
    gone = [3, 7 * 3, 701, 12345]
    store.delete(spark.createDataFrame([(i,) for i in gone], "id long"), 3)
    now = {i: v for i, v in (vectors | new | first).items() if i not in gone}
    assert store.count() == len(now)
    assert found(store, spark, queries, 5) == plain(now, queries, 5)
    touched = {r.shard for r in store._changes().select("shard").distinct().collect()}
    before = files(tmp_path / "v" / "rows")
    assert set(store.compact()) == touched
    after = files(tmp_path / "v" / "rows")
    kept = {p for p in before if int(p.split("shard=")[1].split("/")[0]) not in touched}
    assert all(after[p] == before[p] for p in kept) and not {p for p in before if p not in kept} & set(after)
    assert store._changes().count() == 0 and found(store, spark, queries, 5) == plain(now, queries, 5)


def test_shards_that_run_empty_and_few_rows(spark, tmp_path):
    with_checkpoints(spark)
    vectors = clustered(6)
    store = S.VectorStore.create(frame(spark, vectors), str(tmp_path / "v"), pivots=3)
    assert found(store, spark, vectors, 9) == plain(vectors, vectors, 9)
    store.delete(frame(spark, vectors).select("id"), 1)
    assert store.search(frame(spark, vectors), 2).count() == 0
    store.compact()
    assert store.count() == 0
    store.upsert(frame(spark, {1: vectors[1]}), 2)
    assert found(store, spark, {2: vectors[2]}, 2) == plain({1: vectors[1]}, {2: vectors[2]}, 2)
    empty = S.VectorStore.create(spark.createDataFrame([], ROW), str(tmp_path / "none"))
    assert empty.search(frame(spark, vectors), 2).count() == 0
    with pytest.raises(ValueError):
        empty.upsert(frame(spark, vectors), 1)
