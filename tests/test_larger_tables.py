"""What shows only where tables have several shards, long chains or many keys."""

import random

import pytest
from pyspark.sql import functions as F

from kelpline import catalogue
from kelpline.operators import folds, vectors
from kelpline.operators.vector_store import VectorStore
from kelpline.sources.session import with_checkpoints
from tests.oracle import same_rows


def test_nearest_finds_all_over_several_shards_and_blocks(spark, monkeypatch):
    random.seed(3)
    rows = [(i, [random.random() for _ in range(3)]) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, features array<double>")
    monkeypatch.setattr(vectors, "ROWS_A_SHARD", 9)
    monkeypatch.setattr(vectors, "QUERIES_A_BLOCK", 4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small tables would all meet in one task
    try:
        got = {(r.query_id, r.rank): r.id for r in vectors.nearest(df.where("id % 5 = 0"), df, 3).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for q, v in rows[::5]:
        sims = sorted((-sum(a * b for a, b in zip(v, x, strict=True)), i) for i, x in rows if i != q)
        want |= {(q, k + 1): sims[k][1] for k in range(3)}
    assert got == want


@pytest.mark.parametrize("name", ["pairwise_duplicates", "near_dup_summary", "refolded_duplicates", "stream_dedup"])
def test_folds_equal_their_sql_on_chains(spark, tmp_path, name):
    import duckdb

    random.seed(8)
    rows, signs = [], [1.0] * 64
    for i in range(1, 120):
        signs = [random.choice((-1.0, 1.0)) for _ in signs] if i % 12 == 0 else [-s if j in (i % 5, 7 + i % 9, 20 + i % 13) else s for j, s in enumerate(signs)]
        rows.append((i, signs, i % 10))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    same_rows(catalogue.queries()[name](spark, str(tmp_path)), con, catalogue.oracle_sql()[name])


def test_rounds_of_chains_do_not_grow_with_rows(spark, monkeypatch):
    with_checkpoints(spark)
    made, kind = [], type(spark.range(1))
    checkpoint = kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda self, *a: made.append(1) or checkpoint(self, *a))
    # Cycles of three with a row that leads to each, twenty thousand rows.
    rows = spark.range(20_000).select("id", F.expr("CASE id % 4 WHEN 0 THEN id + 1 WHEN 1 THEN id + 1 WHEN 2 THEN id + 1 ELSE id - 2 END").alias("duplicate_of_id"))
    found = folds.pointer_chains(rows)
    assert found.where("cycle <> id - id % 4 + 1 OR cycle IS NULL OR canonical <> cycle OR stale").isEmpty()
    assert len(made) <= 7


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_chains_equal_a_walk(spark, seed):
    random.seed(seed)
    with_checkpoints(spark)
    ids = random.sample(range(1000), 300)
    to = {i: random.choice(ids) if random.random() < 0.97 else random.choice((None, -i, i)) for i in ids}
    for n in (1, 2, 3, 4, 5, 8, 13):  # cycles of their own
        ring = list(range(2000 + 20 * n, 2000 + 20 * n + n))
        random.shuffle(ring)
        to |= dict(zip(ring, ring[1:] + ring[:1], strict=True)) | {1900 + n: ring[0], 1800 + n: 1900 + n}
    want = {}
    for i in to:
        passed, x = [], i
        while x in to and to[x] not in (None, x) and x not in passed:
            passed.append(x)
            x = to[x]
        low = min(passed[passed.index(x):]) if x in passed else None
        want[i] = (x if low is None else low, low, x not in to)
    got = {r.id: (r.canonical, r.cycle, r.stale) for r in folds.pointer_chains(spark.createDataFrame(list(to.items()), "id long, duplicate_of_id long")).collect()}
    assert got == want


def test_a_query_goes_to_a_bin_once(spark, tmp_path, monkeypatch):
    with_checkpoints(spark)
    random.seed(4)
    rows = spark.createDataFrame([(i, [random.gauss(0, 1) for _ in range(6)]) for i in range(200)], "id long, features array<double>")
    store = VectorStore.create(rows, str(tmp_path / "v"), pivots=16)
    dealt, visit = [], VectorStore._visit
    monkeypatch.setattr(VectorStore, "_visit", lambda self, ways, *a: dealt.append(ways.count()) or visit(self, ways, *a))
    store.visited(rows.where("id % 20 = 0"), 3)
    assert len(dealt) == 2 and max(dealt) <= 10  # all 200 rows fit one bin; once a query's copies were as many as its shards
