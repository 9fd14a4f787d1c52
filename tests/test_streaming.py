import random

from pyspark.sql import functions as F

from kelpline.operators import folds, vectors
from kelpline.sources.session import with_checkpoints
from kelpline.streaming import dedup

ROW = "id long, seq long, quality long, hash long"


def chained_rows(n=150):
    """Hashes in chains of near ones, so that losers, chains and rows that replace others occur."""
    random.seed(11)
    hashes = [random.getrandbits(62) for _ in range(n // 5)]
    rows = []
    for i in range(n):
        h = random.choice(hashes)
        for k in random.sample(range(62), random.choice([0, 1, 3, 5, 9])):
            h ^= 1 << k
        hashes.append(h)
        rows.append((i, i // 2, random.randint(0, 3), h))
    return rows


def test_batches_and_a_restart_give_the_fold_of_all_rows(spark, tmp_path):
    with_checkpoints(spark)
    rows = chained_rows()
    df = spark.createDataFrame(rows, ROW)
    hashes = {i: h for i, _, _, h in rows}
    pairs = [(a, b, -bin(hashes[a] ^ hashes[b]).count("1")) for a in hashes for b in hashes if a < b and bin(hashes[a] ^ hashes[b]).count("1") <= 6]
    want = {r.id: r.duplicate_of_id for r in folds.greedy_duplicates(df, spark.createDataFrame(pairs, "a long, b long, sim long")).collect()}
    source, folder, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    for start, end in ((0, 50), (50, 51), (51, 150)):
        part = spark.createDataFrame([*rows[start:end], (None, 1, 1, 1), (10**6 + start, 1, 1, None), rows[0]], ROW)
        part.coalesce(1).write.mode("append").parquet(source)
        dedup.dedup_stream(spark.readStream.schema(ROW).parquet(source), folder, log).awaitTermination()  # goes on from the log
    got = {r.id: r.duplicate_of_id for r in dedup.pointers(spark, folder).collect()}
    assert got == want and len(set(want.values())) > 10
    # A batch that is run again writes the same again.
    found = spark.createDataFrame([(149, rows[149][1], rows[149][2], rows[149][3], None, None)], dedup.FOUND)
    before = sorted(map(tuple, spark.read.parquet(folder + "/rows").collect()))
    number = 1 + max(r.batch for r in spark.read.parquet(folder + "/rows").select("batch").distinct().collect())
    for _ in range(2):
        dedup.decide(found, number, folder)
    assert sorted(map(tuple, spark.read.parquet(folder + "/rows").collect())) == before
    assert {(r.id, r.hash) for r in spark.read.parquet(folder + "/rows").collect()} == set(hashes.items())
    # Rows that lost in the first batches have left the state; row 0 came again later.
    state = spark.read.format("statestore").option("path", log).option("stateVarName", "rows").load()
    held = {r.id for r in state.select("user_map_key.id").collect()}
    gone = {r.id: r.batch for r in spark.read.parquet(folder + "/gone").collect()}
    assert held >= {i for i, to in got.items() if to is None} and not held & {i for i, n in gone.items() if n < max(gone.values()) and i}


def test_late_rows_go_aside_and_a_replay_changes_nothing(spark, tmp_path):
    with_checkpoints(spark)
    frozen = spark.createDataFrame([("2024-01", 1), ("2024-02", 5)], "month string, frozen_batch long")
    sink = dedup.closed_window_sink(str(tmp_path / "s"), frozen, F.substring("at", 1, 7))
    batches = [[(1, "2024-01-03"), (2, "2024-02-01")], [(3, "2024-01-09"), (4, "2024-02-09"), (5, None)], [(6, "2024-01-31")]]
    for number in (0, 1, 1, 2, 0):
        sink(spark.createDataFrame(batches[number], "id long, at string"), number)
    ids = lambda name: sorted(r.id for r in spark.read.parquet(str(tmp_path / "s" / name)).collect())
    assert ids("open") == [1, 2, 4, 5] and ids("late") == [3, 6]
