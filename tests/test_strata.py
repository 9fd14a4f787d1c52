import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from kelpline.operators import metrics, vectors
from kelpline.sources.session import with_checkpoints


def test_stratified_split_equals_a_plain_one(spark):
    """One stratum holds most rows, some have no name or only one row."""
    with_checkpoints(spark)
    rows = [(i, "hot" if i % 10 else None, "a" if i % 7 else None) for i in range(700)] + [(1000, "single", "b")]
    out = {r["id"]: r["split"] for r in vectors.stratified_split(spark.createDataFrame(rows, "id long, x string, y string"), ["x", "y"], 0.2, "s").collect()}
    groups = defaultdict(list)
    for i, x, y in rows:
        groups[x, y].append(i)
    for ids in groups.values():
        ids.sort(key=lambda i: (hashlib.md5(f"s{i}".encode()).hexdigest(), i))
        n = max(1, int(len(ids) * 0.2 + 0.5))
        assert {i for i in ids if out[i] == "test"} == set(ids[:n])
    assert out[1000] == "test" and len(out) == len(rows)


def test_no_window_is_over_a_stratum(spark):
    with_checkpoints(spark)
    rows = spark.range(1000).select("id", F.lit("one").alias("x"))
    plan = vectors.stratified_split(rows, ["x"], 0.2, "s")._jdf.queryExecution().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert all("_range" in line for line in windows)


def test_pools_are_taken_from_one_table_of_counts(spark):
    """Slices without a name count among the reals of the detector only."""
    with_checkpoints(spark)
    rows = [("d", "g", 1, s) for s in (0.9, 0.4)] + [("d", None, 0, 0.5), ("d", "h", 0, 0.1), ("d", None, 1, 0.3), ("e", "g", 1, 0.2)]
    df = spark.createDataFrame(rows, "detector string, slice string, label int, score double")
    out = {(r["detector"], r["slice"]): (r["n_fake"], r["n_real"], r["auroc"]) for r in metrics.against_pool(df, "detector", "slice", 2).collect()}
    assert out == {("d", "g"): (2, 2, 0.75)}
    own = {(r["detector"], r["slice"]): (r["real_src"], r["n_fake"], r["n_real"], r["auroc"]) for r in metrics.against_own_pool(df, "detector", "slice", 1).collect()}
    assert own[("d", "g")] == ("global", 2, 2, 0.75)
    plan = metrics.against_pool(df, "detector", "slice", 2)._jdf.queryExecution().toString()
    assert "LocalTableScan" not in plan and "LogicalRDD" in plan
