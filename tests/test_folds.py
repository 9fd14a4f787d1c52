import random

import pytest
from pyspark.sql import functions as F

from kelpline.operators import folds, learning
from kelpline.sources.session import with_checkpoints


def example(spark):
    random.seed(5)
    rows = [(i, random.randint(0, 30), random.randint(0, 4)) for i in range(60)]
    pairs = sorted({tuple(sorted(random.sample(range(60), 2))) for _ in range(70)})
    pairs = [(a, b, random.randint(1, 9)) for a, b in pairs]
    with_checkpoints(spark)
    return rows, pairs, spark.createDataFrame(rows, "id long, seq long, quality long"), spark.createDataFrame(pairs, "a long, b long, sim long")


@pytest.mark.parametrize("in_task", [folds.IN_TASK, 0, 12])
def test_greedy_duplicates(spark, in_task):
    rows, pairs, df, pair_df = example(spark)
    quality, near = {i: q for i, _, q in rows}, {}
    for a, b, s in pairs:
        near.setdefault(a, []).append((-s, b))
        near.setdefault(b, []).append((-s, a))
    alive, points = set(), {}
    for i, _, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        best = min((x for x in near.get(i, []) if x[1] in alive), default=None)
        if best and quality[i] < quality[best[1]]:
            points[i] = best[1]
            continue
        if best:
            points[best[1]] = i
            alive.remove(best[1])
        alive.add(i)
    got = {r.id: r.duplicate_of_id for r in folds.greedy_duplicates(df, pair_df, in_task=in_task).collect()}
    assert got == {i: points.get(i) for i, _, _ in rows}
    ends = {r.id: r.canonical for r in folds.resolve_chains(folds.greedy_duplicates(df, pair_df)).collect()}

    def end(i):
        return end(points[i]) if i in points else i

    assert ends == {i: end(i) for i, _, _ in rows}


@pytest.mark.parametrize("in_task", [folds.IN_TASK, 0])
def test_existing_wins(spark, in_task):
    rows, pairs, df, pair_df = example(spark)
    near, points = {}, {}
    for a, b, s in pairs:
        near.setdefault(a, []).append((-s, b))
        near.setdefault(b, []).append((-s, a))
    alive = set()
    for i, _, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        best = min((x for x in near.get(i, []) if x[1] in alive), default=None)
        if best:
            points[i] = best[1]
        else:
            alive.add(i)
    got = {r.id: r.duplicate_of_id for r in folds.greedy_duplicates(df, pair_df, existing_wins=True, in_task=in_task).collect()}
    assert got == {i: points.get(i) for i, _, _ in rows}


@pytest.mark.parametrize("in_task", [folds.IN_TASK, 0])
def test_leader_clusters(spark, in_task):
    rows, pairs, df, pair_df = example(spark)
    close = {(a, b) for a, b, _ in pairs} | {(b, a) for a, b, _ in pairs}
    leaders, want = [], {}
    for i, _, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        want[i] = next((x for x in leaders if (i, x) in close), i)
        if want[i] == i:
            leaders.append(i)
    assert {r.id: r.cluster for r in folds.leader_clusters(df, pair_df, in_task=in_task).collect()} == want


def test_no_pairs(spark):
    _, _, df, pair_df = example(spark)
    assert folds.greedy_duplicates(df, pair_df.limit(0)).where("duplicate_of_id IS NOT NULL").count() == 0
    assert folds.leader_clusters(df, pair_df.limit(0)).where(F.col("cluster") != F.col("id")).count() == 0


def test_agreement_of_equal_labellings(spark):
    df = spark.createDataFrame([(i % 3, i % 3 + 5) for i in range(30)], "x long, y long")
    r = learning.agreement(df, "x", "y").first()
    assert abs(r.nmi - 1) < 1e-9 and abs(r.ari - 1) < 1e-9
