import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpline.operators import folds, learning, metrics, noise, selection
from kelpline.sources.session import with_checkpoints
from tests.test_folds import example


def plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_places(spark):
    with_checkpoints(spark)
    random.seed(2)
    rows = [(random.choice("aaaab"), random.choice([0.5, 0.5, 0.1, random.random()]), i) for i in range(300)]
    got = {r.id: (r.place, r.size) for r in selection.placed(spark.createDataFrame(rows, "g string, v double, id long"), ["g"], ["v", "id"]).collect()}
    for g in "ab":
        mine = sorted((v, i) for h, v, i in rows if h == g)
        assert all(got[i] == (k, len(mine)) for k, (_, i) in enumerate(mine))


@pytest.mark.parametrize("buckets", [2, 5, 1024])
def test_nth_values_and_quantiles(spark, buckets):
    with_checkpoints(spark)
    random.seed(3)
    values = {"a": [random.choice([0.5, random.random(), -1e9, 1e-9]) for _ in range(200)], "b": [7.0], "c": [1.0] * 50}
    rows = [(g, v) for g, vs in values.items() for v in vs]
    counts = spark.createDataFrame(rows, "g string, v double").groupBy("g", "v").agg(F.count("*").alias("n"))
    wanted = [(g, k) for g, vs in values.items() for k in {1, 2, len(vs) // 2 + 1, len(vs), len(vs) + 1}]
    got = selection.nth(counts, ["g"], "v", "n", spark.createDataFrame(wanted, "g string, nth long"), buckets)
    for r in got.collect():
        assert r.found == (sorted(values[r.g])[r.nth - 1] if r.nth <= len(values[r.g]) else None)
    for q in (0.0, 0.3, 0.95, 1.0):
        got = {r.g: r.quantile for r in selection.quantiles(counts, ["g"], "v", "n", q, buckets).collect()}
        assert got == pytest.approx({g: float(np.quantile(v, q)) for g, v in values.items()}, rel=1e-12)


def test_ranks_have_no_window_over_a_detector(spark):
    with_checkpoints(spark)
    df = spark.createDataFrame([("d", "v", 1, 0.5, 1)], "detector string, video string, label int, score double, seq long")
    ranked = plan(metrics.rank_normalized(df))
    assert "_range" in ranked and not re.search(r"windowspecdefinition\(detector#\d+, (?!_range)", ranked)
    assert "percentile" not in plan(metrics.tpr_at_fpr(df, ["detector"]))


def plain_issues(rows):
    labels = sorted({s for _, s, _ in rows})
    cut = {s: np.mean([p[s] for _, t, p in rows if t == s]) for s in labels}
    joint = {(s, s): 0 for s in labels}
    for _, s, p in rows:
        sure = [k for k in range(len(p)) if k in cut and p[k] >= cut[k]]
        if sure:
            k = max(sure, key=lambda k: (p[k], -k))
            joint[s, k] = joint.get((s, k), 0) + 1
    for s in labels:
        joint[s, s] = max(1, joint[s, s])
    found = set()
    for (s, k), n in joint.items():
        size, total = sum(t == s for _, t, _ in rows), sum(m for (t, _), m in joint.items() if t == s)
        prune = n * size // total
        if s != k and prune:
            margins = sorted((round(p[k] - p[s], 9) for _, t, p in rows if t == s), reverse=True)
            found |= {i for i, t, p in rows if t == s and round(p[k] - p[s], 9) >= margins[min(prune, len(margins)) - 1]}
    return {(i, s, int(np.argmax(p))) for i, s, p in rows if i in found and int(np.argmax(p)) != s}


def test_label_issues_equal_plain_python(spark):
    with_checkpoints(spark)
    random.seed(4)
    rows = []
    for i in range(240):
        true, p = i % 3, [random.random() * 0.5 for _ in range(3)]
        p[true] += 0.8
        p = [round(x / sum(p), 2) for x in p]  # ties
        rows.append((f"v{i}", true if i % 8 else (true + 1) % 3, p))
    df = spark.createDataFrame(rows, "item string, label int, probs array<double>")
    got = {(r.item, r.given, r.suggested) for r in noise.label_issues(df).collect()}
    assert got == plain_issues(rows) and len(got) >= 15
    planted = {f"v{i}" for i in range(0, 240, 8)}
    assert len({i for i, _, _ in got} & planted) / len(got) > 0.9


def test_chains_end_and_cycles_are_named(spark):
    with_checkpoints(spark)
    to = {1: None, 2: 1, 3: 2, 4: 3, 10: 12, 11: 10, 12: 11, 9: 12, 8: 9, 20: 20, 21: 20, 30: 99, 31: 30, 50: 51, 51: 50}
    to |= {k: k - 1 for k in range(101, 400)} | {100: None}
    got = {r.id: (r.canonical, r.cycle, r.stale) for r in folds.pointer_chains(spark.createDataFrame(list(to.items()), "id long, duplicate_of_id long")).collect()}
    want = {1: 1, 2: 1, 3: 1, 4: 1, 20: 20, 21: 20} | dict.fromkeys(range(100, 400), 100)
    assert got == {i: (e, None, False) for i, e in want.items()} | {30: (99, None, True), 31: (99, None, True)} | {i: (10, 10, False) for i in (8, 9, 10, 11, 12)} | {50: (50, 50, False), 51: (50, 50, False)}


def test_refolding_touched_components_equals_folding_all(spark):
    rows, pairs, df, pair_df = example(spark)
    state = folds.folded_state(df, pair_df)
    # Some rows change quality, some go, some come with pairs that join components.
    changed = {3: 9, 11: 0}
    rows2 = [(i, s, changed.get(i, q)) for i, s, q in rows if i not in (5, 40)] + [(200, 50, 2), (201, 1, 1)]
    pairs2 = [p for p in pairs if not {5, 40} & set(p[:2])] + [(7, 200, 9), (200, 30, 3)]
    df2, pair2 = spark.createDataFrame(rows2, df.schema), spark.createDataFrame(pairs2, pair_df.schema)
    ids = spark.createDataFrame([(i,) for i in (3, 11, 5, 40, 200, 201)], "id long")
    got = {tuple(r) for r in folds.refolded(df2, pair2, state, ids).collect()}
    assert got == {tuple(r) for r in folds.folded_state(df2, pair2).collect()}


def test_folds_of_classes_and_known_answers(spark):
    with_checkpoints(spark)
    rng = np.random.default_rng(1)
    names = ["x"] * 43 + ["y"] * 21 + ["z"] * 12
    centers = {"x": [4.0, 0, 0], "y": [0, 40.0, 0], "z": [0, 0, 0.4]}
    rows = [(i, (np.array(centers[g]) + rng.normal(size=3) * [0.3, 3, 0.03]).tolist(), g) for i, g in enumerate(names)] + [(1000, [0.0] * 3, None)]
    out = learning.cross_validated(spark.createDataFrame(rows, "id long, features array<double>, generator string")).collect()
    assert len(out) == len(names) and all(r.predicted == r.generator == r.top3[0] and sorted(r.top3) == ["x", "y", "z"] for r in out)
    for g in "xyz":
        sizes = [sum(r.generator == g and r.fold == f for r in out) for f in range(5)]
        assert max(sizes) - min(sizes) <= 1
    blobs = [(i, (np.eye(3)[i % 3] * 50 + rng.normal(size=3)).tolist()) for i in range(90)]
    best = learning.kmeans_sweep(spark.createDataFrame(blobs, "id long, features array<double>"), [2, 3, 5]).first()
    assert best.k == 3 and best.silhouette > 0.9
    sides = [(i, (rng.normal(size=2) + (3 if i % 2 else -3)).tolist(), i % 2) for i in range(200)]
    assert learning.linear_probe(spark.createDataFrame(sides, "id long, features array<double>, label int")).first().auroc > 0.99


def test_early_stop(spark):
    series = {"a": [1.0, 2.0, 2.0, 1.0, 3.0, 9.0], "b": [1.0, 2.0, 3.0], "c": [None, float("nan"), 1.0], "d": [5.0, 1.0, 1.0, 9.0], "e": [None, None]}
    df = spark.createDataFrame([(s, k, v) for s, vs in series.items() for k, v in enumerate(vs)], "s string, k int, v double")
    got = {r.s: tuple(r)[1:] for r in learning.early_stop(df, "s", "k", "v", 2).collect()}
    assert got == {"a": (1, 2.0, 4, True), "b": (2, 3.0, 3, False), "c": (None, None, 2, True), "d": (0, 5.0, 3, True), "e": (None, None, 2, True)}


def test_feature_sets_must_agree(spark):
    with_checkpoints(spark)
    make = lambda ids: spark.createDataFrame([(i, [float(i), 1.0]) for i in ids], "id long, features array<double>")
    out = {r.id: (r.one, r.two, r.features) for r in learning.aligned_features([make([1, 2]), make([2, 1])], ["one", "two"]).collect()}
    assert out == {i: ([i, 1.0], [i, 1.0], [i, 1.0, i, 1.0]) for i in (1.0, 2.0)}
    for other in ([1], [1, 1], [1, 3]):
        with pytest.raises(ValueError):
            learning.aligned_features([make([1, 2]), make(other)], ["one", "two"])
