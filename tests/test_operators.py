import pytest
from pyspark.sql import functions as F

from kelpline.functions import text as T
from kelpline.operators import curation, metrics, vectors


def scores(spark, rows):
    return spark.createDataFrame(rows, "detector string, video string, score double, label int, seq long")


def test_auroc_ties(spark):
    rows = [("d", "a", 0.9, 1, 1), ("d", "b", 0.5, 1, 2), ("d", "c", 0.5, 0, 3), ("d", "e", 0.1, 0, 4), ("one", "a", 0.5, 1, 5)]
    out = {r.detector: r for r in metrics.auroc(scores(spark, rows), ["detector"], {"ff": "fakes_first", "mid": "midrank"}).collect()}
    assert (out["d"].ff, out["d"].mid) == (1.0, 0.875)
    assert out["one"].ff is None and out["one"].mid is None


def test_auroc_empty(spark):
    assert metrics.all_metrics(scores(spark, []), ["detector"]).count() == 0


def test_rank_normalized_breaks_ties_by_item(spark):
    rows = [("d", "b", 0.5, 1, 1), ("d", "a", 0.5, 1, 2), ("d", "c", 0.1, 0, 3), ("d", "c", 0.9, 0, 4)]
    out = {r.video: r.rank_norm for r in metrics.rank_normalized(scores(spark, rows)).collect()}
    assert out == {"a": 0.0, "b": 0.5, "c": 1.0}


@pytest.mark.parametrize(
    ("row", "reason"),
    [
        ((0, 1280, 720, 5.0), "corrupt"), ((None, 0, 0, 5.0), None), ((1, None, None, None), None), ((1, 1280, 720, 5.0), None),
        ((1, 576, 1024, 5.0), None), ((1, 720, 300, 5.0), "resolution"), ((1, 1280, 720, 0.0), "duration"), ((1, 1280, 720, 2.9), "duration"),
        ((1, 1280, 720, 3.0), None), ((1, 1280, 720, 300.0), None), ((1, 1280, 720, 300.1), "duration"),
    ],
)
def test_quality(spark, row, reason):
    df = spark.createDataFrame([row], "file_size_bytes long, resolution_w int, resolution_h int, duration_sec double")
    rule = curation.quality_reason(min_resolution=720, min_short_edge=400, min_duration=3, max_duration=300)
    assert df.select(rule.alias("r")).first().r == reason


def column(spark, value, expression):
    df = spark.createDataFrame([(value,)], "x string")
    return df.select(expression(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("name", "found"),
    [
        ("sora", "sora2"), ("sora 1", "sora1"), ("Veo-3", "veo3"), ("veo 2", "veo2"), ("kling 1.6", "kling1"), ("kling 2.1", "kling21"), ("可灵2.1", "kling21"),
        ("gen-3", "runway-gen3"), ("runway", "runway-gen4"), ("svd", "stable_video_diffusion"), ("wan 2.1", "wan21"), ("", None), ("none", None), (None, None),
    ],
)
def test_generator(spark, name, found):
    assert column(spark, name, T.generator) == found


@pytest.mark.parametrize(("clock", "seconds"), [("12", 12.0), ("0", None), ("-1", None), ("1:05", 65.0), ("1:00:05", 3605.0), ("a:b", None), (None, None)])
def test_duration(spark, clock, seconds):
    assert column(spark, clock, T.duration_seconds) == seconds


@pytest.mark.parametrize(
    ("tags", "platform"), [('["p:x","p:y"]', "x"), ('["lang:en"]', "p"), ("{bad", "p"), (None, "p"), ("[]", "p")]
)
def test_umbrella_platform(spark, tags, platform):
    assert column(spark, tags, lambda t: T.umbrella_platform(F.lit("p"), t)) == platform


def test_tag_rescue(spark):
    df = spark.createDataFrame([(["AI music"],), (["AI music", "video tool"],), (None,)], "tags array<string>")
    assert [r.x for r in df.select(T.tag_rule(F.col("tags"), ["music"], ["tool"]).alias("x")).collect()] == [True, False, False]


def test_judged(spark):
    df = spark.createDataFrame(
        [(None, None, None, ""), (None, None, "late", "t"), (True, 0.7, None, "t"), (True, 0.69, None, "t"), (False, 0.99, None, "t")],
        "ai boolean, conf double, err string, text string",
    )
    kept = curation.judged(F.col("ai"), F.col("conf"), F.col("err"), F.col("text"))
    assert [r.k for r in df.select(kept.alias("k")).collect()] == [True, True, True, False, False]


def test_upsert_policies(spark):
    schema = "id long, title string, published_at string, status string"
    old = spark.createDataFrame([(1, "a", "p", "reviewed"), (2, "b", None, "filtered")], schema)
    new = spark.createDataFrame([(1, None, None, "filtered", 1), (3, "x", "q", "filtered", 1), (3, "y", None, "excluded", 2)], schema + ", seq int")
    out = {r.id: tuple(r)[1:] for r in curation.upsert(old, new, ["id"], ["title"], ["published_at"], ["status"]).collect()}
    assert out == {1: (None, "p", "reviewed", "updated"), 2: ("b", None, "filtered", "kept"), 3: ("y", None, "excluded", "inserted")}


def test_hamming_pairs_finds_all(spark):
    import random

    random.seed(4)
    base = [random.getrandbits(62) for _ in range(40)]
    near = [b ^ sum(1 << k for k in random.sample(range(62), random.randint(0, 8))) for b in base]
    rows = [(i, h) for i, h in enumerate(base + near)]
    first = {}
    for i, h in rows:
        first.setdefault(h, i)
    want = {(a, b) for x, a in first.items() for y, b in first.items() if a < b and bin(x ^ y).count("1") <= 6}
    got = vectors.hamming_pairs(spark.createDataFrame(rows, "id long, hash long"))
    assert {(r.a, r.b) for r in got.collect()} == want


def test_stream_adds_each_key_once(spark, tmp_path):
    from kelpline.streaming.windows import ingest

    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "platform string, id long"
    spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], schema).write.parquet(source)
    spark.createDataFrame([("b", 2)], schema).write.parquet(sink)
    for _ in range(2):
        stream = spark.readStream.schema(schema).parquet(source)
        known = lambda: spark.read.schema(schema).parquet(sink)
        ingest(stream, known, ["platform", "id"], lambda rows: rows.write.mode("append").parquet(sink), str(tmp_path / "log")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(sink).collect())) == [("a", 1), ("b", 2)]
