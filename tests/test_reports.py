import json

from pyspark.sql import functions as F

from kelpline.functions import arrays
from kelpline.functions import text as T
from kelpline.operators import curation, reports
from kelpline.sources import files


def test_iso_micros(spark):
    known = {
        "2024-01-01": 1704067200, "2024-01-01T10:20": 1704104400, "2024-01-01 10:20:30": 1704104430, "2024-01-01T10:20:30+08:00": 1704075630, "2024-01-01T10:20:30Z": 1704104430,
        "2024-02-30": None, "2024-01-01T25:00:00": None, "01/02/2024": None, "": None, "soon": None, None: None,
    }
    rows = spark.createDataFrame([(k,) for k in known], "t string").select("t", T.iso_micros(F.col("t")).alias("us")).collect()
    assert {r["t"]: r["us"] for r in rows} == {k: None if v is None else v * 1_000_000 for k, v in known.items()}


def test_age_cutoff(spark):
    now = F.lit(10**15)
    row = spark.range(1).select(T.age_cutoff(now, 2).alias("a"), T.age_cutoff(now, 0).alias("b"), T.age_cutoff(now, None).alias("c")).first()
    assert tuple(row) == (10**15 - 2 * 86_400_000_000, None, None)


def test_frame_rate_and_sample_times(spark):
    row = spark.range(1).select(*[T.frame_rate(F.lit(t)) for t in ("30000/1001", "25/0", "x/1", "24")], T.sample_times(F.lit(10.0), 3), T.sample_times(F.lit(1.0), 1), T.sample_times(F.lit(None).cast("double"), 2)).first()
    assert abs(row[0] - 29.97002997) < 1e-8 and tuple(row)[1:4] == (None, None, None)
    assert row[4] == [0.5, 5.0, 9.5] and row[5] == [0.1] and row[6] == [None, None]


def test_arrays(spark):
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([1000.0, 1000.0],)], "v array<double>")
    rows = v.select(arrays.normalised(F.col("v")).alias("n"), arrays.softmax(F.col("v")).alias("s")).collect()
    assert rows[0]["n"] == [0.6, 0.8] and rows[1]["n"] == [0.0, 0.0] and rows[1]["s"] == [0.5, 0.5] and rows[2]["s"] == [0.5, 0.5]
    known = {"0": 0, "ff": 255, "FFFFFFFFFFFFFFFF": -1, "8000000000000000": -(2**63), "xyz": None, "": None, "1" * 17: None, None: None}
    rows = spark.createDataFrame([(k,) for k in known], "t string").select("t", arrays.hex_number(F.col("t")).alias("n")).collect()
    assert {r["t"]: r["n"] for r in rows} == known


def test_recent_orders_ties_and_nulls(spark):
    runs = spark.createDataFrame([(1, "a", "2024-01-02"), (2, "a", "2024-01-02"), (3, "b", None), (4, "b", "2024-01-01"), (5, None, "2024-01-03")], "id long, flow string, at string")
    assert [(r["id"], r["place"]) for r in curation.recent(runs, "at", "id", 4).orderBy("place").collect()] == [(5, 1), (2, 2), (1, 3), (4, 4)]
    assert {(r["flow"], r["id"]) for r in curation.recent(runs, "at", "id", 1, "flow").collect()} == {("a", 2), ("b", 4), (None, 5)}
    assert curation.recent(runs.limit(0), "at", "id", 4).count() == 0


def test_documents_are_read_back(spark, tmp_path):
    results = spark.createDataFrame([("d", "g2", 7, 9, 0.51236), ("d", "g1", 5, 9, 1.0), ("e", 'odd "name"', 6, 2, 0.0)], "detector string, generator string, n_fake long, n_real long, auroc double")
    path = str(tmp_path / "results")
    files.write_documents(reports.documents(results, "generator", 5), path)
    files.write_documents(reports.documents(results, "generator", 5), path)  # again: the same files
    found = {r["name"]: json.loads(r["value"]) for r in spark.read.text(path).select("name", "value").collect()}
    assert found["d"] == {"min_fake": 5, "max_n_fake": 7, "results": [{"slice": "g1", "n_fake": 5, "n_real": 9, "auroc": 1.0}, {"slice": "g2", "n_fake": 7, "n_real": 9, "auroc": 0.5124}]}
    assert found["e"]["results"][0]["slice"] == 'odd "name"'


def test_with_blobs_keeps_rows_with_a_file(spark, tmp_path):
    for name in ("1.mp4", "deep/3.mp4", "x.mp4"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"0")
    videos = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (None, "e")], "id long, title string")
    assert sorted(r["title"] for r in curation.with_blobs(videos, files.blob_names(spark, str(tmp_path))).collect()) == ["a", "b", "d"]


def test_withdrawn_takes_copies_and_writes_errata(spark):
    videos = spark.createDataFrame([(1, "p", "x"), (2, "p", "x"), (3, "q", "x"), (4, None, None)], "id long, source_platform string, source_id string")
    requests = spark.createDataFrame([("p", "x", None), ("p", "x", "owner"), ("p", "none", "z"), (None, None, "w")], "source_platform string, source_id string, reason string")
    artefacts = {"manifest": videos.select("id", "source_id"), "test": videos.where("id > 1").select("id")}
    left, errata = curation.withdrawn(artefacts, videos, requests)
    assert {name: sorted(r["id"] for r in rows.collect()) for name, rows in left.items()} == {"manifest": [3, 4], "test": [3, 4]}
    assert sorted(tuple(r) for r in errata.collect()) == [("manifest", 1, "owner"), ("manifest", 2, "owner"), ("test", 2, "owner")]
    assert left["manifest"].columns == ["id", "source_id"]


def test_hard_counts_by_hand(spark):
    items = spark.createDataFrame([(1, True, "a", None), (1, False, "a", "g"), (0, True, "a", None), (1, True, "b", "g")], "label int, is_hard boolean, platform string, generator string")
    out = reports.hard_counts(items, {"fp": (1, "platform", 1), "fg": (1, "generator", 2), "rp": (0, "platform", 1)})
    assert {tuple(r) for r in out.collect()} == {("fp", "a", 1, 2, 0.5), ("fp", "b", 1, 1, 1.0), ("fg", "g", 1, 2, 0.5), ("rp", "a", 1, 1, 1.0)}
