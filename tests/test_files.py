import hashlib

import pytest

from kelpline.sources import files


def test_scores(spark, tmp_path):
    (tmp_path / "npr.jsonl").write_text('{"video": "a.b.mp4", "label": 1, "score": 0.5}\nbroken\n{"detector": "x", "video": "c.mp4", "label": 0, "score": 1}\n')
    rows = {tuple(r) for r in files.read_scores(spark, str(tmp_path)).collect()}
    assert rows == {("npr", "a.b.mp4", 1, 0.5, "a.b"), ("x", "c.mp4", 0, 1.0, "c")}
    with pytest.raises(Exception):
        files.read_scores(spark, str(tmp_path), skip_malformed=False).collect()


def test_annotations(spark, tmp_path):
    (tmp_path / "a.csv").write_text("label,youtube_id,time_start,time_end,split\ng,v,1,11,test\nbad,w,x,11,test\nlong,u,0,100,test\nnone,t,5,5,test\n")
    assert [tuple(r) for r in files.read_annotations(spark, str(tmp_path)).collect()] == [("g", "v", 1.0, 11.0, 10.0, "test")]


def test_manifest(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"id": "1", "title": "a", "crawled_at": "1"}\n{"id": "1", "title": "b", "crawled_at": "2"}\n{"id": "2", "content_tags": ["x"]}\n')
    assert {(r.id, r.title) for r in files.read_manifest(spark, str(tmp_path)).collect()} == {("1", "b"), ("2", None)}


def test_blobs(spark, tmp_path):
    (tmp_path / "v.mp4").write_bytes(b"clip")
    r = files.read_blobs(spark, str(tmp_path)).first()
    assert (r.id, r.size, r.sha256) == ("v", 4, hashlib.sha256(b"clip").hexdigest())


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "train"), (2, "b", "test"), (2, "b", "test")], "id long, t string, split string")
    for _ in range(2):
        files.append_new(df, str(tmp_path / "p"), "id long, t string, split string", ["id"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    files.write_split(df, str(tmp_path / "s"))
    assert (tmp_path / "s" / "split=test").is_dir() and spark.read.json(str(tmp_path / "s")).count() == 3
    files.write_table(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 3
    assert files.markdown(df.limit(1)).split("\n")[0] == "| id | t | split |"
