
import corpus_pipeline
from kelpline.llm import decontamination, near_dedup


def test_stages(spark, sf_dir, documents, odd_documents, no_documents):
    docs, columns = documents, documents.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, docs, sf_dir)
        assert new.columns == columns, name
        docs = new.cache()
    kept = {r.doc_id for r in docs.collect()}
    classes = near_dedup.near_duplicates(documents).collect()
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    dirty = {r.doc_id for r in decontamination.contamination(documents, bench).where("contaminated").collect()}
    assert kept == {r.doc_id for r in classes if r.kept} - dirty
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == kept
    for table, rows in ((odd_documents, None), (no_documents, 0)):
        out = table
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, sf_dir)
        assert rows is None or out.count() == rows


def test_one_row_of_each_group_stays(spark, odd_documents, sf_dir):
    out = corpus_pipeline.drop_near_duplicates(spark, odd_documents, sf_dir)
    ids = [r.doc_id for r in out.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 5, 8, 10]


def test_rows_count_for_their_own_text(spark, sf_dir):
    """A doc_id with different texts loses only the copies and contaminated ones; rows without doc_id are no exception."""
    bench = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("length(text) > 200").orderBy("item_id").limit(1).collect()]
    own = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(5)]
    rows = [(1, own[0]), (7, own[0]), (7, own[1]), (7, own[2]), (7, own[2]), (7, bench[0]), (None, own[3]), (None, own[3]), (None, own[1]), (None, own[4])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = corpus_pipeline.drop_near_duplicates(spark, df, sf_dir)
    key = lambda r: (str(r[0]), r[1])
    want = [(1, own[0]), (7, own[1]), (7, own[2]), (7, bench[0]), (None, own[3]), (None, own[4])]
    assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key)
    dirty = spark.createDataFrame([*want, (None, bench[0])], df.schema)
    out = corpus_pipeline.drop_contaminated(spark, dirty, sf_dir)
    assert sorted(map(tuple, out.collect()), key=key) == sorted((w for w in want if w[1] != bench[0]), key=key)
