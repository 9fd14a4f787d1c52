import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, node string, bucket long"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and blank texts, a very long text, ties, repeated rows, and columns named like those of operators."""
    long = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
    some = " ".join(f"word{i}" for i in range(120))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, long), (5, some), (6, some), (6, some), (7, some + " end"), (None, some), (8, "one two"), (9, "One  TWO"), (10, "\u0000  é ß 可灵 😀 mail@ex.org 1.2.3.4")]
    rows = [(i, t, "en" if i else None, None, None, "n", 1) for i, t in rows]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
