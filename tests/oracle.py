"""Comparison of a DataFrame with the rows of a DuckDB query."""

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in TABLES.split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else value


def same_rows(df, con, sql):
    columns = sorted(df.columns)
    relation = con.sql(sql)
    assert sorted(relation.columns) == columns
    theirs = {c: str(t) for c, t in zip(relation.columns, relation.types, strict=True)}
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == theirs
    key = lambda row: tuple(repr(x) for x in row)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    order = [relation.columns.index(c) for c in columns]
    assert ours == sorted((tuple(plain(r[i]) for i in order) for r in relation.fetchall()), key=key)
