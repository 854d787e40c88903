"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import os

import pytest

from tidewell import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        path = f"{FOLDER}/{t}.parquet"
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    out = db.execute(catalogue.ORACLE[name])
    names, want = [d[0] for d in out.description], out.fetchall()
    df = catalogue.QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(names)
    got = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(repr(plain(r)) for r in want)
