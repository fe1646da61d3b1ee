"""Compares a query with its SQL on the same tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(value):
    if isinstance(value, float):
        return None if value != value else repr(round(value, 8))
    return None if value is None else str(value)


def assert_same(df, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in sorted(want.columns)]
    expected = sorted(([shown(r[i]) for i in at] for r in want.fetchall()), key=str)
    got = sorted(([shown(r[c]) for c in sorted(df.columns)] for r in df.collect()), key=str)
    assert got == expected
