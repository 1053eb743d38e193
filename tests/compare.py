"""Rows of Spark and of DuckDB, compared without order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in found), key=repr)


def same(df, con, sql):
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    want = rows([d[0] for d in cursor.description], cursor.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in cursor.description)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == b
