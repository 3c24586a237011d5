"""Spark rows against DuckDB rows: same columns, same values, any order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def show(x):
    if isinstance(x, float):
        return "nan" if x != x else repr(x)
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(show, x)) + "]"
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).hex()
    return repr(x)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted("|".join(map(show, r)) for r in df.select(*cols).collect())


def duck_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    at = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted("|".join(show(r[i]) for i in at) for r in cur.fetchall())


def check(df, sql, sf_dir):
    assert spark_rows(df) == duck_rows(sql, sf_dir)
