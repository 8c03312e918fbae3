"""Comparing a query's rows with its SQL run by DuckDB."""

import datetime
import decimal
import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (int, decimal.Decimal)) and not isinstance(v, bool):
        return f"{v:f}".rstrip("0").rstrip(".") if isinstance(v, decimal.Decimal) and "." in f"{v:f}" else str(int(v)) if v == int(v) else str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in found)


def same(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    result = duck(sf_dir).execute(sql)
    wanted = rows([d[0] for d in result.description], result.fetchall())
    assert got[0] == wanted[0]
    assert got[1] == wanted[1]
