"""Runs a query and its SQL side by side."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v != v or str(v) in ("<NA>", "NaT", "None"):
        return None
    if isinstance(v, bool):
        return str(v)
    try:
        f = float(v)
        return round(f, 4) + 0.0 if math.isfinite(f) else str(f)
    except (TypeError, ValueError):
        return str(v)


def rows(pdf):
    return sorted((tuple(plain(v) for v in r) for r in pdf[sorted(pdf.columns)].itertuples(index=False)), key=str)


def check(spark, sf_dir, query, sql):
    a, b = query(spark, sf_dir).toPandas(), connection(sf_dir).execute(sql).fetchdf()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
