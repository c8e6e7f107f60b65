"""Holds a query's rows against its SQL in DuckDB."""

from __future__ import annotations

from collections import Counter
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def value(v):
    if isinstance(v, (float, Decimal)):
        return "nan" if v != v else round(float(v), 9)
    return tuple(map(value, v)) if isinstance(v, (list, tuple)) else v


def compare(df, con, sql):
    cols = sorted(df.columns)
    ours = Counter(tuple(value(r[c]) for c in cols) for r in df.collect())
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    place = [rel.columns.index(c) for c in cols]
    theirs = Counter(tuple(value(r[i]) for i in place) for r in rel.fetchall())
    assert ours == theirs, (list((ours - theirs).items())[:3], list((theirs - ours).items())[:3])
    return sum(ours.values())
