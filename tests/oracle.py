"""Runs a query and its SQL on the same tables and compares rows, whatever their order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(value(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(sorted((k, value(x)) for k, x in v.asDict().items()))
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    out = [tuple(value(r[k]) for k in order) for r in rows]
    return sorted(names), sorted(out, key=lambda r: [(x is None, str(type(x)), str(x)) for x in r])


def database(sf_dir):
    db = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        db.execute(f"create view {f.stem} as select * from '{f}'")
    return db


def compare(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    rel = database(sf_dir).sql(sql)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    theirs = rows_of(rel.columns, rel.fetchall())
    assert mine[0] == theirs[0]
    assert len(mine[1]) == len(theirs[1])
    for a, b in zip(mine[1], theirs[1], strict=True):
        assert a == b
