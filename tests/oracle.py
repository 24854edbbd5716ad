"""Run one named query on Spark and its SQL on DuckDB and tell how they differ."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def compare(spark, con, query, sql: str, folder: str) -> tuple[str, float]:
    """'ok' or what differs, and the Spark seconds."""
    start = time.time()
    df = query(spark, folder)
    got = df.collect()
    took = time.time() - start
    names = df.columns
    cursor = con.execute(sql)
    found = [(d[0], str(d[1])) for d in cursor.description]
    rows = cursor.fetchall()
    if sorted(names) != sorted(n for n, _ in found):
        return f"columns {names} != {[n for n, _ in found]}", took
    types = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    wrong = {n: (types[n], t) for n, t in found if types[n] != t}
    order = sorted(names)
    place = {n: i for i, (n, _) in enumerate(found)}
    left = sorted(tuple(_norm(r[n]) for n in order) for r in got)
    right = sorted(tuple(_norm(r[place[n]]) for n in order) for r in rows)
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}", took
    for a, b in zip(left, right):
        if a != b:
            return f"values {order}: {[(x[:300], y[:300]) for x, y in zip(a, b) if x != y]}", took
    if wrong:
        return f"types {wrong}", took
    return "ok", took
