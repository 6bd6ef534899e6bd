"""Run queries against their SQL in DuckDB and compare the rows."""

import math
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float, Decimal)):
        f = float(v)
        return repr(int(f)) if f == int(f) and abs(f) < 1e15 else repr(f)
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, run, sql, sf_dir):
    """None if equal, else a text on the difference."""
    frame = run(spark, sf_dir)
    got = [tuple(r) for r in frame.collect()]
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = rows_of(frame.columns, got), rows_of(names, want)
    if a != b:
        return (f"{sum((a - b).values())} of {len(got)} rows differ: "
                f"{list((a - b))[:2]} != {list((b - a))[:2]}")
    return None
