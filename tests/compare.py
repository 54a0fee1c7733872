"""Run registered queries and their SQL twins side by side."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if not os.path.exists(f"{sf_dir}/{t}.parquet"):
            continue
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return v


def _bag(rows) -> Counter:
    return Counter(tuple(_plain(v) for v in r) for r in rows)


def difference(spark_df, con, sql: str) -> str | None:
    """None when both have the same columns and rows, else what differs."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns: spark {sorted(spark_df.columns)} sql {sorted(names)}"
    order = sorted(names)
    theirs = _bag(
        tuple(row[names.index(c)] for c in order) for row in rel.fetchall()
    )
    ours = _bag(tuple(r) for r in spark_df.select(*(f"`{c}`" for c in order)).collect())
    if ours == theirs:
        return None
    only_ours, only_theirs = list((ours - theirs).items()), list((theirs - ours).items())
    return (
        f"rows: spark {sum(ours.values())} sql {sum(theirs.values())}; {order}; "
        f"only spark {len(only_ours)} {only_ours[:2]}; only sql {len(only_theirs)} {only_theirs[:2]}"
    )
