"""Runs a query and its SQL on the same tables and compares the rows."""

import os
from collections import Counter

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> Counter:
    cell = lambda v: "null" if not isinstance(v, (list, dict)) and pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else f"{float(v):.9g}" if isinstance(v, int) and abs(v) < 1e8 and not isinstance(v, bool) else str(v)
    return Counter(tuple(cell(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


def same(spark, query, sql: str) -> None:
    got, want = query(spark, DATA).toPandas(), duck().sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])
