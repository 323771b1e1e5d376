"""Run registered queries and their SQL side by side: ``python -m checks.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb

from logtally.session import build_session

from .duckdb_sql import SQL
from .spark_queries import all_queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def compare(spark, con, sf: str, name: str) -> str:
    """Empty when equal, else what differs."""
    df = all_queries()[name](spark, sf)
    got_cols = sorted(df.columns)
    got = Counter(tuple(r[c] for c in got_cols) for r in df.collect())
    rel = con.sql(SQL[name])
    want_cols = sorted(rel.columns)
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    at = [rel.columns.index(c) for c in want_cols]
    want = Counter(tuple(r[i] for i in at) for r in rel.fetchall())
    if got == want:
        types = [type(a) is type(b) or a is None or b is None for g, w in zip(sorted(got, key=repr), sorted(want, key=repr)) for a, b in zip(g, w)]
        return "" if all(types) else "types differ"
    return f"{sum(got.values())} vs {sum(want.values())} rows; only spark {list((got - want))[:2]}; only sql {list((want - got))[:2]}"


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(SQL)
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="16g", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name in names:
        began = time.monotonic()
        try:
            difference = compare(spark, con, sf, name)
        except Exception as e:  # report and go on
            difference = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(difference)
        print(f"{'DIFF' if difference else 'ok  '} {name} {time.monotonic() - began:.1f}s {difference}", flush=True)
    print(f"{len(names) - bad} of {len(names)} equal")


if __name__ == "__main__":
    main()
