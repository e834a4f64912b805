"""Run queries next to their SQL twins: python -m checks.compare [sf_dir] [name ...]"""

from __future__ import annotations

import datetime as dt
import glob
import math
import os
import sys
import time

import duckdb

from checks import facts
from checks.queries import QUERIES as TABLE_QUERIES
from checks.twins import TWINS as TABLE_TWINS
from tidemark.session import build_session

QUERIES = {**TABLE_QUERIES, **facts.QUERIES}
TWINS = {**TABLE_TWINS, **facts.TWINS}


def connect(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir: str, name: str) -> str:
    """``ok`` or the first difference."""
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if name not in TWINS:
        return f"rows {len(got)}"
    found = con.sql(TWINS[name])
    want = rows_of(found.columns, found.fetchall())
    if sorted(df.columns) != sorted(found.columns):
        return f"columns {sorted(df.columns)} != {sorted(found.columns)}"
    kinds = {t: ("int" if "INT" in t else t) for t in map(str, found.types)}
    mine = {n: k for n, k in df.dtypes}
    theirs = {n: kinds[str(t)] for n, t in zip(found.columns, found.types)}
    match = {"int": ("int", "bigint", "smallint"), "DOUBLE": ("double",), "VARCHAR": ("string",), "BOOLEAN": ("boolean",),
             "TIMESTAMP": ("timestamp_ntz", "timestamp"), "DATE": ("date",)}
    odd = {n: (mine[n], t) for n, t in theirs.items() if mine[n] not in match.get(t, ())}
    if odd:
        return f"types {odd}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    diff = [(g, w) for g, w in zip(got, want) if g != w]
    return f"ok {len(got)}" if not diff else f"{len(diff)} differ, columns {sorted(df.columns)}: {diff[:2]}"


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
                          spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("OFF")
    con, bad = connect(sf_dir), 0
    for name in args or list(QUERIES):
        began = time.time()
        try:
            result = compare(spark, con, sf_dir, name)
        except Exception as error:
            result = f"ERROR {type(error).__name__}: {str(error)[:700]}"
        bad += not result.startswith(("ok", "rows")) or "!=" in result
        print(f"{name:24s} {time.time() - began:6.2f}s  {result}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
