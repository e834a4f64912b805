"""Readers: monthly trip files, CSV entries, and views over event tables."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import quote

import pandas as pd
import pyarrow.parquet as pq
from py4j.protocol import Py4JJavaError
from pyarrow import fs
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.schema import AUDIT_COLUMNS, TRIP_COLUMNS

_MONTH = re.compile(r"(\d{4})-(\d{2})")


def normalize_names(df: DataFrame) -> DataFrame:
    """Lower-case every column name."""
    return df.toDF(*[c.lower() for c in df.columns])


def align_schema(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Keep the target columns in order, cast them, and add absent ones as NULL."""
    present = set(df.columns)
    return df.select(*[
        (F.col(name).cast(kind) if name in present else F.lit(None).cast(kind)).alias(name)
        for name, kind in schema.items()
    ])


def month_range(spec: str) -> list[str]:
    """``"2015-11:2016-02"`` to the inclusive list of months."""
    first, last = (12 * int(y) + int(m) - 1 for y, m in (_MONTH.fullmatch(p).groups() for p in spec.split(":")))
    return [f"{n // 12:04d}-{n % 12 + 1:02d}" for n in range(first, last + 1)]


def in_months(df: DataFrame, spec: str, ts: str = "tpep_pickup_datetime") -> DataFrame:
    """Rows whose month lies in an inclusive range.

    Compares the timestamp with two constants, so the filter reaches the scan.
    """
    months = month_range(spec)
    if not months:
        return df.limit(0)
    low = F.lit(f"{months[0]}-01").cast("date").cast("timestamp_ntz")
    high = F.add_months(F.lit(f"{months[-1]}-01").cast("date"), 1).cast("timestamp_ntz")
    return df.filter((F.col(ts) >= low) & (F.col(ts) < high))


def _parquet_files(spark: SparkSession, path: str) -> list[str]:
    """A file itself, or the sorted parquet files in a folder and the folders below it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(where):
        raise FileNotFoundError(path)
    if system.getFileStatus(where).isFile():
        return [path]
    found, names = system.listFiles(where, True), []
    while found.hasNext():
        names.append(found.next().getPath().toString())
    return sorted(n for n in names if n.endswith(".parquet") and "/_" not in n[len(path):])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table."""
    return spark.read.parquet(path)


# Files whose footers one task reads, and files read at a time through Spark where tasks cannot reach them.
FOOTERS_A_TASK, FOOTERS_AT_ONCE = 64, 16


def _footer(path: str) -> str | None:
    """Names and types in a file's footer, as text; None where the file system is not open to Python tasks."""
    try:
        local = re.fullmatch(r"(?:file:)?/*(/.*)", path)
        files, inner = (fs.LocalFileSystem(), local[1]) if local else fs.FileSystem.from_uri(quote(path, safe="/:@"))
        with files.open_input_file(inner) as source:
            return "\n".join(f"{f.name}: {f.type}" for f in pq.read_schema(source))
    except (OSError, ValueError, NotImplementedError):
        return None


def footers(spark: SparkSession, files: list[str]) -> DataFrame:
    """``file, footer``: the schema of each file as text, read by tasks."""

    @F.pandas_udf("string")
    def read(paths: pd.Series) -> pd.Series:
        return paths.map(_footer)

    paths = spark.createDataFrame([(f,) for f in files], "file string")
    return paths.repartition(-(-len(files) // FOOTERS_A_TASK)).select("file", read("file").alias("footer"))


def _by_schema(spark: SparkSession, files: list[str]) -> list[DataFrame]:
    """The files as one frame per schema.

    One distributed pass merges the footers.  Only where names clash or types
    differ does a second one tell the schema of each file; files of equal
    footers are then read together, and Spark looks into one of them.
    """
    try:
        merged = spark.read.option("mergeSchema", True).parquet(*files)
        names = [c.lower() for c in merged.columns]
        if len(set(names)) == len(names):
            return [merged]
    except (PySparkException, Py4JJavaError):
        pass  # types differ between files
    # the names that the driver has listed, by schema
    found = footers(spark, files).groupBy("footer").agg(F.sort_array(F.collect_list("file")).alias("files")).collect()
    groups = {r["footer"]: r["files"] for r in sorted(found, key=lambda r: r["files"][0]) if r["footer"] is not None}
    closed = [f for r in found if r["footer"] is None for f in r["files"]]
    if closed:
        with ThreadPoolExecutor(max_workers=FOOTERS_AT_ONCE) as pool:
            for f, schema in zip(closed, pool.map(lambda f: spark.read.parquet(f).schema.json(), closed)):
                groups.setdefault(schema, []).append(f)
    return [spark.read.parquet(*g) for g in groups.values()]


def scan_trips(
    spark: SparkSession, path: str, months: str | None = None,
    schema: dict[str, str] = TRIP_COLUMNS,
) -> DataFrame:
    """Read one trip file or every parquet file of a folder into the trip schema.

    Columns may differ in case, type and presence from file to file, so files
    are read per distinct schema and united afterwards.  ``months`` keeps files
    named for those months when names carry one, and filters rows in any case.
    """
    files = _parquet_files(spark, path)
    if months:
        wanted = set(month_range(months))
        dated = [(f, _MONTH.search(f.rsplit("/", 1)[-1])) for f in files]
        files = [f for f, m in dated if m is None or m.group(0) in wanted]
    if not files:
        raise FileNotFoundError(f"no parquet files in {path}")
    parts = [align_schema(normalize_names(df), schema) for df in _by_schema(spark, files)]
    trips = reduce(DataFrame.unionByName, parts)
    return in_months(trips, months) if months else trips


def read_csv_text(spark: SparkSession, path: str, schema: dict[str, str]) -> DataFrame:
    """A CSV with a header as text columns of ``schema``; unknown columns dropped."""
    raw = normalize_names(
        spark.read.option("header", True).option("encoding", "UTF-8").csv(path))
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    return align_schema(raw, {name: "string" for name in schema})


def read_entries_csv(spark: SparkSession, path: str, schema: dict[str, str] = TRIP_COLUMNS) -> DataFrame:
    """Entries from CSV: blank is NULL, bad numbers are NULL, bad pickups are skipped."""
    text = read_csv_text(spark, path, schema)

    def typed(name: str, kind: str) -> Column:
        if kind.startswith("timestamp"):
            return C.parse_pickup(name)
        if kind == "double":
            return C.coerce_float(name)
        if kind in ("bigint", "int", "smallint"):
            return C.coerce_int(name).try_cast(kind)
        return F.when(F.trim(name) != "", F.col(name))

    parsed = text.select(*[typed(n, k).alias(n) for n, k in schema.items()])
    return parsed.filter(F.col("tpep_pickup_datetime").isNotNull())


# -- views over the event table -----------------------------------------------

def events_as_trips(events: DataFrame) -> DataFrame:
    """Trip records from an event table (id, ts, user, type, value, props)."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    pickup = F.col("ts")
    return events.withColumn("_k", k).select(
        F.col("event_id").alias("id"),
        (F.col("event_id") % 3 + 1).cast("string").alias("vendorid"),
        pickup.alias("tpep_pickup_datetime"),
        (pickup + F.make_dt_interval(F.lit(0), F.lit(0), F.col("_k").cast("int"), F.lit(0).cast("decimal(18,6)")))
        .alias("tpep_dropoff_datetime"),
        (1 + F.col("user_id") % 6).alias("passenger_count"),
        (F.col("value") / 10).alias("trip_distance"),
        (F.col("value") * 0.8).alias("fare_amount"),
        (F.col("value") * 0.15).alias("tip_amount"),
        (F.col("value") * 0.05).alias("tolls_amount"),
        F.col("value").alias("total_amount"),
        F.col("user_id").alias("pulocationid"),
        F.col("_k").alias("dolocationid"),
    )


def events_as_entries(events: DataFrame) -> DataFrame:
    """Manually entered records with audit columns, from sign-up events."""
    trips = events_as_trips(events.filter(F.col("event_type") == "signup"))
    gone = F.col("dolocationid") % 5 == 0
    added = F.col("tpep_pickup_datetime")
    return trips.drop("tpep_dropoff_datetime").select(
        "*",
        F.col("pulocationid").alias("added_by"),
        added.alias("added_at"),
        gone.alias("is_deleted"),
        F.when(gone, F.col("pulocationid") % 10).alias("deleted_by"),
        F.when(gone, added + F.expr("INTERVAL '1' DAY")).alias("deleted_at"),
    )


def events_as_users(events: DataFrame) -> DataFrame:
    """Distinct users with a name."""
    return events.select(F.col("user_id").alias("id")).distinct().withColumn(
        "username", F.concat(F.lit("user_"), F.col("id")))


def entry_schema() -> dict[str, str]:
    """Columns of an entered record: a trip without drop-off, plus the audit trail."""
    trip = {k: v for k, v in TRIP_COLUMNS.items() if k != "tpep_dropoff_datetime"}
    return {"id": "bigint", **trip, **AUDIT_COLUMNS}
