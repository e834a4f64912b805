"""Sinks: CSV export, partitioned parquet, load modes and the result cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions.joins import join_on
from tidemark.session import stored_lookup


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Write the whole frame as CSV files with a header.

    NULL is empty and timestamps are cut to the minute.
    """
    chosen = df.select(*columns) if columns else df
    shown = [
        F.date_format(name, C.MINUTE_FORMAT).alias(name) if kind.startswith("timestamp") else F.col(name)
        for name, kind in chosen.dtypes
    ]
    chosen.select(*shown).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def rebalanced(df: DataFrame, columns: list[str]) -> DataFrame:
    """Bring equal values together, letting AQE cut heavy ones and merge light ones."""
    return df.sparkSession.sql(f"SELECT /*+ REBALANCE({', '.join(columns)}) */ * FROM {{rows}}", rows=df)


def write_trips(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Trips as parquet, one folder per pickup date, ordered by pickup in each file."""
    dated = df.withColumn("pickup_date", F.to_date("tpep_pickup_datetime"))
    (rebalanced(dated, ["pickup_date"])
        .sortWithinPartitions("pickup_date", "tpep_pickup_datetime")
        .write.mode(mode).partitionBy("pickup_date").parquet(path))


def write_series(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Long series as parquet, one folder per resolution and split."""
    (rebalanced(df, ["resolution", "split"])
        .sortWithinPartitions("resolution", "split", "series_id", "ts")
        .write.mode(mode).partitionBy("resolution", "split").parquet(path))


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a parquet table is stored at ``path``."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def load_table(df: DataFrame, path: str, mode: str = "replace") -> bool:
    """Store a table: ``replace`` it, ``keep`` what is there and append, or write
    only ``if_empty``.  Returns whether rows were written."""
    if mode == "if_empty":
        spark = df.sparkSession
        if table_exists(spark, path) and not spark.read.parquet(path).isEmpty():
            return False
        mode = "replace"
    df.write.mode({"replace": "overwrite", "keep": "append"}[mode]).parquet(path)
    return True


def insert_ignore(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows whose key is not stored yet, one row per key."""
    fresh = join_on(new, existing.select(*keys), keys, "left_anti")
    rest = [c for c in new.columns if c not in keys]
    kept = fresh.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")) if rest else fresh.distinct()
    picked = [F.col(f"_row.{c}").alias(c) if c in rest else F.col(c) for c in new.columns]
    return kept.select(*picked)


RESULT_KEYS = ["metric", "resolution", "vendor", "model_name"]


def save_results(results: DataFrame, path: str) -> None:
    """Append scores to the result table, keeping rows already stored."""
    spark = results.sparkSession
    if table_exists(spark, path):
        # only the folders of the series at hand are read: one row per series and model
        touched = results.select(*RESULT_KEYS).distinct()
        near = join_on(spark.read.parquet(path), stored_lookup(touched), RESULT_KEYS, "left_semi")
        results = insert_ignore(results, near, [*RESULT_KEYS, "ts"])
    results.write.mode("append").partitionBy(*RESULT_KEYS).parquet(path)


def lookup_results(
    stored: DataFrame, metric: str, resolution: str, vendor: str, model: str, start: str, end: str
) -> DataFrame:
    """Stored scores of one series and model in an inclusive time range, by time.

    The four key columns are partition folders, so other series are not read.
    """
    wanted = (
        (F.col("metric") == metric) & (F.col("resolution") == resolution)
        & (F.col("vendor") == vendor) & (F.col("model_name") == model)
    )
    low, high = (F.lit(t).cast("timestamp_ntz") for t in (start, end))
    return stored.filter(wanted & F.col("ts").between(low, high)).orderBy("ts")


def split_flagged(scored: DataFrame, folder: str, drop: bool = False) -> None:
    """Write all scored rows, the anomalies, and with ``drop`` also the clean rows.

    The scored rows are written once and read back for the other outputs, so
    scoring runs a single time.
    """
    flagged = f"{folder}/flagged"
    scored.write.mode("overwrite").parquet(flagged)
    stored = scored.sparkSession.read.parquet(flagged)
    stored.filter("is_anomaly = 1").write.mode("overwrite").parquet(f"{folder}/anomalies")
    if drop:
        stored.filter("is_anomaly = 0").write.mode("overwrite").parquet(f"{folder}/cleaned")
