"""Row positions and row windows that never sort a whole group in one task.

Positions come from a count per (group, day) and a running total over days, so
the largest sort is one day of one series.  Row windows are then evaluated in
blocks of consecutive positions; each block also receives the few neighbouring
rows its frames reach into.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.joins import join_on
from tidemark.session import checkpointed, stored_lookup

BLOCK_ROWS = 50_000


def with_position(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Add ``_pos`` (0-based by ``ts`` within ``keys``) and ``_n`` (group size).

    Made for binned series, where a (series, day) pair holds few rows.  The
    series is stored first, since it is read for the counts and for the rows.
    """
    keyed = checkpointed(df).select("*", F.lit(0).alias("_one"), F.to_date(ts).alias("_day"))
    group = ["_one", *keys]
    whole = Window.partitionBy(*group)
    days = (
        keyed.groupBy(*group, "_day")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_n", F.sum("_c").over(whole))
        .withColumn("_before", F.sum("_c").over(whole.orderBy("_day")) - F.col("_c"))
        .drop("_c")
    )
    in_day = Window.partitionBy(*group, "_day").orderBy(ts)
    return (
        join_on(keyed, days, [*group, "_day"])
        .withColumn("_pos", F.col("_before") + F.row_number().over(in_day) - 1)
        .drop("_one", "_day", "_before")
    )


def global_position(df: DataFrame, order: list[str]) -> DataFrame:
    """Add ``_pos`` over all rows in ``order`` without a single-task sort.

    The frame is range-sorted and stored, then each stored partition is shifted
    by the rows before it; ``order`` must be unique for a stable result.
    """
    placed = checkpointed(
        df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_mid", 33))
    parts = placed.groupBy("_part").agg(
        F.count(F.lit(1)).alias("_c"), F.min("_mid").alias("_first"))
    # one row per partition
    parts = parts.withColumn(
        "_before", F.sum("_c").over(Window.partitionBy(F.lit(0)).orderBy("_part")) - F.col("_c"))
    return (
        placed.join(F.broadcast(parts), "_part")
        .withColumn("_pos", F.col("_before") + F.col("_mid") - F.col("_first"))
        .drop("_part", "_mid", "_first", "_before", "_c")
    )


def in_blocks(
    df: DataFrame, before: int | Column, after: int | Column = 0, size: int | Column = BLOCK_ROWS
) -> DataFrame:
    """Copy rows into blocks of consecutive positions.

    Adds ``_block`` and ``_own``: a row sits in its own block, and also in the
    blocks whose frames reach ``before`` rows back or ``after`` rows ahead to it.
    """
    def as_col(x):
        return x if isinstance(x, Column) else F.lit(x)

    pos, width = F.col("_pos"), as_col(size)
    first = F.floor(F.greatest(pos - as_col(after), F.lit(0)) / width)
    last = F.floor((pos + as_col(before)) / width)
    return df.withColumn("_block", F.explode(F.sequence(first, last))).withColumn(
        "_own", F.col("_block") == F.floor(pos / width))


def lagged(
    df: DataFrame, keys: list[str], value: str, lags: dict[str, int], ts: str = "ts"
) -> DataFrame:
    """Add ``value`` from earlier rows of the group: name -> rows back.

    Keeps ``_pos`` and ``_n`` from :func:`with_position` (added when absent).
    """
    placed = df if "_pos" in df.columns else with_position(df, keys, ts)
    block = Window.partitionBy(*keys, "_block").orderBy("_pos")
    return (
        in_blocks(placed, before=max(lags.values()))
        .select("*", *[F.lag(value, n).over(block).alias(name) for name, n in lags.items()])
        .filter("_own")
        .drop("_block", "_own")
    )


def per_group(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Attach per-group results to rows: a left join, broadcast when small."""
    if not keys:
        # a whole-table result is a single row
        return df.join(F.broadcast(table), how="left")
    return join_on(df, stored_lookup(table), keys, "left")
