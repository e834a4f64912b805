"""Exact quantiles of groups of any size.

The built-in ``percentile`` keeps every distinct value of a group in one task.
Here a group is first reduced to counts per *value slice* (a fixed, monotone,
logarithmic grid), which combines map-side and is bounded per group.  The slice
holding the wanted rank is then read again at full precision.  While such a
slice holds more than a million values it is first cut into finer ones, so no
task ever orders more than that.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidemark.functions.joins import join_on
from tidemark.session import BROADCAST_BYTES, checkpointed

SLICES_PER_NAT = 1024
# Slices that are broadcast at most; one holds the group's keys and a few numbers.
BROADCAST_SLICES = BROADCAST_BYTES // 256
# A slice of more values than this is cut into CELLS finer ones; three cuts leave
# a slice at most a few dozen different doubles wide.
SLICE_ROWS = 1_000_000
CELLS = 4096
MAX_CUTS = 3
_LARGEST = 1.7976931348623157e308


def value_slice(value: Column) -> Column:
    """A bigint that never decreases as ``value`` grows; NULL for NaN."""
    size = F.least(F.abs(value), F.lit(_LARGEST))
    rank = F.floor(F.log(size) * SLICES_PER_NAT) + F.lit(1_000_000)
    positive = F.when(F.isnan(value), F.lit(None)).otherwise(rank)
    return F.when(value == 0, F.lit(0)).when(value > 0, positive).otherwise(-rank).cast("bigint")


def _ranks(total: Column, prob: float) -> tuple[Column, Column, Column]:
    """Lower rank, upper rank and the fraction between them (linear rule)."""
    position = (total - 1) * F.lit(float(prob))
    low = F.floor(position)
    return low, F.ceil(position), position - low


def _between(low: Column, high: Column, fraction: Column) -> Column:
    """The point a fraction of the way up; equal ends, infinite ones too, give themselves."""
    return F.when(low == high, low).otherwise(low + (high - low) * fraction)


def _number(value: str) -> Column:
    """A column as double, with NaN for NULL.

    NaN fails every range test, so no test for NULL is needed: the optimizer
    would move one below a derived column and compute the column once more.
    """
    return F.coalesce(F.col(value).cast("double"), F.lit(float("nan")))


def _holds(rank) -> Column:
    """Whether a row of values counted ``_c`` from rank ``_start`` covers a rank."""
    return (F.col("_start") <= rank) & (rank < F.col("_start") + F.col("_c"))


def _ranked(counted: DataFrame, group: list[str], order: Column, before: Column) -> DataFrame:
    """Add ``_start``, the rank of each row's first value."""
    running = Window.partitionBy(*group).orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return counted.withColumn("_start", before + F.sum("_c").over(running) - F.col("_c"))


def quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: dict[str, float],
    weight: str | None = None,
) -> DataFrame:
    """One row per group: ``keys``, ``n`` (non-NULL rows) and one column per prob.

    ``probs`` maps output names to probabilities in [0, 1].  NULL and NaN are
    ignored; a group without values keeps its row with NULL quantiles.  The
    first pass runs when called, because its result decides the join below.
    """
    if not keys:
        found = scalar_quantiles(df, value, probs, weight)
        kinds = ", ".join(["n bigint", *[f"`{name}` double" for name in probs]])
        return df.sparkSession.createDataFrame([(found["n"], *[found[name] for name in probs])], kinds)
    v = _number(value)
    w = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    base = df.select(*keys, v.alias("_v"), w.alias("_w"))
    sliced = base.withColumn("_slice", value_slice(F.col("_v")))
    slices = sliced.groupBy(*keys, "_slice").agg(
        F.sum(F.when(F.isnan("_v"), F.lit(0)).otherwise(F.col("_w"))).alias("_c"),
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    slices = _ranked(
        slices.withColumn("n", F.sum("_c").over(Window.partitionBy(*keys))),
        keys, F.col("_slice").asc_nulls_first(), F.lit(0))
    wanted = F.lit(False)
    for prob in probs.values():
        low, high, _ = _ranks(F.col("n"), prob)
        wanted = wanted | _holds(low) | _holds(high)
    # Slices with a single value need no second look; groups without values have n = 0.
    is_open = F.coalesce(F.col("_lo") < F.col("_hi"), F.lit(False))
    too_big = is_open & (F.col("_c") > SLICE_ROWS)

    def held(rows: DataFrame) -> tuple[DataFrame, int, int]:
        seen = Observation()
        stored = checkpointed(rows.observe(
            seen, F.count_if(is_open).alias("open"), F.count_if(too_big).alias("big")))
        return stored, seen.get["open"], seen.get["big"]

    def among(rows: DataFrame, slices: DataFrame, count: int) -> DataFrame:
        """Rows whose value lies in one of the slices of their group."""
        inside = F.col("_v").between(F.col("_lo"), F.col("_hi"))
        if count <= BROADCAST_SLICES:
            return join_on(rows, F.broadcast(slices.drop("_slice")), keys, extra=inside)
        return join_on(rows.withColumn("_slice", value_slice(F.col("_v"))), slices, [*keys, "_slice"], extra=inside)

    columns = [*keys, "_slice", "_c", "_lo", "_hi", "n", "_start"]
    picked, opened, big = held(slices.filter(wanted | (F.col("n") == 0)).select(*columns))
    for _ in range(MAX_CUTS):
        if big == 0:
            break
        wide = picked.filter(too_big).select(
            *keys, "_slice", F.col("_slice").alias("_from"), "n", F.col("_start").alias("_before"), "_lo", "_hi")
        cell = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * CELLS), F.lit(CELLS - 1))
        cut = among(base, wide, big).select(*keys, "_from", "_before", "n", "_v", "_w", cell.alias("_cell"))
        cut = cut.groupBy(*keys, "_from", "_before", "_cell").agg(
            F.sum("_w").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.max("n").alias("n"))
        cut = _ranked(cut, [*keys, "_from", "_before"], F.col("_cell").asc(), F.col("_before")).filter(wanted)
        picked, opened, big = held(picked.filter(~too_big).unionByName(
            cut.withColumnRenamed("_from", "_slice").select(*columns)))

    settled = picked.filter(~is_open).select(
        *keys, "n", "_start", "_c", F.when(F.col("n") > 0, F.col("_lo")).alias("_v"))
    open_ = picked.filter(is_open).select(
        *keys, "_slice", "n", F.col("_start").alias("_before"), "_lo", "_hi")
    if opened > BROADCAST_SLICES:
        # count equal values first, so the join moves each distinct value once
        base = base.groupBy(*keys, "_v").agg(F.sum("_w").alias("_w"))
    # a slice is known by the rank it starts at
    counted = among(base, open_, opened).groupBy(*keys, "_before", "_v").agg(
        F.sum("_w").alias("_c"), F.max("n").alias("n"))
    read = _ranked(counted, [*keys, "_before"], F.col("_v").asc(), F.col("_before")).select(
        *keys, "n", "_start", "_c", "_v")

    aggregates, results = [], []
    for i, (name, prob) in enumerate(probs.items()):
        low, high, fraction = _ranks(F.col("n"), prob)
        aggregates += [F.max(F.when(_holds(low), F.col("_v"))).alias(f"_low{i}"),
                       F.max(F.when(_holds(high), F.col("_v"))).alias(f"_high{i}")]
        low_v, high_v = F.col(f"_low{i}"), F.col(f"_high{i}")
        results.append(_between(low_v, high_v, fraction).alias(name))
    return (
        settled.unionByName(read)
        .groupBy(*keys)
        .agg(F.max("n").alias("n"), *aggregates)
        .select(*keys, "n", *results)
    )


def medians(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """Exact median per group."""
    return quantiles(df, keys, value, {name: 0.5})


def scalar_quantiles(
    df: DataFrame, value: str, probs: dict[str, float], weight: str | None = None
) -> dict[str, float]:
    """Quantiles of a whole column as numbers, for use as plan constants.

    Same two passes; each returns at most two rows per probability.
    """
    v = _number(value)
    w = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    base = df.select(v.alias("_v"), w.alias("_w"))
    sliced = base.withColumn("_slice", value_slice(F.col("_v")))
    slices = sliced.groupBy("_slice").agg(
        F.sum(F.when(F.isnan("_v"), F.lit(0)).otherwise(F.col("_w"))).alias("_c"),
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.lit(0).alias("_all")).filter("_c > 0")
    slices = _ranked(slices.withColumn("n", F.sum("_c").over(Window.partitionBy("_all"))),
                     ["_all"], F.col("_slice").asc(), F.lit(0))
    wanted = F.lit(False)
    for prob in probs.values():
        low, high, _ = _ranks(F.col("n"), prob)
        wanted = wanted | _holds(low) | _holds(high)
    picked = slices.filter(wanted).collect()
    if not picked:
        return {"n": 0, **{name: None for name in probs}}
    total = picked[0]["n"]
    places = {name: (total - 1) * prob for name, prob in probs.items()}
    ranks = sorted({r for p in places.values() for r in (math.floor(p), math.ceil(p))})
    found = [(r["_start"], r["_c"], r["_lo"]) for r in picked if r["_lo"] == r["_hi"]]
    open_ = [(r["_start"], r["_c"], r["_lo"], r["_hi"]) for r in picked if r["_lo"] < r["_hi"]]
    for _ in range(MAX_CUTS):
        wide = [o for o in open_ if o[1] > SLICE_ROWS]
        if not wide:
            break
        open_ = [o for o in open_ if o[1] <= SLICE_ROWS]
        for start, count, low, high in _cut_slices(base, wide):
            if any(start <= r < start + count for r in ranks):
                if low == high:
                    found.append((start, count, low))
                else:
                    open_.append((start, count, low, high))
    if open_:
        # values outside the slices' ends form one group, summed before the shuffle
        # and ranked beyond every row
        v, before = F.col("_v"), F.lit(1 << 62)
        for start, _, low, high in open_:
            before = F.when(v.between(low, high), F.lit(start)).otherwise(before)
        inside = reduce(lambda a, b: a | b, [v.between(low, high) for _, _, low, high in open_])
        counted = base.groupBy(F.when(inside, v).otherwise(F.lit(float("nan"))).alias("_v")).agg(
            F.sum("_w").alias("_c")).withColumn("_before", before)
        placed = _ranked(counted, ["_before"], F.col("_v").asc(), F.col("_before"))
        hit = reduce(lambda a, b: a | b, [_holds(F.lit(r)) for r in ranks])
        found += [(r["_start"], r["_c"], r["_v"]) for r in placed.filter(hit).collect()]

    def at(rank: int) -> float:
        return next(v for start, count, v in found if start <= rank < start + count)

    out = {"n": total}
    for name, place in places.items():
        low, high = at(math.floor(place)), at(math.ceil(place))
        out[name] = low if low == high else low + (high - low) * (place - math.floor(place))
    return out


def _cut_slices(base: DataFrame, slices: list[tuple]) -> list[tuple]:
    """Cut (start rank, count, low, high) slices into cells; at most CELLS rows each come back."""
    v, which, cell = F.col("_v"), F.lit(-1), F.lit(0).cast("bigint")
    for i, (_, _, low, high) in enumerate(slices):
        here = v.between(low, high)
        which = F.when(here, F.lit(i)).otherwise(which)
        cell = F.when(here, F.least(F.floor((v - low) / (high - low) * CELLS), F.lit(CELLS - 1))).otherwise(cell)
    rows = base.groupBy(which.alias("_which"), cell.alias("_cell")).agg(
        F.sum("_w").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).collect()
    out = []
    for i, (start, *_) in enumerate(slices):
        for r in sorted((r for r in rows if r["_which"] == i), key=lambda r: r["_cell"]):
            out.append((start, r["_c"], r["_lo"], r["_hi"]))
            start += r["_c"]
    return out


def scalar_mad(df: DataFrame, value: str) -> tuple[float | None, float | None]:
    """Median and median absolute deviation of a whole column."""
    median = scalar_quantiles(df, value, {"q": 0.5})["q"]
    if median is None:
        return None, None
    deviation = df.select(F.abs(F.col(value) - F.lit(median)).alias("_dev"))
    return median, scalar_quantiles(deviation, "_dev", {"q": 0.5})["q"]


def array_quantile(values: Column, prob: float) -> Column:
    """Exact quantile of a short array column (linear rule); NULLs must be absent."""
    ordered = F.sort_array(values)
    total = F.size(ordered)
    low, high, fraction = _ranks(total, prob)
    low_v = F.get(ordered, low.cast("int"))
    high_v = F.get(ordered, high.cast("int"))
    return F.when(total > 0, _between(low_v, high_v, fraction))
