"""Time series from trips: bins, profiles, gaps, lags, splits and windows.

A *series* frame has key columns (any, often metric, resolution, vendor), a
``ts`` column and a ``value`` column, and holds non-empty bins only.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions.joins import join_on
from tidemark.functions.ordering import global_position, in_blocks, lagged, per_group, with_position
from tidemark.functions.quantiles import array_quantile, quantiles
from tidemark.operators.records import vendor_filter
from tidemark.schema import (
    ALL_VENDORS, COUNT_METRIC, MAD_FLOOR, RESOLUTION_SECONDS, SERIES_KEYS, VALUE_METRICS,
    canonical, lag_count, resolution_seconds, time_feature_names,
)
from tidemark.session import checkpointed, stored_lookup

PICKUP = "tpep_pickup_datetime"
# Records of a block whose nested bins are taken together.
BLOCK_RECORDS = 50_000
# Values of a sorted run that tell where its ranks lie.
RUN_SAMPLES = 256


# -- binning ------------------------------------------------------------------

def bin_series(
    trips: DataFrame, metric: str, resolution: str, how: str = "median",
    vendor: str = ALL_VENDORS, keys: list[str] | None = None, ts: str = PICKUP,
) -> DataFrame:
    """``ts, value`` per non-empty bin: the trip count, or mean or median of a metric."""
    metric, keys = canonical(metric), keys or []
    rows = vendor_filter(trips, vendor)
    bin_start = C.bin_to(ts, resolution).alias("ts")
    if metric == COUNT_METRIC:
        return rows.groupBy(*keys, bin_start).agg(F.count(F.lit(1)).cast("double").alias("value"))
    value = F.col(metric).cast("double")
    if how == "mean":
        return rows.groupBy(*keys, bin_start).agg(F.avg(value).alias("value"))
    if how == "median":
        binned = rows.select(*keys, bin_start, value.alias("_m"))
        return quantiles(binned, [*keys, "ts"], "_m", {"value": 0.5}).drop("n")
    raise ValueError(f"how must be 'median' or 'mean', not {how!r}")


def _tall(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One row per record and metric: ``keys, metric, value``."""
    return rows.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        keys, metrics, "metric", "value")


def bin_all_metrics(
    trips: DataFrame, resolution: str, vendor: str = ALL_VENDORS, metrics: list[str] = VALUE_METRICS
) -> DataFrame:
    """Trip count and the median of every metric per bin, one column each."""
    chosen = vendor_filter(trips, vendor)
    rows = checkpointed(chosen.select(C.bin_to(PICKUP, resolution).alias("ts"), *metrics))
    counts = rows.groupBy("ts").agg(F.count(F.lit(1)).alias(COUNT_METRIC))
    tall = quantiles(_tall(rows, ["ts"], metrics), ["ts", "metric"], "value", {"value": 0.5})
    wide = tall.groupBy("ts").pivot("metric", metrics).agg(F.first("value"))
    return counts.join(wide, "ts", "left").select("ts", COUNT_METRIC, *metrics)


def bin_mean_metrics(
    trips: DataFrame, unit: str, vendor: str = ALL_VENDORS, metrics: list[str] = VALUE_METRICS
) -> DataFrame:
    """Trip count and the mean of every metric per minute, hour or day."""
    resolution = {"minute": "1m", "hour": "1h", "day": "1d"}[unit]
    return vendor_filter(trips, vendor).groupBy(C.bin_to(PICKUP, resolution).alias("ts")).agg(
        F.count(F.lit(1)).alias(COUNT_METRIC),
        *[F.avg(F.col(m).cast("double")).alias(m) for m in metrics],
    )


def resample_mean(binned: DataFrame, resolution: str, keys: list[str] | None = None) -> DataFrame:
    """Mean of finer bins per wider bin, for every value column; empty bins drop."""
    keys = keys or []
    values = [c for c in binned.columns if c not in (*keys, "ts")]
    coarse = binned.groupBy(*keys, C.bin_to("ts", resolution).alias("ts")).agg(
        *[F.avg(c).alias(c) for c in values])
    return coarse.dropna(how="all", subset=values)


def long_series(
    trips: DataFrame, resolutions: list[str], vendors: list[str] | None = None,
    metrics: list[str] = VALUE_METRICS, how: str = "median", block_records: int = BLOCK_RECORDS,
) -> DataFrame:
    """Every metric x resolution x vendor series in one long frame, from a lattice of nested bins.

    Records are stored once, in bins of the widths' common divisor (*units*).
    Counts, and sums for means, are rolled up from the units.  For medians a
    record goes once to the widest nested bin of at most ``block_records``
    records that holds it, where the medians of all bins within are taken
    together.  Wider bins are met by sorted runs, one per block, vendor and metric:
    samples of the runs bound each median, and only values between are read again.
    ``block_records`` decides how work is dealt out, not what is found.
    """
    if how not in ("median", "mean"):
        raise ValueError(f"how must be 'median' or 'mean', not {how!r}")
    vendors = [canonical(v) for v in (vendors or ["all", "1", "2"])]
    own, total = [v for v in vendors if v != ALL_VENDORS], ALL_VENDORS in vendors
    widths = [resolution_seconds(r) for r in resolutions]
    names = [f"_{i}" for i in range(len(metrics))]
    label = F.when(F.col("vendorid").isin(own), F.col("vendorid")) if own else F.lit(None).cast("string")
    rows = trips.select(label.alias("vendor"), C.bin_floor(PICKUP, math.gcd(*widths)).alias("_t"),
                        *[F.col(m).cast("double").alias(n) for m, n in zip(metrics, names)])
    rows = checkpointed(rows if total else rows.dropna(subset=["vendor"]))

    def labelled(df: DataFrame) -> DataFrame:
        """A row for its own vendor and one for all."""
        labels = [F.lit(ALL_VENDORS)] * total + [F.col("vendor")] * bool(own)
        return df.withColumn("vendor", F.explode(F.array_compact(F.array(*labels))))

    def placed(df: DataFrame) -> DataFrame:
        bins = F.posexplode(F.array(*[C.bin_floor("_t", w) for w in widths])).alias("_r", "ts")
        return labelled(df).select("*", bins)

    def named(position: str, names: list[str]) -> Column:
        return F.get(F.array(*map(F.lit, names)), F.col(position))

    means = [x for n in names for x in (F.sum(n).alias(f"{n}_s"), F.count(n).alias(f"{n}_n"))] if how == "mean" else []
    units = checkpointed(rows.groupBy("vendor", "_t").agg(F.count(F.lit(1)).alias("_c"), *means))
    place = ["_r", "vendor", "ts"]
    rolled = placed(units).groupBy(*place)
    counts = rolled.agg(F.sum("_c").cast("double").alias("value")).select(F.lit(COUNT_METRIC).alias("metric"), *place, "value")
    if how == "mean":
        wide = rolled.agg(*[(F.sum(f"{n}_s") / F.when(F.sum(f"{n}_n") > 0, F.sum(f"{n}_n"))).alias(m)
                            for n, m in zip(names, metrics)])
        values = wide.unpivot(place, metrics, "metric", "value")
    else:
        values = _nested_medians(rows, units, widths, names, own, total, block_records).select(
            named("_m", metrics).alias("metric"), *place, "value")
    series = counts.unionByName(values).dropna(subset=["value"]).withColumn("resolution", named("_r", resolutions))
    return series.select(
        C.series_id().alias("series_id"), "metric", "resolution", "vendor", "ts", "value")


def nest_widths(widths: list[int]) -> list[int]:
    """Widths whose bins nest, each divided by all of ``widths`` up to it; the widest cover years."""
    common = math.lcm(*widths)
    return sorted({c for c in widths if all(c % w == 0 for w in widths if w <= c)} | {common * 8**k for k in range(6)})


def _nested_medians(
    rows: DataFrame, units: DataFrame, widths: list[int], names: list[str], own: list[str], total: bool,
    block_records: int,
) -> DataFrame:
    """Rows (_m, _r, vendor, ts, value): the median of each metric in each bin, by position of metric and width."""
    nests = nest_widths(widths)
    # a bin is taken in a block if the narrowest nested bin that holds it is small enough
    limit = {w: min(c for c in nests if c >= w) for w in widths}
    unit = units.groupBy("_t").agg(F.sum("_c").alias("_c"))
    second = F.unix_date(F.to_date("_t")).cast("bigint") * 86400 + C.seconds_of_day("_t")
    nested = unit.select("_t", "_c", second.alias("_s"), F.explode(F.lit(nests).cast("array<bigint>")).alias("_w")).select(
        "_t", "_c", "_w", (F.col("_s") - F.pmod("_s", "_w")).alias("_b"))
    small = nested.groupBy("_w", "_b").agg(F.sum("_c").alias("_n")).filter(F.col("_n") <= block_records)
    widest = nested.join(small, ["_w", "_b"]).groupBy("_t").agg(F.max(F.struct("_w", "_b")).alias("_p"))
    # a unit of more records is dealt to several blocks of its own
    parts = F.when(F.col("_p").isNull(), F.ceil(F.col("_c") / max(block_records, 1))).otherwise(1)
    blocks = stored_lookup(join_on(unit, widest, ["_t"], "left").select(
        "_t", F.coalesce("_p._w", F.lit(0).cast("bigint")).alias("_w"), F.coalesce("_p._b", second).alias("_b"), parts.alias("_parts")))
    dealt = join_on(rows.withColumn("_i", F.monotonically_increasing_id()), blocks, ["_t"]).withColumn(
        "_part", F.pmod("_i", "_parts")).drop("_i", "_parts")

    def medians(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        at = frame["_t"].to_numpy().astype("datetime64[s]").astype(np.int64)
        code = pd.Categorical(frame["vendor"], categories=own).codes.astype(np.int64)
        columns = [frame[n].to_numpy(dtype=float) for n in names]
        wide = [w for w in widths if limit[w] > key[0]]
        inner = bin_medians(at, code, columns, [(r, w) for r, w in enumerate(widths) if limit[w] <= key[0]], own, total).assign(_runs=None)
        made = [x for x in (inner, sorted_runs(at, code, columns, wide, own) if wide else inner[:0]) if len(x)]
        return (pd.concat(made, ignore_index=True) if made else inner).reindex(columns=inner.columns).assign(_w=key[0])

    found = dealt.groupBy("_w", "_b", "_part").applyInPandas(
        medians, "_r int, vendor string, ts timestamp_ntz, " + ", ".join(f"{n} double" for n in names) + ", _w bigint, _runs array<binary>")
    place = ["_r", "vendor", "ts"]
    wide = not blocks.filter(F.col("_w") < max(limit.values())).isEmpty()
    found = checkpointed(found) if wide else found
    inner = found.filter("_r >= 0").select(*place, F.posexplode(F.array(*names)).alias("_m", "value")).select("_m", *place, "value")
    return inner.unionByName(_run_medians(found.filter("_r < 0"), limit, widths, total)) if wide else inner


def sorted_runs(
    at: np.ndarray, code: np.ndarray, columns: list[np.ndarray], wide: list[int], own: list[str],
) -> pd.DataFrame:
    """Sorted values of a block, by vendor and by stretch of it that lies in one bin of each of the ``wide`` widths.

    Rows (_r, vendor, ts, _runs): -1, a vendor or None, a time within the stretch, and the values of each column as bytes.
    """
    bins = np.stack([at // w for w in wide] + [code])
    found, first, place = np.unique(bins, axis=1, return_index=True, return_inverse=True)
    place, runs = place.reshape(-1), [[] for _ in first]
    for v in columns:
        order = np.argsort(v, kind="stable")[: len(v) - np.count_nonzero(np.isnan(v))]
        order = order[np.argsort(place[order], kind="stable")]
        ends = np.cumsum(np.bincount(place[order], minlength=len(first)))
        for i, part in enumerate(np.split(v[order], ends[:-1])):
            runs[i].append(part.tobytes())
    return pd.DataFrame({"_r": np.full(len(first), -1, np.int32), "vendor": [own[c] if c >= 0 else None for c in code[first]],
                         "ts": at[first].astype("datetime64[s]"), "_runs": runs})


def rank_bounds(samples: list[tuple[int, np.ndarray]], low: int, high: int) -> tuple[float, float]:
    """Values between which the ranks ``low`` to ``high`` of all runs lie, from (length, samples) of each run.

    With a run's samples each at most a step of places apart, no more values lie strictly between the bounds than a few steps of all runs.
    """
    values = np.concatenate([v for _, v in samples])
    places = [sample_places(n) for n, _ in samples]
    # how many of a run are surely not above a sample, and how many may lie below what follows a sample
    up = np.concatenate([np.diff(p, prepend=-1) for p in places])
    past = np.concatenate([np.diff(p, append=n) for (n, _), p in zip(samples, places)])
    order = np.argsort(values, kind="stable")
    values, up, past = values[order], np.cumsum(up[order]), np.cumsum(past[order])
    first = np.searchsorted(values, values, "left")
    below = np.where(first > 0, past[first - 1], 0)
    return float(values[np.searchsorted(below, low, "right") - 1]), float(values[np.searchsorted(up, high + 1, "left")])


def sample_places(n: int) -> np.ndarray:
    """Evenly spaced places of a run, its first and last among them."""
    return np.unique(np.linspace(0, n - 1, min(n, RUN_SAMPLES)).astype(np.int64))


def _run_medians(runs: DataFrame, limit: dict[int, int], widths: list[int], total: bool) -> DataFrame:
    """Rows (_m, _r, vendor, ts, value): medians of the bins that are wider than blocks, from sorted runs.

    Samples of the runs give bounds of each bin's median; only the few values
    between the bounds are read again.  Runs are not moved unless the bounds are many.
    """
    bins = F.array_compact(F.array(*[
        F.when(F.col("_w") < limit[w], F.struct(F.lit(r).alias("_r"), C.bin_floor("ts", w).alias("ts"))) for r, w in enumerate(widths)]))
    labels = F.array_compact(F.array(*[F.lit(ALL_VENDORS)] * total, F.col("vendor")))
    held = runs.select(F.monotonically_increasing_id().alias("_id"), "_runs", F.col("vendor").alias("_own"), bins.alias("_bins"), labels.alias("_labels"))
    place = ["_m", "_r", "vendor", "ts"]

    def sampled(batches):
        for frame in batches:
            out = []
            for i, parts in zip(frame["_id"], frame["_runs"]):
                for m, part in enumerate(parts):
                    v = np.frombuffer(part)
                    if len(v):
                        out.append((i, m, len(v), v[sample_places(len(v))].tobytes()))
            yield pd.DataFrame(out, columns=["_id", "_m", "_n", "_samples"])

    samples = held.select("_id", "_runs").mapInPandas(sampled, "_id bigint, _m int, _n bigint, _samples binary")
    # one small row per run, bin and label
    where = held.select("_id", F.explode("_bins").alias("_p"), "_labels").select("_id", "_p.*", F.explode("_labels").alias("vendor"))
    placed = checkpointed(samples.join(where, "_id"))

    def bounds(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        n = int(frame["_n"].sum())
        low, high = rank_bounds([(k, np.frombuffer(s)) for k, s in zip(frame["_n"], frame["_samples"])], (n - 1) // 2, n // 2)
        return pd.DataFrame([(*key, n, low, high)], columns=[*place, "_n", "_low", "_high"])

    kinds = "_m int, _r int, vendor string, ts timestamp_ntz, "
    # small groups that take time by their number, so they are not put together by bytes
    tasks = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = placed.repartition(tasks, *place).groupBy(*place).applyInPandas(bounds, kinds + "_n bigint, _low double, _high double")
    wanted = join_on(placed.select("_id", *place), found, place)
    wanted = stored_lookup(wanted.groupBy("_id").agg(F.collect_list(F.struct(*place, "_n", "_low", "_high")).alias("_wanted")))

    def between(batches):
        for frame in batches:
            out = []
            for parts, asked in zip(frame["_runs"], frame["_wanted"]):
                for x in asked:
                    v = np.frombuffer(parts[x["_m"]])
                    below, end = np.searchsorted(v, x["_low"], "left"), np.searchsorted(v, x["_high"], "right")
                    inside, times = np.unique(v[below:end], return_counts=True)
                    out.append((x["_m"], x["_r"], x["vendor"], x["ts"], x["_n"], int(below), inside.tobytes(), times.astype(np.int64).tobytes()))
            yield pd.DataFrame(out, columns=[*place, "_n", "_below", "_values", "_times"])

    def middle(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        n, below = int(frame["_n"].iloc[0]), int(frame["_below"].sum())
        values = np.concatenate([np.frombuffer(x) for x in frame["_values"]])
        times = np.concatenate([np.frombuffer(x, np.int64) for x in frame["_times"]])
        order = np.argsort(values, kind="stable")
        at = np.searchsorted(below + np.cumsum(times[order]), [(n - 1) // 2, n // 2], "right")
        low, high = (float(x) for x in values[order][at])
        with np.errstate(invalid="ignore"):
            value = low if low == high else low + np.float64(high - low) * 0.5
        return pd.DataFrame([(*key, value)], columns=[*place, "value"])

    read = held.select("_id", "_runs").join(wanted, "_id").mapInPandas(
        between, kinds + "_n bigint, _below bigint, _values binary, _times binary")
    return read.repartition(tasks, *place).groupBy(*place).applyInPandas(middle, kinds + "value double")


def bin_medians(
    at: np.ndarray, code: np.ndarray, columns: list[np.ndarray], widths: list[tuple[int, int]], own: list[str], total: bool,
) -> pd.DataFrame:
    """Medians per bin of several widths, of all rows and of each vendor's: ``_r, vendor, ts`` and one per column.

    ``at`` is seconds, ``code`` a position in ``own`` or -1, ``widths`` (name, seconds).
    Each column is sorted once; a stable sort by bin then keeps its order.
    """
    orders = [np.argsort(v, kind="stable")[: len(v) - np.count_nonzero(np.isnan(v))] for v in columns]
    labels = np.array([*own, ALL_VENDORS], dtype=object)
    out = []
    for r, w in widths:
        for of_all in [True] * total + [False] * bool(own):
            inside = np.ones(len(at), bool) if of_all else code >= 0
            group = (at // w) * len(labels) + (len(own) if of_all else code)
            found, place = np.unique(group[inside], return_inverse=True)
            if len(found) == 0:
                continue
            full = np.full(len(at), -1, np.int64)
            full[inside] = place
            # short integers are sorted by their digits
            full = full.astype(np.int16) if len(found) < 1 << 15 else full
            medians = []
            for v, order in zip(columns, orders):
                order = order[full[order] >= 0]
                order = order[np.argsort(full[order], kind="stable")]
                n = np.bincount(full[order], minlength=len(found))
                first = np.cumsum(n) - n
                some = n > 0
                low, high = np.full(len(found), np.nan), np.full(len(found), np.nan)
                low[some] = v[order[(first + (n - 1) // 2)[some]]]
                high[some] = v[order[(first + n // 2)[some]]]
                with np.errstate(invalid="ignore"):
                    medians.append(np.where(low == high, low, low + (high - low) * 0.5))
            out.append(pd.DataFrame({
                "_r": np.full(len(found), r, np.int32), "vendor": labels[found % len(labels)],
                "ts": ((found // len(labels)) * w).astype("datetime64[s]"),
                **{f"_{i}": m for i, m in enumerate(medians)}}))
    columns_out = ["_r", "vendor", "ts", *[f"_{i}" for i in range(len(columns))]]
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=columns_out)


def with_split(series: DataFrame, test_days: int = 120) -> DataFrame:
    """Label rows ``val`` from N days before the last day's midnight, else ``train``.

    One cutoff for all series.
    """
    cutoff = series.agg(F.date_sub(F.to_date(F.max("ts")), test_days).cast("timestamp_ntz").alias("_cutoff"))
    # one row
    return series.join(F.broadcast(cutoff), how="cross").withColumn(
        "split", F.when(F.col("ts") >= F.col("_cutoff"), "val").otherwise("train")).drop("_cutoff")


def split_report(series: DataFrame) -> DataFrame:
    """Rows, series, first and last time per split."""
    per_series = series.groupBy("split", "series_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return per_series.groupBy("split").agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_series"),
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def length_report(series: DataFrame) -> DataFrame:
    """Series count and shortest, median and longest length per resolution."""
    lengths = series.groupBy("resolution", "series_id").agg(F.count(F.lit(1)).alias("n"))
    return lengths.groupBy("resolution").agg(
        F.count(F.lit(1)).alias("n_series"), F.min("n").alias("min_len"),
        F.median("n").alias("median_len"), F.max("n").alias("max_len"))


def distinct_series(series: DataFrame) -> DataFrame:
    return series.select("series_id", *SERIES_KEYS).distinct()


def attach_series_meta(scores: DataFrame, series: DataFrame) -> DataFrame:
    """Metric, resolution and vendor of each scored series."""
    return per_group(scores, distinct_series(series), ["series_id"])


# -- weekly profile -----------------------------------------------------------

def week_slot(ts: str | Column = "ts", monday_first: bool = False) -> list[Column]:
    """Weekday and second of the day."""
    weekday = F.weekday(ts) if monday_first else C.weekday_sunday0(ts)
    return [weekday.alias("wd"), C.seconds_of_day(ts).alias("tb")]


def weekly_profile(
    series: DataFrame, keys: list[str] | None = None, monday_first: bool = False,
    floor: float | None = MAD_FLOOR,
) -> DataFrame:
    """Median and MAD of a series per weekday and time of day.

    A group holds one value per week of the span, so its values fit one short
    array and a single aggregation gives both numbers.
    """
    keys = keys or []
    slots = series.dropna(subset=["value"]).groupBy(*keys, *week_slot("ts", monday_first)).agg(
        F.sort_array(F.collect_list("value")).alias("_values"))
    expected = slots.withColumn("expected", array_quantile(F.col("_values"), 0.5))
    deviations = F.transform("_values", lambda x: F.abs(x - F.col("expected")))
    mad = array_quantile(deviations, 0.5)
    return expected.withColumn("mad", F.greatest(mad, F.lit(floor)) if floor else mad).drop("_values")


def attach_profile(
    series: DataFrame, profile: DataFrame, keys: list[str] | None = None, monday_first: bool = False
) -> DataFrame:
    """Expected value and MAD of each bin's weekly slot; NULL where there is none."""
    slotted = series.select("*", *week_slot("ts", monday_first))
    return per_group(slotted, profile.select(*(keys or []), "wd", "tb", "expected", "mad"),
                     [*(keys or []), "wd", "tb"])


# -- daily series -------------------------------------------------------------

def daily_series(
    rows: DataFrame, ts: str, metric: str | None = None, first: str | None = None,
    last: str | None = None, keys: list[str] | None = None,
) -> DataFrame:
    """Count (no metric) or median per calendar day: ``keys, day, value``."""
    keys = keys or []
    dated = rows.withColumn("day", F.to_date(ts))
    if first:
        dated = dated.filter(F.col("day") >= F.lit(first).cast("date"))
    if last:
        dated = dated.filter(F.col("day") <= F.lit(last).cast("date"))
    if metric is None or canonical(metric) == COUNT_METRIC:
        return dated.groupBy(*keys, "day").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return quantiles(dated, [*keys, "day"], metric, {"value": 0.5}).drop("n")


def fill_calendar(
    daily: DataFrame, keys: list[str] | None = None, first: str | None = None, last: str | None = None
) -> DataFrame:
    """Every day from ``first`` to ``last`` (default: each series' own span)."""
    keys = keys or []
    low = F.lit(first).cast("date") if first else F.min("day")
    high = F.lit(last).cast("date") if last else F.max("day")
    spans = daily.groupBy(*keys).agg(F.min("day").alias("_a"), F.max("day").alias("_b"),
                                     low.alias("_first"), high.alias("_last"))
    spine = spans.select(*keys, F.explode(F.sequence("_first", "_last")).alias("day"))
    return join_on(spine, daily, [*keys, "day"], "left")


def interpolate_linear(filled: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Fill NULLs on a straight line between neighbours; edges repeat the nearest value.

    Runs on a gap-free calendar of days, so a series has at most its span's days.
    """
    by = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("day")
    past = by.rowsBetween(Window.unboundedPreceding, 0)
    ahead = by.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("value").isNotNull(), F.struct("day", "value"))
    both = filled.select(
        "*", F.last(known, ignorenulls=True).over(past).alias("_a"),
        F.first(known, ignorenulls=True).over(ahead).alias("_b"))
    gap = F.date_diff(F.col("_b.day"), F.col("_a.day"))
    done = F.date_diff(F.col("day"), F.col("_a.day"))
    line = F.col("_a.value") + (F.col("_b.value") - F.col("_a.value")) * done / F.when(gap != 0, gap)
    value = F.coalesce("value", line, F.col("_a.value"), F.col("_b.value"))
    return both.withColumn("value", value).drop("_a", "_b")


def calendar_lag(daily: DataFrame, days: list[int], keys: list[str] | None = None) -> DataFrame:
    """Values exactly N days earlier as ``lag_<N>d``, NULL where there is no such day.

    One shuffle by shifted day: each row is sent to its own day and to the days
    that look back at it.
    """
    keys = keys or []
    sent = F.array(F.struct(F.lit(0).alias("by"), F.col("day").alias("day")),
                   *[F.struct(F.lit(n).alias("by"), F.date_add("day", n).alias("day")) for n in days])
    moved = daily.select(*keys, F.explode(sent).alias("_to"), F.col("value").alias("_v"))
    picked = moved.groupBy(*keys, F.col("_to.day").alias("day")).agg(
        F.max(F.col("_to.by") == 0).alias("_here"),
        *[F.max(F.when(F.col("_to.by") == n, F.col("_v"))).alias(f"lag_{n}d") for n in days],
        F.max(F.when(F.col("_to.by") == 0, F.col("_v"))).alias("value"))
    return picked.filter("_here").select(*keys, "day", "value", *[f"lag_{n}d" for n in days])


def trailing_mean(
    daily: DataFrame, far: int = 395, near: int = 365, keys: list[str] | None = None,
    name: str = "trailing_mean",
) -> DataFrame:
    """Mean of the values dated from ``far`` to ``near`` days earlier, both included."""
    number = F.date_diff(F.col("day"), F.lit("1970-01-01").cast("date"))
    frame = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_no").rangeBetween(-far, -near)
    return daily.withColumn("_no", number).withColumn(name, F.avg("value").over(frame)).drop("_no")


# -- lags, splits, windows ----------------------------------------------------

def lag_features(
    series: DataFrame, n: int | None = None, keys: list[str] | None = None,
    resolution: str = "1h", time_features: bool = True,
) -> DataFrame:
    """Previous ``n`` values by row position as ``lag_1..lag_n``, with calendar features.

    NULL bins are skipped first; rows without a full set of lags drop.
    """
    keys, n = keys or [], n or lag_count(resolution)
    present = with_position(series.dropna(subset=["value"]), keys)
    lags = lagged(present, keys, "value", {f"lag_{i}": i for i in range(1, n + 1)})
    full = lags.filter(F.col("_pos") >= n)
    if not time_features:
        return full
    wanted = time_feature_names(resolution)
    calendar = dict(zip(["wd", "hour", "minute", "second"], C.time_features("ts")))
    return full.withColumns({name: calendar[name] for name in wanted})


def feature_names(resolution: str, n: int | None = None) -> list[str]:
    """Column order of the forecasters' features."""
    return [f"lag_{i}" for i in range(1, (n or lag_count(resolution)) + 1)] + time_feature_names(resolution)


def time_split(
    series: DataFrame, fraction: float, keys: list[str] | None = None,
    min_rows: int = 0, min_train: int = 0, min_holdout: int = 0, ts: str = "ts",
) -> DataFrame:
    """Label the first ``floor(fraction * n)`` rows ``train`` and the rest ``holdout``.

    Series below any of the minimum sizes are left out.
    """
    placed = with_position(series, keys or [], ts)
    cut = F.floor(F.lit(fraction) * F.col("_n"))
    big = (F.col("_n") >= min_rows) & (cut >= min_train) & (F.col("_n") - cut >= min_holdout)
    part = F.when(F.col("_pos") < cut, "train").otherwise("holdout")
    return placed.filter(big).withColumn("part", part).drop("_pos", "_n")


def context_and_horizon(
    series: DataFrame, start: str, end: str, resolution: str, max_context: int = 1024,
    keys: list[str] | None = None, min_context: int = 8,
) -> DataFrame:
    """The last bins before ``start`` and all bins of the range, marked by ``role``.

    Only ``max_context`` bin widths before the start are read.  Series without
    at least 8 context bins and 1 horizon bin are left out.
    """
    keys = keys or []
    at, to = (F.lit(t).cast("timestamp_ntz") for t in (start, end))
    reach = F.make_dt_interval(secs=F.lit(max_context * resolution_seconds(resolution)).cast("decimal(18,6)"))
    near = series.filter(F.col("ts").between(at - reach, to)).withColumn(
        "role", F.when(F.col("ts") < at, "context").otherwise("horizon"))
    # the context side holds at most max_context + 1 bins per series
    newest = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc("ts"))
    context = (near.filter("role = 'context'")
               .withColumn("_rank", F.row_number().over(newest))
               .filter(F.col("_rank") <= max_context).drop("_rank"))
    horizon = near.filter("role = 'horizon'")
    both = context.unionByName(horizon)
    sizes = both.withColumn("_g", F.lit(0)).groupBy("_g", *keys).agg(
        F.count_if(F.col("role") == "context").alias("_ctx"),
        F.count_if(F.col("role") == "horizon").alias("_hor"))
    enough = sizes.filter((F.col("_ctx") >= min_context) & (F.col("_hor") >= 1)).select("_g", *keys)
    return join_on(both.withColumn("_g", F.lit(0)), enough, ["_g", *keys], "left_semi").drop("_g")


def fixed_windows(
    series: DataFrame, context: int, horizon: int, stride: int, cap: int | None = None,
    keys: list[str] | None = None, first_origin: Column | int | None = None, partial: bool = False,
) -> DataFrame:
    """Windows of ``context`` values and the ``horizon`` values after them.

    Origins start at position ``context`` (or ``first_origin``) and step by
    ``stride`` while a full horizon fits; ``partial`` also keeps short contexts
    and a short last horizon.  With ``cap`` an evenly spaced subset is taken.
    Rows go to the windows they belong to, so a window's arrays are the only
    thing gathered: ``keys, origin, context[], target[], target_ts[]``.
    """
    keys = keys or []
    placed = with_position(series.dropna(subset=["value"]), keys)
    start = F.lit(context) if first_origin is None else (
        F.lit(first_origin) if isinstance(first_origin, int) else first_origin)
    first = start.cast("bigint")
    pos, size = F.col("_pos"), F.col("_n")
    count = F.floor((size - first - (1 if partial else horizon)) / stride) + 1
    # window k covers positions first + k*stride - context .. first + k*stride + horizon - 1
    low = F.greatest(F.ceil((pos - horizon + 1 - first) / stride), F.lit(0))
    high = F.least(F.floor((pos + context - first) / stride), count - 1)
    sent = placed.select("*", first.alias("_first"), count.alias("_m"), low.alias("_lo"), high.alias("_hi"))
    sent = sent.filter("_lo <= _hi").withColumn("_k", F.explode(F.sequence("_lo", "_hi")))
    if cap:
        sent = sent.filter((F.col("_m") <= cap) | _evenly_picked(F.col("_k"), F.col("_m"), cap))
    sent = sent.withColumn("origin", F.col("_first") + F.col("_k") * stride)
    cell = F.struct((pos - F.col("origin")).alias("at"), "ts", F.col("value").cast("double").alias("v"))
    gathered = sent.groupBy(*keys, "origin").agg(F.sort_array(F.collect_list(cell)).alias("_w"))
    behind, ahead = F.filter("_w", lambda x: x["at"] < 0), F.filter("_w", lambda x: x["at"] >= 0)
    return gathered.select(
        *keys, "origin", behind["v"].alias("context"), ahead["v"].alias("target"),
        ahead["ts"].alias("target_ts"))


def _evenly_picked(k: Column, m: Column, cap: int) -> Column:
    """Whether ``k`` is one of ``cap`` evenly spaced integers in 0..m-1, cut to whole."""
    if cap == 1:
        return k == 0
    step = (m - 1) / F.lit(cap - 1)
    near = F.floor(k / step).cast("bigint")
    hits = F.lit(False)
    for i in (near, near + 1):
        hits = hits | ((i < cap - 1) & (F.floor(i * step) == k))
    return hits | (k == m - 1)


def rolling_origins(
    series: DataFrame, context: int, horizon: int, cap: int | None = 150, keys: list[str] | None = None
) -> DataFrame:
    """Origins in the ``val`` part, one horizon apart, with a full context behind."""
    keys = keys or []
    present = series.dropna(subset=["value"]).withColumn("_g", F.lit(0))
    starts = present.groupBy("_g", *keys).agg(F.count_if(F.col("split") == "train").alias("_val"))
    with_start = per_group(present, starts, ["_g", *keys]).drop("_g")
    short = F.greatest(F.ceil((F.lit(context) - F.col("_val")) / horizon), F.lit(0))
    return fixed_windows(with_start, context, horizon, horizon, cap, keys,
                         F.col("_val") + short * horizon)


def random_windows(
    series: DataFrame, context: int, horizon: int, n: int, seed: int = 42, keys: list[str] | None = None
) -> DataFrame:
    """``n`` windows drawn with replacement: a series, then a start, each uniform.

    Draws are hashes of (seed, draw number), so a rerun gives the same windows.
    """
    keys = keys or []
    size = context + horizon
    placed = with_position(series.dropna(subset=["value"]).withColumn("_g", F.lit(0)), ["_g", *keys])
    # one row per series
    eligible = placed.groupBy("_g", *keys).agg(F.max("_n").alias("_len")).filter(F.col("_len") >= size)
    numbered = checkpointed(global_position(eligible, ["_g", *keys]).withColumnRenamed("_pos", "_i"))
    draws = series.sparkSession.range(n).withColumnRenamed("id", "draw")
    total = numbered.count()
    chosen = draws.filter(F.lit(total > 0)).withColumn(
        "_i", F.pmod(F.xxhash64("draw", F.lit(seed)), F.lit(max(total, 1)))).join(numbered, "_i")
    chosen = chosen.withColumn(
        "start", F.pmod(F.xxhash64(F.lit(seed), "draw", F.lit("start")), F.col("_len") - size + 1))
    # send each draw to the position blocks it reads, then pick its rows there
    block = 4 * size
    reads = chosen.withColumn("_block", F.explode(F.sequence(
        F.floor(F.col("start") / block), F.floor((F.col("start") + size - 1) / block)))).drop("_i", "_len")
    rows = placed.withColumn("_block", F.floor(F.col("_pos") / block)).select(
        "_g", *keys, "_block", "_pos", "value")
    hit = join_on(rows, reads, ["_g", *keys, "_block"]).filter(
        (F.col("_pos") >= F.col("start")) & (F.col("_pos") < F.col("start") + size))
    pairs = F.sort_array(F.collect_list(F.struct("_pos", F.col("value").cast("double").alias("v"))))
    values = F.transform(pairs, lambda x: x["v"])
    return hit.groupBy("draw", *keys, "start").agg(values.alias("_w")).select(
        "draw", *keys, "start", F.slice("_w", 1, context).alias("context"),
        F.slice("_w", context + 1, horizon).alias("target"))


def latest_per_key(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row with the newest version per key; combines map-side."""
    rest = [c for c in df.columns if c not in (*keys, version)]
    row = F.max(F.struct(version, *rest)).alias("_row")
    return df.groupBy(*keys).agg(row).select(
        *[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def keep_newest(series: DataFrame, max_bins: int = 4000, keys: list[str] | None = None) -> DataFrame:
    """The newest ``max_bins`` bins of each series."""
    placed = with_position(series, keys or [])
    return placed.filter(F.col("_pos") >= F.col("_n") - max_bins).drop("_pos", "_n")


def naive_diff(series: DataFrame, keys: list[str] | None = None, value: str = "value") -> DataFrame:
    """Absolute change from the previous row as ``naive_diff``."""
    rows = lagged(series, keys or [], value, {"_prev": 1})
    return rows.withColumn("naive_diff", F.abs(F.col(value) - F.col("_prev"))).drop("_prev", "_pos", "_n")


def sample_rows(df: DataFrame, n: int, seed: int = 42, key: str | list[str] | None = None) -> DataFrame:
    """``n`` rows drawn without replacement, the same for any partitioning.

    Rows are ordered by a hash of ``key``, by default of all columns; a hash
    threshold first keeps about the needed share, so only that share is ordered.
    Rows that share a key are drawn together, but for the last one drawn.
    """
    keys = [key] if isinstance(key, str) else key or df.columns
    total = df.count()
    if total <= n:
        return df
    scale = 1 << 40
    share = n / total
    slack = 8 * (share / total) ** 0.5 + 8 / total
    ranked = df.withColumn("_h", F.xxhash64(*keys, F.lit(seed)))
    near = ranked.filter(F.pmod(F.col("_h"), F.lit(scale)) < F.lit(int(min(1.0, share + slack) * scale)))
    return near.orderBy(F.pmod(F.col("_h"), F.lit(scale)), *df.columns).limit(n).drop("_h")


def block_rows(df: DataFrame, hours: int = 24, ts: str = PICKUP) -> DataFrame:
    """Calendar-aligned block start of each row as ``block``."""
    return df.withColumn("block", C.bin_floor(ts, hours * 3600))


