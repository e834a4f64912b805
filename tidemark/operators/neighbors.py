"""Nearest neighbours and density noise on binned series.

Bins are compared on value and calendar position (weekday, hour, minute,
second), all standardised.  Calendar positions are a fixed grid: a *slot* holds
one bin per week, so slots are small, and two bins can only be near each other
when their slots are.  Each bin is sent to the slots within reach and compared
there by binary search on the sorted values; pairs are never listed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions.joins import join_on
from tidemark.functions.ordering import per_group
from tidemark.functions.quantiles import quantiles
from tidemark.operators import anomaly as A
from tidemark.session import checkpointed

# ---- fixed values -----------------------------------------------------------
GRID = {"wd": 7, "hour": 24, "minute": 60, "second": 60}
NEIGHBORS = 5
EPS_QUANTILE = 0.90
EPS_FLOOR = 0.3
MIN_CORE = 3
CORE_SHARE = 20
NOISE_Z = 3.0
# ---- end of fixed values ----------------------------------------------------

# Relative tolerance for distances equal to a radius.
TIE = 1e-9
# First search radius, in steps of the finest calendar axis.
FIRST_STEPS = 6.0
# Calendars of at most this many slots are searched whole.
FEW_SLOTS = 512

_UNIT = {name: f"_u_{name}" for name in GRID}
_SEEN = {name: f"_seen_{name}" for name in GRID}


def prepare(series: DataFrame, keys: list[str]) -> DataFrame:
    """Standardised value ``_v``, slot columns, and each calendar axis' unit and positions.

    A unit is one grid step in standardised terms, 0 for a constant axis.
    """
    calendar = dict(zip(GRID, C.time_features("ts")))
    rows = series.select(*keys, "ts", "value").dropna(subset=["value"]).withColumns(calendar)
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"),
        *[F.stddev_pop(g).alias(f"_s_{g}") for g in GRID],
        # at most 7, 24, 60 and 60 positions
        *[F.sort_array(F.collect_set(g)).alias(_SEEN[g]) for g in GRID])
    units = {_UNIT[g]: F.when(F.col(f"_s_{g}") > 0, 1 / F.when(F.col(f"_s_{g}") > 0, F.col(f"_s_{g}"))).otherwise(0.0)
             for g in GRID}
    value = F.when(F.col("_s") > 0, (F.col("value") - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s"))).otherwise(0.0)
    return per_group(rows, stats, keys).withColumns({**units, "_v": value}).drop(
        "_m", "_s", *[f"_s_{g}" for g in GRID])


def _reach(df: DataFrame, radius: Column) -> DataFrame:
    """Copies of each row, one per slot within ``radius``: adds ``to_*`` and ``_t2``.

    ``_t2`` is the squared calendar distance to that slot.  Only positions that
    occur in the series are tried.
    """
    out = df.withColumn("_r", radius).withColumn("_t2", F.lit(0.0))
    for g in GRID:
        unit, here = F.col(_UNIT[g]), F.col(g)
        # rounding must not cut off an exact tie
        limit = F.col("_r") * F.col("_r") * (1 + TIE) + 1e-12
        near = F.filter(_SEEN[g], lambda x: F.pow((x - here) * unit, 2) + F.col("_t2") <= limit)
        out = out.withColumn(f"to_{g}", F.explode(near))
        step = (F.col(f"to_{g}") - here) * unit
        out = out.withColumn("_t2", F.col("_t2") + step * step)
    return out


def _slot_schema(df: DataFrame, keys: list[str], extra: str) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["ts timestamp_ntz", extra])


def _meet(points: DataFrame, queries: DataFrame, keys: list[str], work, extra: str) -> DataFrame:
    """Bring each slot's points and the queries sent to it together."""
    slot = [f"to_{g}" for g in GRID]
    tagged_points = points.select(
        *keys, *[F.col(g).alias(f"to_{g}") for g in GRID], "ts", "_v",
        F.lit(0.0).alias("_t2"), F.lit(0.0).alias("_r"), F.lit(True).alias("_point"))
    tagged_queries = queries.select(*keys, *slot, "ts", "_v", "_t2", "_r", F.lit(False).alias("_point"))
    both = tagged_points.unionByName(tagged_queries)
    return both.groupBy(*keys, *slot).applyInPandas(work, _slot_schema(points, keys, extra))


def _count_work(keys: list[str]):
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        point = pdf["_point"].to_numpy()
        values = np.sort(pdf.loc[point, "_v"].to_numpy())
        asked = pdf[~point]
        v, t2, r = (asked[c].to_numpy() for c in ("_v", "_t2", "_r"))
        # nearest by distance: start from the widest value gap and check its edges exactly
        gap = np.sqrt(np.maximum(r * r - t2, 0.0))
        lo = np.searchsorted(values, v - gap - 1e-9, "left")
        hi = np.searchsorted(values, v + gap + 1e-9, "right")
        for edge, step in ((lo, 1), (hi, -1)):
            for _ in range(len(values)):
                at = edge if step == 1 else edge - 1
                open_ = lo < hi
                probe = values[np.clip(at, 0, max(len(values) - 1, 0))] if len(values) else v
                far = open_ & (np.sqrt((probe - v) ** 2 + t2) > r)
                if not far.any():
                    break
                edge += np.where(far, step, 0)
        out = asked[[*keys, "ts"]].copy()
        out["found"] = np.maximum(hi - lo, 0)
        return out[out["found"] > 0]

    return work


def neighbor_counts(points: DataFrame, queries: DataFrame, keys: list[str], radius: Column) -> DataFrame:
    """Points within ``radius`` of each query row (itself included): ``keys, ts, found``.

    A hair's width of tolerance counts points exactly at the radius, however
    their distances were rounded.
    """
    met = _meet(points, _reach(queries, radius * (1 + TIE)), keys, _count_work(keys), "found bigint")
    return met.groupBy(*keys, "ts").agg(F.sum("found").alias("found"))


def _nearest_work(keys: list[str], k: int):
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        point = pdf["_point"].to_numpy()
        values = np.sort(pdf.loc[point, "_v"].to_numpy())
        asked = pdf[~point]
        out = asked[[*keys, "ts"]].copy()
        if len(values) == 0 or len(asked) == 0:
            out["near"] = pd.Series([[]] * len(asked), index=out.index, dtype=object)
            return out
        v, t2 = asked["_v"].to_numpy(), asked["_t2"].to_numpy()
        at = np.searchsorted(values, v)
        # the k nearest of a sorted list lie within k places of the insertion point
        places = at[:, None] + np.arange(-k, k)[None, :]
        valid = (places >= 0) & (places < len(values))
        gap = values[np.clip(places, 0, len(values) - 1)] - v[:, None]
        dist = np.where(valid, np.sqrt(gap ** 2 + t2[:, None]), np.inf)
        dist = np.sort(dist, axis=1)[:, :k]
        out["near"] = pd.Series([row[np.isfinite(row)].tolist() for row in dist], index=out.index, dtype=object)
        return out

    return work


def knn_distance(points: DataFrame, keys: list[str], k: int = NEIGHBORS) -> DataFrame:
    """Distance from each bin to its ``min(k, n - 1)``-th neighbour, itself the first.

    Searches slots within a radius and doubles it for the bins whose answer is
    not yet certain, so every answer is exact.
    """
    wanted = F.least(F.lit(k), F.greatest(F.col("_n") - 1, F.lit(1)))
    # the calendar part of a distance cannot exceed this, nor any radius need to
    widest = F.sqrt(sum(((F.lit(size - 1) * F.col(_UNIT[g])) ** 2 for g, size in GRID.items()), F.lit(0.0)))
    todo = points.withColumn("_k", wanted).withColumn("_wide", widest)
    # a coarse calendar has few slots, so all are searched at once; else begin
    # with a few steps of the finest axis
    slots, steps = F.lit(1), []
    for g in GRID:
        seen = F.col(_SEEN[g])
        slots = slots * F.size(seen)
        steps.append(F.when(F.size(seen) > 1, F.col(_UNIT[g]) * (F.array_max(seen) - F.array_min(seen))
                            / F.when(F.size(seen) > 1, F.size(seen) - 1)))
    todo = todo.withColumn("_radius", F.when(slots <= FEW_SLOTS, F.col("_wide") + 1.0).otherwise(
        FIRST_STEPS * F.coalesce(F.least(*steps), F.lit(0.0))))
    done = None
    while True:
        near = _meet(points, _reach(todo, F.col("_radius")), keys, _nearest_work(keys, k), "near array<double>")
        merged = near.groupBy(*keys, "ts").agg(F.sort_array(F.flatten(F.collect_list("near"))).alias("_near"))
        looked = join_on(todo, merged, [*keys, "ts"], "left").withColumn(
            "knn", F.get("_near", (F.col("_k") - 1).cast("int")))
        certain = F.col("knn").isNotNull() & (
            (F.col("knn") <= F.col("_radius")) | (F.col("_radius") >= F.col("_wide")))
        looked = checkpointed(looked.withColumn("_sure", F.coalesce(certain, F.lit(False))).drop("_near"))
        settled = looked.filter("_sure").select(*keys, "ts", "knn")
        done = settled if done is None else done.unionByName(settled)
        todo = looked.filter("NOT _sure").drop("_sure", "knn")
        if todo.isEmpty():
            return done
        # beyond the widest calendar distance every slot has been searched
        todo = todo.withColumn("_radius", F.when(
            2 * F.col("_radius") >= F.col("_wide"), F.col("_wide") + 1.0).otherwise(2 * F.col("_radius")))


def density_noise(series: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Label bins that no dense region reaches: adds ``eps``, ``found`` and ``is_noise``.

    A bin is dense with ``max(3, n // 20)`` bins within ``eps``, the 90 % quantile
    of fifth-neighbour distances (at least 0.3); noise is neither dense nor within
    ``eps`` of a dense bin.  Cluster numbers are not needed for that.
    """
    keys = ["_g", *(keys or [])]
    points = checkpointed(prepare(series.withColumn("_g", F.lit(0)), keys))
    eps = quantiles(knn_distance(points, keys), keys, "knn", {"eps": EPS_QUANTILE}).drop("n")
    points = checkpointed(per_group(points, eps, keys).withColumn("eps", F.greatest("eps", F.lit(EPS_FLOOR))))
    found = neighbor_counts(points, points, keys, F.col("eps"))
    needed = F.greatest(F.lit(MIN_CORE), F.floor(F.col("_n") / CORE_SHARE))
    counted = checkpointed(join_on(points, found, [*keys, "ts"]).withColumn("_core", F.col("found") >= needed))
    core = counted.filter("_core")
    touched = neighbor_counts(core, counted.filter("NOT _core"), keys, F.col("eps")).select(
        *keys, "ts", F.lit(True).alias("_touched"))
    return (
        join_on(counted, touched, [*keys, "ts"], "left")
        .withColumn("is_noise", ~F.col("_core") & F.col("_touched").isNull())
        .select(*keys[1:], "ts", "value", "eps", "found", "is_noise")
    )


def dbscan_noise(series: DataFrame, k: float = 3.0, keys: list[str] | None = None) -> DataFrame:
    """Density noise as z-score 3 (else 0), blended with the local deviation."""
    noise = checkpointed(density_noise(series, keys))
    scored = noise.withColumn("z", F.when(F.col("is_noise"), F.lit(NOISE_Z)).otherwise(F.lit(0.0)))
    return A.blend_score(scored, k, "z", keys)
