"""Exact centred rolling medians of series of any length and frames of any width.

Rows are worked on in blocks of consecutive positions.  Most of a wide frame is
common to all frames of a block; of this common part only the values near its
middle can become a median.  Counts per (block, slice of ranks) tell how many
values lie below and which slices are near the middle, and only their rows are
sent to the block, beside those at the frames' edges.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.joins import join_on
from tidemark.functions.ordering import global_position
from tidemark.session import checkpointed

# Positions of a block, and the most blocks of a series; a longer series has larger blocks.
BLOCK, MOST_BLOCKS = 16_384, 512


def rolling_median(
    df: DataFrame, keys: list[str], value: str, name: str, width: str = "_w", block: int | None = None
) -> DataFrame:
    """Add the median of each row's centred frame; missing values are left out of it.

    ``df`` has ``_pos`` and ``_n`` and the same ``width`` (rows in a frame) for
    all rows of a series.  A task holds a few blocks' rows, whatever the width.
    """
    if not keys:
        return rolling_median(df.withColumn("_one", F.lit(0)), ["_one"], value, name, width, block).drop("_one")
    series = df.select(*keys, "_n", width).distinct()
    size = F.greatest(F.lit(block or BLOCK), F.ceil(F.col("_n") / MOST_BLOCKS)).cast("bigint")
    series = checkpointed(series.select(
        *keys, "_n", size.alias("_size"), F.floor(F.col(width) / 2).alias("_pre"), F.floor((F.col(width) - 1) / 2).alias("_post")))
    rows = join_on(df.select(*keys, "_pos", F.col(value).cast("double").alias("_v")), series, keys)
    rows = checkpointed(rows.select(*keys, "_pos", "_v", "_size", F.floor(F.col("_pos") / F.col("_size")).alias("_p")))
    # Blocks, the blocks common to all their frames (_c1 to _c2), and the first and last block any frame reaches.
    last = F.col("_n") - 1
    low, high = F.col("_b") * F.col("_size"), F.least((F.col("_b") + 1) * F.col("_size") - 1, last)
    inner_low, inner_high = F.greatest(high - F.col("_pre"), F.lit(0)), F.least(low + F.col("_post"), last)
    blocks = checkpointed(
        series.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(last / F.col("_size")))))
        .withColumns({
            "_c1": F.ceil(inner_low / F.col("_size")),
            "_c2": F.when(inner_high == last, F.floor(last / F.col("_size"))).otherwise(F.floor((inner_high + 1) / F.col("_size")) - 1),
            "_from": F.greatest(low - F.col("_pre"), F.lit(0)), "_to": F.least(high + F.col("_post"), last)}))
    common = blocks.filter("_c1 <= _c2")

    # The rows each block needs: its own, those at its frames' edges, and common ones near the middle.
    def part(frame: DataFrame, role: str) -> DataFrame:
        return frame.select(*keys, "_b", F.lit(role).alias("_role"), "_pos", "_v")

    own = part(rows.withColumn("_b", F.col("_p")), "own")
    reach = blocks.select(
        *keys, "_b", "_from", "_to", "_c1", "_c2",
        F.explode(F.sequence(F.floor(F.col("_from") / F.col("_size")), F.floor(F.col("_to") / F.col("_size")))).alias("_p")
    ).filter("_c1 > _c2 OR _p < _c1 OR _p > _c2")
    edges = part(join_on(reach.drop("_c1", "_c2"), rows.drop("_size"), [*keys, "_p"]).filter("_pos BETWEEN _from AND _to"), "edge")
    given, frames = own.unionByName(edges), blocks.select(*keys, "_b", "_pre", "_post")
    if common.isEmpty():  # no frame is wider than its block
        given = join_on(given, frames.withColumns({"_below": F.lit(0), "_common": F.lit(0)}), [*keys, "_b"])
    else:
        near, below = _near_middle(rows, common, keys)
        given = given.unionByName(part(near, "common"))
        frames = join_on(frames, below, [*keys, "_b"], "left").fillna(0, ["_below", "_common"])
        given = join_on(given, frames, [*keys, "_b"])
    kinds = {f.name: f.dataType.simpleString() for f in df.select(*keys).schema.fields}
    schema = ", ".join([*(f"`{k}` {t}" for k, t in kinds.items()), "_pos bigint", f"`{name}` double"])
    found = given.groupBy(*keys, "_b").applyInPandas(lambda pdf: _block_medians(pdf, keys, name), schema)
    return join_on(df, found, [*keys, "_pos"])


def _near_middle(rows: DataFrame, common: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of each block's common part that can be a median, and how many of its values lie below them and in all."""
    ranked = checkpointed(global_position(
        rows.withColumnRenamed("_pos", "_at"), [*keys, "_v", "_at"]).withColumn(
        "_slice", F.floor(F.col("_pos") / F.col("_size"))).drop("_pos", "_size").withColumnRenamed("_at", "_pos"))
    # How many common values lie in each slice, and the slices that can hold a median.
    cells = ranked.filter("_v IS NOT NULL AND NOT isnan(_v)").groupBy(*keys, "_p", "_slice").agg(F.count(F.lit(1)).alias("_c"))
    inside = join_on(
        common.select(*keys, "_b", F.explode(F.sequence("_c1", "_c2")).alias("_p")), cells, [*keys, "_p"])
    whole = Window.partitionBy(*keys, "_b")
    counts = inside.groupBy(*keys, "_b", "_slice").agg(F.sum("_c").alias("_c")).withColumns({
        "_upto": F.sum("_c").over(whole.orderBy("_slice")), "_common": F.sum("_c").over(whole)})
    edge = (F.col("_to") - F.col("_from") + 1) - (F.col("_c2") - F.col("_c1") + 1) * F.col("_size") + F.col("_size")
    counts = join_on(counts, common.select(*keys, "_b", "_c1", "_c2", edge.alias("_edge")), [*keys, "_b"])
    middle = F.floor(F.col("_common") / 2)
    near = checkpointed(counts.filter(
        (F.col("_upto") > middle - F.col("_edge") - 1) & (F.col("_upto") - F.col("_c") <= middle + F.col("_edge") + 1)))
    below = near.groupBy(*keys, "_b").agg(
        F.min(F.col("_upto") - F.col("_c")).alias("_below"), F.max("_common").alias("_common"))

    return join_on(near.select(*keys, "_b", "_slice", "_c1", "_c2"), ranked, [*keys, "_slice"]).filter(
        "_p BETWEEN _c1 AND _c2"), below


def _block_medians(pdf: pd.DataFrame, keys: list[str], name: str) -> pd.DataFrame:
    """Medians of one block's own rows: the sorted values near the middle, with the edges moving through them."""
    own = pdf[pdf["_role"] == "own"].sort_values("_pos")
    edge = pdf[(pdf["_role"] == "edge") & pdf["_v"].notna()].sort_values("_pos")
    values = sorted(pdf.loc[(pdf["_role"] == "common") & pdf["_v"].notna(), "_v"].tolist())
    pre, post, below, common = (int(pdf[c].iloc[0]) for c in ("_pre", "_post", "_below", "_common"))
    places, moving = edge["_pos"].to_numpy(), edge["_v"].tolist()
    starts = np.searchsorted(places, own["_pos"].to_numpy() - pre)
    ends = np.searchsorted(places, own["_pos"].to_numpy() + post, "right")
    out, at, to = [], 0, 0
    for start, end in zip(starts.tolist(), ends.tolist()):
        while to < end:
            insort(values, moving[to])
            to += 1
        while at < start:
            del values[bisect_left(values, moving[at])]
            at += 1
        n = common + end - start
        if n == 0:
            out.append(None)
            continue
        low = values[(n - 1) // 2 - below]
        high = low if n % 2 else values[n // 2 - below]
        out.append(low if low == high else low + (high - low) * 0.5)
    return own[[*keys, "_pos"]].assign(**{name: pd.Series(out, index=own.index, dtype=float)})
