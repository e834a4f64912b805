"""Isolation forest (Liu, Ting and Zhou, 2008) on Spark.

Each tree sees a few hundred hashed-drawn rows.  Trees of a forest per group
stay a table: they meet the rows of their group, cut into parts of bounded size,
in a cogroup.  Only a forest of a whole table, which has at most
``trees * 2 * tree_rows`` nodes whatever the data's size, is sent to the tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions.joins import join_on
from tidemark.functions.ordering import per_group
from tidemark.functions.quantiles import quantiles, scalar_quantiles
from tidemark.operators import anomaly as A
from tidemark.schema import (
    CLEAN_FEATURES, FILE_CONTAMINATION, MIN_FOREST_ROWS, SERIES_CONTAMINATION, STREAM_CONTAMINATION,
    TREE_ROWS, TREES, time_feature_names,
)
from tidemark.session import checkpointed, stored_lookup

# Groups a block's trees are grown in; its row pool is copied once per group.
GROW_GROUPS = 8
# Hashes are compared modulo this.
HASH_RANGE = 1 << 40
# Rows scored at a time inside a task, and rows of a group that one task holds.
SCORE_ROWS, PART_ROWS = 4096, 50_000
# The score above which a record is anomalous when no share is given.
AUTO_SCORE = 0.5


def average_path(n: float) -> float:
    """Expected path length of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _grow(values: np.ndarray, depth_limit: int, rng: np.random.Generator) -> list[tuple]:
    """Nodes of one tree: (node, feature, cut, left, right, path)."""
    nodes, work = [None], [(0, np.arange(len(values)), 0)]
    while work:
        node, rows, depth = work.pop()
        part = values[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        splittable = np.flatnonzero(high > low)
        if depth >= depth_limit or len(rows) <= 1 or len(splittable) == 0:
            nodes[node] = (node, -1, 0.0, node, node, depth + average_path(len(rows)))
            continue
        f = int(rng.choice(splittable))
        cut = float(rng.uniform(low[f], high[f]))
        below = part[:, f] < cut
        if not below.any():
            below = part[:, f] <= low[f]
        left, right = len(nodes), len(nodes) + 1
        nodes += [None, None]
        nodes[node] = (node, f, cut, left, right, 0.0)
        work += [(left, rows[below], depth + 1), (right, rows[~below], depth + 1)]
    return nodes


@dataclass
class Forest:
    """Trees as (tree, node) arrays, and the features they read.

    A leaf has feature -1 and points to itself.
    """

    features: list[str]
    arrays: dict[str, np.ndarray] | None

    @classmethod
    def stacked(cls, features: list[str], trees: pd.DataFrame) -> "Forest":
        """Node lists of one forest as arrays padded to the largest tree; no trees give no forest."""
        if not len(trees):
            return cls(features, None)
        lists = [np.asarray(n, dtype=float).reshape(-1, 6) for n in trees.sort_values("tree")["nodes"]]
        block = np.zeros((len(lists), max(len(n) for n in lists), 6))
        block[:, :, 1] = -1
        for i, nodes in enumerate(lists):
            block[i, : len(nodes)] = nodes
        return cls(features, {
            "feature": block[:, :, 1].astype(np.int16), "cut": block[:, :, 2],
            "left": block[:, :, 3].astype(np.int32), "right": block[:, :, 4].astype(np.int32),
            "path": block[:, :, 5], "norm": average_path(float(trees["rows"].iloc[0]))})

    def score(self, values: np.ndarray) -> np.ndarray:
        """Scores in (0, 1]; NaN for rows without all features, or without trees."""
        out = np.full(len(values), np.nan)
        if self.arrays is None:
            return out
        found, usable = self.arrays, np.flatnonzero(~np.isnan(values).any(axis=1))
        feature, left = np.maximum(found["feature"], 0).astype(np.intp), found["left"].astype(np.intp)
        # of two children the right one follows the left; a leaf has no cut, so a row stays there
        cut = np.where(found["feature"] < 0, np.nan, found["cut"])
        levels = self.depths()
        for start in range(0, len(usable), SCORE_ROWS):
            part = values[usable[start:start + SCORE_ROWS]]
            # one tree at a time, so that nodes and cells stay in the processor's cache
            cells, row = part.T.ravel(), np.arange(len(part))
            path = np.empty((len(feature), len(part)))
            for tree in range(len(feature)):
                base, cuts, lefts, at = feature[tree] * len(part), cut[tree], left[tree], np.zeros(len(part), np.intp)
                for _ in range(levels[tree]):
                    value = cells.take(base.take(at) + row)
                    at = lefts.take(at) + (value >= cuts.take(at))
                found["path"][tree].take(at, out=path[tree])
            depth = np.ascontiguousarray(path.T).mean(axis=1)
            out[usable[start:start + SCORE_ROWS]] = np.exp2(-depth / found["norm"])
        return out

    def depths(self) -> list[int]:
        """How many cuts the longest way through each tree passes."""
        found, out = self.arrays, []
        for feature, left in zip(found["feature"], found["left"]):
            level, nodes = 0, np.zeros(1, np.int64)
            while len(nodes := nodes[feature[nodes] >= 0]):
                level, nodes = level + 1, np.concatenate([left[nodes], left[nodes] + 1])
            out.append(level)
        return out


def _label(group: str | None):
    return F.col(group).cast("string") if group else F.lit("")


def grown_trees(
    df: DataFrame, features: list[str], trees: int = TREES, tree_rows: int = TREE_ROWS,
    seed: int = 42, key: str = "id", group: str | None = None,
) -> DataFrame:
    """Rows (group, tree, rows, nodes): a forest per ``group`` value, on rows that have all features.

    A group's trees draw from a pool of ``trees * tree_rows`` of its rows, chosen
    by hash.  A threshold from the group's size first keeps little more than
    that, so a large group does not meet in the ranking.  Groups with fewer than
    20 usable rows get no trees.  Features are worked out once and stored, as they
    are read to count and to draw; a filter before would work them out once more.
    """
    usable = checkpointed(df.select(
        _label(group).alias("_group"), F.xxhash64(F.col(key), F.lit(seed)).alias("_h"), F.col(key).alias("_key"),
        *[F.col(f).cast("double").alias(f) for f in features])).dropna(subset=features)
    wanted = trees * tree_rows
    sizes = stored_lookup(usable.groupBy("_group").agg(F.count(F.lit(1)).alias("_size")))
    # eight standard deviations above the wanted number
    share = F.lit(wanted + 8 * wanted ** 0.5 + 8) / F.col("_size")
    near = join_on(usable, sizes, ["_group"]).filter(F.pmod(F.col("_h"), F.lit(HASH_RANGE)) < share * HASH_RANGE)
    ranked = Window.partitionBy("_group").orderBy("_h", "_key", *features)
    pool = near.withColumn("_i", F.row_number().over(ranked)).filter(F.col("_i") <= wanted)
    copies = pool.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(GROW_GROUPS - 1))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < MIN_FOREST_ROWS:
            return pd.DataFrame(columns=["group", "tree", "rows", "nodes"])
        name, part = pdf["_group"].iloc[0], int(pdf["_part"].iloc[0])
        values = pdf.sort_values("_i")[features].to_numpy(dtype=float)
        rows = min(tree_rows, len(values))
        limit, out = math.ceil(math.log2(max(rows, 2))), []
        for tree in range(part, trees, GROW_GROUPS):
            rng = np.random.default_rng([seed, tree])
            drawn = values[rng.choice(len(values), rows, replace=False)]
            nodes = np.array(_grow(drawn, limit, rng), dtype=float)
            out.append((name, tree, rows, nodes.ravel().tolist()))
        return pd.DataFrame(out, columns=["group", "tree", "rows", "nodes"])

    return copies.groupBy("_group", "_part").applyInPandas(grow, "group string, tree int, rows int, nodes array<double>")


def fit_forest(
    df: DataFrame, features: list[str], trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 42, key: str = "id"
) -> Forest:
    """One forest of a whole table; its nodes, bounded by ``trees * 2 * tree_rows``, come to the driver."""
    return Forest.stacked(list(features), grown_trees(df, features, trees, tree_rows, seed, key).toPandas())


def forest_score(df: DataFrame, model: Forest, name: str = "forest_score") -> DataFrame:
    """Add the anomaly score; higher is more anomalous, NULL without features or trees."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        found = shared.value.score(np.column_stack([c.to_numpy(dtype=float) for c in columns]))
        return pd.Series(found).where(~np.isnan(found), None)

    return df.withColumn(name, score(*[F.col(f).cast("double") for f in model.features]))


def block_scores(
    df: DataFrame, trees: DataFrame, features: list[str], group: str, key: str = "id", name: str = "forest_score"
) -> DataFrame:
    """Add the score by the forest of each row's own group.

    A group of many rows is cut by hash into parts of about ``PART_ROWS``, and its
    trees are copied to each part; neither the driver nor a task holds more than
    one group's trees and one part's rows.
    """
    features = list(features)
    labelled = df.withColumn("_group", _label(group))
    sizes = stored_lookup(labelled.groupBy("_group").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).alias("_parts")))
    parted = join_on(labelled, sizes, ["_group"]).withColumn(
        "_part", F.pmod(F.xxhash64(F.col(key)), F.col("_parts"))).drop("_parts")
    copies = join_on(trees.withColumnRenamed("group", "_group"), sizes, ["_group"]).withColumn(
        "_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1))).drop("_parts")
    columns = df.columns

    def scored(rows: pd.DataFrame, grown: pd.DataFrame) -> pd.DataFrame:
        found = Forest.stacked(features, grown).score(rows[features].to_numpy(dtype=float))
        return rows[columns].assign(**{name: pd.Series(found, index=rows.index).where(~np.isnan(found), None)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", {name} double"
    return parted.groupBy("_group", "_part").cogroup(copies.groupBy("_group", "_part")).applyInPandas(scored, schema)


def clean_blocks(
    rows: DataFrame, group: str | None = None, features: list[str] = CLEAN_FEATURES,
    contamination: float | str = STREAM_CONTAMINATION, trees: int = TREES, seed: int = 42, key: str = "id",
) -> DataFrame:
    """Mark each record ``usable`` and ``is_anomaly`` by a forest of its own block.

    Blocks are the values of ``group``, all treated in one pass (default: a
    single block).  Records without all features are unusable.  A block with
    fewer than 20 usable records flags nothing.  A ``contamination`` of ``"auto"``
    flags scores above one half.  Scores are stored once, as the threshold and
    the caller both read them.
    """
    usable = F.lit(True)
    for f in features:
        usable = usable & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
    marked = rows.withColumn("usable", usable)
    if group:
        grown = checkpointed(grown_trees(marked, features, trees, TREE_ROWS, seed, key, group))
        scored = checkpointed(block_scores(marked, grown, features, group, key))
    else:
        scored = checkpointed(forest_score(marked, fit_forest(marked, features, trees, TREE_ROWS, seed, key)))
    if contamination == "auto":
        return scored.withColumn("is_anomaly", F.coalesce(F.col("forest_score") > AUTO_SCORE, F.lit(False)))
    keys = [group] if group else []
    cut = quantiles(scored, keys, "forest_score", {"_cut": 1.0 - contamination}).drop("n")
    return per_group(scored, cut, keys).withColumn(
        "is_anomaly", F.coalesce(F.col("forest_score") > F.col("_cut"), F.lit(False))).drop("_cut")


def cleaning_stats(marked: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Raw, unusable, anomalous and clean counts with the anomaly rate."""
    raw = F.col("n_raw")
    return marked.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("n_raw"),
        F.count_if(~F.col("usable")).alias("n_unusable"),
        F.count_if(F.col("is_anomaly")).alias("n_anomaly"),
        F.count_if(F.col("usable") & ~F.col("is_anomaly")).alias("n_clean"),
    ).withColumn("anom_rate", F.when(raw > 0, F.round(F.col("n_anomaly") / F.when(raw > 0, raw), 4)).otherwise(0.0))


def clean_rows(marked: DataFrame) -> DataFrame:
    """The records kept by cleaning."""
    return marked.filter("usable AND NOT is_anomaly").drop("usable", "is_anomaly", "forest_score")


def flag_file(
    trips: DataFrame, features: list[str] = CLEAN_FEATURES, contamination: float | str = FILE_CONTAMINATION,
    trees: int = TREES, seed: int = 42, key: str = "id",
) -> DataFrame:
    """Score a whole table with one forest and a threshold from the scores of all its rows.

    Missing and infinite features count as 0, so every record is scored.  Adds
    ``anomaly_score`` (above 0 means anomalous) and ``is_anomaly`` 0/1.
    """
    safe = {f"_f_{f}": C.finite_or_zero(f) for f in features}
    prepared = trips.withColumns(safe)
    model = fit_forest(prepared, list(safe), trees, TREE_ROWS, seed, key)
    if model.arrays is None:
        raise ValueError(f"fewer than {MIN_FOREST_ROWS} records to fit on")
    scored, cut = forest_score(prepared, model).drop(*safe), AUTO_SCORE
    if contamination != "auto":
        # scored once, for the threshold and the flags
        scored = checkpointed(scored)
        cut = scalar_quantiles(scored, "forest_score", {"q": 1.0 - contamination})["q"]
    score = F.col("forest_score") - F.lit(cut)
    return (
        scored.withColumn("anomaly_score", score)
        .withColumn("is_anomaly", (F.col("anomaly_score") > 0).cast("int"))
        .drop("forest_score")
    )


def with_model_features(series: DataFrame, resolution: str) -> DataFrame:
    """Value plus the calendar features that vary at the resolution; NULL bins drop."""
    calendar = dict(zip(["wd", "hour", "minute", "second"], C.time_features("ts")))
    return series.dropna(subset=["value"]).withColumns(
        {n: calendar[n] for n in time_feature_names(resolution)})


def score_series_forest(
    train: DataFrame, series: DataFrame, resolution: str, k: float = 3.0,
    contamination: float = SERIES_CONTAMINATION, trees: int = TREES, seed: int = 42,
) -> DataFrame:
    """Forest score of one series, as a z-score blended with the local deviation.

    Splits are drawn between a feature's extremes, so scaling the features would
    not change the trees and is left out.
    """
    features = ["value", *time_feature_names(resolution)]
    model = fit_forest(with_model_features(train, resolution), features, trees, TREE_ROWS, seed, key="ts")
    if model.arrays is None:
        raise ValueError("the training series is too short")
    raw = checkpointed(forest_score(with_model_features(series, resolution), model))
    z = A.series_robust_z(raw, "forest_score").drop(*time_feature_names(resolution))
    return A.blend_score(z, k)
