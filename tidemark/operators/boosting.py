"""Histogram boosting of many models at once, and their ensembles as flat node arrays.

Rows of all models are binned once by quantiles of each model's features and packed into blocks of bounded size, one row of
bytes a block.  Targets are whole numbers, so histograms add up to the same sums in any order.

* A model whose rows fill one block has its whole histograms there; all such models grow in one job.
* A model of more blocks grows level by level: each block counts by (node, feature, bin), Spark adds the counts of all
  blocks of all models up and picks each node's split, and only the splits come back.

Both ways run the same steps on the same sums, so they make the same trees.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.joins import join_on
from tidemark.session import checkpointed, stored_lookup

# Rows of a model in one block, at most about; a block of 60 features takes 4 MB.
BLOCK_ROWS = 50_000
# A target's largest deviation in whole units.
UNITS = 1 << 24
# Rounds between two stores of a large model's predictions, and cells of a batch of predictions.
ROUNDS_A_STORE = 8
CELLS = 1 << 20
ACCURACY = 10_000


@dataclass(frozen=True)
class Boosting:
    """How an ensemble grows; with holdout rows it stops once ``patience`` rounds have not lowered their error."""

    rounds: int
    depth: int
    step: float = 0.05
    min_leaf: int = 20
    row_share: float = 0.8
    bins: int = 127
    patience: int = 40
    seed: int = 42


@dataclass
class Ensemble:
    """Trees as one set of node arrays.

    A row goes from a node to its left child, or to the one after it if its
    feature is beyond the cut; a leaf is its own left child behind a cut that
    nothing is beyond.
    """

    base: float = 0.0
    depth: int = 0
    roots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    cut: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Predictions of rows of features: all trees of a batch of rows take a step at a time."""
        out = np.full(len(x), self.base)
        if not len(self.roots):
            return out
        size = max(1, CELLS // len(self.roots))
        for a in range(0, len(x), size):
            part = x[a:a + size]
            rows = np.arange(len(part))[:, None]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            for _ in range(self.depth):
                node = self.left[node] + (part[rows, self.feature[node]] > self.cut[node])
            out[a:a + size] += self.value[node].sum(1)
        return out

    def plus(self, other: "Ensemble") -> "Ensemble":
        """The ensemble whose prediction is the sum of both."""
        shift = len(self.feature)
        return Ensemble(
            self.base + other.base, max(self.depth, other.depth), np.append(self.roots, other.roots + shift),
            np.append(self.feature, other.feature), np.append(self.cut, other.cut),
            np.append(self.left, other.left + shift), np.append(self.value, other.value))

    def first(self, rounds: int) -> "Ensemble":
        """The first ``rounds`` trees."""
        if rounds >= len(self.roots):
            return self
        end = int(self.roots[rounds])
        return Ensemble(self.base, self.depth, self.roots[:rounds], *[
            a[:end] for a in (self.feature, self.cut, self.left, self.value)])

    def as_row(self) -> dict:
        return {"base": float(self.base), "depth": int(self.depth), **{
            k: getattr(self, k).tolist() for k in ("roots", "feature", "cut", "left", "value")}}

    @classmethod
    def of_row(cls, row) -> "Ensemble":
        whole, real = ("roots", "feature", "left"), ("cut", "value")
        return cls(row["base"], row["depth"], **{k: np.asarray(row[k], np.int64) for k in whole},
                   **{k: np.asarray(row[k], np.float64) for k in real})


ENSEMBLE = ("base double, depth int, roots array<int>, feature array<int>, cut array<double>, left array<int>, "
            "value array<double>")
# What a fit tells of a model besides its ensemble: errors are mean squares of the holdout, by round.
FITTED = f"{ENSEMBLE}, n_train long, n_holdout long, trees int, errors array<double>"


def stopping_round(errors: list[float], patience: int) -> tuple[int, bool]:
    """The number of rounds with the least error before ``patience`` rounds brought none lower, and whether they did."""
    best = 0
    for i, error in enumerate(errors):
        if error < errors[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


# -- steps on one block ------------------------------------------------------------

def drawn(ids: np.ndarray, round_: int, how: Boosting) -> np.ndarray:
    """Whether each row takes part in a round: a hash of its id, so that the same rows are drawn wherever they lie."""
    with np.errstate(over="ignore"):
        x = ids.view(np.uint64) ^ np.uint64((round_ + 1) * 0x9E3779B97F4A7C15 + how.seed & (1 << 64) - 1)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return (x ^ x >> np.uint64(31)) < np.uint64(min(int(how.row_share * 2**64), 2**64 - 1))


def histograms(bins: np.ndarray, value: np.ndarray, node: np.ndarray, nodes: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums of whole values by (node, feature, bin); rows of node -1 are left out."""
    rows = node >= 0
    bins, value, node = bins[rows], value[rows], node[rows]
    d = bins.shape[1]
    cell = ((node[:, None] * d + np.arange(d)) * width + bins).ravel()
    shape, size = (nodes, d, width), nodes * d * width
    counts = np.bincount(cell, minlength=size).reshape(shape)
    sums = np.bincount(cell, weights=np.repeat(value.astype(np.float64), d), minlength=size).reshape(shape)
    return counts, sums


def splits(counts: np.ndarray, sums: np.ndarray, min_leaf: int) -> list[np.ndarray]:
    """Per node the feature and bin of the best split (feature -1 where none helps), and count and sum of its left side.

    The gain is the drop in squared error; of equal gains the first feature and
    the lowest bin win.
    """
    n, s = counts.sum(2)[:, :1, None], sums.sum(2)[:, :1, None]
    left_n, left_s = counts.cumsum(2), sums.cumsum(2)
    right_n, right_s = n - left_n, s - left_s
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left_s**2 / left_n + right_s**2 / right_n - s**2 / n
    gain = np.where((left_n >= min_leaf) & (right_n >= min_leaf), gain, -1.0).reshape(len(counts), -1)
    best = gain.argmax(1)
    rows = np.arange(len(counts))
    feature, bin_ = np.divmod(best, counts.shape[2])
    useful = gain[rows, best] > 1e-6
    return [np.where(useful, feature, -1), bin_, left_n[rows, feature, bin_], left_s[rows, feature, bin_]]


class Tree:
    """A tree that grows level by level: node arrays over bins, and the nodes that may still be split."""

    def __init__(self, count: float, total: float):
        self.feature, self.bin, self.left = [0], [-1], [0]  # bin -1: a leaf
        self.count, self.total = [count], [total]
        self.open = [0]

    def grow(self, found: list[np.ndarray], min_leaf: int) -> None:
        """Split the open nodes as found; their children that are large enough are open next."""
        new = []
        for node, f, b, n, s in zip(self.open, *(x.tolist() for x in found)):
            if f < 0:
                continue
            self.feature[node], self.bin[node], self.left[node] = f, b, len(self.feature)
            for count, total in ((n, s), (self.count[node] - n, self.total[node] - s)):
                if count >= 2 * min_leaf:
                    new.append(len(self.feature))
                self.left.append(len(self.feature))
                self.feature.append(0)
                self.bin.append(-1)
                self.count.append(count)
                self.total.append(total)
        self.open = new

    def descend(self, bins: np.ndarray, node: np.ndarray, steps: int = 1) -> np.ndarray:
        feature, bin_, left = np.array(self.feature), np.array(self.bin), np.array(self.left)
        rows = np.arange(len(bins))
        for _ in range(steps):
            inner = bin_[node] >= 0
            node = np.where(inner, left[node] + (bins[rows, feature[node]] > bin_[node]), node)
        return node

    def slots(self, node: np.ndarray) -> np.ndarray:
        """The place of each row's node among the open ones, or -1."""
        place = np.full(len(self.feature), -1)
        place[self.open] = np.arange(len(self.open))
        return place[node]

    def values(self, step: float, unit: float) -> np.ndarray:
        return step * unit * np.array(self.total) / np.maximum(np.array(self.count), 1)


def flattened(trees: list[tuple[Tree, float]], cuts: list[np.ndarray], base: float, how: Boosting) -> Ensemble:
    """Trees over bins, each with its unit, as an ensemble over values."""
    out, roots = {k: [] for k in ("feature", "cut", "left", "value")}, []
    at = 0
    for tree, unit in trees:
        roots.append(at)
        bin_ = np.array(tree.bin)
        out["feature"] += tree.feature
        out["cut"] += [cuts[f][b] if b >= 0 else math.inf for f, b in zip(tree.feature, tree.bin)]
        out["left"] += (np.array(tree.left) + at).tolist()
        out["value"] += np.where(bin_ < 0, tree.values(how.step, unit), 0.0).tolist()
        at += len(bin_)
    return Ensemble(base, how.depth if trees else 0, np.array(roots, np.int64), np.array(out["feature"], np.int64),
                    np.array(out["cut"], np.float64), np.array(out["left"], np.int64), np.array(out["value"], np.float64))


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin numbers: how many cuts lie below each value; what is not a number is beyond all."""
    return np.stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(cuts)], 1).astype(np.uint8)


def cuts_of(x: np.ndarray, bins: int) -> np.ndarray:
    """The distinct quantiles of values that lie in one place, as :func:`model_cuts` takes them."""
    return np.unique(np.quantile(x, np.arange(1, bins) / bins, method="inverted_cdf"))


def grown(bins: np.ndarray, target: np.ndarray, train: np.ndarray, ids: np.ndarray, base: float, unit: float,
          cuts: list[np.ndarray], how: Boosting, whole: bool = False) -> tuple[Ensemble, list[float]]:
    """An ensemble from rows that lie in one place, cut to its best round unless ``whole``, and the holdout's error by round."""
    width = max((len(c) for c in cuts), default=0) + 1
    prediction, check = np.full(len(target), base), ~train
    trees, errors = [], []
    for i in range(how.rounds):
        value = np.rint((target - prediction) / unit)
        used = train & drawn(ids, i, how)
        if not used.any():
            break
        node = np.zeros(len(bins), np.int64)
        tree = Tree(int(used.sum()), float(value[used].sum()))
        for _ in range(how.depth):
            if not tree.open:
                break
            slot = np.where(used, tree.slots(node), -1)
            tree.grow(splits(*histograms(bins, value, slot, len(tree.open), width), how.min_leaf), how.min_leaf)
            node = tree.descend(bins, node)
        prediction = prediction + tree.values(how.step, unit)[node]
        trees.append((tree, unit))
        if check.any():
            errors.append(float(np.mean((target[check] - prediction[check]) ** 2)))
            best, stopped = stopping_round(errors, how.patience)
            if stopped:
                break
    if errors and not whole:
        trees = trees[:stopping_round(errors, how.patience)[0]]
    return flattened(trees, cuts, base, how), errors


# -- models as rows ------------------------------------------------------------------

PACKED = "block int, blocks int, base double, unit double, cuts array<array<double>>, bins binary, target binary, train binary, ids binary"


def _group(keys: list[str]) -> list[Column]:
    return [F.lit(0).alias("_g"), *[F.col(k) for k in keys]]


def model_cuts(rows: DataFrame, keys: list[str], features: list[str], label: str, how: Boosting,
               alike: dict[str, str] | None = None) -> DataFrame:
    """Per model its training rows' number, mean target, unit, block count and cuts of each feature.

    Cuts are quantiles of the training rows from bounded sketches.  Features that
    hold the same values shifted may share one: ``alike`` names whose.
    """
    source = {f: (alike or {}).get(f, f) for f in features}
    shares = [i / how.bins for i in range(1, how.bins)]
    known = F.col(label).isNotNull()
    train = (F.col("part") == "train") & known
    found = rows.groupBy(*_group(keys)).agg(
        F.count_if(known).alias("_rows"), F.count_if(train).alias("n_train"), F.avg(F.when(train, F.col(label))).alias("base"),
        F.max(F.abs(F.col(label))).alias("_most"),
        *[F.percentile_approx(F.when(train, F.col(c)), shares, ACCURACY).alias(f"_q{i}")
          for i, c in enumerate(dict.fromkeys(source.values()))])
    place = {c: f"_q{i}" for i, c in enumerate(dict.fromkeys(source.values()))}
    cuts = F.array(*[F.array_sort(F.array_distinct(F.coalesce(F.col(place[source[f]]), F.array().cast("array<double>"))))
                     for f in features])
    unit = F.greatest(F.col("_most") + F.abs("base"), F.lit(1e-300)) / UNITS
    # keys under new identities, as the rows they came from are joined to this
    return found.filter("n_train > 0").select(
        F.lit(0).alias("_g"), *[F.col(k).alias(k) for k in keys], "n_train", "base", unit.alias("unit"), cuts.alias("cuts"),
        F.ceil(F.col("_rows") / BLOCK_ROWS).cast("int").alias("blocks"))


def packed(rows: DataFrame, keys: list[str], features: list[str], label: str, how: Boosting,
           alike: dict[str, str] | None = None) -> DataFrame:
    """One row per block of a model's rows, with its bins, targets and row ids as bytes.

    ``rows`` hold ``keys``, ``part`` (train or holdout), the features and the
    label, and ``_id``, a number by which rows are dealt and drawn.  Rows without
    a label are left out, and so are models without training rows.
    """
    rows = rows.select(*_group(keys), "part", F.col("_id"), F.col(label).cast("double").alias("_y"),
                       *[F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(features)])
    named = [f"_f{i}" for i in range(len(features))]
    places = {f: f"_f{i}" for i, f in enumerate(features)}
    shared = {places[f]: places[g] for f, g in (alike or {}).items()}
    models = stored_lookup(model_cuts(rows.drop("_g"), keys, named, "_y", how, shared))
    dealt = join_on(rows, models.select("_g", *keys, "blocks"), ["_g", *keys]).withColumn(
        "block", F.pmod(F.xxhash64("_id"), F.col("blocks")).cast("int")).drop("blocks")
    spread = models.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = ["_g", *keys, "block"]
    schema = T.StructType([models.schema[k] for k in keys] + list(T.StructType.fromDDL(PACKED)))

    def pack(values: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        values = values.dropna(subset=["_y"])
        if not len(values) or not len(model):
            return pd.DataFrame(columns=schema.names)
        m = model.iloc[0]
        cuts = [np.asarray(c, np.float64) for c in m["cuts"]]
        values = values.sort_values("_id", kind="stable")
        return pd.DataFrame([{
            **{k: m[k] for k in [*keys, "block", "blocks", "base", "unit"]}, "cuts": [c.tolist() for c in cuts],
            "bins": binned(values[named].to_numpy(np.float64), cuts).tobytes(), "target": values["_y"].to_numpy(np.float64).tobytes(),
            "train": (values["part"] == "train").to_numpy().tobytes(), "ids": values["_id"].to_numpy(np.int64).tobytes()}],
            columns=schema.names)

    return dealt.groupBy(*group).cogroup(spread.groupBy(*group)).applyInPandas(pack, schema)


# One way to grow for all models, or one for each by the tuple of its keys.
Ways = Boosting | dict[tuple, Boosting]


def _way(how: Ways, row, keys: list[str]) -> Boosting:
    return how[tuple(row[k] for k in keys)] if isinstance(how, dict) else how


def _opened(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    cuts = [np.asarray(c, np.float64) for c in row["cuts"]]
    target, ids = np.frombuffer(row["target"]), np.frombuffer(row["ids"], np.int64)
    bins = np.frombuffer(row["bins"], np.uint8).reshape(len(target), len(cuts))
    return bins, target, np.frombuffer(row["train"], bool), ids, cuts


def _fitted_row(row, keys: list[str], made: Ensemble, errors: list[float], n_train: int, n_holdout: int) -> dict:
    return {**{k: row[k] for k in keys}, **made.as_row(), "n_train": n_train, "n_holdout": n_holdout,
            "trees": len(made.roots), "errors": errors}


def fit_models(rows: DataFrame, keys: list[str], features: list[str], label: str, how: Ways,
               alike: dict[str, str] | None = None, whole: bool = False) -> DataFrame:
    """One ensemble per model: ``keys`` and the columns of ``FITTED``, one row each; see :func:`packed` for ``rows``.

    With holdout rows the trees end at the round with the least holdout error,
    unless the ``whole`` ensemble is asked for, for a later fit to go on from.
    Models may grow in different ways, of which only the bins must be the same.
    """
    one = next(iter(how.values())) if isinstance(how, dict) else how
    blocks = checkpointed(packed(rows, keys, features, label, one, alike))
    schema = T.StructType([blocks.schema[k] for k in keys] + list(T.StructType.fromDDL(FITTED)))

    def here(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                bins, target, train, ids, cuts = _opened(row)
                made, errors = grown(bins, target, train, ids, row["base"], row["unit"], cuts, _way(how, row, keys), whole)
                out = _fitted_row(row, keys, made, errors, int(train.sum()), int((~train).sum()))
                yield pd.DataFrame([out], columns=schema.names)

    small = blocks.filter("blocks = 1")
    out = checkpointed(small.mapInPandas(here, schema))
    large = blocks.filter("blocks > 1")
    return out if large.isEmpty() else out.unionByName(_fit_large(large, keys, how, schema, whole))


class _Growing:
    """A large model on the driver: its trees so far, the one that grows, and its errors."""

    def __init__(self, row, cuts: list[np.ndarray], how: Boosting):
        self.row, self.cuts, self.how = row, cuts, how
        self.width = max((len(c) for c in cuts), default=0) + 1
        self.trees: list[tuple[Tree, float]] = []
        self.tree: Tree | None = None
        self.kept, self.errors, self.done = 0, [], False
        self.n_train = self.n_holdout = 0


def _advanced(row, state: _Growing) -> tuple[np.ndarray, ...]:
    """A block's arrays with its predictions after all whole trees of ``state``."""
    bins, target, train, ids, _ = _opened(row)
    prediction = np.frombuffer(row["prediction"])
    for tree, unit in state.trees[state.kept:]:
        node = tree.descend(bins, np.zeros(len(bins), np.int64), state.how.depth)
        prediction = prediction + tree.values(state.how.step, unit)[node]
    return bins, target, train, ids, prediction


def _fit_large(blocks: DataFrame, keys: list[str], how: Ways, schema: T.StructType, whole: bool) -> DataFrame:
    """Grow models of several blocks, a level of all of them at a time.

    A job adds up histograms by (model, node, feature, bin) and gives one split
    a node.  The driver holds the trees; predictions are stored with the blocks
    every few rounds, which also cuts the lineage.
    """
    spark = blocks.sparkSession
    name = F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys]) if keys else F.lit("")
    start = F.udf(lambda target, base: np.full(len(target) // 8, base).tobytes(), "binary")
    blocks = checkpointed(blocks.withColumn("_model", name).withColumn("prediction", start("target", "base")))
    # one row per large model
    states = {r["_model"]: _Growing(r, [np.asarray(c) for c in r["cuts"]], _way(how, r, keys))
              for r in blocks.filter("block = 0").select("_model", "base", "unit", "cuts", *keys).collect()}

    def begin(i: int) -> None:
        """Count the drawn rows of round i, and the holdout's error after the round before."""
        live = {m: s for m, s in states.items() if not s.done}
        for m, r in _roots(blocks, live, i).items():
            s = live[m]
            s.n_train, s.n_holdout = r["n_train"], r["n_holdout"]
            if s.trees and r["n_holdout"]:
                s.errors.append(r["error"] / r["n_holdout"])
            s.tree = Tree(r["n"], float(r["total"]))
            s.done = not r["n"] or i >= s.how.rounds or bool(s.errors) and stopping_round(s.errors, s.how.patience)[1]

    for i in range(max(s.how.rounds for s in states.values())):
        begin(i)
        for level in range(max(s.how.depth for s in states.values())):
            live = {m: s for m, s in states.items() if not s.done and s.tree.open and level < s.how.depth}
            if not live:
                break
            found = _level(blocks, live, i)
            for m, s in live.items():
                s.tree.grow([np.array([found[m, k][j] for k in range(len(s.tree.open))]) for j in range(4)], s.how.min_leaf)
        grew = [s for s in states.values() if not s.done]
        if not grew:
            break
        for s in grew:
            s.trees.append((s.tree, s.row["unit"]))
        if i % ROUNDS_A_STORE == ROUNDS_A_STORE - 1:
            blocks = checkpointed(_with_predictions(blocks, states))
            for s in states.values():
                s.kept = len(s.trees)
    begin(max(s.how.rounds for s in states.values()))
    out = []
    for s in states.values():
        trees = s.trees[:stopping_round(s.errors, s.how.patience)[0]] if s.errors and not whole else s.trees
        out.append(_fitted_row(s.row, keys, flattened(trees, s.cuts, s.row["base"], s.how), s.errors, s.n_train, s.n_holdout))
    return spark.createDataFrame([tuple(r[n] for n in schema.names) for r in out], schema)


def _with_predictions(blocks: DataFrame, states: dict[str, _Growing]) -> DataFrame:
    names = blocks.columns

    def advance(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["prediction"] = [_advanced(r, states[r["_model"]])[4].tobytes() for r in frame.to_dict("records")]
            yield frame[names]

    return blocks.mapInPandas(advance, blocks.schema)


def _roots(blocks: DataFrame, live: dict[str, _Growing], i: int) -> dict:
    """Per model the drawn rows of a round, the sum of their whole targets, and the holdout's squared error before it."""
    if not live:
        return {}
    cell = "_model string, n long, total long, n_train long, n_holdout long, error double"
    names = [c.split()[0] for c in cell.split(", ")]

    def count(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                if row["_model"] not in live:
                    continue
                state = live[row["_model"]]
                bins, target, train, ids, prediction = _advanced(row, state)
                value, used = np.rint((target - prediction) / row["unit"]), train & drawn(ids, i, state.how)
                error = float(((target - prediction)[~train] ** 2).sum())
                yield pd.DataFrame([(row["_model"], int(used.sum()), int(value[used].sum()), int(train.sum()),
                                     int((~train).sum()), error)], columns=names)

    sums = blocks.mapInPandas(count, cell).groupBy("_model").agg(*[F.sum(c).alias(c) for c in names[1:]])
    return {r["_model"]: r for r in sums.collect()}


def _level(blocks: DataFrame, live: dict[str, _Growing], i: int) -> dict:
    """(model, place among the open nodes) -> split, from the histograms of all blocks."""
    cell = "_model string, node int, feature int, bin int, n long, total long"

    def count(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                m = row["_model"]
                if m not in live:
                    continue
                state = live[m]
                bins, target, train, ids, prediction = _advanced(row, state)
                used = train & drawn(ids, i, state.how)
                node = state.tree.descend(bins[used], np.zeros(int(used.sum()), np.int64), state.how.depth)
                value = np.rint((target - prediction) / row["unit"])[used]
                counts, sums = histograms(bins[used], value, state.tree.slots(node), len(state.tree.open), state.width)
                k, f, b = np.nonzero(counts)
                yield pd.DataFrame({"_model": m, "node": k, "feature": f, "bin": b, "n": counts[k, f, b],
                                    "total": sums[k, f, b].astype(np.int64)})

    sums = blocks.mapInPandas(count, cell).groupBy("_model", "node", "feature", "bin").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"))

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        state = live[rows["_model"].iloc[0]]
        counts = np.zeros((1, len(state.cuts), state.width), np.int64)
        total = np.zeros(counts.shape)
        counts[0, rows["feature"], rows["bin"]], total[0, rows["feature"], rows["bin"]] = rows["n"], rows["total"]
        f, b, n, s = (x[0] for x in splits(counts, total, state.how.min_leaf))
        return pd.DataFrame([(state.row["_model"], int(rows["node"].iloc[0]), int(f), int(b), int(n), float(s))],
                            columns=["_model", "node", "feature", "bin", "n", "total"])

    # a node's histogram has at most features times bins rows
    best = sums.groupBy("_model", "node").applyInPandas(
        choose, "_model string, node int, feature int, bin int, n long, total double")
    return {(r["_model"], r["node"]): tuple(r)[2:] for r in best.collect()}


def predicted(features: Column, ensemble: Ensemble) -> Column:
    """The predictions of an ensemble for a column of feature arrays."""

    @F.arrow_udf(T.DoubleType())
    def predict(rows: pa.Array) -> pa.Array:
        values = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return pa.array(ensemble.predict(values.reshape(len(rows), -1)) if len(rows) else np.zeros(0), pa.float64())

    return predict(features)


def predicted_each(which: Column, features: Column, ensembles: dict[int, Ensemble]) -> Column:
    """The predictions of the ensemble whose number a row names; 0 where there is none."""

    @F.arrow_udf(T.DoubleType())
    def predict(chosen: pa.Array, rows: pa.Array) -> pa.Array:
        chosen = chosen.to_numpy(zero_copy_only=False)
        values = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
        out = np.zeros(len(rows))
        for number in np.unique(chosen):
            if number in ensembles:
                out[chosen == number] = ensembles[number].predict(values[chosen == number])
        return pa.array(out, pa.float64())

    return predict(which, features)
