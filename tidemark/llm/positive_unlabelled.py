"""Quality scores learnt from trusted positives and unlabelled web text.

Each text becomes a few bytes of style measures in one pass.  A linear score of
hinges of them minimises the non-negative unbiased risk with squared loss.  That
risk depends on the data only by means and products of the features among the
positives and among the unlabelled, so all rows count and one aggregation of
whole numbers, exact in any order, is all the data that a fit needs.  The class
prior is estimated from scores of rows the fit has not seen.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import column, small_batches, stored, text_column, tidy

# Measures are kept as 0 .. TOP.
TOP = 255
# Each measure enters as itself and as its excess over these knots.
KNOTS = (4, 12, 24, 48, 80, 112, 144, 176, 208, 236)
SLOPE = 4.0
RIDGE = 1e-4
# Of a class prior's estimate: the error's probability, and bins of scores.
DOUBT, SCORE_BINS = 0.1, 1000
PRIOR_ROUNDS = 4
FOLDS, HELD_OUT_OF, HELD_OUT = 2, 3, 1

SYMBOLS = b"#$%&*|<>@^~=+_\\{}[]"
MARKS = b".,;:"
CALLS = b"!?"
DIGITS = b"0123456789"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
HIGH = bytes(range(128, 256))
CONTROL = bytes(set(range(32)) - set(b" \t\n\x0b\x0c\r"))

MEASURES = [
    "symbols", "calls", "capitals", "digits", "high_bytes", "marks", "spaces", "control", "entropy", "mean_word",
    "longest_word", "distinct_words", "next_equal", "distinct_pairs", "commonest_word", "repeated_lines", "upper_words",
    "plain_words", "short_words", "n_words"]


def _count(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def style(text: bytes) -> bytes:
    """``MEASURES`` of one UTF-8 text, a byte each; shares by their square root, so that small ones differ."""
    n, words = len(text), text.split()
    k = len(words)
    if not k:
        return bytes(len(MEASURES))
    bytes_seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    p = bytes_seen[bytes_seen > 0] / n
    lengths = list(map(len, words))
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = _count(text, LETTERS)
    spaces = n - sum(lengths)
    shares = [
        _count(text, SYMBOLS) / n, _count(text, CALLS) / n, _count(text, UPPER) / letters if letters else 0.0,
        _count(text, DIGITS) / n, _count(text, HIGH) / n, _count(text, MARKS) / n, spaces / n, _count(text, CONTROL) / n,
        (float(-(p * np.log2(p)).sum()) / 8) ** 2, min((n - spaces) / k / 20, 1.0) ** 2,
        min(math.log2(max(lengths)) / 16, 1.0) ** 2, len(counts) / k, sum(map(eq, words, words[1:])) / k,
        len(set(zip(words, words[1:]))) / (k - 1) if k > 1 else 1.0, max(counts.values()) / k,
        1 - len(set(lines)) / len(lines), sum(map(bytes.isupper, words)) / k, sum(map(bytes.isalpha, words)) / k,
        sum(x <= 3 for x in lengths) / k, min(math.log2(k + 1) / 24, 1.0) ** 2]
    return bytes(round(TOP * math.sqrt(max(s, 0.0))) for s in shares)


@F.arrow_udf(T.BinaryType())
def _styled(texts: pa.Array) -> pa.Array:
    out = pa.array([style(t or b"") for t in texts.cast(pa.binary()).to_pylist()], pa.binary())
    tidy()
    return out


def hinges(rows: np.ndarray) -> np.ndarray:
    """The features of rows of measures: a constant, the measures, and their excess over each knot; whole numbers."""
    m = rows.astype(np.int64)
    return np.concatenate([np.full((len(m), 1), TOP), m, *[np.maximum(m - k, 0) for k in KNOTS]], axis=1)


WIDTH = 1 + len(MEASURES) * (1 + len(KNOTS))


def _as_rows(measures: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(measures.to_pylist()), np.uint8).reshape(-1, len(MEASURES))


@dataclass
class Sums:
    """Row count and sum of products of features; the first feature is constant, so row 0 holds the sums."""

    n: int = 0
    products: np.ndarray = field(default_factory=lambda: np.zeros((WIDTH, WIDTH)))

    def __add__(self, other: "Sums") -> "Sums":
        return Sums(self.n + other.n, self.products + other.products)

    def means(self) -> tuple[np.ndarray, np.ndarray]:
        """Means of features and of their products, features in units of ``TOP``."""
        products = self.products / (TOP * TOP * max(self.n, 1))
        return products[0], products


def fitted(positive: Sums, unlabelled: Sums, prior: float) -> np.ndarray:
    """Weights g of least non-negative risk for a class prior.

    With loss (1 - z)^2 / 4 the unbiased risk is E_u[(1 + g)^2] / 4 - prior E_p[g],
    and the non-negative one is the greater of it and of the positives' own part,
    prior E_p[(1 - g)^2] / 4: two convex quadratics.  The least of the greater one
    is the least of a mix of both; the share of the mix is found by bisection on
    the part that may not be negative.
    """
    m_p, s_p = positive.means()
    m_u, s_u = unlabelled.means()
    ridge = (RIDGE + 1.0 / max(positive.n, 1)) * np.eye(WIDTH)
    ridge[0, 0] = 1e-9

    def solved(share: float) -> np.ndarray:
        a = (share * s_u + (1 - share) * prior * s_p) / 2 + ridge
        b = -share * m_u / 2 + (1 + share) * prior * m_p / 2
        return np.linalg.solve(a, b)

    def negatives(w: np.ndarray) -> float:
        """Risk of the negatives among the unlabelled, by what is left after the positives' share."""
        return (1 + 2 * w @ m_u + w @ s_u @ w) / 4 - prior * (1 + 2 * w @ m_p + w @ s_p @ w) / 4

    w = solved(1.0)
    if negatives(w) >= 0:
        return w
    low, high = 0.0, 1.0
    for _ in range(40):
        share = (low + high) / 2
        low, high = (share, high) if negatives(solved(share)) >= 0 else (low, share)
    return solved(low)


def score(measures: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Scores in 0 .. 1, at least a half where g >= 0, rounded so that they do not hang on the order of sums."""
    g = hinges(measures) @ (weights / TOP)
    return np.round(1 / (1 + np.exp(-SLOPE * np.clip(g, -50, 50))), 6)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, doubt: float = DOUBT) -> float:
    """The share of positives among the unlabelled, from counts by score bin, low to high.

    The best bin estimate: among rows above a cut the unlabelled must be at least
    prior times as frequent as the positives; the cut whose bound, errors of both
    shares included, is lowest gives the prior.
    """
    n_p, n_u = positive.sum(), unlabelled.sum()
    if not n_p or not n_u:
        return 0.5
    p, u = (np.cumsum(x[::-1])[::-1] / x.sum() for x in (positive, unlabelled))
    slack = math.sqrt(math.log(4 / doubt) / 2) * (1 / math.sqrt(n_p) + 1 / math.sqrt(n_u))
    seen = p > 0
    bound = (u[seen] + slack) / p[seen]
    best = int(np.argmin(bound))
    return float(np.clip(u[seen][best] / p[seen][best], 0.01, 0.99))


# -- Spark ---------------------------------------------------------------------------

def held_out(key: Column) -> Column:
    """Rows no label is learnt from: the CRC-32 of the key as text leaves 1 when divided by 3; a null key is empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % HELD_OUT_OF == HELD_OUT


def measured(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (id, held_out, positive, fold, style), one a document.

    A row is a trusted positive if it is not held out and all labels of its key
    say quality 1.  Only some 40 bytes a document are shuffled, or none if the
    labels are few.
    """
    small_batches(docs)
    slim = docs.select(column(docs, key).alias("id"), _styled(text_column(docs, text)).alias("style"))
    trusted = labels.groupBy(F.col("doc_id").alias("id")).agg(
        (F.min(F.coalesce("quality", F.lit(0))) == 1).alias("good")).filter("good")
    fold = F.floor(F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))) / HELD_OUT_OF) % FOLDS
    out = held_out(F.col("id"))
    return slim.join(trusted, "id", "left").select(
        "id", out.alias("held_out"), (~out & F.coalesce("good", F.lit(False))).alias("positive"), fold.cast("int").alias("fold"),
        "style")


def _task_sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[bool, int], np.ndarray] = {}
    for batch in batches:
        x = hinges(_as_rows(batch.column("style"))).astype(np.float64)
        positive, fold = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("positive", "fold"))
        for f in range(FOLDS):
            for kind, rows in ((False, fold == f), (True, (fold == f) & positive)):
                part = x[rows]
                if len(part):
                    sums[kind, f] = sums.get((kind, f), 0) + (part.T @ part).astype(np.int64)  # whole numbers below 2^53
    for (kind, f), total in sums.items():
        upper = total[np.triu_indices(WIDTH)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([kind] * len(upper)), pa.array([f] * len(upper), pa.int32()),
             pa.array(np.arange(len(upper)), pa.int32()), pa.array(upper)], ["positive", "fold", "cell", "total"])


def sums_of(rows: DataFrame) -> dict[tuple[bool, int], Sums]:
    """Sums by (positive, fold); the unlabelled are all rows given, positives included."""
    # per fold and kind one number a pair of features comes to the driver
    cells = (rows.select("positive", "fold", "style")
             .mapInArrow(_task_sums, "positive boolean, fold int, cell int, total long")
             .groupBy("positive", "fold", "cell").agg(F.sum("total").alias("total")).toPandas())
    out = {(kind, f): Sums() for kind in (False, True) for f in range(FOLDS)}
    for (kind, f), part in cells.groupby(["positive", "fold"]):
        products = np.zeros((WIDTH, WIDTH))
        i, j = (x[part["cell"].to_numpy()] for x in np.triu_indices(WIDTH))
        products[i, j] = products[j, i] = part["total"].to_numpy()
        out[bool(kind), int(f)] = Sums(int(round(products[0, 0] / (TOP * TOP))), products)
    return out


def scorer(weights: np.ndarray):
    """An Arrow function from measures to scores."""

    @F.arrow_udf(T.DoubleType())
    def scored(measures: pa.Array) -> pa.Array:
        return pa.array(score(_as_rows(measures), weights), pa.float64())

    return scored


@dataclass
class Model:
    """Weights of the hinges and the class prior they were fitted for; no weights where there was nothing to learn from."""

    weights: np.ndarray | None
    prior: float


def learnt(rows: DataFrame) -> Model:
    """A model of stored rows of :func:`measured`, of which the held out are not read.

    Fold 0 is fitted and fold 1 scored in turn until the prior stays; the last
    fit is to both.  Each turn reads the slim rows once and counts by score bin.
    """
    rows = rows.filter("not held_out")
    sums = sums_of(rows)
    everything = [sums[kind, 0] + sums[kind, 1] for kind in (True, False)]
    if not everything[0].n:
        return Model(None, 0.5)
    check, fit = rows.filter("fold = 1"), [sums[kind, 0] for kind in (True, False)]
    prior = 0.5
    if fit[0].n and sums[True, 1].n:
        for _ in range(PRIOR_ROUNDS):
            bins = F.floor(scorer(fitted(*fit, prior))(F.col("style")) * (SCORE_BINS - 1)).cast("int")
            counts = check.select(bins.alias("bin"), "positive").groupBy("bin").agg(
                F.count(F.lit(1)).alias("u"), F.count_if("positive").alias("p")).toPandas()
            p, u = (np.bincount(counts["bin"], counts[c], SCORE_BINS) for c in "pu")
            before, prior = prior, estimated_prior(p, u)
            if abs(prior - before) < 0.005:
                break
    return Model(fitted(*everything, prior), prior)


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """``id``, ``held_out``, ``score`` and ``predicted`` of rows of :func:`measured`; a half each without a model."""
    value = F.lit(0.5) if model.weights is None else scorer(model.weights)(F.col("style"))
    return rows.select("id", "held_out", value.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def quality_scores(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (key, held_out, score, predicted), one a document.

    Null texts are empty; texts without words have measures of zero and get a
    score like any other.  Equal texts get equal scores.  Nothing but the text
    enters a score.  Without a trusted positive every score is a half.
    """
    rows = stored(measured(docs, labels, text, key))
    return scored(rows, learnt(rows)).withColumnRenamed("id", key)
