"""Quality rules on documents and on their hosts.

Each document is measured in one narrow pass over its whole text.  The failures
are added up by host (the ``source`` column), each host's rate is shrunk by a
beta prior that is itself estimated from all hosts, and the host's verdict is
joined back to its documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import column, free_name, small_batches, stored, text_column, tidy

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))
WINDOW = 8
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


@dataclass(frozen=True)
class Limits:
    """Thresholds of the document rules and of the host verdicts."""

    min_words: int = 20
    repeat_percent: int = 30
    symbol_percent: int = 10
    severe_symbol_percent: int = 30
    dup_line_percent: int = 30
    longest_mean_word: int = 12
    strict_rate: float = 0.5
    closed_rate: float = 0.9


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words that lie in a window of ``size`` words found at least twice; ``size`` is a power of two.

    Windows get exact integer ids by doubling: a window is the pair of its halves' ids.
    """
    n = len(words)
    if n <= size:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    if len(known) == n:
        return 0
    width = 1
    while width < size:
        pairs = ids[:-width] * (ids.max() + 1) + ids[width:]
        distinct, ids = np.unique(pairs, return_inverse=True)
        if len(distinct) == len(pairs):
            return 0
        width *= 2
    starts = np.flatnonzero(np.bincount(ids)[ids] > 1)
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + size, -1)
    return int(np.count_nonzero(np.cumsum(edges)))


def measure(text: bytes) -> tuple[int, ...]:
    """``MEASURES`` of one UTF-8 text."""
    words = text.split()  # bytes split at exactly the six ASCII white space characters
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text.translate(None, SPACES + CONTINUATION)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
    )


@F.arrow_udf(T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
def _measured(texts: pa.Array) -> pa.Array:
    rows = [measure(t or b"") for t in texts.cast(pa.binary()).to_pylist()]
    tidy()
    return pa.StructArray.from_arrays(
        [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(MEASURES))], MEASURES)


def base_failed(m: Column, limits: Limits = Limits()) -> Column:
    return (m["n_words"] < limits.min_words) | (
        100 * m["n_repeat_words"] > limits.repeat_percent * m["n_words"])


def soft_failures(m: Column, limits: Limits = Limits()) -> Column:
    """How many of the softer rules a document breaks: symbols (twice if severe), repeated lines, overlong words."""
    broken = [
        100 * m["n_symbols"] > limits.symbol_percent * m["n_words"],
        100 * m["n_symbols"] > limits.severe_symbol_percent * m["n_words"],
        100 * m["n_dup_lines"] > limits.dup_line_percent * m["n_lines"],
        m["word_chars"] > limits.longest_mean_word * m["n_words"],
    ]
    return sum((b.cast("int") for b in broken), F.lit(0))


def host_verdicts(failures: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per host from rows (host, failed): counts, shrunk rate, and documents' tolerance.

    The beta prior comes from all hosts by moments: the variance of the hosts'
    rates beyond what chance gives.  ``tolerance`` is how many soft failures a
    document of that host may have: 1 on an open host, 0 on a strict one, and -1
    (nothing passes) on a closed one.
    """
    hosts = stored(
        failures.groupBy("host").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    )
    total = hosts.agg(
        F.sum("n").alias("n"), F.sum("n_failed").alias("f"), F.count(F.lit(1)).alias("hosts"),
        F.sum(F.col("n_failed").cast("double") * F.col("n_failed") / F.col("n")).alias("squares"),
    ).first()
    alpha, beta = prior(total["n"] or 0, total["f"] or 0, total["hosts"], total["squares"] or 0.0)
    rate = (F.col("n_failed") + F.lit(alpha)) / (F.col("n") + F.lit(alpha + beta))
    return hosts.select("host", "n", "n_failed", rate.alias("rate")).withColumn(
        "tolerance",
        F.when(F.col("rate") >= limits.closed_rate, -1).when(F.col("rate") >= limits.strict_rate, 0).otherwise(1))


def prior(n: int, failed: int, hosts: int, squares: float) -> tuple[float, float]:
    """Beta parameters from the sums n, failed, and failed^2 / n over hosts; at least one pseudo-document."""
    if n == 0:
        return 0.5, 0.5
    p = failed / n
    within = p * (1 - p)
    between = (squares - n * p * p) / n - within * hosts / n
    strength = min(max(within / between - 1, 1.0), 1e6) if between > 0 else 1e6
    p = min(max(p, 1e-6), 1 - 1e-6)
    return p * strength, (1 - p) * strength


def judged(docs: DataFrame, text: str = "text", host: str = "source", limits: Limits = Limits()) -> DataFrame:
    """``docs`` with one more struct column (last): the measures, ``base_failed`` and ``kept``.

    A null text is empty and fails; a null host is a host of its own.  Repeated
    rows are judged each for itself.  Columns of ``docs`` stay as they are.
    Texts are read twice: for the hosts' counts, and to judge by the verdicts.
    Only the table of hosts is shuffled or, below Spark's threshold, broadcast.
    """
    small_batches(docs)
    m, h, v = (free_name(docs, x) for x in ("_measure", "_host", "_verdict"))
    measured = docs.withColumn(m, _measured(text_column(docs, text)))
    failed = base_failed(F.col(m), limits) | (soft_failures(F.col(m), limits) > 0)
    hosts = host_verdicts(
        measured.select(column(docs, host).alias("host"), failed.alias("failed")), limits)
    hosts = stored(hosts).select(F.col("host").alias(h), F.col("tolerance").alias(v))
    joined = measured.join(hosts, column(docs, host).eqNullSafe(F.col(h)), "left")
    bad = base_failed(F.col(m), limits)
    return joined.withColumn(
        m,
        F.struct(
            *[F.col(m)[x].alias(x) for x in MEASURES], bad.alias("base_failed"),
            (~bad & (soft_failures(F.col(m), limits) <= F.col(v))).alias("kept")),
    ).drop(h, v)


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", limits: Limits = Limits()) -> DataFrame:
    """The documents that pass the rules, with the columns of ``docs``."""
    out = judged(docs, text, host, limits)
    return out.filter(F.col(out.columns[-1])["kept"]).select(*[column(docs, c) for c in docs.columns])
