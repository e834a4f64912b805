"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most three bits differ in at most two
outside some one of three blocks (the block that holds the most of them).  With
that block cleared, both fingerprints' balls of radius one, half of two, meet in
a common variant.  So every distinct fingerprint emits its variants of radius
one for each cleared block, variants are shuffled, and what meets is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import column, free_name, shuffle_partitions, small_batches, stored, text_column, tidy
from tidemark.llm.components import components

SHINGLE, SEED, RADIUS = 3, 42, 3
BLOCKS = ((0, 21), (21, 42), (42, 64))
AT_ONCE = 1 << 14
# Runs of up to this many fingerprints are compared together, one pass per pair of places.
SHORT = 6


def fingerprint(text: bytes) -> int:
    """The unsigned SimHash of one UTF-8 text; 0 without words."""
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII white space characters
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        values = [hashed(b" ".join(words), SEED)]
    else:
        values = [hashed(b" ".join(x), SEED) for x in zip(*(words[i:] for i in range(SHINGLE)))]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(values), AT_ONCE):
        part = np.array(values[i:i + AT_ONCE], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(values), bitorder="little").view("<u8")[0])


@F.arrow_udf(T.LongType())
def fingerprints(texts: pa.Array) -> pa.Array:
    """The SimHash of each text, as a signed long of the same bits."""
    got = np.array([fingerprint(t or b"") for t in texts.cast(pa.binary()).to_pylist()], np.uint64)
    tidy()
    return pa.array(got.view(np.int64), pa.int64())


def variants() -> list[tuple[int, int]]:
    """(keep, flip) for every variant: ``fp & keep ^ flip``; the cleared block says which block it is."""
    def signed(x: int) -> int:
        return x - (1 << 64) if x >> 63 else x

    out = []
    for number, (low, high) in enumerate(BLOCKS, 1):
        keep = ~(((1 << (high - low)) - 1) << low) & ((1 << 64) - 1)
        flips = [0] + [1 << b for b in range(64) if not low <= b < high]
        out += [(signed(keep), signed(number << low ^ f)) for f in flips]
    return out


def run_links(values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is linked in one run of distinct fingerprints.

    A walk compares each reached fingerprint with those not reached yet.  A run
    that grows large is dense, so most are reached at once and the rest is short.
    """
    out, left = [], values
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= RADIUS
            if near.any():
                found = left[near]
                out.append((np.full(len(found), at), found))
                queue.extend(found)
                left = left[~near]
    return out


def verified(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links among fingerprints with equal keys; rows are sorted by key."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    links = []
    for n in range(2, SHORT + 1):
        at = starts[sizes == n]
        for i in range(n):
            for j in range(i + 1, n):
                a, b = values[at + i], values[at + j]
                near = np.bitwise_count(a ^ b) <= RADIUS
                links.append((a[near], b[near]))
    for s, n in zip(starts[sizes > SHORT], sizes[sizes > SHORT]):
        links += run_links(np.unique(values[s:s + n]))
    if not links:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    a, b = (np.concatenate(x) for x in zip(*links))
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b], axis=0)
    return pairs[:, 0], pairs[:, 1]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(parts):
        if parts:
            a, b = verified(*(np.concatenate(x) for x in zip(*parts)))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], ["a", "b"])

    kept = []  # rows of the key that the last batch ended in
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = batch.column(0).to_numpy()
        values = batch.column(1).to_numpy().view(np.uint64)
        last = int(np.searchsorted(keys, keys[-1]))
        if last:
            yield from out([*kept, (keys[:last], values[:last])])
            kept = []
        elif kept and kept[0][0][0] != keys[0]:
            yield from out(kept)
            kept = []
        kept.append((keys[last:], values[last:]))
    yield from out(kept)


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all fingerprints (column ``fp``, distinct) within three bits of each other."""
    masks = F.array(*[F.struct(F.lit(k).alias("keep"), F.lit(f).alias("flip")) for k, f in variants()])
    keyed = distinct.select("fp", F.explode(masks).alias("m")).select(
        F.col("fp").bitwiseAND(F.col("m.keep")).bitwiseXOR(F.col("m.flip")).alias("key"), "fp")
    return (
        keyed.repartition(shuffle_partitions(distinct.sparkSession), "key").sortWithinPartitions("key")
        .mapInArrow(_links, "a bigint, b bigint"))


def classes(prints: DataFrame) -> DataFrame:
    """Rows (fp, component_id) from stored rows (doc_id, fp): the smallest doc_id reachable over links.

    Equal fingerprints meet once, in a count per fingerprint, however many
    documents share one.  Null ids never name a component that has another id.
    """
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(distinct.select("fp")))
    named = stored(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")))
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return named.join(lowest, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: its id, fingerprint (16 hex digits) and component.

    Null and empty texts have fingerprint zero and are linked like any other.
    """
    small_batches(docs)
    prints = stored(docs.select(column(docs, key).alias("doc_id"), fingerprints(text_column(docs, text)).alias("fp")))
    return prints.join(classes(prints), "fp").select(
        F.col("doc_id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One document of each component, with the columns of ``docs``: the smallest (id, text hash), null ids last.

    What goes is found on rows of (id, text hash, fingerprint).  Of repeated
    rows with the same id and text, one stays.
    """
    small_batches(docs)
    rows = stored(docs.select(
        column(docs, key).alias("doc_id"), F.xxhash64(text_column(docs, text)).alias("th"),
        fingerprints(text_column(docs, text)).alias("fp")))
    named = rows.groupBy("doc_id", "th", "fp").agg(F.count(F.lit(1)).alias("n"))
    distinct = stored(rows.groupBy("fp").agg(F.lit(0).alias("_")))
    roots = components(links(distinct.select("fp")))
    named = named.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "th")
    best = stored(named.groupBy("root").agg(
        F.min_by(F.struct("doc_id", "th", "n"), first).alias("best")).select("best.*"))
    i, t, n = (free_name(docs, x) for x in ("_id", "_hash", "_n"))
    best = best.select(F.col("doc_id").alias(i), F.col("th").alias(t), F.col("n").alias(n))
    kept = docs.join(
        best, column(docs, key).eqNullSafe(F.col(i)) & (F.xxhash64(text_column(docs, text)) == F.col(t)))
    columns = [column(docs, c) for c in docs.columns]
    repeated = kept.filter(F.col(n) > 1).dropDuplicates([i, t])
    return kept.filter(F.col(n) == 1).select(*columns).unionByName(repeated.select(*columns))
