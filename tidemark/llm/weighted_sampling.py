"""Document fingerprints by consistent weighted sampling.

A document is a bag of words.  For each of K samples every word draws, from its
hash alone, two gamma variates and a uniform one, which put a quantised weight
and a random height on it; the word with the lowest height and its quantised
weight are the sample.  Two bags give the same sample with a probability equal to
their generalised Jaccard similarity, the sum of the smaller weights over the
sum of the larger ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import column, small_batches, text_column, tidy
from tidemark.llm.ordered import with_followers

SAMPLES = 128
# Terms that are worked on together, to stay in a processor's cache.
TOGETHER = 1 << 14
SCHEMA = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")

_WORD_BYTES = set(b"abcdefghijklmnopqrstuvwxyz0123456789") | set(range(0x80, 0x100))
_TO_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if b in _WORD_BYTES else 32 for b in range(256))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(bits: np.ndarray, size: int) -> np.ndarray:
    """Numbers within (0, 1) from integers below 2^size."""
    return np.minimum((bits.astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-size), np.float32(1 - 2.0**-24))


def draws(terms: np.ndarray, logs: np.ndarray, sample: int) -> np.ndarray:
    """A number per term for one sample: height in the upper 32 bits, the hash of term and quantised weight in the lower.

    ``terms`` are 64-bit hashes, ``logs`` their weights' logarithms.  The smallest
    number over a bag's terms is the bag's sample.
    """
    seeds = mixed(terms ^ mixed(np.array([sample + 1], np.uint64)))
    bits = mixed(seeds + np.uint64(0x9E3779B97F4A7C15))
    # A gamma variate with shape 2 is minus the logarithm of the product of two uniform ones.
    r = -np.log(uniform(seeds >> np.uint64(32), 32) * uniform(seeds & np.uint64(0xFFFFFFFF), 32))
    log_c = np.log(-np.log(uniform(bits >> np.uint64(40), 24) * uniform(bits >> np.uint64(16) & np.uint64(0xFFFFFF), 24)))
    beta = uniform(bits & np.uint64(0xFFFF), 16)
    t = np.floor(logs / r + beta)
    height = log_c - r * (t - beta) - r
    found = height.view(np.uint32)
    ordered = found ^ np.where(found >> 31 == 1, np.uint32(0xFFFFFFFF), np.uint32(1 << 31))
    # The hash depends on term and quantised weight; t is a small whole number.
    payload = (bits ^ (t.astype(np.int64).view(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)
    return ordered.astype(np.uint64) << np.uint64(32) | payload


def bags(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (term hash, count) pairs, and each text's entries: pair numbers, and bounds by text.

    Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters.
    """
    assert len(texts) < 1 << 16
    data = np.frombuffer(b" " + b" ".join(t.translate(_TO_WORDS) for t in texts) + b" ", np.uint8)
    space = data == 32
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    if not len(starts):
        empty = np.empty(0, np.int64)
        return empty.astype(np.uint64), empty, empty, np.zeros(len(texts) + 1, np.int64)
    sizes = ends - starts
    inside = np.arange(int(sizes.max()), dtype=np.uint64)
    factors = mixed(inside + np.uint64(1)) | np.uint64(1)
    letters = data[~space].astype(np.uint64) + np.uint64(1)
    first = np.cumsum(sizes) - sizes
    letters *= factors[np.arange(len(letters)) - np.repeat(first, sizes)]
    hashes = mixed(np.add.reduceat(letters, first) ^ sizes.astype(np.uint64))
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    owner = np.searchsorted(text_ends, starts, "left").astype(np.uint64)
    # 48 bits of a word's hash are its identity; a text's number stands above them.
    keys = np.sort(owner << np.uint64(48) | hashes >> np.uint64(16))
    edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    count = np.diff(np.r_[edge, len(keys)])
    entry = keys[edge]
    term = entry & np.uint64((1 << 48) - 1)
    _, at, index = np.unique(mixed(term ^ count.astype(np.uint64) << np.uint64(48)) + count.astype(np.uint64) // np.uint64(1 << 16),
                             return_index=True, return_inverse=True)
    bounds = np.searchsorted(entry >> np.uint64(48), np.arange(len(texts) + 1).astype(np.uint64))
    return term[at], count[at], index, bounds


def signatures(texts: list[bytes], samples: int = SAMPLES) -> np.ndarray:
    """A row of ``samples`` 16-bit hashes per UTF-8 text; all zero without words."""
    hashes, weights, index, bounds = bags(texts)
    out = np.zeros((samples, len(texts)), np.uint16)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        logs = np.log(weights).astype(np.float32)
        drawn = np.empty(len(hashes), np.uint64)
        for sample in range(samples):
            for i in range(0, len(hashes), TOGETHER):
                drawn[i:i + TOGETHER] = draws(hashes[i:i + TOGETHER], logs[i:i + TOGETHER], sample)
            lowest = np.minimum.reduceat(drawn[index], bounds[full])
            out[sample, full] = (lowest & np.uint64(0xFFFF)).astype(np.uint16)
    return np.ascontiguousarray(out.T)


def text_of(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    last: list = []  # the row that still waits for the one after it
    for batch in batches:
        rows = last + list(zip(*(c.to_pylist() for c in batch.columns)))
        if not rows:
            continue
        last = rows[-1:]
        pairs = [i for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0] and not rows[i][1]]
        if not pairs:
            continue
        changed = [edited(rows[i][3], rows[i + 1][3]).encode() for i in pairs]
        signed = signatures([r[3].encode() for r in rows] + changed)
        own, after, new = signed[pairs], signed[[i + 1 for i in pairs]], signed[len(rows):]
        yield pa.RecordBatch.from_arrays([
            pa.array([rows[i][2] for i in pairs], pa.int64()),
            pa.array([len(rows[i][3]) for i in pairs], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in changed]),
            pa.array([text_of(x) for x in own]), pa.array([text_of(x) for x in new]),
            pa.array([likeness(*x) for x in zip(own, new)], pa.float64()),
            pa.array([likeness(*x) for x in zip(own, after)], pa.float64())], names)
        tidy()


def compared(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprints of documents and of their edited texts, and how alike they are.

    Documents follow each other by id, null ids first; equal ids by text hash;
    the first follows the last, and a lone document itself.  A null text is
    empty.  A text without words has a fingerprint of zeros, so two such are
    alike (1.0).  Texts move once, to ranges of ids, and are read as streams.
    """
    small_batches(docs)
    rows = docs.select(column(docs, key).cast("long").alias("doc_id"), text_column(docs, text).alias("text")).withColumn(
        "tie", F.xxhash64("text"))
    ordered = with_followers(rows, "doc_id", "tie").select("_bucket", "_ahead", "doc_id", "text")
    return ordered.mapInArrow(_compared, SCHEMA).withColumnRenamed("doc_id", key)
