"""How filters interact: what each removes, alone and behind others, in every order.

Texts are measured by a table-driven byte transducer.  One finite-state pass
over the UTF-8 bytes counts words, capitals, code points and symbols, marks
where words begin and end, and the word spans go into a hash table that
compares bytes before it takes two words for the same.  Each document then is a
set of failed filters, of which only counts per part are needed to play all
orders of the filters.
"""

from __future__ import annotations

import json
import math
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import column, small_batches, stored, text_column, tidy

FILTERS = "ABCDE"
MEASURES = ["n_words", "n_distinct", "n_capitals", "n_chars", "n_symbols"]

# ---- fixed values: thresholds and characters of the filters -------------------
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 3
SYMBOLS = b"#$%&*|"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
# ---- end of fixed values ------------------------------------------------------

# -- the transducer ---------------------------------------------------------------

# Classes of bytes.
SPACE, CAPITAL, SYMBOL, TAIL, OTHER = range(5)
# States: outside and inside a word.
OUT, IN = 0, 1
# What a transition emits, as bits.
BEGIN, END, POINT, UPPER, SIGN = 1, 2, 4, 8, 16


def _classes() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    table[0x80:0xC0] = TAIL  # continuation bytes belong to a code point counted at its first byte
    table[ord("A"):ord("Z") + 1] = CAPITAL
    table[list(SYMBOLS)] = SYMBOL
    table[list(SPACES)] = SPACE
    return table


CLASS = _classes()
# The state after a byte of a class; it does not depend on the state before.
NEXT = np.array([OUT, IN, IN, IN, IN], np.uint8)
# What a byte of a class emits, by the state before it.
EMIT = np.array([
    [POINT, BEGIN | POINT | UPPER, BEGIN | POINT | SIGN, BEGIN, BEGIN | POINT],
    [END | POINT, POINT | UPPER, POINT | SIGN, 0, POINT]], np.uint8)


def transduced(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The emissions of each byte of a buffer; texts begin, outside a word, at the places ``first``."""
    kind = CLASS[data]
    state = np.empty_like(kind)
    state[1:] = NEXT[kind[:-1]]
    state[first[first < len(data)]] = OUT
    return EMIT[state, kind]


# -- the table of words -----------------------------------------------------------

BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


def hashed_spans(letters: np.ndarray, begin: np.ndarray, length: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """64-bit hashes of (owner, word) for words that lie back to back in ``letters``."""
    powers = np.multiply.accumulate(np.full(int(length.max()), BASE, np.uint64))
    place = np.arange(len(letters)) - np.repeat(begin, length)
    sums = np.add.reduceat((letters.astype(np.uint64) + np.uint64(1)) * powers[place], begin)
    out = sums ^ (owner.astype(np.uint64) + np.uint64(1)) * MIX ^ length.astype(np.uint64)
    out ^= out >> np.uint64(32)
    out *= MIX
    return out ^ out >> np.uint64(29)


def same_bytes(letters: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the words that begin at ``a`` and at ``b``, of equal lengths of at least one, are equal."""
    ends = np.cumsum(length)
    begins = ends - length
    step = np.arange(int(ends[-1])) - np.repeat(begins, length)
    differs = letters[np.repeat(a, length) + step] != letters[np.repeat(b, length) + step]
    return ~np.logical_or.reduceat(differs, begins)


def first_of_kind(letters: np.ndarray, begin: np.ndarray, length: np.ndarray, owner: np.ndarray,
                  hashes: np.ndarray) -> np.ndarray:
    """Whether each word is the one that stands for all equal words of its owner.

    Open addressing with linear probing, all words a step at a time: a free slot
    takes one of the words that want it; a word whose slot holds an equal word,
    compared by bytes, is done; the others go on to the next slot.
    """
    n = len(begin)
    size = 1 << int(2 * n - 1).bit_length()
    table = np.full(size, -1, np.int64)
    new = np.zeros(n, bool)
    todo = np.arange(n)
    slot = (hashes & np.uint64(size - 1)).astype(np.int64)
    while len(todo):
        want = slot[todo]
        free = table[want] < 0
        table[want[free]] = todo[free]  # of several that want one slot the last stays
        held = table[want]
        mine = held == todo
        new[todo[mine]] = True
        alike = ~mine & (hashes[held] == hashes[todo]) & (length[held] == length[todo]) & (owner[held] == owner[todo])
        checked = np.flatnonzero(alike)
        if len(checked):
            alike[checked] = same_bytes(letters, begin[held[checked]], begin[todo[checked]], length[todo[checked]])
        todo = todo[~mine & ~alike]
        slot[todo] = (slot[todo] + 1) & (size - 1)
    return new


def measured(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """``MEASURES`` of texts that lie back to back in a buffer, bounded by ``offsets``."""
    texts = len(offsets) - 1
    if not len(data):
        return [np.zeros(texts, np.int64) for _ in MEASURES]
    out = transduced(data, offsets[:-1])

    def per_text(bit: int) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum((out & bit) > 0)])
        return upto[offsets[1:]] - upto[offsets[:-1]]

    starts = np.flatnonzero(out & BEGIN)
    distinct = np.zeros(texts, np.int64)
    if len(starts):
        inside = CLASS[data] != SPACE
        owner = np.searchsorted(offsets, starts, "right") - 1
        upto = np.concatenate([[0], np.cumsum(inside)])
        begin = upto[starts]
        length = np.diff(np.append(begin, upto[-1]))
        letters = data[inside]
        new = first_of_kind(letters, begin, length, owner, hashed_spans(letters, begin, length, owner))
        distinct = np.bincount(owner[new], minlength=texts)
    return [per_text(BEGIN), distinct, per_text(UPPER), per_text(POINT), per_text(SIGN)]


@F.arrow_udf(T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
def _measured(texts: pa.Array) -> pa.Array:
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.empty(0, np.uint8)
    columns = measured(data, offsets - offsets[0])
    tidy()
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], MEASURES)


# -- filters ------------------------------------------------------------------------

def failed_by_text(m: Column) -> Column:
    """Bits of the filters A to D that a text with the measures ``m`` fails."""
    tests = [
        m["n_words"] < MIN_WORDS,
        100 * m["n_distinct"] < DISTINCT_PERCENT * m["n_words"],
        100 * m["n_capitals"] > CAPITAL_PERCENT * m["n_chars"],
        m["n_symbols"] > 0,
    ]
    return sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0))


def failure_counts(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id",
                   part: str = "lang") -> DataFrame:
    """Rows (part, mask, n, good, toxic): documents by the set of filters they fail, as bits of ``FILTERS``.

    A text repeats (E) if a smaller key has an equal text, by its SHA-256 and
    length; a null key comes after all others.  Rows of equal key and text are
    no repeats of each other.  A key is good, or toxic, if any row of
    ``labels`` says so; keys without labels, and null keys, are neither.  Null texts are empty,
    and a null part is the empty string.

    Only 60 bytes a document are shuffled.  Documents of one text are counted
    before the shuffle, so a text that a third of them share is a few rows.
    """
    small_batches(docs)
    t = text_column(docs, text)
    slim = docs.select(
        F.coalesce(column(docs, part).cast("string"), F.lit("")).alias("part"),
        column(docs, key).alias("id"), failed_by_text(_measured(t)).alias("mask"),
        F.unhex(F.sha2(t, 256)).alias("digest"), F.octet_length(t).alias("bytes"))
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    same = ["digest", "bytes", "mask", "part", "good", "toxic"]
    rows = slim.join(marks, "id", "left").select(
        "digest", "bytes", "mask", "part", F.coalesce("good", F.lit(0)).alias("good"),
        F.coalesce("toxic", F.lit(0)).alias("toxic"), F.struct(F.col("id").isNull().alias("none"), "id").alias("at"))
    # rows of one key and text are counted first, so that ties for the smallest key are known
    groups = rows.groupBy(*same, "at").agg(F.count(F.lit(1)).alias("n")).groupBy(*same).agg(
        F.sum("n").alias("n"), F.min(F.struct("at", "n")).alias("first"))
    least = F.min("first.at").over(Window.partitionBy("digest", "bytes"))
    kept = F.when(F.col("first.at") == least, F.col("first.n")).otherwise(F.lit(0).cast("long"))
    repeat = 1 << FILTERS.index("E")
    split = F.explode(F.array(
        F.struct(F.col("mask").alias("mask"), F.col("kept").alias("n")),
        F.struct((F.col("mask") + repeat).alias("mask"), (F.col("n") - F.col("kept")).alias("n")))).alias("s")
    both = groups.withColumn("kept", kept).select("part", "good", "toxic", split)
    n = F.col("s.n")
    return both.groupBy("part", F.col("s.mask").alias("mask")).agg(
        F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic")).filter("n > 0")


def steps(filters: str = FILTERS) -> list[tuple[str, int, int, int]]:
    """(order, step, bit of its filter, bits of the filters before it) of all orders."""
    out = []
    for order in permutations(filters):
        before = 0
        for i, name in enumerate(order):
            bit = 1 << filters.index(name)
            out.append(("".join(order), i + 1, bit, before))
            before |= bit
    return out


def audited(counts: DataFrame) -> DataFrame:
    """Every part, order and step, with what the step's filter does there, from rows of :func:`failure_counts`.

    A part's counts are one row of at most 32 entries, so each of its steps is
    worked out within its own row.  An empty table gives no rows.
    """
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("c"))
    # one literal of 600 entries, not a join with every step
    names = ["filter_order", "step", "bit", "before"]
    listed = F.from_json(
        F.lit(json.dumps([dict(zip(names, s)) for s in steps()])),
        "array<struct<filter_order:string,step:int,bit:int,before:int>>")
    rows = parts.select("part", "c", F.explode(listed).alias("s")).select("part", "c", "s.*")
    bit, before = F.col("bit"), F.col("before")

    def total(test, what: str = "n") -> Column:
        return F.aggregate(
            "c", F.lit(0).cast("long"), lambda a, x: a + F.when(test(x["mask"]), x[what]).otherwise(F.lit(0).cast("long")))

    def fails(mask: Column, bits: Column) -> Column:
        return mask.bitwiseAND(bits) != 0

    def removed(mask: Column) -> Column:
        return fails(mask, bit) & ~fails(mask, before)

    orders = math.factorial(len(FILTERS))
    # of the orders, one in as many as a document fails filters has this filter first among them
    share = F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + F.when(
        fails(x["mask"], bit), x["n"] * (F.lit(orders) / F.bit_count(x["mask"])).cast("long")).otherwise(F.lit(0).cast("long")))
    return rows.select(
        "part", "filter_order", "step",
        total(lambda m: ~fails(m, before.bitwiseOR(bit))).alias("kept"),
        total(removed).alias("removed"),
        total(lambda m: fails(m, bit) & fails(m, before)).alias("redundant"),
        total(lambda m: m == bit).alias("unique_fails"),
        total(removed, "good").alias("good_lost"),
        total(removed, "toxic").alias("toxic_lost"),
        share.alias("shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id",
                 part: str = "lang") -> DataFrame:
    """:func:`audited` of the documents; the counts, 32 rows a part at most, are stored between."""
    return audited(stored(failure_counts(docs, labels, text, key, part)))
