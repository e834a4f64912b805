"""Licence detection by ordered signature rules.

Rules are regular expressions over a text's words (lower case, one space apart).
A rule runs only where its keywords occur.  Where detections overlap, one
whose words lie within a detection of the same or a higher priority is dropped.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import cache
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import column, small_batches, text_column
from tidemark.llm.license_signatures import SIGNATURES, spdx_rules

_WORD_BYTES = set(b"abcdefghijklmnopqrstuvwxyz0123456789") | set(range(0x80, 0x100))
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b in _WORD_BYTES else 32 for b in range(256))

# The base phrases and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]


class Rule(NamedTuple):
    label: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    priority: int
    confidence: float


class Detection(NamedTuple):
    label: str
    start: int
    end: int
    priority: int
    confidence: float


@cache
def rules() -> list[Rule]:
    """All rules by priority; of one priority in the order they are written."""
    out = [Rule(label, (keywords,), re.compile(f"(?<= ){pattern}(?= )"), priority, confidence)
           for label, keywords, pattern, priority, confidence, _ in [*spdx_rules(), *SIGNATURES]]
    return sorted(out, key=lambda r: -r.priority)


@cache
def gates() -> dict[str, list[int]]:
    """Rule numbers by first keyword."""
    out: dict[str, list[int]] = {}
    for i, rule in enumerate(rules()):
        out.setdefault(rule.keywords[0], []).append(i)
    return out


def normal(text: bytes) -> tuple[bytes, int]:
    """The words, each between single spaces, and their number."""
    words = text.translate(_TO_WORDS).split()
    return b" " + b" ".join(words) + b" ", len(words)


def detections(words: str) -> list[Detection]:
    """What the rules find in normal text, after suppression, by start."""
    numbers = sorted(i for k, found in gates().items() if k in words for i in found)
    kept: list[Detection] = []
    for i in numbers:
        rule = rules()[i]
        if not all(k in words for k in rule.keywords[1:]):
            continue
        at, passed = 0, 0
        for m in rule.pattern.finditer(words):
            passed += words.count(" ", at, m.start()) if m.start() > at else 0
            at = m.start()
            end = passed + words.count(" ", at, m.end())
            kept.append(Detection(rule.label, passed - 1, end, rule.priority, rule.confidence))
    return suppressed(kept)


def suppressed(found: list[Detection]) -> list[Detection]:
    """Detections that lie in none of a higher priority, and in no longer or earlier one of the same, by start."""
    out: list[Detection] = []
    for priority in sorted({d.priority for d in found}, reverse=True):
        # The kept ones of higher priorities: the farthest end among those that start at or before a word.
        starts = [d.start for d in out]
        ends = list(accumulate((d.end for d in out), max))
        reach, level = -1, []
        for d in sorted((d for d in found if d.priority == priority), key=lambda d: (d.start, -d.end)):
            before = bisect_right(starts, d.start)
            if d.end <= reach or before and ends[before - 1] >= d.end:
                continue
            reach = d.end
            level.append(d)
        out = sorted(out + level, key=lambda d: d.start)
    return out


def places(words: bytes, phrase: str) -> list[int]:
    """First words of all places of a phrase, overlapping ones too."""
    wanted = f" {phrase} ".encode()
    out, at, passed = [], 0, 0
    found = words.find(wanted)
    while found >= 0:
        passed += words.count(b" ", at, found)
        at = found
        out.append(passed)
        found = words.find(wanted, found + 1)
    return out


class Scan(NamedTuple):
    n_words: int
    n_base: int
    first_word: int | None
    last_word: int | None
    base_labels: str
    labels: str
    score: float
    found: list[Detection]


def scan(text: bytes) -> Scan:
    """Base places and detections of one UTF-8 text."""
    words, n = normal(text)
    base = [(p, label) for phrase, label in PHRASES for p in places(words, phrase)]
    found = detections(words.decode())
    own = {label for _, label in base}
    score = max([0.5] * bool(base) + [d.confidence for d in found], default=0.0)
    return Scan(n, len(base), min(base)[0] if base else None, max(base)[0] if base else None,
                ",".join(sorted(own)), ",".join(sorted(own | {d.label for d in found})), score, found)


_FOUND = T.ArrayType(T.StructType([
    T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("confidence", T.DoubleType())]))
_TYPE = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()), T.StructField("found", _FOUND)])


@F.arrow_udf(_TYPE)
def _scanned(texts: pa.Array) -> pa.Array:
    got = [scan(t or b"") for t in texts.cast(pa.binary()).to_pylist()]
    found = pa.list_(pa.struct([
        ("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("confidence", pa.float64())]))
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), found]
    columns = [
        pa.array([[{"label": d.label, "start": d.start, "end": d.end, "confidence": d.confidence} for d in s.found]
                  for s in got], found) if name == "found" else pa.array([getattr(s, name) for s in got], kind)
        for name, kind in zip(Scan._fields, kinds)]
    return pa.StructArray.from_arrays(columns, list(Scan._fields))


def scanned(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: the key, the fields of ``Scan``, detections as structs of word intervals.

    A null text is empty: no words, no places, empty labels, score 0.  Rows are
    independent of each other; nothing is shuffled.
    """
    small_batches(docs)
    out = docs.select(column(docs, key).alias(key), _scanned(text_column(docs, text)).alias("_scan"))
    return out.select(key, "_scan.*")
