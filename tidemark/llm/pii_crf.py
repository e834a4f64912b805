"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans.  They also label the tokens of a bounded sample,
from which the field's potentials are counted piece by piece: tokens by their
shape, neighbours, and skip edges between repeated or similar tokens anywhere in
a document.  Loopy message passing over a whole document then makes labels of
repeated entities agree, and adds spans that the patterns missed.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import column, free_name, small_batches, text_column, tidy

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
N = len(LABELS)
# Documents whose tokens train the potentials, about.
SAMPLE = 4000
# A token is added when its label is at least this probable.
SURE = 0.7
ROUNDS, DAMPING = 20, 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_SPACES = frozenset(" \t\n\x0b\x0c\r")
_REST = re.compile(r"[0-9@][^ \t\n\x0b\x0c\r]*+")


class Span(NamedTuple):
    kind: int
    start: int
    end: int


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[Span]:
    """Leftmost matches, found from each @ outwards; the reach to the left ends at the @ or match before."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            out.append(Span(0, start, done))
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[Span]:
    """All base spans, by start and then kind."""
    if not _ANY.search(text):
        return []
    out = emails(text) if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(Span(1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = digits_of(m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(Span(2, *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(digits_of(m[0])) <= 15:
            out.append(Span(3, *m.span()))
    return sorted(out, key=lambda s: (s.start, s.kind))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in sorted(spans, key=lambda s: (s.start, s.kind)))


# -- tokens and features ---------------------------------------------------------

class Token(NamedTuple):
    start: int  # without punctuation around it
    end: int
    joined: bool  # only white space stands between it and the token before
    shape: str
    coarse: str
    digits: str
    key: str


_EDGE = "\"'.,;:!?()[]{}<>|*#$%&"
_RUN = re.compile(r"[0-9]+|[^\W\d_]+|.", re.S)
_LETTER = re.compile(r"[^\W\d_]")
_GAP = re.compile(r"[ \t\n\x0b\x0c\r]*")
# A longer shape is named by its digest, so a long token takes no more room.
SHAPE_CHARS = 24


def _size(n: int) -> str:
    return "d" if n <= 3 else "f" if n == 4 else "m" if n <= 9 else "n" if n <= 13 else "c" if n <= 19 else "x"


def described(text: str, start: int, end: int, joined: bool) -> Token:
    """A token from a stretch without white space."""
    while end > start and text[end - 1] in _EDGE:
        end -= 1
    low = start
    while low < end and text[low] in _EDGE:
        low += 1
    core, lead = text[low:end], text[start:low][-1:]
    if "@" in core:
        user, _, domain = core.partition("@")
        shape = f"{'a' if user else ''}@{'a' if domain else ''}{min(domain.count('.'), 2)}"
    else:
        runs = [_size(len(r)) if r[0] in "0123456789" else "a" if r[0].isalpha() else r[0] for r in _RUN.findall(core)]
        shape = lead + "".join(runs)
        if len(shape) > SHAPE_CHARS:
            shape = f"#{xxhash.xxh64_hexdigest(shape)}"
    digits = digits_of(core)
    letters = _LETTER.search(core) is not None
    coarse = f"{'@' in core}{letters}{_size(len(digits))}{min(core.count('.'), 4)}{core[:1] == '+'}"
    return Token(low, end, joined, shape, coarse, digits, core.lower())


def tokens(text: str) -> list[Token]:
    """The tokens with a digit or an @, which alone can be personal data; all others are surely none."""
    out, last = [], 0
    for m in _REST.finditer(text):
        start = m.start()
        while start > last and text[start - 1] not in _SPACES:
            start -= 1
        joined = bool(out) and _GAP.fullmatch(text, last, start) is not None
        token = described(text, start, m.end(), joined)
        last = m.end()
        if token.start < token.end:
            out.append(token)
    return out


def edges(found: list[Token]) -> tuple[list[tuple[int, int]], ...]:
    """Chain, repeat and similar edges; each kind's number is at most the number of tokens.

    A repeated token is linked to its occurrence before, so all occurrences hang
    together; so are tokens of the same shape with at least seven digits or an @.
    """
    chain = [(i - 1, i) for i in range(1, len(found)) if found[i].joined]
    repeat, similar, seen, alike = [], [], {}, {}
    for i, t in enumerate(found):
        name = t.digits if len(t.digits) >= 7 and "@" not in t.key else t.key
        if len(name) >= 4:
            if name in seen:
                repeat.append((seen[name], i))
            seen[name] = i
        if len(t.digits) >= 7 or "@" in t.key:
            if t.shape in alike:
                similar.append((alike[t.shape], i))
            alike[t.shape] = i
    return chain, repeat, similar


def weak_labels(found: list[Token], spans: list[Span]) -> list[int]:
    """The kind of the first span that covers a token's first character, else none."""
    out, at = [], 0
    ordered = sorted(spans, key=lambda s: (s.start, s.kind))
    for t in found:
        while at < len(ordered) and ordered[at].end <= t.start:
            at += 1
        hit = next((s for s in ordered[at:at + len(KINDS)] if s.start < t.end and s.end > t.start), None)
        out.append(1 + hit.kind if hit else 0)
    return out


# -- potentials ------------------------------------------------------------------

def counted(text: str) -> Counter:
    """Counts of (what, name, label, label) that the potentials are made from."""
    found = tokens(text)
    labels = weak_labels(found, base_spans(text)) if found else []
    out: Counter = Counter()
    for t, y in zip(found, labels):
        out["shape", t.shape, y, 0] += 1
        out["coarse", t.coarse, y, 0] += 1
    for name, pairs in zip(("chain", "repeat", "similar"), edges(found)):
        for i, j in pairs:
            out["edge", name, labels[i], labels[j]] += 1
    return out


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total: Counter = Counter()
        for text in batch.column(0).to_pylist():
            total += counted(text or "")
        rows = [(*k, n) for k, n in total.items()]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in zip(*rows)], ["what", "name", "a", "b", "n"])


class Field:
    """Log potentials of tokens and edges."""

    def __init__(self, counts: dict[tuple, int]):
        prior = np.full(N, 0.5)
        shapes, coarse = ({}, {})
        tables = {k: np.full((N, N), 0.2) + 0.8 * np.eye(N) for k in ("chain", "repeat", "similar")}
        for (what, name, a, b), n in counts.items():
            if what == "edge":
                tables[name][a, b] += n
                tables[name][b, a] += n
            else:
                kept = shapes if what == "shape" else coarse
                kept.setdefault(name, np.zeros(N))[a] += n
                prior[a] += n * (what == "coarse")
        self.prior = prior / prior.sum()
        self.coarse = {k: (v + 2 * self.prior) / (v.sum() + 2) for k, v in coarse.items()}
        self.shapes = shapes
        self.edges = []
        for k in ("chain", "repeat", "similar"):
            p = tables[k] / tables[k].sum()
            self.edges.append(np.clip(np.log(p / np.outer(p.sum(1), p.sum(0))), -3, 3))

    def node(self, t: Token) -> np.ndarray:
        """Log probabilities of a token's label by shape, smoothed by its coarse features."""
        back = self.coarse.get(t.coarse, self.prior)
        own = self.shapes.get(t.shape)
        return np.log(back if own is None else (own + 3 * back) / (own.sum() + 3))

    def marginals(self, found: list[Token]) -> np.ndarray:
        """Label probabilities of each token after loopy message passing over the document."""
        nodes = np.array([self.node(t) for t in found])
        groups = edges(found)
        source = np.array([i for g in groups for i, _ in g], np.int64)
        target = np.array([j for g in groups for _, j in g], np.int64)
        if not len(source):
            return np.exp(nodes)
        tables = np.repeat(np.array(self.edges), [len(g) for g in groups], axis=0)
        # Both directions; the message back along edge e is e + E or e - E.
        heads, tails = np.r_[source, target], np.r_[target, source]
        tables = np.concatenate([tables, tables.transpose(0, 2, 1)])
        back = np.r_[len(source):2 * len(source), 0:len(source)]
        messages = np.zeros((len(heads), N))
        for _ in range(ROUNDS):
            belief = nodes.copy()
            np.add.at(belief, tails, messages)
            sent = (belief[heads] - messages[back])[:, :, None] + tables
            top = sent.max(1, keepdims=True)
            new = np.log(np.exp(sent - top).sum(1)) + top[:, 0]
            new -= new.max(1, keepdims=True)
            change = np.abs(new - messages).max()
            messages = DAMPING * messages + (1 - DAMPING) * new
            if change < 1e-3:
                break
        belief = nodes.copy()
        np.add.at(belief, tails, messages)
        belief = np.exp(belief - belief.max(1, keepdims=True))
        return belief / belief.sum(1, keepdims=True)

    def spans(self, text: str, base: list[Span]) -> list[Span]:
        """``base`` and the spans of sure tokens that no base span touches."""
        found = tokens(text)
        if not found:
            return base
        shares = self.marginals(found)
        labels = np.where(shares.max(1) >= SURE, shares.argmax(1), 0).tolist()
        for i, y in enumerate(weak_labels(found, base)):
            labels[i] = -1 if y else labels[i]
        out, i = list(base), 0
        while i < len(found):
            kind, j = labels[i], i + 1
            if kind == 1 + KINDS.index("phone"):  # a number may be spread over tokens
                while j < len(found) and labels[j] == kind and found[j].joined:
                    j += 1
            if kind > 0 and plausible(kind - 1, text[found[i].start:found[j - 1].end]):
                out.append(Span(kind - 1, found[i].start, found[j - 1].end))
            i = j
        return out


def plausible(kind: int, text: str) -> bool:
    """Whether an added span could be of its kind at all."""
    digits = digits_of(text)
    if kind == 0:
        return 0 < text.find("@") < len(text) - 1
    if kind == 1:
        parts = text.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15


def train(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Field:
    """Potentials from about ``sample`` distinct texts, drawn by a hash; a bounded set of counts reaches the driver.

    Counts of shapes that occur once are left to the coarse features.  On an
    empty table all potentials are flat.
    """
    small_batches(docs)
    body = text_column(docs, text)
    n = max(docs.count(), 1)
    drawn = docs.select(body.alias("text")).withColumn("hash", F.xxhash64("text"))
    share = min(sample / n, 1.0)
    drawn = drawn.filter(F.pmod("hash", F.lit(1 << 48)) < int(share * (1 << 48)) + 1).dropDuplicates(["hash"])
    counts = (
        drawn.select("text").mapInArrow(_count_batches, "what string, name string, a bigint, b bigint, n bigint")
        .groupBy("what", "name", "a", "b").agg(F.sum("n").alias("n"))
        .filter("what != 'shape' or n > 1").collect())
    return Field({(r["what"], r["name"], r["a"], r["b"]): r["n"] for r in counts})


def masked(text: str, spans: list[Span]) -> str:
    """The text with each stretch of overlapping spans replaced by the name of its first span's kind."""
    out, done, name = [], 0, None
    for s in sorted(spans, key=lambda s: (s.start, s.kind)):
        if s.start >= done or name is None:
            out += [text[done:s.start], f"[{KINDS[s.kind].upper()}]"]
            name = s.kind
        done = max(done, s.end)
    return "".join(out) + text[done:]


_TYPE = T.StructType([
    *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS], T.StructField("base_sha256", T.StringType()),
    T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType())])


def _finder(field: Field, return_text: bool):
    def found(text: str) -> tuple[list[Span], list[Span]]:
        base = base_spans(text)
        return base, field.spans(text, base)

    if return_text:
        @F.arrow_udf(T.StringType())
        def clean(texts: pa.Array) -> pa.Array:
            out = pa.array([masked(t, found(t)[1]) for t in texts.to_pylist()], pa.string())
            tidy()
            return out
        return clean

    @F.arrow_udf(_TYPE)
    def find(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts.to_pylist():
            base, spans = found(t)
            kinds = Counter(s.kind for s in base)
            rows.append((*(kinds[k] for k in range(len(KINDS))), hashlib.sha256(listed(base).encode()).hexdigest(),
                         listed(spans), len(spans) - len(base)))
        types = [pa.int64()] * len(KINDS) + [pa.string(), pa.string(), pa.int64()]
        return pa.StructArray.from_arrays(
            [pa.array([r[i] for r in rows], k) for i, k in enumerate(types)], [f.name for f in _TYPE.fields])
    return find


def spans(docs: DataFrame, text: str = "text", key: str = "doc_id", field: Field | None = None) -> DataFrame:
    """One row per document: key, base counts by kind, hash of the base spans, all spans, number of added ones.

    A null text is empty and has no spans.  Rows are labelled each for itself,
    so repeated rows give repeated results; only the training sample is shuffled.
    """
    field = field or train(docs, text)
    out = docs.select(column(docs, key).alias(key), _finder(field, False)(text_column(docs, text)).alias("_found"))
    return out.select(key, "_found.*")


def without_personal_data(docs: DataFrame, text: str = "text", field: Field | None = None) -> DataFrame:
    """``docs`` with spans in ``text`` replaced by their kind's name, and ``n_chars``, if there, counted anew.

    A null text stays null.
    """
    field = field or train(docs, text)
    clean: Column = _finder(field, True)(text_column(docs, text))
    name = free_name(docs, "_clean")
    out = docs.withColumn(name, clean)
    body = F.when(column(docs, text).isNotNull(), F.col(name))
    columns = []
    for c in docs.columns:
        if c == text:
            columns.append(body.alias(c))
        elif c == "n_chars":
            columns.append(F.coalesce(F.length(body), column(docs, c)).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(column(docs, c))
    return out.select(*columns)
