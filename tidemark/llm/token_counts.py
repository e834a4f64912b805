"""Token counts by a transducer whose chunk state maps compose.

A text is read as a string over segments (see :mod:`tidemark.llm.segments`).
The transducer has one synchronised state between segments; the transition over
a segment emits its number of tokens and returns there.  Transitions are
compiled for the distinct segments of a batch, from the tokenizer itself.

A chunk of a text may begin and end inside a segment.  Its state map therefore
is (head, emitted, tail): the characters before its first sure cut, the tokens
of the whole segments, the characters from its last one; a chunk without a cut
is a head alone.  Composition joins a tail and the next head into a segment and
is associative, so a text's chunks are composed in doubling steps: by a prefix
scan where the counts up to each chunk are wanted, by its up-sweep where only the
text's is.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import column, small_batches, text_column, tidy
from tidemark.llm.segments import SPECIAL, Encoder, pieces, plain, shared_encoder

CHUNK = 1 << 15
LIMIT = 512


class StateMap(NamedTuple):
    """What a chunk does; ``tail`` is None if the chunk has no sure cut."""

    head: str
    emitted: int
    tail: str | None


class Transducer:
    def __init__(self, encoder: Encoder | None = None):
        self.encoder = encoder or shared_encoder()

    def emits(self, piece: str) -> int:
        """Tokens emitted over one whole segment."""
        return len(self.encoder.tokenizer.encode_ordinary(piece)) if piece else 0

    def chunk(self, text: str) -> StateMap:
        """The state map of any chunk."""
        first, *rest = pieces(text)
        if not rest:
            return StateMap(text, 0, None)
        return StateMap(first, sum(map(self.emits, rest[:-1])), rest[-1])

    def chunks(self, texts: list[str]) -> list[StateMap]:
        """State maps of many chunks; each distinct segment's transition is compiled once."""
        array = pa.array(texts, pa.string())
        easy = plain(array)
        where = np.flatnonzero(easy)
        maps: list = [None] * len(texts)
        if len(where):
            lists = pc.split_pattern(array.take(pa.array(where)), " ")
            begins = lists.offsets.to_numpy()
            coded = lists.values.dictionary_encode()
            _, bounds = self.encoder.table(coded.dictionary)
            codes = coded.indices.to_numpy()
            upto = np.r_[0, np.cumsum(np.diff(bounds)[codes])]
            ends = begins[1:] - 1
            heads, tails = (coded.dictionary.take(pa.array(codes[x])).to_pylist() for x in (begins[:-1], ends))
            inner = upto[np.maximum(ends, begins[:-1] + 1)] - upto[begins[:-1] + 1]
            for i, head, n, tail, lone in zip(
                    where.tolist(), heads, inner.tolist(), tails, (ends == begins[:-1]).tolist()):
                maps[i] = StateMap(head, 0, None) if lone else StateMap(head, n, " " + tail)
        for i in np.flatnonzero(~easy).tolist():
            maps[i] = self.chunk(texts[i])
        return maps

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        """The state map of ``a`` followed by ``b``: a's tail and b's head are read as one."""
        middle = self.chunk((a.head if a.tail is None else a.tail) + b.head)
        if a.tail is None and b.tail is None:
            return middle
        if a.tail is None:
            if middle.tail is None:
                return StateMap(middle.head, b.emitted, b.tail)
            return StateMap(middle.head, middle.emitted + self.emits(middle.tail) + b.emitted, b.tail)
        emitted = a.emitted + middle.emitted + b.emitted
        if b.tail is None:
            if middle.tail is None:
                return StateMap(a.head, emitted, middle.head)
            return StateMap(a.head, emitted + self.emits(middle.head), middle.tail)
        emitted += self.emits(middle.head) + self.emits(middle.tail or "")
        return StateMap(a.head, emitted, b.tail)

    def scan(self, maps: list[StateMap]) -> list[StateMap]:
        """Inclusive prefix compositions: an up-sweep over pairs, then the odd places from their neighbours."""
        if len(maps) < 2:
            return maps
        pairs = self.scan([self.compose(*maps[i:i + 2]) for i in range(0, len(maps) - 1, 2)])
        out = [maps[0]]
        for i in range(1, len(maps)):
            out.append(pairs[i // 2] if i % 2 else self.compose(pairs[i // 2 - 1], maps[i]))
        return out

    def total(self, maps: list[StateMap]) -> int:
        """Tokens of the text that these chunks make up: the scan's up-sweep alone, which keeps no prefix.

        At any time the maps hold each character of the text once at most, also if it has no sure cut.
        """
        while len(maps) > 1:
            maps = [self.compose(*maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        m = maps[0]
        return m.emitted + self.emits(m.head) + self.emits(m.tail or "")

    def counts(self, texts: list[str], size: int = CHUNK) -> list[int]:
        """Tokens of each text as the library counts them: the special string is one token wherever it stands."""
        parts, owner, fixed = [], [], [0] * len(texts)
        for i, text in enumerate(texts):
            for j, part in enumerate(text.split(SPECIAL)):
                fixed[i] += j > 0
                cut = [part[k:k + size] for k in range(0, len(part), size)]
                parts += cut
                owner += [(i, j)] * len(cut)
        maps = self.chunks(parts)
        begin = 0
        for end in range(1, len(maps) + 1):
            if end == len(maps) or owner[end] != owner[begin]:
                fixed[owner[begin][0]] += self.total(maps[begin:end])
                begin = end
        return fixed


@F.arrow_udf(T.LongType())
def _counted(texts: pa.Array) -> pa.Array:
    out = pa.array(Transducer().counts([t or "" for t in texts.to_pylist()]), pa.int64())
    tidy()
    return out


def token_counts(docs: DataFrame, text: str = "text", key: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """One row per document: key, n_bytes, n_tokens, over_limit.

    A null text is empty: no bytes, no tokens.  Rows are independent of each
    other, so repeated rows and ids give repeated results; nothing is shuffled.
    """
    small_batches(docs)
    return docs.select(
        column(docs, key).alias(key), F.octet_length(text_column(docs, text)).cast("long").alias("n_bytes"),
        _counted(text_column(docs, text)).alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)
