"""Pack documents into sequences by order-preserving dynamic programming.

Documents stand in the order of their ids.  Each range of ids is read as one
stream of tokens and cut into windows of at most ``LENGTH`` tokens; cuts stand
at ends of documents or sentences, and elsewhere only where those are too far
apart.  The cuts minimise padding plus penalties for split documents.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import column, shuffle_partitions, small_batches, text_column, tidy
from tidemark.llm.segments import Encoder, shared_encoder

LENGTH, END_ID = 2048, 1
# Penalties in tokens of padding: a cut at the end of a sentence, and one within a sentence.
SENTENCE_CUT, HARD_CUT = 1, 48
# Lengths below 2048 that need no padding and are used, and what an unfilled sequence of such a length costs.
SHORT_LENGTHS, SHORT_COST = (1024, 512, 256), 4
# A stretch of this many tokens is cut by itself; bounds a worker's memory.
STRETCH = 1 << 19
SCHEMA = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint")


def padding(length: int, limit: int = LENGTH) -> int:
    """Padding of a sequence: none at a power of two, else up to ``limit``."""
    return 0 if length & (length - 1) == 0 else limit - length


def best_cuts(places: list[int], penalties: list[int], limit: int = LENGTH) -> list[int]:
    """Window ends (places) with the least padding plus penalties.

    ``places`` ascend to the stream's length, start above 0, and are at most
    ``limit`` apart.  The best predecessor of a place is the front of a monotone
    queue over cost plus place, or a place that leaves a length without padding.
    """
    at = {0: 0}  # place -> its best cost
    before = {}
    queue = deque([(0, 0)])  # (cost + place, place), ascending in both
    shorts = [x for x in SHORT_LENGTHS if x < limit]
    for place, penalty in zip(places, penalties):
        while queue[0][1] < place - limit:
            queue.popleft()
        low, source = queue[0]
        cost = low + limit - place  # its cost, and padding of limit - (place - source)
        for short in shorts:
            other = at.get(place - short)
            if other is not None and other + SHORT_COST < cost:
                cost, source = other + SHORT_COST, place - short
        cost += penalty
        at[place] = cost
        before[place] = source
        value = cost + place
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, place))
    out, place = [], places[-1]
    while place:
        out.append(place)
        place = before[place]
    return out[::-1]


def candidates(total: int, document_ends: np.ndarray, sentence_ends: np.ndarray,
               limit: int = LENGTH) -> tuple[list[int], list[int]]:
    """Places where a window may end, and their penalties; long gaps get places at powers of two."""
    places = np.union1d(document_ends, sentence_ends[(sentence_ends > 0) & (sentence_ends < total)])
    penalties = np.where(np.isin(places, document_ends), 0, SENTENCE_CUT)
    gaps = np.diff(np.r_[0, places])
    long = np.flatnonzero(gaps > limit // 2)
    if len(long):
        more = np.concatenate([np.arange(places[i] - gaps[i] + limit // 8, places[i], limit // 8) for i in long])
        places, penalties = np.r_[places, more], np.r_[penalties, np.full(len(more), HARD_CUT)]
        order = np.argsort(places, kind="stable")
        places, penalties = places[order], penalties[order]
    return places.tolist(), penalties.tolist()


def cut(ids: np.ndarray, ends: np.ndarray, sentence_end: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Pieces (document number, start in the stream, length, window number) of one stretch."""
    sentence_ends = np.flatnonzero(sentence_end[ids]) + 1
    windows = np.array(best_cuts(*candidates(len(ids), ends, sentence_ends)))
    bounds = np.union1d(windows, ends)
    starts = np.r_[0, bounds[:-1]]
    return list(zip(
        np.searchsorted(ends, starts, "right").tolist(), starts.tolist(), (bounds - starts).tolist(),
        np.searchsorted(windows, starts, "right").tolist()))


class Packer:
    """Turns documents, in order, into columns of ``SCHEMA``."""

    def __init__(self, first_id: int, encoder: Encoder | None = None, stretch: int = STRETCH):
        self.encoder = encoder or shared_encoder()
        self.next_id, self.stretch = first_id, stretch
        self.doc_ids: list = []
        self.ids: list[np.ndarray] = []
        self.n = 0

    def add(self, doc_ids: list, texts: pa.Array) -> list[tuple]:
        ids, bounds = self.encoder.batch(texts)
        end = np.array([END_ID], np.uint16)
        rows = []
        for i, doc_id in enumerate(doc_ids):
            self.doc_ids.append(doc_id)
            self.ids += [ids[bounds[i]:bounds[i + 1]], end]
            self.n += int(bounds[i + 1] - bounds[i]) + 1
            if self.n >= self.stretch:
                rows += self.flush()
        self.ids = [x.copy() for x in self.ids]  # lets go of the batch
        return rows

    def flush(self) -> list[tuple]:
        if not self.doc_ids:
            return []
        tokens = [len(x) + 1 for x in self.ids[::2]]
        ids, ends = np.concatenate(self.ids), np.cumsum(tokens)
        wide = ids.astype("<u4")
        rows, offset, last = [], 0, 0
        for number, start, length, window in cut(ids, ends, self.encoder.sentence_end):
            if window != last:
                offset, last = 0, window
            rows.append((self.doc_ids[number], int(start - (ends[number] - tokens[number])), length,
                         zlib.crc32(wide[start:start + length]), tokens[number], self.next_id + window, offset))
            offset += length
        self.next_id += last + 1
        self.doc_ids, self.ids, self.n = [], [], 0
        return rows


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    names = [f.split()[0] for f in SCHEMA.split(", ")]
    packer = None

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names)

    for b in batches:
        packer = packer or Packer(TaskContext.get().partitionId() << 40)
        if b.num_rows and (rows := packer.add(b.column(0).to_pylist(), b.column(1))):
            yield batch(rows)
        tidy()
    if packer and (rows := packer.flush()):
        yield batch(rows)


def packed(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pieces of documents with their sequence and offset.

    Texts move once, to ranges of ids (ties by text hash, null ids first); each
    range is packed as a stream, so one with very many rows takes time but no
    memory.  A null text is empty and has the end id alone.  Repeated rows are
    packed each for itself; an empty table gives no rows.
    """
    small_batches(docs)
    body = text_column(docs, text)
    rows = docs.select(column(docs, key).cast("long").alias("doc_id"), body.alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    return (
        rows.repartitionByRange(shuffle_partitions(docs.sparkSession), *order)
        .sortWithinPartitions(*order).mapInArrow(_packed, SCHEMA)
        .withColumnRenamed("doc_id", key))
