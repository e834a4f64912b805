"""Near-duplicate passages by compact windows.

A text is a sequence of five-word shingles.  Under a min-hash function all
passages of a text that contain place c, and in which c has the least hash, share
one signature; they form a compact window (l, c, r).  The windows of at least the
shortest passage's length are nodes of the Cartesian tree over the hashes.  The
signatures of two functions together are a joint key: passages with equal least
hashes by both functions share it, and form a joint window.  Texts are partnered
within a joint key, so two functions agree on each pair before any partner is
chosen.  Windows of a pair of texts that overlap are merged, and the passages are
compared shingle by shingle.

First each window is compared with the first text of its key and the text before.
That connects the texts of a key if all agree with the first.  Where one does not,
all texts of the key that are not connected by then are compared with each other,
but for pairs that cannot be alike by the shingles that they share.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import dealt
from tidemark.llm.common import column, shuffle_partitions, small_batches, stored, text_column, tidy
from tidemark.llm.components import components
from tidemark.llm.dealt import scrambled

SHINGLE, MIN_WORDS, SIMILARITY = 5, 50, 0.8
# Hash functions; any two of them must agree on a passage.
FUNCTIONS = 4
PAIRED = list(combinations(range(FUNCTIONS), 2))
ONE, TWO = np.array(PAIRED).T
# Bytes of texts that are cut into windows together: at 2 MB few minima fit into MINIMA, and ranges are read through.
TOGETHER = 1 << 20
# Numbers kept for minima of ranges, and the bits of a ranked hash that are its place.
MINIMA, PLACE = 1 << 24, np.uint64((1 << 28) - 1)
# Regions of texts are widened to multiples of this, so that the many partners of one text share regions.
GRID = 64
WORD = r"[^\x20\x09-\x0D]+"
# A window's place holds its salt, l and r; of 63 bits l and r take 28 each.
WINDOWS, SALT_AT, L_AT, BITS = "key bigint, tid bigint, place bigint", 56, 28, (1 << 28) - 1
# A signature that this many texts of a hashed share of all texts have is hot: its windows are dealt to several
# tasks.  At most HOT_KEYS of them are known; the others are handled in one task each, as rare ones are.
# A salt is a text's six highest bits.
SAMPLE_OF, HOT_TEXTS, HOT_KEYS, SALTS = 64, 16, 10_000, 64
# Of a key with this many texts, the first one and the one before make all pairs.
ALL_PAIRED = 3
# Of so many places one may be unmatched for each time that a stretch has them, but none at its beginning (see ``segments``).
NINE = 9
# Of a passage's least number of places, those that are matched at the beginning of any near-duplicate stretch: of each
# beginning of a stretch less than a ninth is not matched (see ``segments``), which is five of 46 places at most.
SHARED = MIN_WORDS - SHINGLE + 1 - (MIN_WORDS - SHINGLE) // 9
PAIRS = "tb bigint, ta bigint, lb int, rb int, la int, ra int, key bigint, salt int"
REGIONS = "tb bigint, ta bigint, lb int, rb int, la int, ra int, keys array<struct<key:bigint,lb:int,rb:int>>"
LINK = ["tb", "ta", "start", "end", "partner_start", "partner_end", "similarity"]
VERIFIED = ("tb bigint, ta bigint, start bigint, end bigint, partner_start bigint, partner_end bigint, similarity double, "
            "key bigint")
KEYED = ("tid bigint, lo int, hi int, part binary, owner bigint, need int, most int, common bigint, rare binary, "
         "shared binary")
KEYED_AS = pa.schema([
    ("tid", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("part", pa.binary()), ("owner", pa.int64()), ("need", pa.int32()),
    ("most", pa.int32()), ("common", pa.int64()), ("rare", pa.binary()), ("shared", pa.binary())])
# Bytes of the stretches that others meet together, and of places of them that are compared at once.
GROUP, CELLS = 1 << 18, 1 << 22
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' shingles one after another, and the bounds of each text's."""
    data = np.frombuffer(b" " + b"\n".join(t.lower() for t in texts) + b" ", np.uint8)
    space = _SPACE[data]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    sizes = np.flatnonzero(~space[:-1] & space[1:]) + 1 - starts
    factors = scrambled(np.arange(1, int(sizes.max()) + 1, dtype=np.uint64)) | np.uint64(1)
    first = np.cumsum(sizes) - sizes
    letters = data[~space].astype(np.uint64) + np.uint64(1)
    letters *= factors[np.arange(len(letters)) - np.repeat(first, sizes)]
    words = scrambled(np.add.reduceat(letters, first) ^ sizes.astype(np.uint64))
    bounds = np.searchsorted(starts, np.cumsum([1, *[len(t) + 1 for t in texts]]))
    turns = scrambled(np.arange(101, 101 + SHINGLE, dtype=np.uint64)) | np.uint64(1)
    n = max(len(words) - SHINGLE + 1, 0)
    mixed = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        mixed += words[i:i + n] * turns[i]
    mixed = scrambled(mixed)
    counts = np.maximum(np.diff(bounds) - SHINGLE + 1, 0)
    ends = np.cumsum(counts)
    where = np.arange(ends[-1]) - np.repeat(ends - counts, counts) + np.repeat(bounds[:-1], counts)
    return mixed[where], np.r_[0, ends]


class Minima:
    """Least hashes of ranges by several functions, with their places in the low bits; ties go to the left.

    Ranges are two overlapping stretches of 2^k places, whose minima are kept for
    as many k as ``MINIMA`` numbers allow; longer ranges are read through.
    """

    def __init__(self, hashed: list[np.ndarray], longest: int):
        self.ranked = np.concatenate([x & ~PLACE | np.arange(len(x), dtype=np.uint64) for x in hashed])
        table, row, width = [], self.ranked, 1
        while width <= longest and (len(table) + 1) * len(row) <= MINIMA:
            table.append(row)
            row = row.copy()
            np.minimum(row[:-width], row[width:], out=row[:-width])
            width *= 2
        self.table, self.reach = np.concatenate(table or [self.ranked[:0]]), width if table else 0

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out = np.empty(len(low), np.uint64)
        size = high - low
        near = np.flatnonzero(size < self.reach)
        if len(near):
            k = np.frexp(size[near])[1].astype(np.int64) - 1
            row = k * len(self.ranked)
            out[near] = np.minimum(self.table[row + low[near]], self.table[row + high[near] - (1 << k)])
        if len(near) < len(low):
            far = np.flatnonzero(size >= self.reach)
            # From the right to the left, so that nothing is read that lies between two ranges.
            far = far[np.argsort(-low[far], kind="stable")]
            ends = np.empty(2 * len(far), np.int64)
            ends[::2], ends[1::2] = low[far], high[far]
            out[far] = np.minimum.reduceat(np.append(self.ranked, PLACE), ends)[::2]
        return out


def joint_windows(hashed: list[np.ndarray], pairs: list[tuple[int, int]], bounds: np.ndarray,
                  least: int) -> tuple[np.ndarray, ...]:
    """(pair, l, c, d, r) of the longest windows, of at least ``least`` places, whose least hashes are at c by the one
    and at d by the other function of a pair; ``r`` is inclusive and ties go to the left.

    All texts and pairs are searched level by level: a window without the left or
    without the right one of its two places is a window of the next level.  One
    that is reached from both sides is kept from the right side only.
    """
    minima, n = Minima(hashed, int(np.diff(bounds).max(initial=0))), len(hashed[0])
    one, two = (np.array(x) * n for x in zip(*pairs))
    pair = np.repeat(np.arange(len(pairs)), len(bounds) - 1)
    low, high = np.tile(bounds[:-1], len(pairs)), np.tile(bounds[1:], len(pairs))
    stop, left = high, np.zeros(len(low), bool)  # end of the text; reached by leaving out the left place
    out = []
    while True:
        wide = np.flatnonzero(high - low >= least)
        low, high, stop, left, pair = (x[wide] for x in (low, high, stop, left, pair))
        if not len(low):
            break
        i, j = one[pair], two[pair]
        first, second = minima.of(low + i, high + i), minima.of(low + j, high + j)
        again = np.flatnonzero(left & (high < stop))
        if len(again):
            a, b, i, j = low[again] - 1, high[again], i[again], j[again]
            twice = ((minima.ranked[a + i] < np.minimum(first[again], minima.ranked[b + i]))
                     | (minima.ranked[a + j] < np.minimum(second[again], minima.ranked[b + j])))
            keep = np.ones(len(low), bool)
            keep[again[twice]] = False
            low, high, stop, pair, first, second = (x[keep] for x in (low, high, stop, pair, first, second))
        c, d = (first & PLACE).astype(np.int64), (second & PLACE).astype(np.int64)
        out.append((pair, low, c, d, high - 1))
        left = np.repeat([False, True], len(c))
        low, high = np.concatenate([low, np.minimum(c, d) + 1]), np.concatenate([np.maximum(c, d), high])
        stop, pair = np.tile(stop, 2), np.tile(pair, 2)
    if not out:
        return (np.empty(0, np.int64),) * 5
    return tuple(np.concatenate(x) for x in zip(*out))


def compact_windows(values: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(l, c, r) of all windows of one function of at least ``least`` places, ``r`` inclusive; ties go to the left."""
    _, low, at, _, high = joint_windows([values], [(0, 0)], bounds, least)
    return low, at, high


def salts(key: np.ndarray, tid: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The salt of each window: of a hot key its text's highest bits, which ascend with the text, else 0."""
    return np.where(np.isin(key, hot), (tid >> 58) + SALTS // 2, 0)


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of (tid, text) cut into some ``TOGETHER`` bytes of text each; no text is cut."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // TOGETHER
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for low, high in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(low, high - low)


def _windows(hot: np.ndarray):
    """Windows of texts as rows of three numbers; those of a hot signature are salted by their text."""
    least = MIN_WORDS - SHINGLE + 1

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in together(batches):
            ids = batch.column(0).to_numpy()
            values, bounds = shingles([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()])
            if len(values) > BITS:
                raise ValueError(f"a batch of texts has {len(values)} shingles; at most {BITS} can be numbered")
            hashed = [scrambled(values + scrambled(np.array([n + 1], np.uint64))) for n in range(FUNCTIONS)]
            pair, l, c, d, r = joint_windows(hashed, PAIRED, bounds, least)
            table = np.stack(hashed)
            # Hashes of different functions differ, so the key tells the functions too.
            key = scrambled(table[ONE[pair], c] + scrambled(table[TWO[pair], d]))
            owner = np.searchsorted(bounds, c, "right") - 1
            base, tid = bounds[owner], ids[owner]
            place = l - base << L_AT | r - base
            # Sorted by one number: windows of a key and text lie side by side, by l.  In a text that repeats itself
            # most of them lie within the one before; one that other windows come between is kept.  Texts come one after
            # another, so that shuffled rows are alike and compress well.
            bits = max(len(ids).bit_length(), 1)
            text = owner.astype(np.uint64) << np.uint64(64 - bits)
            order = np.argsort(text | scrambled(key) >> np.uint64(bits + 24) << np.uint64(24)
                               | np.minimum(l - base, (1 << 24) - 1).astype(np.uint64))
            key, owner, tid, place, r = key[order], owner[order], tid[order], place[order], r[order]
            within = (key[1:] == key[:-1]) & (owner[1:] == owner[:-1]) & (r[1:] <= r[:-1])
            use = np.flatnonzero(np.append(True, ~within)[:len(key)])
            key, tid, place = key[use].view(np.int64), tid[use], place[use]
            place |= salts(key, tid, hot) << SALT_AT
            if len(key):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, tid, place)], ["key", "tid", "place"])
            tidy()

    return windows


def _dealt_windows(hot: np.ndarray, parts: int):
    """Windows of texts as blocks of columns (key, tid, salt, l, r), dealt by key and salt."""
    windows = _windows(hot)

    def dealt_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in windows(batches):
            key, tid, place = (c.to_numpy() for c in batch.columns)
            salt = place >> SALT_AT
            part = dealt.part_of(key ^ scrambled(salt.view(np.uint64) + np.uint64(1)).view(np.int64), parts)
            yield dealt.packed(part, [key, tid, salt, place >> L_AT & BITS, place & BITS])

    return dealt_windows


def _dealt_partners(hot: np.ndarray):
    """Partners of the windows that ``_dealt_windows`` made; only those of a hot key or of one that comes again are sorted."""
    partners = _partners(hot)

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, tid, salt, low, high in dealt.gathered(batches, 5):
            order = np.argsort(key)
            ranked = key[order]
            again = ranked[1:] == ranked[:-1]
            use = np.r_[False, again] | np.r_[again, False]
            known = np.zeros(len(key) + 1, np.int64)
            np.add.at(known, np.searchsorted(ranked, hot), 1)
            np.add.at(known, np.searchsorted(ranked, hot, "right"), -1)
            use = order[use | (np.cumsum(known)[:-1] > 0)]
            key, tid, place = key[use], tid[use], salt[use] << SALT_AT | low[use] << L_AT | high[use]
            order = np.lexsort((place, tid, key))
            yield pa.RecordBatch.from_arrays([pa.array(x[order]) for x in (key, tid, place)], ["key", "tid", "place"])

    def dealt_partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from partners(ordered(batches))
        tidy()

    return dealt_partners


def _partners(hot: np.ndarray):
    """Pair each window with the first text of its key and with the text before it.

    Rows are sorted by (key, tid, place), and so by salt and l too.  Of a hot key only the text before
    within the salt is known here; its windows are also given out open, with key
    and salt and without a partner.  Only three rows of a key are remembered,
    however many it has.  Pairs with the first text name their key, unless it has
    so few texts that all its pairs are given out.
    """
    names = ["tb", "ta", "lb", "rb", "la", "ra", "key", "salt"]

    def rows_of(tid, low, high, b, a=None, key=None, salt=None):
        none = pa.nulls(len(b), pa.int64())
        partner = (none, none, none) if a is None else (tid[a], low[a], high[a])
        columns = [tid[b], partner[0], low[b], high[b], *partner[1:], none if key is None else key, none if salt is None else salt[b]]
        kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.int64(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(x).cast(t) for x, t in zip(columns, kinds)], names)

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [c.to_numpy() for c in batch.columns]
            n_old = 0
            if carried is not None:
                n_old = len(carried[0])
                rows = [np.r_[a, b] for a, b in zip(carried, rows)]
            key, tid, at = rows
            salt, low, high = at >> SALT_AT, at >> L_AT & BITS, at & BITS
            place = np.arange(len(key))
            new_key = np.r_[True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])]
            new_tid = new_key | np.r_[True, tid[1:] != tid[:-1]]
            again = ~new_tid & np.r_[False, low[1:] == low[:-1]]  # a copy of the same text
            run = np.maximum.accumulate(np.where(new_key, place, 0))
            group = np.maximum.accumulate(np.where(new_tid, place, 0))
            before = np.where(group > run, np.r_[0, group[:-1]][group], run)  # first row of the text before
            fresh = ~again & (place >= n_old)
            wanted = fresh & (group > run)
            salted = np.isin(key, hot)
            # Runs that go on beyond this batch may have more texts.
            many = np.add.reduceat(new_tid.astype(np.int64), np.flatnonzero(new_key)) > ALL_PAIRED
            many[-1] = True
            many[0] |= n_old > 0
            many = many[np.cumsum(new_key) - 1]
            b = np.flatnonzero(wanted & ~salted)
            if len(b):
                yield rows_of(tid, low, high, b, run[b], pa.array(key[b], mask=~many[b]))
            b = np.flatnonzero(wanted & (salted | (before != run)))
            if len(b):
                yield rows_of(tid, low, high, b, before[b])
            b = np.flatnonzero(fresh & salted)
            if len(b):
                yield rows_of(tid, low, high, b, key=key[b], salt=salt)
            keep = np.unique([run[-1], before[-1], group[-1], len(key) - 1])
            carried = [x[keep] for x in rows]

    return partners


def hot_keys(docs: DataFrame) -> np.ndarray:
    """The hottest signatures of the sample, sorted.

    At most ``HOT_KEYS`` rows come to the driver.  Which keys are known decides
    how work is dealt out, not what is found; partners are not taken from the sample.
    """
    found = (
        docs.filter(F.pmod("tid", F.lit(SAMPLE_OF)) == 0).select("tid", "text")
        .mapInArrow(_windows(np.empty(0, np.int64)), WINDOWS).select("key", "tid").distinct()
        .groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= HOT_TEXTS).orderBy(F.desc("n"), "key").limit(HOT_KEYS).collect())
    return np.sort(np.array([r["key"] for r in found], np.int64))


def segments(match: np.ndarray, least: int, ratio: float) -> list[tuple[int, int]]:
    """Stretches [start, end) of at least ``least`` places, ``ratio`` of them matched, from and to a match.

    A stretch ends where the score is used up, so more than ``ratio`` of any beginning of one is matched, too.
    """
    edge = np.flatnonzero(np.diff(np.r_[0, match.astype(np.int8), 0]))
    cost = ratio / (1 - ratio) if ratio < 1 else np.inf
    out, start, score, best, best_end, last = [], -1, 0.0, 0.0, -1, 0
    for low, high in zip(edge[::2].tolist(), edge[1::2].tolist()):
        if start >= 0:
            score -= cost * (low - last)
            if score <= 0:
                if best_end - start >= least:
                    out.append((start, best_end))
                start = -1
        if start < 0:
            start, score, best, best_end = low, 0.0, 0.0, high
        score += high - low
        if score >= best:
            best, best_end = score, high
        last = high
    if start >= 0 and best_end - start >= least:
        out.append((start, best_end))
    return out


# Two stretches of one length have a Jaccard similarity of 0.8 if 8/9 of their shingles are shared.  A stretch
# that fails is cut by the next ratio; runs without a mismatch come last.
RATIOS = (2 * SIMILARITY / (1 + SIMILARITY), 0.95, 1.0)


def matches(parts_b: list[bytes], parts_a: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of shingle sequences, one after another: which places of b are in a, their bounds by pair, and the pairs
    that may be alike: those with as many matched places together as any stretch begins with."""
    least, keys = MIN_WORDS - SHINGLE + 1, []
    for parts in (parts_b, parts_a):
        sizes = np.array([len(x) // 4 for x in parts], np.int64)
        owner = np.repeat(np.arange(len(parts), dtype=np.uint64), sizes)
        keys.append(owner << np.uint64(32) | np.frombuffer(b"".join(parts), np.uint32))
        if parts is parts_b:
            bounds, of = np.r_[0, np.cumsum(sizes)], owner.astype(np.int64)
    b, a = keys[0], np.append(np.sort(keys[1]), np.uint64(2**64 - 1))
    match = a[np.searchsorted(a, b)] == b
    total = np.r_[0, np.cumsum(match)]
    n = max(len(b) - least + 1, 0)
    near = begins(total)[:n] & (of[:n] == of[least - 1:least - 1 + n])
    return match, bounds, np.unique(of[:n][near])


def begins(total: np.ndarray) -> np.ndarray:
    """Places where a stretch may begin, by the matches before each place along the last axis.

    Less than a ninth of any beginning of a stretch is not matched: none of nine places, one of 18 at most, and so on.
    """
    least = MIN_WORDS - SHINGLE + 1
    n = max(total.shape[-1] - least, 0)
    out = np.ones((*total.shape[:-1], n), bool)
    for size in range(NINE, least + 1, NINE):
        out &= total[..., size:size + n] - total[..., :n] > size - size // NINE
    return out


def ends(total: np.ndarray) -> np.ndarray:
    """Places from which a stretch's last places may go, by the matches before each place along the last axis.

    A stretch ends where its score is highest, so at most a ninth of any end of one is not matched.
    """
    least = MIN_WORDS - SHINGLE + 1
    n = max(total.shape[-1] - least, 0)
    out = np.ones((*total.shape[:-1], n), bool)
    for size in range(NINE, least + 1, NINE):
        out &= total[..., least:least + n] - total[..., least - size:least - size + n] >= size - size // NINE
    return out


def among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which numbers are among some that are sorted."""
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def compared(b: np.ndarray, a: np.ndarray, least: int, match: np.ndarray | None = None) -> list[tuple[int, int, int, int, float]]:
    """Near-duplicate stretches of two shingle sequences: bounds in b and in a, and their Jaccard similarity.

    ``match`` tells which places of b are in a, if that is known.
    """
    out = []
    todo = [(0, len(b), 0)]
    match = np.isin(b, a) if match is None else match
    while todo:
        begin, end, level = todo.pop()
        for low, high in segments(match[begin:end], least, RATIOS[level]):
            low, high = begin + low, begin + high
            own = np.unique(b[low:high])
            found = segments(among(a, own), 1, RATIOS[level])
            start, stop = max(found, key=lambda x: x[1] - x[0])
            other = np.unique(a[start:stop])
            same = int(among(other, own).sum())
            share = same / (len(own) + len(other) - same)
            if share >= SIMILARITY:
                out.append((low, high, start, stop, share))
            elif level + 1 < len(RATIOS):
                todo.append((low, high, level + 1))
    return out


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of the regions of a text, which is cut into shingles once; and a row with its number of words as the
    end of a region that begins at -1, if it has five or more."""
    names, kinds = ["tid", "lo", "hi", "part"], [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    for batch in batches:
        values, bounds = shingles([t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()])
        slim, rows, size = (values >> np.uint64(32)).astype(np.uint32), [[], [], [], []], 0
        for tid, regions, s, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
            low, high = ([x[k] for x in regions] for k in ("lo", "hi"))
            parts = [slim[s + a:min(s + b, e)].tobytes() for a, b in zip(low, high)]
            for column, some in zip(rows, ([tid] * (len(low) + 1), [*low, -1], [*high, e - s + SHINGLE - 1], [*parts, b""])):
                column += some
            size += sum(map(len, parts))
            if size > TOGETHER:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds)], names)
                rows, size = [[], [], [], []], 0
        if rows[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds)], names)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of pairs of regions; and once a batch, a row with each named key in whose window no link is found."""
    least = MIN_WORDS - SHINGLE + 1
    kinds = [pa.int64()] * 6 + [pa.float64(), pa.int64()]
    for batch in batches:
        rows = []
        tb, ta, lb, la = (c.to_numpy() for c in batch.columns[:4])
        parts_b, parts_a = (c.to_pylist() for c in batch.columns[4:6])
        keys = batch.column(6)
        first = keys.offsets.to_numpy()
        names, low, high = (x.to_numpy() for x in keys.values.flatten())
        missed = np.zeros(len(names), bool)
        missed[first[0]:first[-1]] = True
        match, bounds, likely = matches(parts_b, parts_a)
        for i in likely.tolist():
            found = compared(np.frombuffer(parts_b[i], np.uint32), np.frombuffer(parts_a[i], np.uint32), least,
                             match[bounds[i]:bounds[i + 1]])
            t, u, at, other = (int(x[i]) for x in (tb, ta, lb, la))
            own = slice(first[i], first[i + 1])
            for s, e, v, w, j in found:
                rows.append((t, u, at + s, at + e + SHINGLE - 1, other + v, other + w + SHINGLE - 1, j, None))
                missed[own] &= np.minimum(high[own] + 1, at + e) - np.maximum(low[own], at + s) < least
        missing, at = np.unique(names[missed], return_index=True)
        pair = np.searchsorted(first, np.flatnonzero(missed)[at], "right") - 1
        rows += [(t, u, *[None] * 5, k) for t, u, k in zip(tb[pair].tolist(), ta[pair].tolist(), missing.tolist())]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], [*LINK, "key"])


def _merged(parts: int):
    """The stretches of a text that its slices make up, and the partition that they go to."""
    names = ["tid", "lo", "hi", "part", "owner", "to"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int32()]

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            to = dealt.part_of(batch.column(0).to_numpy(), parts).tolist()
            for tid, slices, owner, part in zip(*(c.to_pylist() for c in batch.columns), to):
                slices = [(x["lo"], np.frombuffer(x["part"], np.uint32)) for x in slices]
                size = max(lo + len(x) for lo, x in slices)
                values, used = np.zeros(size, np.uint32), np.zeros(size + 2, np.int8)
                for lo, x in slices:
                    values[lo:lo + len(x)] = x
                    used[lo + 1:lo + len(x) + 1] = 1
                edge = np.flatnonzero(np.diff(used)).tolist()
                rows += [(tid, a, b, values[a:b].tobytes(), owner, part) for a, b in zip(edge[::2], edge[1::2])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

    return merged


def rarest(size: int, at: np.ndarray, shared: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices of places, of a stretch of ``size``, one of which any stretch of another text that is alike must have.

    ``at`` are the places whose shingles others have, too.  The first nine places of an alike stretch are all matched, so
    the rarest of them is.
    """
    match, rank = np.zeros(size, bool), np.full(size, len(at))
    match[at] = True
    chosen, found = np.zeros(size, bool), segments(match, MIN_WORDS - SHINGLE + 1, RATIOS[0])
    if found:
        rank[at[np.lexsort((shared, count))]] = np.arange(len(at))
        first = begins(np.r_[0, np.cumsum(match)])
    for low, high in found:
        some = low + np.flatnonzero(first[low:high - MIN_WORDS + SHINGLE])
        chosen[some + np.lib.stride_tricks.sliding_window_view(rank, NINE)[some].argmin(1)] = True
    return np.flatnonzero(chosen[at])


def in_common(match: np.ndarray, values: np.ndarray) -> tuple[int, int]:
    """Of shingles of which others have those of ``match``: how many different ones a stretch of another text must at least
    have in common with one of these to be alike, and the most that a stretch of these can have in common with others."""
    least, need = MIN_WORDS - SHINGLE + 1, len(values)
    found, most = segments(match, 1, RATIOS[0]), 0
    for low, high in sorted(found, key=lambda x: x[0] - x[1]):
        if high - low <= most:
            break
        most = max(most, len(np.unique(values[low:high][match[low:high]])))
    found = [(low, high) for low, high in found if high - low >= least]
    if not found:
        return need, most
    first = begins(np.r_[0, np.cumsum(match)])
    order = np.argsort(values, kind="stable")
    again = order[1:][(values[order[1:]] == values[order[:-1]]) & (order[1:] - order[:-1] < least)]
    for low, high in found:
        distinct = least
        if ((again >= low) & (again < high)).any():
            some = low + np.flatnonzero(first[low:high - least + 1])
            distinct = min((len(np.unique(values[i:i + least])) for i in some.tolist()), default=least)
        need = min(need, int(np.ceil(SIMILARITY * distinct - 1e-9)))
    return need, most


def _dealt_shingles(parts: int):
    """The different shingles of stretches as blocks of columns (shingle, tid, lo, owner), dealt by shingle."""

    def dealt_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = [np.unique(np.frombuffer(x, np.uint32)) for x in batch.column(3).to_pylist()]
            of = np.repeat(np.arange(len(values)), [len(x) for x in values])
            s = np.concatenate(values).astype(np.int64)
            tid, lo, owner = (batch.column(i).to_numpy().astype(np.int64)[of] for i in (0, 1, 4))
            yield dealt.packed(dealt.part_of(s, parts), [s, tid, lo, owner])

    return dealt_shingles


def _dealt_shared(parts: int):
    """Shingles that stretches of several owners have, with the number of stretches, dealt by text."""

    def dealt_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, tid, lo, owner in dealt.gathered(batches, 4):
            order = np.argsort(s)
            s, tid, lo, owner = (x[order] for x in (s, tid, lo, owner))
            at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            size = np.diff(np.append(at, len(s)))
            several = np.repeat(np.minimum.reduceat(owner, at) != np.maximum.reduceat(owner, at), size)
            if several.any():
                tid = tid[several]
                yield dealt.packed(dealt.part_of(tid, parts), [tid, lo[several], s[several], np.repeat(size, size)[several]])

    return dealt_shared


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches with what is needed to find others that may be alike, from stretches and blocks of shared shingles."""
    stretches, blocks = {}, []
    for batch in batches:
        kind = batch.column(0).is_valid()
        for x in batch.filter(kind).select(list(range(5))).to_pylist():
            stretches.setdefault(x["tid"], []).append(x)
        blocks.append(batch.filter(pc.invert(kind)).select(list(range(5, 11))))
    for rows in dealt.gathered(iter(blocks), 4):
        order = np.lexsort((rows[2], rows[1], rows[0]))
        tid, lo, s, n = (x[order] for x in rows)
        first = np.r_[True, (tid[1:] != tid[:-1]) | (lo[1:] != lo[:-1])]
        bounds = np.append(np.flatnonzero(first), len(tid)).tolist()
        found = []
        for a, b in zip(bounds[:-1], bounds[1:]):
            x = next(x for x in stretches[int(tid[a])] if x["lo"] == lo[a])
            values = np.frombuffer(x["part"], np.uint32).astype(np.int64)
            where = np.minimum(np.searchsorted(s[a:b], values), b - a - 1)
            match = s[a:b][where] == values
            at = np.flatnonzero(match)
            use = at[rarest(len(values), at, values[at], n[a:b][where[at]])]
            need, most = in_common(match, values)
            names = (np.unique(values[use]), s[a:b])
            found.append((*x.values(), need, most, int(s[a:b][n[a:b].argmax()]), *(x.astype(np.uint32).tobytes() for x in names)))
            if len(found) == 256 or b == len(tid):
                yield pa.RecordBatch.from_arrays([pa.array(x, k.type) for x, k in zip(zip(*found), KEYED_AS)], schema=KEYED_AS)
                found = []
    tidy()


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each of the shingles in the first column, with the other columns."""
    for batch in batches:
        parts = batch.column(0).to_pylist()
        s = np.frombuffer(b"".join(parts), np.uint32).astype(np.int64)
        of = np.repeat(np.arange(len(parts)), [len(x) // 4 for x in parts])
        for low in range(0, len(s), 1 << 16):
            some = pa.array(of[low:low + (1 << 16)])
            yield pa.RecordBatch.from_arrays([pa.array(s[low:low + (1 << 16)]), *(x.take(some) for x in batch.columns[1:])],
                                             ["s", *batch.schema.names[1:]])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the stretches that meet a group of others; the group's rows come first."""
    least, group, members, index, waiting = MIN_WORDS - SHINGLE + 1, None, [], None, []

    def links() -> list[tuple]:
        nonlocal index, waiting
        if not waiting:
            return []
        if index is None:
            parts = [np.unique(x[3]) for x in members]
            names = np.concatenate(parts)
            order = np.argsort(names, kind="stable")
            index = names[order], np.repeat(np.arange(len(parts)), [len(x) for x in parts])[order]
        tid, owner, ids, owners = (np.array([x[k] for x in some], np.int64) for some in (waiting, members) for k in (0, 2))
        use = (ids < tid[:, None]) & (owners != owner[:, None])
        out = []
        for i, k, match in alike([x[3] for x in waiting], *index, use):
            text, lo, _, b = waiting[i]
            other, start, _, a = members[k]
            out += [(text, other, lo + s, lo + e + SHINGLE - 1, start + v, start + w + SHINGLE - 1, j, None)
                    for s, e, v, w, j in compared(b, a, least, match)]
        waiting = []
        return out

    kinds = [pa.int64()] * 6 + [pa.float64(), pa.int64()]
    for batch in batches:
        rows, cells = [], 0
        for at, first, *row, part in zip(*(c.to_pylist() for c in batch.columns)):
            if at != group:
                rows += links()
                group, members, index, cells = at, [], None, 0
            (members if first else waiting).append((*row, np.frombuffer(part, np.uint32)))
            if not first:
                cells += len(part) // 4 * len(members)
                if cells > CELLS:
                    rows += links()
                    cells = 0
        rows += links()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], [*LINK, "key"])
    tidy()


def alike(parts: list[np.ndarray], names: np.ndarray, of: np.ndarray, use: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Of the pairs in ``use`` of sequences and members of a group those that may share a stretch, and which places of
    the sequence are in the member.

    ``names`` are the different shingles of each member, sorted, and ``of`` tells whose they are.  Members are taken in turns,
    so that at most ``CELLS`` places, or those of one member, are held.
    """
    least, size = MIN_WORDS - SHINGLE + 1, use.shape[1]
    sizes = np.array([len(x) for x in parts], np.int64)
    b, step = np.concatenate(parts), max(CELLS // max(int(sizes.sum()), 1), 1)
    of_b, place_b = np.repeat(np.arange(len(parts)), sizes), np.arange(len(b)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    for begin in range(0, size, step):
        turn = (of >= begin) & (of < begin + step) if step < size else slice(None)
        a, whose = names[turn], of[turn]
        low = np.searchsorted(a, b)
        count = np.searchsorted(a, b, "right") - low
        at = np.repeat(np.arange(len(b)), count)
        pair = of_b[at] * size + whose[np.arange(len(at)) + np.repeat(low - np.cumsum(count) + count, count)]
        some = np.flatnonzero((np.bincount(pair, minlength=use.size) >= SHARED) & use.ravel())
        if not len(some):
            continue
        # The places of all pairs that are left, one pair after another.
        rank = np.full(use.size, -1)
        rank[some] = np.arange(len(some))
        row, length = rank[pair], sizes[some // size]
        start = np.cumsum(length) - length
        match = np.zeros(int(length.sum()), bool)
        match[start[row[row >= 0]] + place_b[at[row >= 0]]] = True
        total, owner = np.r_[0, np.cumsum(match)], np.repeat(np.arange(len(some)), length)
        whole = owner[least - 1:] == owner[:max(len(owner) - least + 1, 0)]
        first, last = (np.flatnonzero(x(total) & whole) for x in (begins, ends))
        earliest, latest = np.full(len(some), len(match)), np.full(len(some), -1)
        np.minimum.at(earliest, owner[first], first)
        np.maximum.at(latest, owner[last], last)
        for i in np.flatnonzero(earliest <= latest).tolist():
            yield int(some[i] // size), int(some[i] % size), match[start[i]:start[i] + length[i]]


def closed(opened: DataFrame) -> DataFrame:
    """Pairs of open windows of hot keys with the first text of the key, and of the first text of a salt with the last
    text of the salt before."""
    ends = opened.groupBy("key", "salt").agg(
        F.min(F.struct("tb", "lb", "rb")).alias("first"),
        F.max(F.struct("tb", (-F.col("lb")).alias("lb"), "rb")).alias("last"))
    # At most one row per salt.
    by_key = Window.partitionBy("key").orderBy("salt")
    ends = ends.select("key", "salt", F.col("first.tb").alias("_start"), F.first("first").over(by_key).alias("_first"),
                       F.lag("last").over(by_key).alias("_last"))
    last = F.struct("_last.tb", (-F.col("_last.lb")).alias("lb"), "_last.rb")
    partners = F.array("_first", F.when(F.col("tb") == F.col("_start"), F.when(F.col("_last").isNotNull(), last)))
    return (
        opened.select("tb", "lb", "rb", "key", "salt").join(ends, ["key", "salt"])
        .select("tb", "lb", "rb", "key", F.posexplode(partners).alias("_i", "_p"))
        .filter(F.col("_p").isNotNull() & (F.col("tb") != F.col("_p.tb")))
        .select("tb", F.col("_p.tb").alias("ta"), "lb", "rb", F.col("_p.lb").alias("la"), F.col("_p.rb").alias("ra"),
                F.when(F.col("_i") == 0, F.col("key")).alias("key")))


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Regions of all pairs of windows of a partition, widened; windows of two texts that overlap or touch make one."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    tb, ta, lb, rb, la, ra = (table.column(i).to_numpy().astype(np.int64) for i in range(6))
    named = table.column(6).is_valid().to_numpy()
    key = pc.fill_null(table.column(6), 0).to_numpy()
    order = np.lexsort((la, rb, lb, ta, tb))
    tb, ta, lb, rb, la, ra, named, key = (x[order] for x in (tb, ta, lb, rb, la, ra, named, key))
    fresh = np.r_[True, (tb[1:] != tb[:-1]) | (ta[1:] != ta[:-1])]
    base = np.cumsum(fresh) << 32
    reach = np.maximum.accumulate(base + rb) - base
    first = fresh | np.r_[True, lb[1:] > reach[:-1] + 1]
    at, region = np.flatnonzero(first), np.cumsum(first) - 1
    wide = [np.minimum.reduceat(lb, at) // GRID * GRID, -(-(np.maximum.reduceat(rb, at) + 1) // GRID) * GRID,
            np.minimum.reduceat(la, at) // GRID * GRID, -(-(np.maximum.reduceat(ra, at) + 1) // GRID) * GRID]
    # Regions that are the same when they are widened are one.
    columns = [tb[at], ta[at], *wide]
    order = np.lexsort(columns[::-1])
    columns = [x[order] for x in columns]
    first = np.r_[True, np.any([x[1:] != x[:-1] for x in columns], axis=0)]
    group = np.empty(len(at), np.int64)
    group[order] = np.cumsum(first) - 1
    columns = [x[first] for x in columns]
    some = np.flatnonzero(named)
    owner = group[region[some]]
    some = some[np.argsort(owner, kind="stable")]
    bounds = np.searchsorted(np.sort(owner), np.arange(len(columns[0]) + 1)).astype(np.int32)
    keys = pa.StructArray.from_arrays([pa.array(key[some]), pa.array(lb[some], pa.int32()), pa.array(rb[some], pa.int32())],
                                      ["key", "lb", "rb"])
    kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
    out = pa.RecordBatch.from_arrays(
        [*(pa.array(x, k) for x, k in zip(columns, kinds)), pa.ListArray.from_arrays(pa.array(bounds), keys)],
        ["tb", "ta", "lb", "rb", "la", "ra", "keys"])
    for low in range(0, out.num_rows, 1 << 14):
        yield out.slice(low, 1 << 14)
    tidy()


def candidates(docs: DataFrame) -> DataFrame:
    """Regions (tb, ta, lb, rb, la, ra, keys) of two texts where windows of a joint key meet; docs has (tid, text).

    Regions are widened to multiples of ``GRID``, with exclusive ends.  ``keys`` are the joint keys with windows (key, lb, rb)
    of tb of which ta is the first text.
    """
    parts = shuffle_partitions(docs.sparkSession)
    hot = hot_keys(docs)
    windows = docs.select("tid", "text").mapInArrow(_dealt_windows(hot, parts), dealt.schema(5))
    pairs = dealt.shuffled(windows).mapInArrow(_dealt_partners(hot), PAIRS)
    if len(hot):
        pairs = stored(pairs)  # read twice
        opened = pairs.filter("ta IS NULL")
        pairs = pairs.filter("ta IS NOT NULL").drop("salt").unionByName(closed(opened))
    return pairs.select("tb", "ta", "lb", "rb", "la", "ra", "key").repartition(parts, "tb", "ta").mapInArrow(_regions, REGIONS)


def verified(regions: DataFrame, pieces: DataFrame) -> DataFrame:
    """Links of the regions (tb, ta, lb, rb, la, ra, keys), and the keys without one; pieces has (tid, lo, hi, part)."""
    for side in "ba":
        regions = regions.join(
            pieces.select(F.col("tid").alias(f"t{side}"), F.col("lo").alias(f"l{side}"), F.col("hi").alias(f"r{side}"),
                          F.col("part").alias(f"part_{side}")), [f"t{side}", f"l{side}", f"r{side}"])
    return stored(regions.select("tb", "ta", "lb", "la", "part_b", "part_a", "keys").mapInArrow(_verified, VERIFIED))


def open_links(regions: DataFrame, pieces: DataFrame, found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Verified links between texts of different components, of keys whose texts do not all agree with the first one.

    Stretches of such keys are compared with all stretches of other components but those that cannot be alike.
    ``found`` are the verified rows and ``nodes`` the components so far.
    """
    parts = shuffle_partitions(regions.sparkSession)
    nodes = nodes.withColumnRenamed("node", "tid")
    owner = F.coalesce("root", "tid")
    keys = found.filter("key IS NOT NULL").select("key").distinct()
    windows = stored(regions.filter(F.size("keys") > 0).select(
        "tb", "ta", "lb", "rb", "la", "ra", F.explode("keys.key").alias("key")).distinct().join(keys, "key", "left_semi"))
    texts = windows.select("key", F.col("tb").alias("tid")).unionByName(windows.select("key", F.col("ta").alias("tid"))).distinct()
    keys = texts.join(nodes, "tid", "left").groupBy("key").agg(F.min(owner).alias("_a"), F.max(owner).alias("_b"))
    windows = windows.join(stored(keys.filter("_a != _b").select("key")), "key", "left_semi")
    spans = windows.select(F.col("tb").alias("tid"), F.col("lb").alias("lo"), F.col("rb").alias("hi")).unionByName(
        windows.select(F.col("ta").alias("tid"), F.col("la").alias("lo"), F.col("ra").alias("hi"))).distinct()
    slices = pieces.join(spans, ["tid", "lo", "hi"]).groupBy("tid").agg(F.collect_list(F.struct("lo", "part")).alias("slices"))
    stretches = stored(
        slices.join(nodes, "tid", "left").select("tid", "slices", owner.alias("owner"))
        .mapInArrow(_merged(parts), "tid bigint, lo int, hi int, part binary, owner bigint, to int"))
    shingled = stretches.mapInArrow(_dealt_shingles(parts), dealt.schema(4))
    shared = dealt.shuffled(shingled).mapInArrow(_dealt_shared(parts), dealt.schema(4)).withColumnRenamed("part", "to")
    both = stretches.unionByName(shared, allowMissingColumns=True)
    keyed = stored(dealt.shuffled(both, "to").mapInArrow(_keyed, KEYED))
    # The least frequent shingles of stretches meet groups of stretches that have them.
    rare = keyed.filter(F.length("rare") > 0).select("rare", "tid", "lo", "owner", "need").mapInArrow(
        _listed, "s bigint, tid bigint, lo int, owner bigint, need int")
    least = rare.agg(F.min("need")).first()[0]
    members = keyed.filter(F.col("most") >= F.lit(least))
    sizes = members.groupBy("common").agg(F.ceil(F.sum(F.length("part")) / GROUP).alias("_n"))
    group = F.xxhash64("common", F.pmod(F.xxhash64("tid", "lo"), "_n")).alias("at")
    members = stored(members.join(sizes, "common").select(group, "tid", "lo", "owner", "part", "most", "shared"))
    asked = rare.groupBy("s").agg(F.min("need").alias("_need"))
    groups = (
        members.select("shared", "at", "tid", "owner", "most").mapInArrow(
            _listed, "s bigint, at bigint, tid bigint, owner bigint, most int")
        .join(asked, "s").filter("most >= _need").groupBy("s", "at")
        .agg(F.max("most").alias("most"), F.min("tid").alias("_first"), F.min("owner").alias("_a"), F.max("owner").alias("_b")))
    meets = rare.join(groups, "s").filter("most >= need AND tid > _first AND (_a != owner OR _b != owner)").select(
        "at", "tid", "lo").distinct()
    meets = stored(meets)
    columns = ["at", "first", "tid", "lo", "owner", "part"]
    rows = members.join(meets.select("at").distinct(), "at", "left_semi").withColumn("first", F.lit(True)).select(columns).unionByName(
        meets.join(keyed, ["tid", "lo"]).withColumn("first", F.lit(False)).select(columns))
    met = rows.repartition(parts, "at").sortWithinPartitions("at", F.desc("first"))
    return stored(met.mapInArrow(_met, VERIFIED)).select(LINK)


def joined(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, root) of the nodes so far and further links."""
    edges = links.select("tb", "ta").distinct()
    for side in "ba":
        edges = edges.join(nodes.select(F.col("node").alias(f"t{side}"), F.col("root").alias(f"_{side}")), f"t{side}", "left")
    roots = stored(components(edges.select(F.coalesce("_b", "tb").alias("a"), F.coalesce("_a", "ta").alias("b"))))
    return stored(
        nodes.join(roots.select(F.col("node").alias("root"), F.col("root").alias("_root")), "root", "left")
        .select("node", F.coalesce("_root", "root").alias("root")).unionByName(roots).distinct())


def without_detours(links: DataFrame) -> DataFrame:
    """One row for each link of a stretch to its first and its last partner, and to others that do not have the same first
    one; the others are named in ``also`` beside the first partner.

    A link in ``also`` joins two stretches that are both linked to one third.
    """
    stretch = Window.partitionBy("tb", "start", "end")
    marked = links.withColumns({"_first": F.min("ta").over(stretch), "_last": F.max("ta").over(stretch)})
    own = (F.col("ta") == F.col("_first")) | (F.col("ta") == F.col("_last"))
    firsts = links.groupBy("tb", "start", "end").agg(F.min("ta").alias("_other")).withColumnsRenamed(
        {"tb": "ta", "start": "partner_start", "end": "partner_end"})
    others = marked.filter(~own).join(firsts, ["ta", "partner_start", "partner_end"], "left").withColumn(
        "_implied", F.col("_other").eqNullSafe(F.col("_first")))
    also = others.filter("_implied").groupBy("tb", "start", "end", F.col("_first").alias("ta")).agg(
        F.array_sort(F.collect_set(F.struct("partner_id", "partner_start", "partner_end", "similarity"))).alias("also"))
    return marked.filter(own).select(links.columns).unionByName(others.filter("NOT _implied").select(links.columns)).join(
        also, ["tb", "ta", "start", "end"], "left")


def repeated_passages(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Links between documents that share a passage of at least ``MIN_WORDS`` words, or a near copy of one, with classes.

    Rows (key, partner_id, start_word, end_word, partner_start, partner_end,
    similarity, also, class_id); ends are exclusive.  ``class_id`` is the smallest
    id that links reach, over all texts that share a joint key and a passage.
    Each text with a shared passage is linked to the first text that has it and to
    the one before it, in the order of text hashes, so links connect all texts
    that share a passage and grow with the input, not with pairs; texts
    of different classes of a key are compared with all others of it.  A passage may
    have no row if its texts are of one class by others.  ``also`` holds
    further links of the row's passage, (partner_id, partner_start, partner_end,
    similarity), which the rows imply.  A text stands under its smallest id; its
    exact copies are linked to that id over all their words.  Null texts and texts
    that are too short have no links.
    """
    small_batches(docs)
    rows = docs.select(column(docs, key).cast("long").alias("doc_id"), text_column(docs, text).alias("text")).withColumn(
        "tid", F.xxhash64("text"))
    owners = stored(rows.select("doc_id", "tid"))
    # Stored, so that joins with texts that have very many partners can be split.
    first = stored(owners.groupBy("tid").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    regions = stored(candidates(rows))
    needs = regions.select(F.col("tb").alias("tid"), F.col("lb").alias("lo"), F.col("rb").alias("hi")).unionByName(
        regions.select(F.col("ta").alias("tid"), F.col("la").alias("lo"), F.col("ra").alias("hi"))).distinct()
    # One document of each text that has regions or copies.
    needs = needs.groupBy("tid").agg(F.collect_list(F.struct("lo", "hi")).alias("regions"))
    none = F.array().cast("array<struct<lo:int,hi:int>>")
    needs = stored(first.join(needs, "tid", "left").filter((F.col("n") > 1) | F.col("regions").isNotNull()).select(
        "tid", F.coalesce("regions", none).alias("regions"), F.col("first").alias("_first")))
    one = rows.join(needs, "tid").filter(F.col("doc_id").eqNullSafe(F.col("_first")))
    pieces = stored(
        one.select("tid", "regions", "text").mapInArrow(_sliced, "tid bigint, lo int, hi int, part binary")
        .dropDuplicates(["tid", "lo", "hi"]))
    found = verified(regions, pieces)
    links = found.filter("key IS NULL").select(LINK)
    nodes = stored(components(links.select(F.col("tb").alias("a"), F.col("ta").alias("b"))))
    if not found.filter("key IS NOT NULL").isEmpty():
        again = open_links(regions, pieces, found, nodes)
        links, nodes = links.unionByName(again), joined(nodes, again)
    roots = nodes.join(first.select(F.col("tid").alias("node"), "first"), "node")
    roots = roots.join(roots.groupBy("root").agg(F.min("first").alias("class_id")), "root")
    names = stored(first.join(roots.select(F.col("node").alias("tid"), "class_id"), "tid", "left").select(
        "tid", "first", F.coalesce("class_id", "first").alias("class_id")))
    links = without_detours(stored(
        links.distinct().join(names.withColumnsRenamed({"tid": "tb", "first": "doc_id"}), "tb")
        .join(names.select(F.col("tid").alias("ta"), F.col("first").alias("partner_id")), "ta")))
    words = pieces.filter("lo < 0").select("tid", F.col("hi").alias("n_words")).filter(F.col("n_words") >= MIN_WORDS)
    copies = owners.join(first.filter("n > 1").select("tid"), "tid").join(names, "tid").filter(
        ~F.col("doc_id").eqNullSafe(F.col("first"))).join(words, "tid")
    columns = ["partner_id", "start_word", "end_word", "partner_start", "partner_end", "similarity"]
    length = F.col("n_words").cast("long")
    also = "array<struct<partner_id:bigint,partner_start:bigint,partner_end:bigint,similarity:double>>"
    none = F.array().cast(also)
    return (
        links.withColumnsRenamed({"start": "start_word", "end": "end_word"}).select(
            "doc_id", *columns, F.coalesce("also", none).alias("also"), "class_id").distinct()
        .unionByName(copies.select(
            "doc_id", F.col("first").alias("partner_id"), F.lit(0).cast("long").alias("start_word"), length.alias("end_word"),
            F.lit(0).cast("long").alias("partner_start"), length.alias("partner_end"), F.lit(1.0).alias("similarity"),
            none.alias("also"), "class_id"))
        .withColumnRenamed("doc_id", key))
