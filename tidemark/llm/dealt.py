"""Rows of numbers that are shuffled as blocks of bytes.

A task makes one row for each part of its batch that goes to one partition, with a
block of bytes a column.  So Spark moves and serializes few rows, and numpy sorts
those of a partition at once.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import shuffle_partitions

# Rows of a partition that are held at once; more of them go to temporary files by their first column.
HELD, FILES = 1 << 23, 64


def scrambled(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def part_of(x: np.ndarray, parts: int) -> np.ndarray:
    """The partition of each of the 64-bit numbers."""
    return (scrambled(x.view(np.uint64)) % np.uint64(parts)).astype(np.int32)


def schema(columns: int) -> str:
    return ", ".join(["part int", "n int", *(f"c{i} binary" for i in range(columns))])


def packed(part: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """One row for each of the partitions ``part``, with its rows of the columns of int64 as bytes.

    Of a column without negative numbers only the bytes in use are kept: one, two, four or eight.
    """
    order = np.argsort(part.astype(np.uint16) if part.max(initial=0) < 1 << 16 else part, kind="stable")
    ordered = part[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])[:len(ordered)]
    bounds = np.append(first, len(ordered))
    out = [pa.array(ordered[first], pa.int32()), pa.array(np.diff(bounds), pa.int32())]
    for x in columns:
        kind = np.int64 if x.min(initial=0) < 0 else np.min_scalar_type(int(x.max(initial=0)))
        data = x.astype(kind)[order]
        ends = (bounds * data.itemsize).astype(np.int32)
        out.append(pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(data)]))
    return pa.RecordBatch.from_arrays(out, ["part", "n", *(f"c{i}" for i in range(len(columns)))])


def shuffled(frame: DataFrame, part: str = "part") -> DataFrame:
    """Each row at the partition that its ``part`` names."""
    return frame.repartitionById(shuffle_partitions(frame.sparkSession), part)


def unpacked(sizes: list[int], columns: list[list[bytes]]) -> list[np.ndarray]:
    """The columns of int64 of some rows that ``packed`` made."""
    out = []
    for column in columns:
        parts = [np.frombuffer(x, np.int64 if len(x) == 8 * n else f"u{len(x) // n}") for n, x in zip(sizes, column)]
        out.append(np.concatenate([x.astype(np.int64, copy=False) for x in parts]) if parts else np.empty(0, np.int64))
    return out


def gathered(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[list[np.ndarray]]:
    """The columns of a partition's rows; if they are many, in several turns, each with all rows of its first numbers."""
    sizes, held, n, files = [], [[] for _ in range(columns)], 0, []

    def put():
        rows = unpacked(sizes, held)
        where = scrambled(rows[0].view(np.uint64)) >> np.uint64(58)
        order = np.argsort(where, kind="stable")
        table = np.stack(rows, 1)[order]
        bounds = np.searchsorted(where[order], np.arange(FILES + 1))
        for file, low, high in zip(files, bounds[:-1], bounds[1:]):
            file.write(table[low:high].tobytes())
        sizes.clear()
        for x in held:
            x.clear()

    try:
        for batch in batches:
            some = batch.column(1).to_pylist()
            sizes += some
            for x, column in zip(held, batch.columns[2:]):
                x += column.to_pylist()
            n += sum(some)
            if n > HELD:
                files = files or [tempfile.TemporaryFile() for _ in range(FILES)]
                put()
                n = 0
        if not files:
            if n:
                rows = unpacked(sizes, held)
                sizes.clear()
                for x in held:
                    x.clear()
                yield rows
            return
        if n:
            put()
        for file in files:
            file.seek(0)
            table = np.frombuffer(file.read(), np.int64).reshape(-1, columns)
            if len(table):
                yield [np.ascontiguousarray(x) for x in table.T]
    finally:
        for file in files:
            file.close()
