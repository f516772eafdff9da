"""Packing of tokenised documents into fixed windows by best-fit decreasing (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cuts, small_batches, tidy, utf8_column, written
from .tokens import word_ids

#: Ids that are packed together at most; bounds a task's memory.
GROUP_IDS = 2 << 20
#: Pieces of windows less full than this are packed once more, over all partitions.
CLOSED = 0.99

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """Open windows by remaining capacity; a segment tree of counts finds the tightest that fits."""

    def __init__(self, width: int):
        self.leaves = 1 << (width + 1 - 1).bit_length()
        if self.leaves <= width:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(width + 1)]

    def _add(self, capacity: int, by: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, window: int, capacity: int) -> None:
        if capacity > 0:
            self.open[capacity].append(window)
            self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The open window with the least capacity of at least ``need``, and that capacity."""
        count, i = self.count, need + self.leaves
        if not count[i]:
            # Up to the first ancestor with windows right of here, then down its leftmost path.
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        self._add(capacity, -1)
        return self.open[capacity].pop(), capacity


def best_fit_decreasing(lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Window and offset of each piece (1 to ``width`` long), and the number of windows.

    Longest pieces first, equal ones in their order; each goes to the tightest window it fits.
    """
    tree, windows = CapacityTree(width), 0
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        found = tree.take(need) if need < width else None
        if found is None:
            found, windows = (windows, width), windows + 1
        window[k], offset[k] = found[0], width - found[1]
        tree.put(found[0], found[1] - need)
    return window, offset, windows


_SCHEMA = SCHEMA + ", closed boolean"


def pack(docs: DataFrame, tokenizer_path: str, width: int = 2048) -> DataFrame:
    """Pieces of all documents, packed into windows of ``width`` ids.

    Takes ``doc_id`` and ``text``; other columns are not read. A document longer than ``width`` is
    cut into full windows and a rest. A null or empty text is its end id alone; a null doc_id stays
    null; repeated rows are packed each for itself; ties in length keep their order; no rows give
    no pieces. Each input partition is packed by itself in groups of at most GROUP_IDS ids; only the
    pieces of windows that stay less than CLOSED full, a few for each group, are shuffled and packed
    again together, so padding does not grow with the number of partitions. ``ids`` holds the
    piece's ids as little-endian 32-bit numbers. ``sequence_id`` is unique, not gapless.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_ids(tokenizer_path)
        base = TaskContext.get().partitionId() << 33
        held, n = [], 0
        for b in batches:
            ids, offs = table.encode(*utf8_column(b.column(1)))
            for i, j in _cuts(offs, GROUP_IDS):
                if held and n + offs[j] - offs[i] > GROUP_IDS:
                    out, base = _packed(held, width, base)
                    held, n = [], 0
                    yield from out
                held.append((b.column(0).slice(i, j - i), ids[offs[i]:offs[j]], offs[i:j + 1] - offs[i]))
                n += offs[j] - offs[i]
        if held:
            yield from _packed(held, width, base)[0]

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (1 << 62) + (TaskContext.get().partitionId() << 33)
        held, n = [], 0
        for b in batches:
            for i, j in _cuts(np.concatenate([[0], np.cumsum(b.column(2).to_numpy())]), GROUP_IDS):
                part = b.slice(i, j - i)
                size = int(part.column(2).to_numpy().sum())
                if held and n + size > GROUP_IDS:
                    out, base = _repacked(held, width, base)
                    held, n = [], 0
                    yield from out
                held.append(part)
                n += size
        if held:
            yield from _repacked(held, width, base)[0]

    small_batches(docs.sparkSession)
    pieces = written(docs.select("doc_id", "text").mapInArrow(tidy(first), _SCHEMA), "pieces", compression="zstd")
    left = pieces.filter("NOT closed").drop("closed")
    groups = max(1, -(-(left.agg(F.sum("length")).first()[0] or 0) // GROUP_IDS))
    return pieces.filter("closed").drop("closed").unionByName(left.repartition(groups).mapInArrow(tidy(again), SCHEMA))


def _cuts(offs: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(offs) - 1:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j
        i = j


def _packed(held: list, width: int, base: int) -> tuple[Iterator[pa.RecordBatch], int]:
    doc = pa.concat_arrays([h[0] for h in held]).cast(pa.int64())
    ids = np.concatenate([h[1] for h in held])
    tokens = np.concatenate([np.diff(h[2]) for h in held])
    first = np.cumsum(tokens) - tokens
    pieces = -(-tokens // width)
    row = np.repeat(np.arange(len(tokens)), pieces)
    start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * width
    length = np.minimum(width, tokens[row] - start)
    window, offset, windows = best_fit_decreasing(length, width)
    closed = (np.bincount(window, weights=length, minlength=windows) >= CLOSED * width)[window]
    at = first[row] + start
    raw = ids.astype("<u4", copy=False).view(np.uint8)
    step = 512

    def batch(k: slice) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            doc.take(pa.array(row[k])), pa.array(start[k]), pa.array(length[k]),
            cuts(raw, 4 * at[k], 4 * (at[k] + length[k])),
            pa.array(tokens[row[k]]), pa.array(base + window[k]), pa.array(offset[k]), pa.array(closed[k])],
            names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "closed"])

    return (batch(slice(i, i + step)) for i in range(0, len(row), step)), base + windows


def _repacked(held: list[pa.RecordBatch], width: int, base: int) -> tuple[Iterator[pa.RecordBatch], int]:
    t = pa.Table.from_batches(held)
    window, offset, windows = best_fit_decreasing(t["length"].to_numpy(), width)
    t = t.set_column(5, "sequence_id", pa.array(base + window)).set_column(6, "offset", pa.array(offset))
    return iter(t.to_batches(max_chunksize=512)), base + windows
