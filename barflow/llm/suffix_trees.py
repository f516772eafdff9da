"""Removal of repeated 20-word windows by prefix-partitioned suffix trees (operator 13).

Suffixes of the corpus, word by word, are dealt by prefixes of variable length, and a task builds the
trees of the prefixes it gets. Not every suffix is a leaf: a window of 20 words is looked up by its
anchor, the prefix of least hash that starts in it and lies in it whole. Equal windows have equal
anchors at equal distances, so a leaf at each anchor is enough; it stands for the stretch of windows
that have this anchor. A prefix that is common in the corpus would bring too many leaves to one task;
it is lengthened, from 4 words to 8, then to the whole window, until groups fit memory.

In a tree the leaves are sorted by the words from the anchor on, and the depths between neighbours
(common words) tell the internal nodes: a node of depth d is a longest range of leaves with depths
of d or more. A second order, by the words before the anchor read backwards, tells how far leaves
agree to the left. A window that starts o words before its anchor repeats where leaves share a node
of depth 20 - o and agree on o words to the left: a repeat that reaches to both sides. Of its leaves
the earliest keeps the window, all others lose it. Each loss is confirmed by comparing bytes.

Stretches that are equal within a task, or within a prefix by a hash of all their words, are
one leaf: the earliest stands for all, and the others are lost whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cuts, runs, small_batches, steps, tidy, utf8_column, written
from .shingles import _SPACE, mix, part_hashes, powers, prefix_hashes

WORDS = 20
#: Prefix lengths; the last is the window itself.
PREFIXES = (4, 8, WORDS)
#: Bytes of text that are hashed at a time; longer texts are cut with an overlap.
CHUNK = 1 << 18
#: One document of SAMPLE tells which prefixes are common; seen less often than LEAST_COMMON there, none is.
SAMPLE, LEAST_COMMON = 256, 16
#: Repeated stretches that a task remembers.
SEEN = 50_000

_PLACE = np.uint64((1 << 22) - 1)
_NONE = ~np.uint64(0)


def spaced(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with one space after each word and no other whitespace, a step of rows at a time."""
    out, sizes = [np.zeros(0, np.uint8)], [np.zeros(1, np.int64)]
    for i, j in steps(offs, CHUNK):
        text, at = raw[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        ink = ~_SPACE[text]
        last = np.zeros(len(text), bool)
        last[at[1:][np.diff(at) > 0] - 1] = True
        # The first whitespace after a word stays, as a space; a word that ends its row gets one.
        keep = ink.copy()
        keep[1:] |= ink[:-1] & ~last[:-1]
        bare = np.flatnonzero(ink & last)
        kept = np.where(ink, text, 32).astype(np.uint8)[keep]
        count = np.concatenate([np.zeros(1, np.int64), np.cumsum(keep)])
        out.append(np.insert(kept, count[bare + 1], 32))
        sizes.append(count[at[1:]] - count[at[:-1]] + np.diff(np.searchsorted(bare, at)))
    return np.concatenate(out), np.cumsum(np.concatenate(sizes))


def _pieces(raw: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Spaced text in steps of whole rows, or overlapping parts of a long row: bytes, offsets, first row, words before."""
    for i, j in steps(offs, CHUNK):
        lo, hi = int(offs[i]), int(offs[j])
        if hi - lo <= CHUNK:
            yield raw[lo:hi], offs[i:j + 1] - lo, i, 0
            continue
        at, before, size = lo, 0, CHUNK
        while at < hi:
            part = raw[at:min(hi, at + size)]
            ends = np.flatnonzero(part == 32) + 1
            if len(ends) < WORDS and at + size < hi:
                size *= 2  # words of a megabyte
                continue
            yield part[:ends[-1]] if len(ends) else part, np.array([0, ends[-1] if len(ends) else len(part)]), i, before
            if at + size >= hi:
                break
            # The next part starts with the last 19 words of this one.
            at += int(ends[-WORDS])
            before += len(ends) - WORDS + 1
            size = CHUNK


class Hashed:
    """Words of spaced rows, and hashes of their sequences."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray):
        self.stop = np.flatnonzero(raw == 32)
        self.start = np.concatenate([[0], self.stop[:-1] + 1]) if len(self.stop) else self.stop
        self.words = mix(part_hashes(prefix_hashes(raw), self.start, self.stop) + (self.stop - self.start).astype(np.uint64))
        self.first = np.searchsorted(self.start, offs)
        up, self.down = powers(len(self.words) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.words * up[:len(self.words)])])

    def sequences(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64))

    def windows(self) -> np.ndarray:
        """First words of all windows, none over the end of a row."""
        n = len(self.words)
        edge = np.zeros(n + 1, np.int64)
        rows = np.flatnonzero(np.diff(self.first) >= WORDS)
        np.add.at(edge, self.first[rows], 1)
        np.add.at(edge, self.first[rows + 1] - WORDS + 1, -1)
        return np.flatnonzero(np.cumsum(edge[:-1]) > 0)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of every ``w`` neighbours."""
    out = x[:len(x) - w + 1].copy()
    for k in range(1, w):
        np.minimum(out, x[k:len(x) - w + 1 + k], out=out)
    return out


class CommonPrefixes:
    """Hashes of prefixes that are to be lengthened."""

    def __init__(self, hashes: list[int]):
        self.hashes = np.sort(np.array(hashes, np.int64).view(np.uint64))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def among(self, g: np.ndarray) -> np.ndarray:
        """Places of common prefixes in ``g``."""
        if not len(self.hashes):
            return np.zeros(0, np.int64)
        may = np.flatnonzero(self.bits[(g >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, g[may]), len(self.hashes) - 1)
        return may[self.hashes[at] == g[may]]


NONE_COMMON = CommonPrefixes([])


def stretches(h: Hashed, common: CommonPrefixes = NONE_COMMON) -> tuple[np.ndarray, ...]:
    """Stretches of windows with one anchor: row, first window, windows, anchor's distance from it, prefix hash, hash of the words."""
    start, n = h.windows(), len(h.words)
    if not len(start):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    anchor, key = np.zeros(len(start), np.int64), np.zeros(len(start), np.uint64)
    left = np.arange(len(start))  # windows without an anchor yet
    for size in PREFIXES:
        at = np.arange(n - size + 1)
        g = h.sequences(at, at + size)
        rank = (g >> np.uint64(1)) & ~_PLACE | at.astype(np.uint64)
        if size < WORDS:
            rank[common.among(g)] = _NONE
        least = _sliding_min(rank, WORDS - size + 1)[start[left]]
        found = least != _NONE
        at = (least[found] & _PLACE).astype(np.int64)
        anchor[left[found]], key[left[found]] = at, g[at]
        left = left[~found]
        if not len(left):
            break
    row = np.searchsorted(h.first, start, "right") - 1
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (key[1:] != key[:-1]) | (row[1:] != row[:-1]) | (np.diff(start) != 1)]))
    count = np.diff(np.concatenate([new, [len(start)]]))
    start, anchor, key = start[new], anchor[new], key[new]
    return row[new], start, count, anchor - start, key, h.sequences(start, start + count + WORDS - 1)


def common_prefixes(docs: DataFrame) -> list[int]:
    """Prefixes of 4 and 8 words so common that their leaves would fill a good part of a task; about 70 for each shuffle partition at most.

    They are counted in a sample and only decide how long a prefix is, never what is found. A stretch
    has about 8 windows, so a prefix with a share s of all places has at most 8 s of all stretches;
    one that makes a quarter of a partition is common. Shares add up to 1, which bounds the list.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = spaced(*utf8_column(b.column(0)))
            for part, po, _, _ in _pieces(raw, offs):
                h = Hashed(part, po)
                start = h.windows()
                for size in PREFIXES[:-1] if len(start) else ():
                    hashes, counts = np.unique(h.sequences(start, start + size), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts)], names=["gram", "c"])

    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sample = docs.filter(F.pmod(F.xxhash64("rk", "rh"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(tidy(task), "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))
    sample = written(sample.filter(F.col("c") > 1), "prefix-counts")
    total = sample.agg(F.sum("c")).first()[0] or 0
    return [r["gram"] for r in sample.filter(F.col("c") >= max(LEAST_COMMON, total // (34 * parts))).select("gram").collect()]


_LEAF = "akey long, done boolean, dig long, rk long, rh long, start long, n int, rel int"


def _combined(key: np.ndarray, rk: np.ndarray, rh: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each stretch, the earliest one of its key, and how many have it."""
    order = np.lexsort((start, rh, rk, key))
    k = key[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    group = np.cumsum(new) - 1
    first, count = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
    first[order] = order[np.flatnonzero(new)][group]
    count[order] = np.bincount(group)[group]
    return first, count


def _leaves(docs: DataFrame, common: list[int]) -> DataFrame:
    """A row for each stretch that may be a leaf, and runs of those that an earlier equal one makes lost whole (done)."""
    shared = docs.sparkSession.sparkContext.broadcast(CommonPrefixes(common))  # bounded, see common_prefixes

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, seen = shared.value, {}
        for b in batches:
            rk, rh = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            raw, offs = spaced(*utf8_column(b.column(2)))
            for part, po, first, before in _pieces(raw, offs):
                row, start, n, rel, anchor, dig = stretches(Hashed(part, po), common)
                if not len(row):
                    continue
                own_rk, own_rh, at = rk[first + row], rh[first + row], start - np.searchsorted(np.flatnonzero(part == 32), po)[row] + before
                key = mix(anchor + dig * np.uint64(3) + n.astype(np.uint64))
                one, count = _combined(key, own_rk, own_rh, at)
                done = one != np.arange(len(row))
                # A repeated row is the same place once more, and tells nothing new.
                again = done & (own_rk == own_rk[one]) & (own_rh == own_rh[one]) & (at == at[one])
                # What stands earlier in this task need not travel again.
                told_of = np.flatnonzero(~done & (count > 1))
                for k, name, *place in zip(*(c.tolist() for c in (told_of, key[told_of], own_rk[told_of], own_rh[told_of], at[told_of]))):
                    place = tuple(place)
                    told = seen.get(name)
                    if told is not None and told <= place:
                        done[k] = True
                        again[k] = told == place
                    else:
                        if len(seen) > SEEN:
                            seen.clear()
                        seen[name] = place
                live, d = np.flatnonzero(~done), np.flatnonzero(done & ~again)
                # Neighbouring stretches that are done make one run.
                new = np.flatnonzero(np.concatenate([[True], (np.diff(d) != 1) | (np.diff(row[d]) != 0) | (at[d][1:] != at[d][:-1] + n[d][:-1])])) if len(d) else d
                run, windows = d[new], np.add.reduceat(n[d], new) if len(d) else n[d]
                pick = np.concatenate([live, run])
                is_done = np.repeat([False, True], [len(live), len(run)])
                spread = mix((at[pick] * 64 + row[pick]).astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.where(is_done, spread, anchor.view(np.int64)[pick])), pa.array(is_done), pa.array(dig.view(np.int64)[pick]), pa.array(own_rk[pick]), pa.array(own_rh[pick]), pa.array(at[pick]),
                    pa.array(np.concatenate([n[live], windows]).astype(np.int32)), pa.array(rel[pick].astype(np.int32))], names=["akey", "done", "dig", "rk", "rh", "start", "n", "rel"])

    return docs.select("rk", "rh", "text").mapInArrow(tidy(task), _LEAF)


def _grouped(leaves: DataFrame) -> DataFrame:
    """Stretches that are lost whole (lost), and the leaves of all prefixes that have several different ones (open)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "akey", 20_000):
            akey, done, dig = (t[c].to_numpy() for c in ("akey", "done", "dig"))
            n, rel = t["n"].to_numpy(), t["rel"].to_numpy()
            new_key = np.concatenate([[True], (akey[1:] != akey[:-1]) | (done[1:] != done[:-1])])
            # Equal words at an equal distance: the earliest comes first, and is the leaf.
            new_leaf = new_key | np.concatenate([[True], (dig[1:] != dig[:-1]) | (n[1:] != n[:-1]) | (rel[1:] != rel[:-1])])
            at = np.flatnonzero(new_leaf)[np.cumsum(new_leaf) - 1]
            again = ~new_leaf & ~done  # the leaf's own place, from a repeated row
            for c in ("rk", "rh", "start"):
                x = t[c].to_numpy()
                again &= x == x[at]
            lost = (done | ~new_leaf) & ~again
            key = np.cumsum(new_key) - 1
            opened = new_leaf & ~done
            opened &= (np.bincount(key, weights=opened) > 1)[key]
            keep = t.select(["akey", "rk", "rh", "start", "n", "rel"]).append_column("lost", pa.array(lost)).filter(pa.array(lost | opened))
            yield from keep.combine_chunks().to_batches(max_chunksize=20_000)

    dealt = leaves.repartition("akey").sortWithinPartitions("akey", "done", "dig", "n", "rel", "rk", "rh", "start")
    return dealt.mapInArrow(tidy(task), "akey long, rk long, rh long, start long, n int, rel int, lost boolean")


_CONTENT = "akey long, rk long, rh long, start long, n int, rel int, bytes binary"


def _contents(docs: DataFrame, opened: DataFrame) -> DataFrame:
    """Words of open leaves, each with a space after it. A row's list of leaves is smaller than its text."""
    lists = opened.groupBy("rk", "rh").agg(F.collect_list(F.struct("akey", "start", "n", "rel")).alias("x"))
    # All columns of docs go along, as in the last join: one shuffle of the texts then serves both.
    joined = docs.join(lists, ["rk", "rh"]).select("rk", "rh", "text", "x", "doc_id")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rk, rh = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            raw, offs = spaced(*utf8_column(b.column(2)))
            ends = np.flatnonzero(raw == 32) + 1
            begin = np.concatenate([[0], ends])
            x = b.column(3)
            flat = x.flatten()
            akey, start, n, rel = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            row = np.repeat(np.arange(b.num_rows), np.diff(x.offsets.to_numpy()))
            w = np.searchsorted(ends, offs, "right")[row] + start
            lo, hi = begin[w], begin[w + n + WORDS - 1]
            for i in range(0, len(row), 5_000):
                k = slice(i, i + 5_000)
                yield pa.RecordBatch.from_arrays([
                    pa.array(akey[k]), pa.array(rk[row[k]]), pa.array(rh[row[k]]), pa.array(start[k]), pa.array(n[k]), pa.array(rel[k]),
                    cuts(raw, lo[k], hi[k])], names=["akey", "rk", "rh", "start", "n", "rel", "bytes"])

    return joined.mapInArrow(tidy(task), _CONTENT)


class Forest:
    """Suffix trees of several groups: leaves sorted by their words, with the depths between neighbours."""

    def __init__(self, group: np.ndarray, words: np.ndarray, first: np.ndarray, size: np.ndarray):
        """A leaf's words are ``words[first], words[first + 1 * step]`` and so on, ``size`` of them; ``group`` is 0, 1, ..."""
        m, width = len(group), int(size.max(initial=0))
        table = np.zeros((m, width + 1), np.uint64)
        table[:, 0] = group
        for k in range(width):
            has = np.flatnonzero(size > k)
            table[has, k + 1] = words[first[has] + k]
        self.order = np.lexsort(table.T[::-1])
        # Depth between a leaf and the one before: common words, none over the border of a group.
        a, b = self.order[1:], self.order[:-1]
        differs = table[a] != table[b]
        common = np.where(differs.any(1), differs.argmax(1), width + 1) - 1
        self.depth = np.concatenate([[-1], np.minimum(common, np.minimum(size[a], size[b]) if m > 1 else common)])

    def nodes(self, depth: int) -> np.ndarray:
        """For each leaf, the number of its node of this depth; leaves under one node share their first ``depth`` words."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(self.depth < depth)
        return out


def _later(t: pa.Table) -> tuple[np.ndarray, ...]:
    """Of the leaves of whole groups, runs of windows that stand earlier too: rk, rh, start, windows."""
    akey, rk, rh, start = (t[c].to_numpy() for c in ("akey", "rk", "rh", "start"))
    order = np.lexsort((start, rh, rk, akey))
    new = np.concatenate([[True], (np.diff(akey[order]) != 0) | (np.diff(rk[order]) != 0) | (np.diff(rh[order]) != 0) | (np.diff(start[order]) != 0)])
    t = t.take(pa.array(order[new]))  # a repeated row's leaf is one
    akey, rk, rh, start, n, rel = (t[c].to_numpy() for c in ("akey", "rk", "rh", "start", "n", "rel"))
    n, rel = n.astype(np.int64), rel.astype(np.int64)
    raw, offs = utf8_column(t["bytes"].combine_chunks().cast(pa.large_binary()))
    h = Hashed(raw, offs)
    group = np.cumsum(np.concatenate([[0], akey[1:] != akey[:-1]]))
    anchor = h.first[:-1] + rel
    right = Forest(group, h.words, anchor, np.minimum(h.first[1:] - anchor, WORDS))
    back = h.words[::-1]
    left = Forest(group, back, len(back) - anchor, rel)
    place = np.empty(len(rk), np.int64)
    place[np.lexsort((start, rh, rk))] = np.arange(len(rk))
    gone = []
    for o in range(WORDS - PREFIXES[0] + 1):
        leaf = np.flatnonzero((rel >= o) & (rel - n < o))
        if len(leaf) < 2:
            continue
        a, b = right.nodes(WORDS - o)[leaf], left.nodes(o)[leaf]
        order = np.lexsort((place[leaf], b, a))
        new = np.concatenate([[True], (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)])
        leaf = leaf[order]
        first = leaf[np.flatnonzero(new)][np.cumsum(new) - 1]
        again = np.flatnonzero(~new)
        again = again[_same_words(raw, h, anchor[leaf[again]] - o, anchor[first[again]] - o)]
        gone.append((leaf[again], rel[leaf[again]] - o))
    if not gone:
        return rk[:0], rk[:0], rk[:0], rk[:0]
    leaf, w = (np.concatenate(c) for c in zip(*gone))
    order = np.lexsort((w, leaf))
    leaf, w = leaf[order], w[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(leaf) != 0) | (np.diff(w) != 1)])) if len(leaf) else leaf
    return rk[leaf[new]], rh[leaf[new]], start[leaf[new]] + w[new], np.diff(np.concatenate([new, [len(leaf)]]))


def _same_words(raw: np.ndarray, h: Hashed, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether the windows at words ``p`` and ``q`` have the same bytes."""
    lo, hi = h.start[p], h.start[q]
    size = h.stop[p + WORDS - 1] - lo
    out = size == h.stop[q + WORDS - 1] - hi
    i = 0
    k = np.flatnonzero(out)
    k = k[np.argsort(size[k], kind="stable")]
    while i < len(k):
        # Windows of like size are compared together, a quarter of a million bytes at a time.
        j = i + max(1, min(len(k) - i, (1 << 18) // max(1, int(size[k[min(len(k) - 1, i + 2048)]]))))
        part = k[i:j]
        span = np.arange(int(size[part[-1]]))
        inside = span < size[part][:, None]
        x = raw[np.minimum(lo[part][:, None] + span, len(raw) - 1)]
        y = raw[np.minimum(hi[part][:, None] + span, len(raw) - 1)]
        out[part] = ((x == y) | ~inside).all(1)
        i = j
    return out


def _resolved(contents: DataFrame) -> DataFrame:
    """Runs of lost windows (rk, rh, start, n) among open leaves."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "akey", 1024):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _later(t)], names=["rk", "rh", "start", "n"])

    return contents.repartition("akey").sortWithinPartitions("akey").mapInArrow(tidy(task), "rk long, rh long, start long, n long")


def later_runs(docs: DataFrame) -> DataFrame:
    """Runs (rk, rh, start, n) of windows whose words also start earlier; docs has rk, rh, text and doc_id."""
    grouped = written(_grouped(_leaves(docs, common_prefixes(docs))), "leaves")
    more = _resolved(_contents(docs, grouped.filter("NOT lost")))
    return grouped.filter("lost").select("rk", "rh", "start", F.col("n").cast("long").alias("n")).unionByName(more)


def remove_later(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, and ``kept`` (the remaining words, joined by one space).

    A word goes if a window of 20 words that covers it also starts earlier: in a smaller doc_id, or
    in the same document before. Rows of one doc_id with different texts stand in the order of a
    hash of the text; rows equal in doc_id and text are one document and get the same result; rows
    without doc_id come last, in the order of that hash. Null texts have no words; texts of fewer
    than 20 words lose nothing; very long ones are hashed in overlapping parts. No rows give no
    rows. Other columns are not read.

    Stretches are taken as equal by 64-bit hashes of prefix and words together, and words by 64-bit
    hashes within trees, where bytes confirm every loss.
    """
    small_batches(docs.sparkSession, 100)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("rk"), F.xxhash64("text").alias("rh"))
    found = later_runs(d).groupBy("rk", "rh").agg(F.collect_set(F.struct("start", "n")).alias("x"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = spaced(*utf8_column(b.column(1)))
            ends = np.flatnonzero(raw == 32) + 1
            first = np.searchsorted(ends, offs, "right")
            x = b.column(2).fill_null([]) if b.column(2).null_count else b.column(2)
            flat, of = x.flatten(), np.diff(x.offsets.to_numpy())
            row = np.repeat(np.arange(b.num_rows), of)
            edge = np.zeros(len(ends) + 1, np.int64)
            if len(row):
                start, n = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(2))
                np.add.at(edge, first[row] + start, 1)
                np.add.at(edge, first[row] + start + n + WORDS - 1, -1)
            gone = np.cumsum(edge[:-1]) > 0
            size = np.diff(np.concatenate([[0], ends]))
            left = raw[~np.repeat(gone, size)]
            total = np.concatenate([[0], np.cumsum(np.where(gone, 0, size))])[first]
            removed = np.concatenate([[0], np.cumsum(gone)])[first]
            kept = cuts(left, total[:-1], np.maximum(total[:-1], total[1:] - 1))  # without the last word's space
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(first)), pa.array(np.diff(removed)), kept], names=["doc_id", "n_words", "n_removed", "kept"])

    return d.join(found, ["rk", "rh"], "left").select("doc_id", "text", "x").mapInArrow(tidy(task), "doc_id long, n_words long, n_removed long, kept binary")
