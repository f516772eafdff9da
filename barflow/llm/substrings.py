"""Removal of repeated 200-byte strings by a hash-compared suffix sort (operator 8).

Every 200-byte window has an anchor: the 48-byte gram in it with the least hash. Equal windows have
equal anchors at equal distances, so only suffixes that share an anchor need comparing. Very common
grams are anchors only of windows that have no other, so a passage in a third of all rows does not
bring its various surroundings to one place.

A stretch is a run of windows with one anchor. Within a task, stretches of equal hash and equal bytes
are combined before the shuffle. Of anchors with several stretches left, the stretches' bytes are
sorted as suffixes by a merge sort whose comparisons find common extensions by binary search over
prefix polynomial hashes: equal stretches become neighbours, and one of each different stretch has
its 200-byte windows sorted the same way. Neighbours count as equal once their bytes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cuts, runs, small_batches, steps, tidy, utf8_column, written
from .shingles import mix, part_hashes, prefix_hashes

LENGTH, GRAM = 200, 48
_WINDOW = LENGTH - GRAM + 1
#: Bytes of one text that are hashed at a time; longer texts are cut with an overlap.
CHUNK = 1 << 20
#: Longest stretch's bytes: all windows that can share an anchor.
_LONGEST = LENGTH + _WINDOW - 1
#: One document of SAMPLE tells which grams are common; seen less often than LEAST_COMMON there, none is.
SAMPLE, LEAST_COMMON = 256, 16
#: Repeated stretches that a task remembers.
SEEN = 300_000

_POSITION = np.uint64((1 << 24) - 1)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of every ``w`` neighbours, by running minima from both ends of blocks."""
    n = len(x)
    full = -(-n // w) * w
    padded = np.full(full, ~np.uint64(0))
    padded[:n] = x
    block = padded.reshape(-1, w)
    left = np.minimum.accumulate(block, 1).reshape(-1)
    right = np.minimum.accumulate(block[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n - w + 1], left[w - 1:n])


class CommonGrams:
    """Hashes of common grams; a table of bits sorts most others out."""

    def __init__(self, hashes: list[int]):
        self.hashes = np.sort(np.array(hashes, np.int64).view(np.uint64))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def among(self, g: np.ndarray) -> np.ndarray:
        """Places of common grams in ``g``."""
        if not len(self.hashes):
            return np.zeros(0, np.int64)
        may = np.flatnonzero(self.bits[(g >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, g[may]), len(self.hashes) - 1)
        return may[self.hashes[at] == g[may]]


NONE_COMMON = CommonGrams([])


def gram_hashes(raw: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """A hash of each GRAM neighbouring bytes."""
    at = np.arange(len(raw) - GRAM + 1)
    return mix(part_hashes(prefix, at, at + GRAM))


def _window_starts(offs: np.ndarray, n: int) -> np.ndarray:
    """Places where LENGTH bytes start within one row."""
    size = np.diff(offs)
    edge = np.zeros(n + 1, np.int64)
    rows = np.flatnonzero(size >= LENGTH)
    edge[offs[rows]] += 1
    edge[offs[rows] + size[rows] - LENGTH + 1] -= 1
    return np.flatnonzero(np.cumsum(edge)[:max(0, n - LENGTH + 1)] > 0)


def stretches(raw: np.ndarray, offs: np.ndarray, common: CommonGrams = NONE_COMMON) -> tuple[np.ndarray, ...]:
    """Stretches of windows with one anchor: row, first window's start in ``raw``, windows, anchor's distance from it, anchor hash, hash of the bytes."""
    empty = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    start = _window_starts(offs, len(raw))
    if not len(start):
        return empty
    p = prefix_hashes(raw)
    g = gram_hashes(raw, p)
    rank = (g >> np.uint64(1)) & ~_POSITION | np.arange(len(g), dtype=np.uint64)
    rank[common.among(g)] |= np.uint64(1 << 63)
    least = _sliding_min(rank, _WINDOW)
    anchor = (least[start] & _POSITION).astype(np.int64)
    row = np.searchsorted(offs, start, "right") - 1
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]))
    n = np.diff(np.concatenate([new, [len(start)]]))
    start, anchor = start[new], anchor[new]
    return row[new], start, n, anchor - start, g[anchor], part_hashes(p, start, start + n + LENGTH - 1)


def _pieces(raw: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Steps of whole rows, or overlapping parts of a row longer than CHUNK: bytes, offsets, first row, byte before."""
    for i, j in steps(offs, CHUNK):
        lo, hi = int(offs[i]), int(offs[j])
        if hi - lo <= CHUNK:
            yield raw[lo:hi], offs[i:j + 1] - lo, i, 0
        else:
            for a in range(0, hi - lo - LENGTH + 1, CHUNK):
                part = raw[lo + a:min(hi, lo + a + CHUNK + LENGTH - 1)]
                yield part, np.array([0, len(part)]), i, a


_OCC = "akey long, done boolean, dig long, rk long, rh int, start long, n int, rel int, known boolean"


def common_grams(docs: DataFrame) -> list[int]:
    """Grams so common that a task should not get all stretches around one; about 300 for each shuffle partition at most.

    They are counted in a sample, and only decide which anchor a window has, never what is found.
    A gram with a share s of all grams may anchor 77 s of all stretches; one that makes half a
    partition that way is common. Shares add up to 1, which bounds the list.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = utf8_column(b.column(0))
            for part, po, _, _ in _pieces(raw, offs):
                if len(part) >= LENGTH:
                    hashes, counts = np.unique(gram_hashes(part, prefix_hashes(part))[_window_starts(po, len(part))], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts)], names=["gram", "c"])

    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sample = docs.filter(F.pmod(F.xxhash64("rk", "rh"), F.lit(SAMPLE)) == 0).select("text")
    total = sample.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = max(LEAST_COMMON, total // (_WINDOW * parts))
    counts = sample.mapInArrow(tidy(task), "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c")).filter(F.col("c") >= least)
    return [r["gram"] for r in counts.select("gram").collect()]


def _combined(whole: bytes, start: np.ndarray, size: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each stretch, its first one of equal hash and bytes, and how many are so."""
    _, one, back = np.unique(key, return_index=True, return_inverse=True)
    first = one[back]
    for k in np.flatnonzero(first != np.arange(len(key))).tolist():
        f = int(first[k])
        if size[k] != size[f] or whole[start[k]:start[k] + size[k]] != whole[start[f]:start[f] + size[f]]:
            first[k] = k  # another text of the same hash: left to the sort
    return first, np.bincount(first, minlength=len(key))


def _occurrences(docs: DataFrame, common: list[int]) -> DataFrame:
    """A row for each stretch that is not yet known to be repeated, and one (known) of those that are; runs of all others (done)."""
    shared = docs.sparkSession.sparkContext.broadcast(CommonGrams(common))  # bounded, see common_grams

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, seen = shared.value, set()
        for b in batches:
            rk, rh = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            raw, offs = utf8_column(b.column(2))
            for part, po, first, before in _pieces(raw, offs):
                row, start, n, rel, anchor, dig = stretches(part, po, common)
                if not len(row):
                    continue
                key = mix(anchor + dig * np.uint64(3) + n.astype(np.uint64))
                one, count = _combined(part.tobytes(), start, n + LENGTH - 1, key)
                own = np.arange(len(row))
                known = (one == own) & (count > 1)
                done = one != own
                # What this task has told as repeated before need not be told again.
                told = np.flatnonzero(known)
                again = np.fromiter((k in seen for k in key[told].tolist()), bool, len(told))
                if len(seen) > SEEN:
                    seen.clear()
                seen.update(key[told].tolist())
                done[told[again]] = True
                live = np.flatnonzero(~done)
                # Neighbouring stretches that are done make one run.
                d = np.flatnonzero(done)
                new = np.flatnonzero(np.concatenate([[True], (np.diff(d) != 1) | (np.diff(row[d]) != 0)])) if len(d) else d
                run, windows = d[new], np.add.reduceat(n[d], new) if len(d) else n[d]
                pick = np.concatenate([live, run])
                is_done = np.repeat([False, True], [len(live), len(run)])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.where(is_done, start[pick] * 0x9E3779B1 + row[pick], anchor.view(np.int64)[pick])), pa.array(is_done), pa.array(dig.view(np.int64)[pick]),
                    pa.array(rk[first + row[pick]]), pa.array(rh[first + row[pick]]), pa.array(start[pick] - po[row[pick]] + before),
                    pa.array(np.concatenate([n[live], windows]).astype(np.int32)), pa.array(rel[pick].astype(np.int32)), pa.array(known[pick] | is_done)],
                    names=["akey", "done", "dig", "rk", "rh", "start", "n", "rel", "known"])

    return docs.select("rk", "rh", "text").mapInArrow(tidy(task), _OCC)


def _grouped(occ: DataFrame) -> DataFrame:
    """Stretches known to be repeated (full), and those whose bytes must be compared (open): all of an anchor with several."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "akey", 50_000):
            akey, done, dig, known = (t[c].to_numpy() for c in ("akey", "done", "dig", "known"))
            new_key = np.concatenate([[True], (akey[1:] != akey[:-1]) | (done[1:] != done[:-1])])
            new_dig = new_key | np.concatenate([[True], dig[1:] != dig[:-1]])
            # Of known ones with one hash, one takes part; they come first.
            spare = known & ~new_dig & np.concatenate([[False], known[:-1]])
            key = np.cumsum(new_key) - 1
            opened = ~spare & ~done & (np.bincount(key, weights=~spare) > 1)[key]
            yield t.select(["akey", "rk", "rh", "start", "n", "rel"]).append_column("full", pa.array(known)).append_column("opened", pa.array(opened)).filter(pa.array(known | opened)).combine_chunks().to_batches(max_chunksize=100_000)

    flat = lambda batches: (b for out in task(batches) for b in out)
    dealt = occ.repartition("akey").sortWithinPartitions("akey", "done", "dig", F.col("known").desc())
    return dealt.mapInArrow(tidy(flat), "akey long, rk long, rh int, start long, n int, rel int, full boolean, opened boolean")


_CONTENT = "akey long, rk long, rh int, start long, n int, rel int, known boolean, bytes binary"


def _contents(docs: DataFrame, opened: DataFrame) -> DataFrame:
    """Bytes of open stretches. A row's list of them is smaller than the row's text."""
    lists = opened.groupBy("rk", "rh").agg(F.collect_set(F.struct("akey", "start", "n", "rel", "full")).alias("x"))
    # All columns of docs go along, as in the last join: one shuffle of the texts then serves both.
    joined = docs.join(lists, ["rk", "rh"]).select("rk", "rh", "text", "x", "doc_id")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rk, rh = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            raw, offs = utf8_column(b.column(2))
            x = b.column(3)
            of = x.offsets.to_numpy()
            flat = x.flatten()
            akey, start, n, rel, known = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(5))
            row = np.repeat(np.arange(b.num_rows), np.diff(of))
            at = offs[row] + start
            for i in range(0, len(row), 20_000):
                k = slice(i, i + 20_000)
                yield pa.RecordBatch.from_arrays([
                    pa.array(akey[k]), pa.array(rk[row[k]]), pa.array(rh[row[k]]), pa.array(start[k]), pa.array(n[k]), pa.array(rel[k]), pa.array(known[k]),
                    cuts(raw, at[k], at[k] + n[k] + LENGTH - 1)],
                    names=["akey", "rk", "rh", "start", "n", "rel", "known", "bytes"])

    return joined.mapInArrow(tidy(task), _CONTENT)


class SuffixSorter:
    """Compares suffixes of a text, each up to its own length, through prefix polynomial hashes."""

    def __init__(self, text: np.ndarray):
        self.text = np.concatenate([text, np.zeros(_LONGEST, np.uint8)])
        self.prefix = prefix_hashes(self.text)

    def extension(self, p: np.ndarray, q: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Common bytes from ``p`` and ``q`` on, up to ``limit``, by binary search."""
        lo = np.zeros(len(p), np.int64)
        step = 1 << (int(limit.max()).bit_length() - 1) if len(p) else 0
        while step:
            to = np.minimum(lo + step, limit)
            same = (to > lo) & (part_hashes(self.prefix, p, p + to) == part_hashes(self.prefix, q, q + to))
            lo[same] = to[same]
            step >>= 1
        return lo

    def before(self, p: np.ndarray, q: np.ndarray, lp: np.ndarray, lq: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether the suffix at ``p`` (``lp`` long) sorts before that at ``q``; equal ones as ``ties`` says."""
        limit = np.minimum(lp, lq)
        e = self.extension(p, q, limit)
        at = np.minimum(e, limit - 1)
        return np.where(e >= limit, (lp < lq) | (lp == lq) & ties, self.text[p + at] < self.text[q + at])

    def sort(self, pos: np.ndarray, bucket: np.ndarray, size_of: np.ndarray) -> np.ndarray:
        """Order of suffixes (``size_of`` bytes each) within buckets (``bucket`` ascending): bottom-up merge sort of all buckets at once.

        An element's place after a merge is its own rank plus its rank in the sibling run, found by
        binary search there; each comparison takes logarithmic time.
        """
        order = np.arange(len(pos))
        first = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1))
        size = np.diff(np.concatenate([first, [len(pos)]]))
        base, size = np.repeat(first, size), np.repeat(size, size)
        place = np.arange(len(pos)) - base
        width = 1
        while width < int(size.max()):
            run = place // width
            sibling = (run ^ 1) * width
            end = np.minimum(sibling + width, size)
            live = np.flatnonzero(sibling < size)
            lo, hi = sibling[live].copy(), end[live].copy()
            me, long, right = pos[order[live]], size_of[order[live]], (run[live] & 1).astype(bool)
            while True:
                go = np.flatnonzero(lo < hi)
                if not len(go):
                    break
                mid = (lo[go] + hi[go]) // 2
                # How many of the sibling run come before this element; ties keep the left run first.
                other = order[base[live[go]] + mid]
                less = self.before(pos[other], me[go], size_of[other], long[go], right[go])
                lo[go] = np.where(less, mid + 1, lo[go])
                hi[go] = np.where(less, hi[go], mid)
            to = np.arange(len(pos))
            start = np.minimum(run[live], run[live] ^ 1) * width
            to[live] = base[live] + start + (place[live] - run[live] * width) + (lo - sibling[live])
            moved = np.empty_like(order)
            moved[to] = order
            order = moved
            width *= 2
        return order

    def equals(self, pos: np.ndarray, bucket: np.ndarray, size_of: np.ndarray) -> np.ndarray:
        """A class number for each suffix; those of a bucket with equal bytes share one. Verified."""
        if not len(pos):
            return np.zeros(0, np.int64)
        order = self.sort(pos, bucket, size_of)
        a, b = order[:-1], order[1:]
        near = (bucket[a] == bucket[b]) & (size_of[a] == size_of[b])
        k = np.flatnonzero(near)
        k = k[self.extension(pos[a[k]], pos[b[k]], size_of[a[k]]) >= size_of[a[k]]]
        same = np.zeros(len(order), bool)
        same[k + 1] = self._same_bytes(pos[a[k]], pos[b[k]], size_of[a[k]])
        out = np.empty(len(pos), np.int64)
        out[order] = np.cumsum(~same) - 1
        return out

    def _same_bytes(self, p: np.ndarray, q: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = np.ones(len(p), bool)
        for i in range(0, len(p), 8192):
            k = slice(i, i + 8192)
            span = np.arange(int(size[k].max()))
            out[k] = ((self.text[p[k][:, None] + span] == self.text[q[k][:, None] + span]) | (span >= size[k][:, None])).all(1)
        return out


def _compared(t: pa.Table) -> tuple[np.ndarray, ...]:
    """Of open stretches, runs of windows that are repeated: rk, rh, start, windows."""
    akey, rk, rh, start, n, rel, known = (t[c].to_numpy() for c in ("akey", "rk", "rh", "start", "n", "rel", "known"))
    n, rel = n.astype(np.int64), rel.astype(np.int64)
    text, offs = utf8_column(t["bytes"])
    sorter = SuffixSorter(text)
    group = np.cumsum(np.concatenate([[0], np.diff(akey) != 0]))
    # Whole stretches first: equal ones lie equally far from the anchor, else their bytes cannot agree on it.
    cls = sorter.equals(offs[:-1], group, n + LENGTH - 1)
    _, one, cls, count = np.unique(cls, return_index=True, return_inverse=True, return_counts=True)
    full = (count > 1) | (np.bincount(cls, weights=known) > 0)
    whole = np.flatnonzero(full[cls] & ~known)
    # Then the windows of one of each different stretch.
    several = (np.bincount(group[one]) > 1)[group[one]]
    m = np.sort(one[several])
    of = np.repeat(m, n[m])
    w = np.arange(len(of)) - np.repeat(np.cumsum(n[m]) - n[m], n[m])
    # Equal windows lie equally far from the anchor.
    code = group[of] * 1024 + (w - rel[of] + 512)
    _, back, places = np.unique(code, return_inverse=True, return_counts=True)
    wanted = np.bincount(back, weights=~full[cls[of]]) > 0
    at = np.flatnonzero(((places > 1) & wanted)[back])
    at = at[np.argsort(code[at], kind="stable")]
    rep = np.zeros(len(of), bool)
    if len(at):
        same = sorter.equals(offs[of[at]] + w[at], code[at], np.full(len(at), LENGTH))
        rep[at] = (np.bincount(same) > 1)[same]
    k = np.flatnonzero(rep & ~full[cls[of]])
    new = np.flatnonzero(np.concatenate([[True], (np.diff(k) != 1) | (np.diff(of[k]) != 0)])) if len(k) else k
    f, size = of[k[new]], np.diff(np.concatenate([new, [len(k)]]))
    return (np.concatenate([rk[whole], rk[f]]), np.concatenate([rh[whole], rh[f]]), np.concatenate([start[whole], start[f] + w[k[new]]]), np.concatenate([n[whole], size]))


def _resolved(contents: DataFrame) -> DataFrame:
    """Runs of repeated windows (rk, rh, start, n) among open stretches."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "akey", 1024):
            rk, rh, start, n = _compared(t)
            yield pa.RecordBatch.from_arrays([pa.array(rk), pa.array(rh), pa.array(start), pa.array(n)], names=["rk", "rh", "start", "n"])

    return contents.repartition("akey").sortWithinPartitions("akey").mapInArrow(tidy(task), "rk long, rh int, start long, n long")


def repeated_runs(docs: DataFrame) -> DataFrame:
    """Runs (rk, rh, start, n) of window starts whose LENGTH bytes also start elsewhere; docs has rk, rh and text."""
    grouped = written(_grouped(_occurrences(docs, common_grams(docs))), "stretches")
    more = _resolved(_contents(docs, grouped.filter("opened")))
    return grouped.filter("full").select("rk", "rh", "start", F.col("n").cast("long").alias("n")).unionByName(more)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, and ``kept`` (the remaining bytes).

    Null and empty texts have no bytes. Rows that repeat a whole document count as further places,
    whatever their doc_id; a null doc_id is as good as any; ties cannot arise, as all equal strings
    go. Texts of fewer than 200 bytes lose nothing; very long ones are hashed in overlapping parts.
    No rows give no rows. Other columns are not read. Rows are told apart by doc_id and a hash of
    the text; rows equal in both have equal results and stand for themselves as places.
    """
    small_batches(docs.sparkSession, 250)
    d = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit(1), "text")).alias("rk"), F.hash("text").alias("rh"))
    found = repeated_runs(d).groupBy("rk", "rh").agg(F.collect_set(F.struct("start", "n")).alias("x"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = utf8_column(b.column(1))
            out = []
            for k, x in enumerate(b.column(2).to_pylist()):
                text = raw[offs[k]:offs[k + 1]]
                if not x:
                    out.append((len(text), 0, 0, text.tobytes()))
                    continue
                edge = np.zeros(len(text) + 1, np.int64)
                s = np.array([y["start"] for y in x], np.int64)
                n = np.array([y["n"] for y in x], np.int64)
                np.add.at(edge, s, 1)
                np.add.at(edge, s + n + LENGTH - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                out.append((len(text), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()), text[~gone].tobytes()))
            cols = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return d.join(found, ["rk", "rh"], "left").select("doc_id", "text", "x").mapInArrow(tidy(task), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
