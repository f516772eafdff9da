"""Benchmark decontamination by greedy string tiling (operator 2).

Documents and benchmark items that share a run of five words (a seed) are compared by greedy string
tiling: the longest runs of unmarked words that stand in both are marked, then the next longest,
down to five words, each search by running Karp-Rabin hashes. An item leaks into a document if the
tiles cover at least 0.75 of its words, in whatever order its passages stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, steps, tidy, utf8_column, written
from .shingles import shingle_hashes, words

#: Least words of a tile, and least share of an item's words under tiles.
LEAST_TILE, COVERAGE = 5, 0.75
#: Bytes of benchmark text that one pass over the documents carries to the executors.
BLOCK_BYTES = 32 << 20
#: Pairs of seed and item that are looked at together; a row's own are never parted.
PAIRS = 1 << 20

SCHEMA = "doc_id long, item_id long, coverage double, n_tiles long, matched_words long, item_words long"

_M = np.uint64(0x9E3779B97F4A7C15)


def _karp_rabin(w: np.ndarray, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all runs of ``size`` unmarked words, and their hashes from running prefix sums."""
    m = len(w) - size + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(w), _M)]))
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * up[:len(w)])])
    whole = np.concatenate([[0], np.cumsum(free)])
    at = np.flatnonzero(whole[size:] - whole[:-size] == size)
    # Shifted to one power, so equal runs have equal hashes.
    return at, (prefix[at + size] - prefix[at]) * up[len(w) - at]


def tile(item: np.ndarray, doc: np.ndarray, least: int = LEAST_TILE) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in doc, words), longest first; no word is in two tiles.

    The next length to try is found by bisection: a run of a length holds runs of all shorter ones.
    """
    tiles: list[tuple[int, int, int]] = []
    item_free, doc_free = np.ones(len(item), bool), np.ones(len(doc), bool)

    def common(size: int):
        ia, ih = _karp_rabin(item, item_free, size)
        da, dh = _karp_rabin(doc, doc_free, size)
        # Both scaled by the power of their own length: bring the item's to the document's.
        ih = ih * np.array(pow(int(_M), len(doc), 1 << 64), np.uint64)
        dh = dh * np.array(pow(int(_M), len(item), 1 << 64), np.uint64)
        hit = np.isin(ih, dh)
        return ia[hit], ih[hit], da, dh

    high = min(len(item), len(doc))
    while high >= least:
        low = least - 1  # the longest size known to match
        lo, hi = least, high
        while lo <= hi:
            mid = (lo + hi) // 2
            if len(common(mid)[0]):
                low, lo = mid, mid + 1
            else:
                hi = mid - 1
        if low < least:
            break
        ia, ih, da, dh = common(low)
        order = np.argsort(dh, kind="stable")
        dh, da = dh[order], da[order]
        before = len(tiles)
        for a, h in zip(ia.tolist(), ih):
            if not item_free[a:a + low].all():
                continue
            for d in da[np.searchsorted(dh, h):np.searchsorted(dh, h, "right")].tolist():
                if doc_free[d:d + low].all() and (item[a:a + low] == doc[d:d + low]).all():
                    tiles.append((a, d, low))
                    item_free[a:a + low] = doc_free[d:d + low] = False
                    break
        high = low if len(tiles) > before else low - 1  # equal hashes of other words mark nothing
    return tiles


def _near(seeds: np.ndarray, size: int, n: int) -> np.ndarray:
    """Positions of words within ``size`` words of a seed."""
    keep = np.zeros(n + 1, np.int64)
    np.add.at(keep, np.maximum(seeds - size, 0), 1)
    np.add.at(keep, np.minimum(seeds + size, n), -1)
    return np.flatnonzero(np.cumsum(keep[:-1]) > 0)


def _covered(code: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each code, how many item words its seeds (starts ``at``, ``least`` long) cover together; no tiling covers more."""
    order = np.lexsort((at, code))
    code, at = code[order], at[order]
    new = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    gap = np.full(len(at), least)
    gap[:-1] = np.where(code[1:] == code[:-1], np.minimum(at[1:] - at[:-1], least), least)
    return code[new], np.add.reduceat(gap, new) if len(new) else gap


def _block(docs: DataFrame, items: list, least: int, coverage: float) -> DataFrame:
    """One pass over the documents against benchmark texts that fit BLOCK_BYTES, each with the ids of its items."""
    ids = [r["ids"] for r in items]
    raw, offs = utf8_column(pa.array([r["text"] for r in items], pa.large_string()))
    _, _, h, first = words(raw, offs)
    item_words = [h[first[k]:first[k + 1]] for k in range(len(ids))]
    s = shingle_hashes(h, least)
    at = np.concatenate([np.zeros(0, np.int64)] + [np.arange(first[k], max(first[k], first[k + 1] - least + 1)) for k in range(len(ids))]).astype(np.int64)
    owner = np.searchsorted(first, at, "right") - 1
    order = np.argsort(s[at], kind="stable")
    seed, owner, where = s[at][order], owner[order], (at - first[owner])[order]
    shared = docs.sparkSession.sparkContext.broadcast((ids, item_words, seed, owner, where))
    # A small table says which seeds can be there at all, before any search.
    bits = np.zeros(1 << 20, bool)
    bits[(seed >> np.uint64(44)).astype(np.int64)] = True
    bloom = docs.sparkSession.sparkContext.broadcast(bits)

    def pairs(hit: np.ndarray, row: np.ndarray, s: np.ndarray) -> Iterator[tuple[int, int]]:
        """Rows and items whose shared seeds can cover enough of the item."""
        ids, item_words, seed, owner, where = shared.value
        need = np.array([coverage * len(w) - 1e-9 for w in item_words])
        lo = np.searchsorted(seed, s[hit])
        # A seed counts once in a row, however often it stands there: a row meets each seed of the block once at most.
        one = np.unique(row * np.int64(len(seed) + 1) + lo)
        row, lo = one // (len(seed) + 1), one % (len(seed) + 1)
        n = np.searchsorted(seed, seed[lo], "right") - lo
        cut = np.concatenate([[0], np.cumsum(n)])
        i = 0
        while i < len(lo):
            j = max(i + 1, int(np.searchsorted(cut, cut[i] + PAIRS, "right")) - 1)
            j = int(np.searchsorted(row, row[j - 1], "right"))  # whole rows
            k = np.repeat(lo[i:j] - (cut[i:j] - cut[i]), n[i:j]) + np.arange(cut[j] - cut[i])
            code, covered = _covered(np.repeat(row[i:j], n[i:j]) * np.int64(len(ids)) + owner[k], where[k], least)
            for c in code[covered >= need[code % len(ids)]].tolist():
                yield divmod(c, len(ids))
            i = j

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, item_words, seed, *_ = shared.value
        bits = bloom.value
        for b in batches:
            doc_ids, out = b.column(0), []
            raw, offs = utf8_column(b.column(1))
            for i, j in steps(offs):
                _, _, h, first = words(raw[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
                s = shingle_hashes(h, least)
                hit = np.flatnonzero(bits[(s >> np.uint64(44)).astype(np.int64)])
                hit = hit[np.searchsorted(seed, s[hit], "right") > np.searchsorted(seed, s[hit])]
                row = np.searchsorted(first, hit, "right") - 1
                inside = hit + least <= first[row + 1]
                for r, it in pairs(hit[inside], row[inside], s):
                    doc, item = h[first[r]:first[r + 1]], item_words[it]
                    # Tiles lie around seeds; the rest of the document, cut out, leaves a mark.
                    at = np.flatnonzero(np.isin(s[first[r]:first[r + 1] - least + 1], shingle_hashes(item, least)))
                    near = _near(at, least, len(doc))
                    part = doc[near]
                    gap = np.flatnonzero(np.diff(near) > 1) + 1
                    part = np.insert(part, gap, np.uint64(0))
                    t = tile(item, part, least)
                    got = sum(x[2] for x in t)
                    if got >= coverage * len(item) - 1e-9:
                        out += [(doc_ids[i + r].as_py(), one, got / len(item), len(t), got, len(item)) for one in ids[it]]
            cols = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.float64()] + [pa.int64()] * 3)],
                                             names=["doc_id", "item_id", "coverage", "n_tiles", "matched_words", "item_words"])

    return docs.select("doc_id", "text").mapInArrow(tidy(task), SCHEMA)


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST_TILE, coverage: float = COVERAGE) -> DataFrame:
    """Pairs of document and benchmark item whose tiles cover at least ``coverage`` of the item.

    Reads ``doc_id, text`` and ``item_id, text``. Null or empty texts and items of fewer than
    ``least`` words pair with nothing; repeated rows and equal items pair each for itself; of tiles
    of one length those that start first are taken; very long texts are searched whole; empty tables
    give no rows; other columns are not read. The benchmark is carried to the executors in blocks of at most BLOCK_BYTES of text, one
    pass over the documents for each block, so its size is bounded whatever the benchmark's.
    """
    small_batches(docs.sparkSession)
    # Equal texts are one text with several ids, so a block's size is that of its different texts.
    bench = written(benchmark.select("item_id", "text").filter(F.length("text") > 0).groupBy("text").agg(F.collect_list(F.col("item_id").cast("long")).alias("ids"), F.sum(F.col("item_id").isNull().cast("int")).alias("unnamed")), "benchmark")
    bench = bench.select("text", F.concat("ids", F.array_repeat(F.lit(None).cast("long"), F.col("unnamed").cast("int"))).alias("ids"))
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-2 * total // BLOCK_BYTES) if total > BLOCK_BYTES else 1
    out = None
    for k in range(blocks):
        part = bench if blocks == 1 else bench.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k)
        one = _block(docs, part.collect(), least, coverage)  # a block, bounded by BLOCK_BYTES
        out = one if out is None else out.unionByName(one)
    return out
