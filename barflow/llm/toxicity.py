"""Toxicity by nearest labelled examples under exact TF-IDF cosine (operator 3).

All terms of the labelled examples are indexed. Examples stand in blocks; a block keeps each common
term's largest weight, which bounds its cosines, and only blocks that may hold a nearer example are
searched, so the k nearest are exact; an example is never its own neighbour. Their distance-weighted
votes, shrunk to the base rate, give the score by a logistic curve fitted to the examples' own votes,
each with itself left out. Terms that stand nearly alone in toxic examples weigh BOOST times their
TF-IDF.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, steps, tidy, utf8_column, written
from .labelled import learnable, remainder
from .shingles import mix, part_hashes, prefix_hashes

#: Labelled rows to learn from at most; fewest toxic examples of a telling term, their least share, its boost.
LABELLED_ROWS, LEAST_TOXIC, PURITY, BOOST = 5_000, 5, 0.8, 4.0
NEIGHBOURS, BLOCK, PULL = 25, 64, 1.0
#: Terms in most examples, whose weights stand in a full matrix; queries searched together; blocks searched first.
COMMON, TOGETHER, FIRST = 1024, 256, 8
MOD, HELD = 5, 0
#: Lengths in bytes of word beginnings that are terms too, with a mark that keeps their hashes apart.
_PREFIXES = ((5, np.uint64(0x2545F4914F6CDD1D)), (7, np.uint64(0x9E3779B97F4A7C15)))
_INK = np.zeros(256, bool)
_INK[48:58] = _INK[65:91] = _INK[97:123] = _INK[128:] = _INK[95] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def term_hashes(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and 64-bit hashes of all terms in texts, not in order.

    Words are runs of letters, digits, _ and bytes beyond ASCII, A-Z lower-cased. A word's terms are
    itself, and its first 5 and 7 bytes if it is longer.
    """
    low = _LOWER[raw]
    ink = np.zeros(len(raw) + 1, bool)
    ink[:len(raw)] = _INK[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offs] = True
    before = np.concatenate([[False], ink[:-1]])
    start, stop = np.flatnonzero(ink & (~before | edge)), np.flatnonzero(before & (~ink | edge))
    row = np.searchsorted(offs, start, "right") - 1
    p = prefix_hashes(low)
    rows, hashes = [row], [mix(part_hashes(p, start, stop) + (stop - start).astype(np.uint64))]
    for n, mark in _PREFIXES:
        long = np.flatnonzero(stop - start > n)
        rows.append(row[long])
        hashes.append(mix(part_hashes(p, start[long], start[long] + n) ^ mark))
    return np.concatenate(rows), np.concatenate(hashes)


class TermCounter:
    """Counts known terms in texts; ``hashes`` of terms stand in the order of their places."""

    def __init__(self, hashes: np.ndarray):
        self.hashes, self.table = hashes, None

    def __getstate__(self) -> dict:
        return {"hashes": self.hashes, "table": None}

    def places(self, h: np.ndarray) -> np.ndarray:
        """Places of terms, -1 of unknown ones: a sorted table, entered by the leading bits."""
        if self.table is None:
            order = np.argsort(self.hashes)
            bits = max(1, len(order).bit_length() + 1)
            at = np.searchsorted(self.hashes[order] >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
            self.table = self.hashes[order], order.astype(np.int32), at, np.uint64(64 - bits)
        known, order, at, shift = self.table
        out = np.full(len(h), -1, np.int64)
        bucket = (h >> shift).astype(np.int64)
        k, end = at[bucket], at[bucket + 1]
        todo = np.flatnonzero(k < end)
        while len(todo):
            hit = known[k[todo]] == h[todo]
            out[todo[hit]] = order[k[todo[hit]]]
            k[todo] += 1
            todo = todo[~hit & (k[todo] < end[todo])]
        return out

    def count(self, raw: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text the places of its terms, rising, and their counts."""
        n = max(1, len(self.hashes))
        for i, j in steps(offs):
            row, h = term_hashes(raw[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
            at = self.places(h)
            key, c = np.unique((row * n + at)[at >= 0], return_counts=True)
            cut = np.searchsorted(key, np.arange(j - i + 1) * n)
            for a, z in zip(cut[:-1].tolist(), cut[1:].tolist()):
                yield (key[a:z] % n).astype(np.int32), c[a:z].astype(np.int32)


def _packed(t: np.ndarray, c: np.ndarray) -> bytes:
    """Steps between places, then counts."""
    return np.concatenate([np.diff(t, prepend=np.int32(0)), c]).astype("<i4").tobytes()


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, c = np.frombuffer(raw, "<i4").reshape(2, -1)
    return np.cumsum(steps, dtype=np.int32), c


class BlockMaxIndex:
    """Examples' unit vectors in blocks of BLOCK, with each common term's largest weight in each block.

    The search structures are made at the first search.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, ids: np.ndarray, n_terms: int):
        # Examples with the same leading term stand together: bounds get tighter.
        order = sorted(range(len(vectors)), key=lambda k: (int(vectors[k][0][np.argmax(vectors[k][1])]), int(ids[k])))
        self.labels, self.ids, self.n_terms = labels[order], ids[order], n_terms
        self.ptr = np.cumsum([0] + [len(vectors[k][0]) for k in order])
        self.terms = np.concatenate([vectors[k][0] for k in order] or [np.zeros(0)]).astype(np.int32)
        self.weights = np.concatenate([vectors[k][1] for k in order] or [np.zeros(0)])
        self.opened = None

    def _open(self) -> tuple:
        """Places of common terms, their matrix in double and in single precision, its largest weights by block; postings of the other terms."""
        if self.opened is None:
            n = -(-len(self.labels) // BLOCK) * BLOCK
            held = np.bincount(self.terms, minlength=self.n_terms)
            common = np.argsort(-held, kind="stable")[:COMMON]
            place = np.full(self.n_terms, -1, np.int32)
            place[common] = np.arange(len(common))
            row = np.repeat(np.arange(len(self.labels), dtype=np.int32), np.diff(self.ptr))
            at = place[self.terms]
            matrix = np.zeros((n, len(common)))
            matrix[row[at >= 0], at[at >= 0]] = self.weights[at >= 0]
            rest = np.flatnonzero(at < 0)
            rest = rest[np.argsort(self.terms[rest], kind="stable")]
            held[common] = 0
            start = np.concatenate([[0], np.cumsum(held)])
            rough = matrix.astype(np.float32)
            self.opened = (place, matrix, rough, rough.reshape(-1, BLOCK, len(common)).max(1), start, row[rest], self.weights[rest])
        return self.opened

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples with a cosine over 0; ties by place."""
        return self.nearest_of([(terms, weights)], k)[0]

    def nearest_of(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` for each of the queries."""
        if not len(self.labels):
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        return [x for i in range(0, len(queries), TOGETHER) for x in self._search(queries[i:i + TOGETHER], k)]

    def _search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        place, matrix, rough, largest, start, rows, weights = self._open()
        n, blocks = len(matrix), len(largest)
        cos = np.zeros((len(queries), n), np.float32)
        q = np.zeros((len(queries), matrix.shape[1]))
        met = []
        for i, (t, w) in enumerate(queries):
            at = place[t]
            q[i, at[at >= 0]] = w[at >= 0]
            t, w = t[at < 0], w[at < 0]
            size = start[t + 1] - start[t]
            post = np.repeat(start[t] - np.cumsum(size) + size, size) + np.arange(size.sum())
            met.append((rows[post], weights[post] * np.repeat(w, size)))
            cos[i] = np.bincount(*met[i], n)
        single = q.astype(np.float32)
        # A block's bound: its largest sum over the other terms, and its largest weights of common ones.
        by_block = cos.reshape(len(queries), blocks, BLOCK)
        bound = by_block.max(2) + single @ largest.T
        first = min(FIRST, blocks)
        done = np.zeros(bound.shape, bool)
        np.put_along_axis(done, np.argpartition(-bound, first - 1, 1)[:, :first], True, 1)
        self._finish(by_block, single, rough, done)
        more = ~done & (bound >= self._kth(np.where(done[:, :, None], by_block, 0), k)[:, None] - 1e-5) & (bound > 0)
        self._finish(by_block, single, rough, more)
        by_block[~(done | more)] = 0
        least = np.maximum(self._kth(by_block, k) - 1e-5, 0)
        return [self._exact(np.flatnonzero((cos[i] > 0) & (cos[i] >= least[i])), q[i], *met[i], k) for i in range(len(queries))]

    @staticmethod
    def _finish(by_block: np.ndarray, q: np.ndarray, matrix: np.ndarray, which: np.ndarray) -> None:
        for b in np.flatnonzero(which.any(0)):
            i = np.flatnonzero(which[:, b])
            by_block[i, b] += q[i] @ matrix[b * BLOCK:(b + 1) * BLOCK].T

    @staticmethod
    def _kth(by_block: np.ndarray, k: int) -> np.ndarray:
        flat = by_block.reshape(len(by_block), -1)
        return np.partition(flat, flat.shape[1] - k, 1)[:, flat.shape[1] - k] if flat.shape[1] >= k else np.zeros(len(flat), np.float32)

    def _exact(self, where: np.ndarray, common: np.ndarray, rows: np.ndarray, products: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Cosines of the examples that may be among the nearest, in double precision."""
        if not len(where):
            return np.zeros(0, np.int64), np.zeros(0)
        matrix = self._open()[1]
        slot = np.zeros(len(matrix), np.int64)
        slot[where] = 1 + np.arange(len(where))
        cos = matrix[where] @ common + np.bincount(slot[rows], products, len(where) + 1)[1:]
        order = np.lexsort((where, -np.round(cos, 12)))[:k]
        return where[order], cos[order]


def _unit(t: np.ndarray, c: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = (1 + np.log(c)) * weight[t]
    size = np.sqrt((w * w).sum())
    return t, w / size if size else w


def vote(cos: np.ndarray, labels: np.ndarray, base: float) -> float:
    """Share of toxic ones among neighbours, weighted by nearness and drawn to the base rate."""
    w = 1 / (1.05 - np.minimum(cos, 1))
    return float((w @ labels + PULL * base) / (w.sum() + PULL))


def calibrated(p: float, curve: tuple[float, float]) -> float:
    return float(1 / (1 + np.exp(-np.clip(curve[0] * np.log(p / (1 - p)) + curve[1], -30, 30))))


def fitted_curve(votes: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from a vote's log-odds to the label, by Newton's steps; labels are smoothed."""
    if len(votes) < 20 or labels.min() == labels.max():
        return 1.0, 0.0
    x = np.stack([np.log(votes / (1 - votes)), np.ones(len(votes))], 1)
    good, bad = labels.sum(), len(labels) - labels.sum()
    want = np.where(labels > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    w = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        w = w - np.clip(np.linalg.solve(h, x.T @ (p - want)), -2, 2)
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


class Examples:
    """Examples' counts as they are sent to the tasks, compressed; the index is made from them there."""

    def __init__(self, counts: list[bytes], labels: np.ndarray, ids: np.ndarray, weight: np.ndarray):
        self.sizes, self.labels, self.ids, self.weight = np.array([len(x) for x in counts], np.int64), labels, ids, weight
        self.counts = pa.compress(b"".join(counts), "zstd", asbytes=True)
        self.made = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"made": None}

    def index(self) -> BlockMaxIndex:
        if self.made is None:
            raw = memoryview(pa.decompress(self.counts, int(self.sizes.sum()), "zstd", asbytes=True))
            ends = np.cumsum(self.sizes)
            self.made = BlockMaxIndex([_unit(*_unpacked(raw[e - n:e]), self.weight) for e, n in zip(ends.tolist(), self.sizes.tolist())], self.labels, self.ids, max(1, len(self.weight)))
        return self.made


def known_terms(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of the examples, and whether they tell: (toxic + 0.1) / (all + 1) >= PURITY. Equal texts count once."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            raw, offs = utf8_column(b.column(1))
            for i, j in steps(offs):
                row, h = term_hashes(raw[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
                order = np.lexsort((row, h))
                row, h = row[order], h[order]
                once = np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])])[:len(h)]
                terms, of = np.unique(h[once], return_inverse=True)
                bad = np.bincount(of, weights=label[i:j][row[once]], minlength=len(terms)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(bad), pa.array(np.bincount(of, minlength=len(terms)))], names=["term", "bad", "n"])

    one = sample.groupBy(F.xxhash64("text").alias("h"), F.length("text")).agg(F.first("text").alias("text"), F.max("label").alias("label"))
    got = one.select("label", "text").mapInArrow(tidy(task), "term long, bad long, n long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).toArrow()
    # Frequent terms come first: steps between places stay small.
    got = got.sort_by([("n", "descending"), ("term", "ascending")])
    bad, n = got["bad"].to_numpy(), got["n"].to_numpy()
    return got["term"].to_numpy().view(np.uint64), (bad >= LEAST_TOXIC) & (bad + 0.1 >= PURITY * (n + 1))


def score(docs: DataFrame, labels: DataFrame, mod: int = MOD, held: int = HELD, labelled_rows: int = LABELLED_ROWS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, and evidence (nearest examples' ids, cosines, labels).

    Every document with a term of any example is searched; one without (an empty or null text too)
    gets the share of toxic ones among such examples, and no evidence. A null doc_id is scored,
    never held out; repeated rows get equal scores; equal cosines go by the index's order. A very long
    text is counted whole; no rows give no rows; with no labels every score is one half. Document frequencies cover all documents. At
    most ``labelled_rows`` examples.
    """
    small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    known = learnable(labels, "toxic", mod, held, labelled_rows)
    sample = written(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"), "toxicity-sample")
    terms, telling = known_terms(sample)
    shared_counter = sc.broadcast(TermCounter(terms))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = shared_counter.value
        for b in batches:
            rows = [_packed(*x) for x in counter.count(*utf8_column(b.column(1)))]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(rows, pa.binary())], names=["doc_id", "counts"])

    n_terms = len(terms)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(n_terms + 1, np.int64), 0
        for b in batches:
            for raw in b.column(0).to_pylist():
                seen[_unpacked(raw)[0]] += 1
            n += b.num_rows
        seen[-1] = n
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["term", "df"])

    vectors = written(docs.select("doc_id", "text").mapInArrow(tidy(count), "doc_id long, counts binary"), "toxicity-counts", compression="zstd")
    told = vectors.select("counts").mapInArrow(tidy(frequencies), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(n_terms + 1)
    df[told["term"].to_numpy()] = told["df"].to_numpy()
    weight = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1) * np.where(telling, BOOST, 1.0)
    examples = vectors.join(F.broadcast(known), "doc_id").groupBy("doc_id", "label").agg(F.min("counts").alias("counts")).toArrow()  # at most labelled_rows
    ids, y = examples["doc_id"].to_numpy(), examples["label"].to_numpy().astype(np.int64)
    counts = examples["counts"].to_pylist()
    del examples
    empty = np.array([not c for c in counts], bool)
    full = np.flatnonzero(~empty)
    blank = float((y[empty].sum() + 0.5) / (empty.sum() + 1))
    base = float((y.sum() + 0.5) / (len(y) + 1))
    shared = sc.broadcast(Examples([counts[k] for k in full], y[full], ids[full], weight))
    del counts

    def voting(curve: tuple[float, float]):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, weight = shared.value.index(), shared.value.weight
            memo: dict[bytes, tuple] = {}
            for b in batches:
                s, near, cosines, votes = [], [], [], []
                own, raws = b.column(0).to_pylist(), b.column(1).to_pylist()
                if len(memo) > 10_000:
                    memo.clear()
                new = [raw for raw in dict.fromkeys(raws) if raw not in memo]
                # One more than needed, as the document itself may be an example.
                memo.update(zip(new, index.nearest_of([_unit(*_unpacked(raw), weight) for raw in new], NEIGHBOURS + 1)))
                for doc, raw in zip(own, raws):
                    at, cos = memo[raw]
                    other = index.ids[at] != (-1 if doc is None else doc)
                    at, cos = at[other][:NEIGHBOURS], cos[other][:NEIGHBOURS]
                    s.append(calibrated(vote(cos, index.labels[at], base), curve) if len(at) else blank)
                    near.append(index.ids[at[:5]].tolist())
                    cosines.append(cos[:5].tolist())
                    votes.append(index.labels[at[:5]].tolist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array(near, pa.list_(pa.int64())), pa.array(cosines, pa.list_(pa.float64())), pa.array(votes, pa.list_(pa.int64()))],
                                                 names=["doc_id", "score", "evidence_ids", "evidence_cosines", "evidence_labels"])

        return tidy(task), "doc_id long, score double, evidence_ids array<long>, evidence_cosines array<double>, evidence_labels array<long>"

    own = vectors.filter("length(counts) > 0").join(F.broadcast(known.select("doc_id")), "doc_id").select("doc_id", "counts").mapInArrow(*voting((1.0, 0.0))).select("doc_id", "score").toArrow()
    label = dict(zip(ids.tolist(), y.tolist()))
    curve = fitted_curve(own["score"].to_numpy(), np.array([label[k] for k in own["doc_id"].to_pylist()], float))
    out = vectors.mapInArrow(*voting(curve))
    return out.select("doc_id", F.coalesce(remainder("doc_id", mod) == held, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence_ids", "evidence_cosines", "evidence_labels")
