"""Quality scores by positive-unlabelled learning with the non-negative risk (operator 5).

A small network is trained on documents labelled good (trusted positives) against documents without
labels. The risk of the unlabelled set, less the positives' share of it, estimates the risk on bad
documents; where that estimate falls below zero, its gradient is reversed, so the network cannot
win by memorising positives. A start is fitted on the labelled rows, their labels hidden; the class
prior is then estimated from how often unlabelled documents score as high as positives that were
held back; then the risk is taken over all documents without labels, as sums over partitions, in a
fixed number of passes. Each document's features are computed once and written.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, steps, tidy, utf8_column, written
from .labelled import learnable, remainder

#: Labelled rows to learn from at most; passes over all documents without a label.
LABELLED_ROWS, PASSES = 20_000, 10
#: Passes and step of a start without labelled negatives; steps of a score, and positives held back at least, for the prior.
START_PASSES, START_RATE, BINS, LEAST_BACK = 40, 3e-2, 200, 30
SHAPES, DENSE, HIDDEN, EPOCHS, BATCH, RATE, DECAY = 512, 10, 24, 30, 512, 3e-3, 1e-5
MOD, HELD = 3, 1

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[128:] = ord("A"), ord("a"), ord("a")
_CLASS[48:58] = ord("0")
_RUN = np.zeros(256, bool)
_RUN[[ord(c) for c in "Aa0"]] = True
_place: dict[bytes, int] = {}


def _shape_place(shape: bytes) -> int:
    got = _place.get(shape)
    if got is None:
        if len(_place) > 20_000:
            _place.clear()
        got = _place[shape] = zlib.crc32(shape) % SHAPES
    return got


def features(raw: np.ndarray, offs: np.ndarray) -> Iterator[np.ndarray]:
    """A row's vector: shares of word shapes (hashed), then counts and shares over the whole text.

    A shape has A, a, 0 for runs of capitals, other letters and digits, and other signs as they are.
    Counts and lengths enter as bounded values: past e**10 words, say, longer texts look alike.
    """
    for i, j in steps(offs):
        part = raw[offs[i]:offs[j]]
        cls = _CLASS[part]
        keep = np.ones(len(part), bool)
        keep[1:] = ~((cls[1:] == cls[:-1]) & _RUN[cls[1:]])
        starts = offs[i:j] - offs[i]
        keep[starts[starts < len(part)]] = True
        short = cls[keep]
        at = np.concatenate([[0], np.cumsum(keep)])[offs[i:j + 1] - offs[i]]
        whole, short = part.tobytes(), short.tobytes()
        for k in range(j - i):
            text = whole[offs[i + k] - offs[i]:offs[i + k + 1] - offs[i]]
            yield _vector(text, short[at[k]:at[k + 1]])


def _vector(text: bytes, shapes: bytes) -> np.ndarray:
    v = np.zeros(SHAPES + DENSE, np.float32)
    words, lines = text.split(), text.split(b"\n")
    n = len(words)
    if not n:
        v[SHAPES] = 1.0
        return v
    for shape, c in Counter(shapes.split()).items():
        v[_shape_place(shape)] += c
    v[:SHAPES] = np.sqrt(v[:SHAPES] / n)
    size = len(text)
    different = len(set(words))
    v[SHAPES + 1] = min(1.0, np.log1p(n) / 10)
    v[SHAPES + 2] = min(3.0, size / n / 10)
    v[SHAPES + 3] = np.sqrt(sum(map(eq, words, words[1:])) / n)
    v[SHAPES + 4] = different / n
    v[SHAPES + 5] = np.log(different) / np.log(n) if n > 1 else 1.0
    v[SHAPES + 6] = len(set(lines)) / len(lines)
    v[SHAPES + 7] = np.sqrt((text.count(b"|") + text.count(b"\t")) / n)
    v[SHAPES + 8] = np.sqrt(text.count(b"http") / n)
    v[SHAPES + 9] = min(1.0, len(lines) / n)
    return v


class Network:
    """One hidden layer; the output is the log-odds of a good document."""

    def __init__(self, weights: list[np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, d: int, rng: np.random.Generator) -> Network:
        f = np.float32
        return cls([(rng.standard_normal((d, HIDDEN)) / np.sqrt(d) * 3).astype(f), np.zeros(HIDDEN, f), (rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN)).astype(f), np.zeros(1, f)])

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(x @ self.w[0] + self.w[1], 0)
        return h, h @ self.w[2] + self.w[3]

    def gradient(self, x: np.ndarray, h: np.ndarray, g: np.ndarray) -> list[np.ndarray]:
        back = np.outer(g, self.w[2]) * (h > 0)
        return [x.T @ back, back.sum(0), h.T @ g, np.array([g.sum()], np.float32)]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _slopes(negative: float, zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the risk by the outputs; reversed where the estimated risk of bad documents is below zero."""
    if negative >= 0:
        return prior * (_sigmoid(zp) - 1) - prior * _sigmoid(zp), _sigmoid(zu)
    return prior * _sigmoid(zp), -_sigmoid(zu)


def _adam(net: Network, m: list[np.ndarray], s: list[np.ndarray], t: int, gradient: list[np.ndarray], rate: float = RATE) -> None:
    for k, w in enumerate(net.w):
        g = gradient[k] + DECAY * w
        m[k] = 0.9 * m[k] + 0.1 * g
        s[k] = 0.999 * s[k] + 0.001 * g * g
        w -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)


def risk_sums(vectors: DataFrame, net: Network) -> tuple[int, float, list[np.ndarray]]:
    """Over all rows: their number, the sum of losses on "bad", and the sum of its gradients.

    Sums are made by partition, then by groups of partitions, and the few groups' in the driver.
    """
    sc = vectors.sparkSession.sparkContext
    shared = sc.broadcast(net)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, n, loss, total = shared.value, 0, 0.0, None
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(0).to_pylist())
            h, z = net.forward(x)
            g = [v.astype(np.float64) for v in net.gradient(x, h, _sigmoid(z))]
            n, loss, total = n + len(x), loss + float(np.logaddexp(0, z.astype(np.float64)).sum()), g if total is None else [a + c for a, c in zip(total, g)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([pickle.dumps((n, loss, total))], pa.binary())], names=["part", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = -1, None
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part, total = k, _added(total, pickle.loads(raw))
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([pickle.dumps(total)], pa.binary())], names=["part", "sums"])

    schema = "part long, sums binary"
    rows = vectors.mapInArrow(tidy(task), schema).repartition(8, "part").sortWithinPartitions("part").mapInArrow(add, schema).collect()
    shared.unpersist()
    total = None
    for r in sorted(rows, key=lambda r: r["part"]):
        total = _added(total, pickle.loads(r["sums"]))
    return total or (0, 0.0, [np.zeros(w.shape) for w in net.w])


def _added(a: tuple | None, b: tuple) -> tuple:
    return b if a is None else (a[0] + b[0], a[1] + b[1], [x + y for x, y in zip(a[2], b[2])])


def refine(net: Network, positive: np.ndarray, vectors: DataFrame, prior: float, passes: int = PASSES, rate: float = RATE) -> Network:
    """Minimise the same risk over all rows of ``vectors`` as the unlabelled side, one step a pass."""
    m = [np.zeros_like(w) for w in net.w]
    s = [np.zeros_like(w) for w in net.w]
    for t in range(1, passes + 1):
        n, loss, total = risk_sums(vectors, net)
        if not n:
            return net
        h, z = net.forward(positive)
        negative = loss / n - prior * np.logaddexp(0, z).mean()
        gp, _ = _slopes(negative, z, z[:0], prior)
        side = 1.0 if negative >= 0 else -1.0
        a = net.gradient(positive, h, (gp / len(positive)).astype(np.float32))
        _adam(net, m, s, t, [x + (side * y / n).astype(np.float32) for x, y in zip(a, total)], rate)
    return net


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 7) -> Network:
    """Minimise prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)), logistic loss."""
    rng = np.random.default_rng(seed)
    net = Network.fresh(positive.shape[1], rng)
    m = [np.zeros_like(w) for w in net.w]
    s = [np.zeros_like(w) for w in net.w]
    t = 0
    for _ in range(EPOCHS):
        rounds = max(1, max(len(positive), len(unlabelled)) // BATCH)
        for _ in range(rounds):
            p = positive[rng.integers(0, len(positive), BATCH)]
            u = unlabelled[rng.integers(0, len(unlabelled), BATCH)]
            hp, zp = net.forward(p)
            hu, zu = net.forward(u)
            # Loss on "bad" is softplus(z), on "good" softplus(-z).
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            gp, gu = _slopes(negative, zp, zu, prior)
            a, b = net.gradient(p, hp, (gp / BATCH).astype(np.float32)), net.gradient(u, hu, (gu / BATCH).astype(np.float32))
            t += 1
            _adam(net, m, s, t, [x + y for x, y in zip(a, b)])
    return net


_ENTRY = np.dtype([("at", "<u2"), ("value", "<f2")])


def packed(v: np.ndarray) -> bytes:
    """A vector's places and values that are not zero."""
    at = np.flatnonzero(v)
    out = np.empty(len(at), _ENTRY)
    out["at"], out["value"] = at, v[at]
    return out.tobytes()


def matrix(raws: list[bytes]) -> np.ndarray:
    """The vectors of packed rows."""
    flat = np.frombuffer(b"".join(raws), _ENTRY)
    x = np.zeros((len(raws), SHAPES + DENSE), np.float32)
    x[np.repeat(np.arange(len(raws)), [len(r) // _ENTRY.itemsize for r in raws]), flat["at"]] = flat["value"]
    return x


def vectors_of(docs: DataFrame) -> DataFrame:
    """doc_id and packed vector of every document, written once."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([packed(v) for v in features(*utf8_column(b.column(1)))], pa.binary())], names=["doc_id", "v"])

    return written(docs.select("doc_id", "text").mapInArrow(tidy(task), "doc_id long, v binary"), "quality-vectors", compression="zstd")


def unlabelled_vectors(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """Vectors of all documents without a label; the join is by shuffle at every size, as labels may be many."""
    named = labels.select("doc_id").filter("doc_id IS NOT NULL").distinct().hint("merge")
    return written(vectors.join(named, "doc_id", "left_anti").select("v"), "quality-unlabelled", compression="zstd")


def score_counts(vectors: DataFrame, net: Network) -> np.ndarray:
    """How many rows have each score, in BINS steps."""
    shared = vectors.sparkSession.sparkContext.broadcast(net)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, n = np.unique(_bins(net_score(shared.value, matrix(b.column(0).to_pylist()))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], names=["bin", "n"])

    out = np.zeros(BINS, np.int64)
    for r in vectors.mapInArrow(tidy(task), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():  # BINS rows
        out[r["bin"]] = r["n"]
    return out


def net_score(net: Network, x: np.ndarray) -> np.ndarray:
    return _sigmoid(net.forward(x)[1]).astype(np.float64)


def _bins(s: np.ndarray) -> np.ndarray:
    return np.minimum((s * BINS).astype(np.int64), BINS - 1)


def class_prior(unlabelled: np.ndarray, positive: np.ndarray) -> float:
    """The positives' share among unlabelled rows, from counts of scores of both.

    Above any score, unlabelled rows are at least the positives' share times the positives above it;
    the least ratio of the two tails, with room for chance, bounds that share and is near it where
    some scores are reached by positives alone.
    """
    u, p = (np.cumsum(x[::-1])[::-1] for x in (unlabelled, positive))
    if not u[0] or not p[0]:
        return 0.5
    chance = np.sqrt(np.log(40) / (2 * p[0])) + np.sqrt(np.log(40) / (2 * u[0]))
    tail_u, tail_p = u / u[0], p / p[0]
    # The score whose bound, with chance added, is least; its plain ratio is the estimate.
    k = int(np.argmin((tail_u + chance) / np.maximum(tail_p, 1e-9)))
    return float(np.clip(tail_u[k] / tail_p[k], 0.01, 0.99))


def train(vectors: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, mod: int = MOD, held: int = HELD) -> tuple[Network | None, float]:
    """The network and the class prior; no network where there is no positive to learn from.

    With positives alone among the labels, the start is fitted by passes over the unlabelled rows.
    """
    known = learnable(labels, "quality", mod, held, labelled_rows)
    got = vectors.join(F.broadcast(known), "doc_id").select("doc_id", "label", "v").toArrow().sort_by("doc_id")  # at most labelled_rows
    x, y = matrix(got["v"].to_pylist()), got["label"].to_numpy()
    if not (y == 1).any():
        return None, 0.5
    free = unlabelled_vectors(vectors, labels)
    positive = x[y == 1]
    back = np.arange(len(positive)) % 3 == 0 if len(positive) > 2 else np.zeros(len(positive), bool)
    share = float(((y == 1).sum() + 1) / (len(y) + 2))
    if (y == 0).any():
        start = fit(positive[~back], x, share)
    else:
        share = 0.5
        start = refine(Network.fresh(x.shape[1], np.random.default_rng(7)), positive[~back], free, share, START_PASSES, START_RATE)
    counts = score_counts(free, start)
    prior = class_prior(counts, np.bincount(_bins(net_score(start, positive[back])), minlength=BINS)) if back.sum() >= LEAST_BACK and counts.sum() else share
    return refine(start, positive, free, prior), prior


def score(docs: DataFrame, labels: DataFrame, mod: int = MOD, held: int = HELD, keep: list[str] | None = None, **bounds: int) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted; and the columns named by ``keep``.

    Null and empty texts are scored by their own feature. A null doc_id is scored, never held out;
    repeated rows get the same score; with no positive label every score is 0.5. Only ``text``
    decides the score.
    """
    small_batches(docs.sparkSession)
    vectors = vectors_of(docs)
    net, _ = train(vectors, labels, mod=mod, held=held, **bounds)
    shared = docs.sparkSession.sparkContext.broadcast(net)  # one small network

    def rated(x: np.ndarray) -> pa.Array:
        return pa.array(net_score(shared.value, x) if shared.value else np.full(len(x), 0.5))

    def by_vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), rated(matrix(b.column(1).to_pylist()))], names=["doc_id", "score"])

    def by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # Rounded as the written vectors are, so that both ways give one score.
            x = matrix([packed(v) for v in features(*utf8_column(b.column(1)))])
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), rated(x), *b.columns[2:]], names=["doc_id", "score", *names])

    if keep is None:
        out = vectors.mapInArrow(tidy(by_vector), "doc_id long, score double")
    else:
        # Further columns and their texts are not joined back to the vectors: one more look at each text costs less.
        names = [f"kept_{k}" for k in range(len(keep))]
        schema = ", ".join(["doc_id long", "score double", *[f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep)]])
        out = docs.select("doc_id", "text", *[F.col(c).alias(n) for n, c in zip(names, keep)]).mapInArrow(tidy(by_text), schema)
        out = out.select("doc_id", "score", *[F.col(n).alias(c) for n, c in zip(names, keep)])
    return out.select("doc_id", F.coalesce(remainder("doc_id", mod) == held, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"), *(keep or []))
