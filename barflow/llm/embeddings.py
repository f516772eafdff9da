"""Near-duplicate embeddings by cross-polytope hashing with exact confirmation (operator 6).

A vector is rotated by fast Hadamard transforms with random signs; its hash is the signed axis
nearest to it. A table joins two such hashes; the two nearest axes of each give four buckets
(multiprobe). Vectors in one bucket are compared by their cosine in double precision. A pair that
meets in several buckets counts in the first one alone, so pairs are never gathered. Only ids and
keys are grouped to find the buckets of two or more; a vector then goes, in its own precision and
with its hashes, to those alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import runs, small_batches, tidy, written
from .graph import components

TABLES, PROBES, LEAST_COSINE = 6, 2, 0.93
#: Members of a bucket that one block of its comparison holds.
BLOCK = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def axes(x: np.ndarray) -> np.ndarray:
    """For each row, table and hash: the PROBES nearest signed axes, nearest first."""
    n, d = x.shape
    size = 1 << max(1, (d - 1).bit_length())
    wide = np.zeros((n, size))
    wide[:, :d] = x
    rng = np.random.default_rng(size)
    out = np.zeros((n, TABLES, 2, PROBES), np.int64)
    for t in range(TABLES):
        for f in range(2):
            y = wide
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], size))
            top = np.argsort(-np.abs(y), 1, kind="stable")[:, :PROBES]
            out[:, t, f, :top.shape[1]] = 2 * top + (np.take_along_axis(y, top, 1) < 0)
    return out


def _matrix(col: pa.ChunkedArray | pa.Array, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), dtype).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _dealt(reps: DataFrame) -> DataFrame:
    """A row for each vector and bucket: the bucket's key, and its table and axes in one number."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, per = b.num_rows, TABLES * PROBES * PROBES
            if not n:
                continue
            a = _codes(b.column(3))
            first = np.repeat(a[:, :, 0], PROBES, 2).reshape(n, per)
            second = np.tile(a[:, :, 1], (1, 1, PROBES)).reshape(n, per)
            table = np.tile(np.repeat(np.arange(TABLES), PROBES * PROBES), (n, 1))
            row = pa.array(np.repeat(np.arange(n), per))
            place = (table | first << _X1 | second << _X2).reshape(-1)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(row) for c in (0, 1, 2)), pa.array(place)], names=["id", "label", "d", "place"])

    d = reps.select("id", "label", "d", "codes").mapInArrow(tidy(task), "id long, label long, d long, place long")
    return d.select("id", "place", F.xxhash64("label", "d", "place").alias("key"))


#: Bits of a place: table, then the two axes, then the side of a block pair.
_X1, _X2, _SIDE = 8, 28, 48
_AXIS = (1 << 20) - 1


def _codes(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), "<i4").reshape(len(col), TABLES, 2, PROBES).astype(np.int64)


def _links_in(ids, mult, x, code, t, x1, x2, side) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one block pair of a bucket: id, weight of links first met here, smallest id linked."""
    n = len(ids)
    counts, root = np.zeros(n, np.int64), ids.copy()
    linked_a, linked_b = [], []
    for at in range(0, n, BLOCK):
        rows = slice(at, min(at + BLOCK, n))
        i, j = np.nonzero(x[rows] @ x.T >= LEAST_COSINE)
        i = i + at
        keep = (i < j) & ((side[i] == 2) | (side[i] != side[j]))
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        linked_a.append(i)
        linked_b.append(j)
        new = np.ones(len(i), bool)
        shared = []
        for k in range(t + 1):
            both = [(code[i, k, f][:, :, None] == code[j, k, f][:, None, :]) for f in range(2)]
            if k < t:
                new &= ~(both[0].any((1, 2)) & both[1].any((1, 2)))
            else:
                shared = both
        # In this table a pair may share several buckets; the one of the smallest axes counts it.
        for f, mine in ((0, x1), (1, x2)):
            least = np.where(shared[f].any(2), code[i, t, f], np.iinfo(np.int64).max).min(1)
            new &= least == mine
        np.add.at(counts, i[new], mult[j[new]])
        np.add.at(counts, j[new], mult[i[new]])
    if linked_a:
        a, b = np.concatenate(linked_a), np.concatenate(linked_b)
        while True:
            low = np.minimum(root[a], root[b])
            before = root.copy()
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            if (before == root).all():
                break
    return counts, root, np.flatnonzero((counts > 0) | (root != ids))


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """Per row of ``vectors(vec_id, embedding, label)``: vec_id, n_links, component_id, kept.

    Pairs of equal, non-null labels and equal length link at a cosine of at least 0.93. Vectors
    that are null, empty, zero, or hold null or non-finite components, and rows without a label or
    vec_id, link with nothing; a null vec_id has a null component and is kept. Equal vectors of a
    label are one class from the start, linked with each other; a repeated row counts as another
    vector of its class, and ties have no order to settle. Vectors may be of any length up to 500,000.
    No rows give no rows. Other columns are not read.
    """
    small_batches(vectors.sparkSession, 2000)
    v = vectors.select("vec_id", F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    fine = (F.size("e") > 0) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    v = v.withColumn("ok", F.coalesce(fine & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)))
    # -0.0 and 0.0 hash alike once added to 0.0.
    same = F.transform("e", lambda x: x + F.lit(0.0))
    v = v.withColumn("h1", F.when(F.col("ok"), F.xxhash64("label", same))).withColumn("h2", F.when(F.col("ok"), F.xxhash64(F.lit(7), same, "label")))
    classes = written(v.filter("ok").groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("mult")), "embedding-classes")

    single = vectors.schema["embedding"].dataType.elementType.typeName() == "float"
    dtype = "<f4" if single else "<f8"

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = b.column(2)
            flat, dims = e.flatten().to_numpy(zero_copy_only=False), np.diff(e.offsets.to_numpy()).astype(np.int64)
            at = np.cumsum(dims) - dims
            for d in np.unique(dims).tolist():
                k = np.flatnonzero(dims == d)
                x = flat[at[k][:, None] + np.arange(d)]
                codes, raw = axes(_unit(x)).astype("<i4"), x.astype(dtype)
                row = pa.array(k)
                yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array([r.tobytes() for r in raw], pa.binary()), pa.array(np.full(len(k), d)), b.column(3).take(row), pa.array([c.tobytes() for c in codes], pa.binary())],
                                                 names=["id", "label", "v", "d", "mult", "codes"])

    reps = (v.filter("ok").join(classes, ["h1", "h2"]).filter("vec_id = id").dropDuplicates(["id", "h1", "h2"])
            .select("id", "label", "e", "mult").mapInArrow(tidy(packed), "id long, label long, v binary, d long, mult long, codes binary"))
    reps = written(reps, "embedding-reps")
    dealt = written(_dealt(reps), "embedding-keys", compression="zstd")
    sizes = dealt.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    # Vectors meet only in buckets of two or more; a large bucket is cut into pairs of blocks.
    rows = dealt.join(sizes, "key").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    rows = (rows.withColumn("own", F.pmod(F.xxhash64("id", "key"), F.col("blocks").cast("long")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("g", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
            .withColumn("side", F.when(F.col("own") < F.col("other"), 0).when(F.col("own") > F.col("other"), 1).otherwise(2)))
    rows = rows.select("g", "id", F.col("place").bitwiseOR(F.shiftleft(F.col("side").cast("long"), _SIDE)).alias("place")).join(reps.select("id", "v", "d", "mult", "codes"), "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "g", 8192):
            g, ids, place, d, mult = (t[c].to_numpy() for c in ("g", "id", "place", "d", "mult"))
            cuts = [*np.flatnonzero(np.diff(g, prepend=g[0] - 1)).tolist(), len(g)]
            out = [(np.zeros(0, np.int64),) * 3]
            for a, z in zip(cuts, cuts[1:]):
                if z - a < 2:
                    continue
                x = _unit(_matrix(t["v"].slice(a, z - a), dtype).reshape(z - a, int(d[a])))
                sure = x @ x.T if z - a <= 64 else None
                if sure is not None and not (np.triu(sure, 1) >= LEAST_COSINE).any():
                    continue
                tab, x1, x2 = int(place[a]) & 0xFF, int(place[a]) >> _X1 & _AXIS, int(place[a]) >> _X2 & _AXIS
                c, root, who = _links_in(ids[a:z], mult[a:z], x, _codes(t["codes"].slice(a, z - a)), tab, x1, x2, place[a:z] >> _SIDE)
                out.append((ids[a:z][who], c[who], root[who]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["id", "links", "root"])

    found = written(rows.select("g", "id", "place", "d", "mult", "v", "codes").repartition("g").sortWithinPartitions("g")
                    .mapInArrow(tidy(compare), "id long, links long, root long"), "embedding-links")
    comp = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    known = (classes.join(links, "id", "left").join(comp.withColumnRenamed("node", "id"), "id", "left")
             .select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    out = v.select("vec_id", "h1", "h2").join(known, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
