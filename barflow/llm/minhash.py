"""Near-duplicate documents by min-max hashing with exact confirmation (operator 4).

Each permutation of a document's shingle hashes gives two signature values, the smallest and the
largest, so 64 permutations make 128 values. Bands of four values send documents to buckets. A
bucket links its members to its first document; a bucket that is not one component after that is
compared within itself. Links are confirmed on whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import runs, small_batches, tidy, utf8_column, written
from .graph import components
from .shingles import mix, sets

WORDS, PERMUTATIONS, BAND_VALUES = 5, 64, 4
BANDS = 2 * PERMUTATIONS // BAND_VALUES
#: Links: 100 * intersection >= SHARE * union.
SHARE = 75
#: Pairs whose 128 signature bytes agree less than this have a similarity of 0.75 with odds under 1e-6.
LEAST_ESTIMATE = 0.53
#: Further permutations for documents of open buckets: 512 values, so the same odds allow a closer bound.
MORE_PERMUTATIONS, LEAST_CLOSE_ESTIMATE = 256, 0.66
#: Members of a bucket that one block of its inner comparison holds.
BLOCK = 2048

_rng = np.random.default_rng(20240131)
_A = _rng.integers(0, 1 << 63, PERMUTATIONS + MORE_PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, PERMUTATIONS + MORE_PERMUTATIONS, np.uint64)


def signature(shingles: np.ndarray, which: slice = slice(0, PERMUTATIONS)) -> np.ndarray:
    """Smallest and largest value of the set under each permutation, side by side."""
    a, b = _A[which], _B[which]
    low, high = np.full(len(a), ~np.uint64(0)), np.zeros(len(a), np.uint64)
    for at in range(0, len(shingles), 1024):
        v = shingles[at:at + 1024, None] * a + b
        np.minimum(low, v.min(0), out=low)
        np.maximum(high, v.max(0), out=high)
    return np.stack([low, high], 1).reshape(-1)


def band_values(signature: np.ndarray) -> np.ndarray:
    """A row of four values for each band: two minima and two maxima, of four permutations.

    The minimum and the maximum of one permutation are not independent in small sets, so they never
    stand in one band; a pair of similarity s then shares a band with odds near s ** 4.
    """
    low, high = signature[0::2], np.roll(signature[1::2], PERMUTATIONS // 2)
    return np.stack([low[0::2], low[1::2], high[0::2], high[1::2]], 1)


def _top_bytes(values: np.ndarray) -> bytes:
    return (values >> np.uint64(56)).astype(np.uint8).tobytes()


def _estimate(same: np.ndarray) -> np.ndarray:
    """Similarity from the share of equal signature bytes, less chance hits."""
    return (same - 1 / 256) / (1 - 1 / 256)


_FEATURES = "doc_id long, n_shingles long, h1 long, h2 long, sig binary, bands array<long>"


def features(docs: DataFrame) -> DataFrame:
    """Per document: set size, two hashes of the set, a byte of each signature value, band keys."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.arange(BANDS, dtype=np.uint64)
        for b in batches:
            n, h1, h2, sig, bands = [], [], [], [], []
            for s in sets(*utf8_column(b.column(1)), WORDS):
                n.append(len(s))
                m = mix(s)
                h1.append(m.sum(dtype=np.uint64))
                h2.append(mix(m ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64))
                if not len(s):
                    sig.append(b"")
                    bands.append(np.zeros(0, np.int64))
                    continue
                v = mix(signature(s))
                sig.append(_top_bytes(v))
                key = number
                for column in band_values(v).T:
                    key = mix(key * np.uint64(0x5851F42D4C957F2D) + column)
                bands.append(key.view(np.int64))
            lens = np.cumsum([0] + [len(x) for x in bands]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(np.array(h1, np.uint64).view(np.int64)), pa.array(np.array(h2, np.uint64).view(np.int64)),
                pa.array(sig, pa.binary()), pa.ListArray.from_arrays(pa.array(lens), pa.array(np.concatenate([np.zeros(0, np.int64), *bands])))],
                names=["doc_id", "n_shingles", "h1", "h2", "sig", "bands"])

    return docs.select("doc_id", "text").mapInArrow(tidy(task), _FEATURES)


def _bytes_matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(col), -1)


def _likely(pairs: DataFrame, feats: DataFrame) -> DataFrame:
    """Pairs whose set sizes and signatures allow a link; adds nothing else."""
    a = feats.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("sig").alias("sa"))
    b = feats.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("sig").alias("sb"))
    # Map-side, the sizes alone drop pairs before signatures meet.
    sized = pairs.join(b, "b").join(a, "a").filter(100 * F.least("na", "nb") >= SHARE * F.greatest("na", "nb"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if not t.num_rows:
                continue
            e = _estimate((_bytes_matrix(t.column(2)) == _bytes_matrix(t.column(3))).mean(1))
            keep = e >= LEAST_ESTIMATE
            yield pa.RecordBatch.from_arrays([t.column(0).filter(pa.array(keep)), t.column(1).filter(pa.array(keep)), pa.array(e[keep])], names=["a", "b", "estimate"])

    return sized.select("a", "b", "sa", "sb").mapInArrow(tidy(task), "a long, b long, estimate double")


def _confirmed(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    """The pairs that link on their whole sets."""
    full = (pairs.select("a", "b").join(shingles.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a")
            .join(shingles.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b").select("a", "b", "sa", "sb"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = np.zeros(t.num_rows, bool)
            for k, (x, y) in enumerate(zip(t.column(2), t.column(3))):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = np.sort(np.concatenate([x, y]))
                inter = int((both[1:] == both[:-1]).sum())
                keep[k] = 100 * inter >= SHARE * (len(both) - inter)
            yield pa.RecordBatch.from_arrays([t.column(0).filter(pa.array(keep)), t.column(1).filter(pa.array(keep))], names=["a", "b"])

    return full.mapInArrow(tidy(task), "a long, b long")


def _shingle_table(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Sorted shingle hashes and the longer signature of the documents in ``ids``; of rows that share a doc_id one."""
    more = slice(PERMUTATIONS, PERMUTATIONS + MORE_PERMUTATIONS)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                found = list(sets(*utf8_column(part.column(1)), WORDS))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([len(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary()), pa.array([_top_bytes(mix(signature(s, more))) for s in found], pa.binary())],
                                                 names=["doc_id", "n", "s", "sig"])

    return docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").mapInArrow(tidy(task), "doc_id long, n long, s binary, sig binary").dropDuplicates(["doc_id"])


def _inner_pairs(rows: DataFrame) -> DataFrame:
    """Likely pairs of different components within buckets: rows are (key, m, id, component, n, sig, bands).

    A pair that shares several buckets is told by that of its first common band alone.
    A large bucket is cut into blocks of about BLOCK members, and each pair of blocks is a group of
    its own, so no task holds a whole bucket.
    """
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id", "key"), blocks.cast("long")).cast("int")
    dealt = (rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
             .withColumn("g", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
             .withColumn("side", F.when(F.col("own") < F.col("other"), 0).when(F.col("own") > F.col("other"), 1).otherwise(2)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "g", 4096):
            g, key, ids, comp, n, side = (t[c].to_numpy() for c in ("g", "key", "id", "component", "n", "side"))
            sig = _bytes_matrix(t["sig"])
            bands = t["bands"].combine_chunks().flatten().to_numpy().reshape(len(g), BANDS)
            cuts = [*np.flatnonzero(np.diff(g, prepend=g[0] - 1)).tolist(), len(g)]
            out_a, out_b = [], []
            for x, z in zip(cuts, cuts[1:]):
                for k in range(x, z):
                    o = np.arange(x, z)
                    o = o[(comp[o] > comp[k]) & ((side[k] == 2) | (side[o] != side[k])) & (100 * np.minimum(n[o], n[k]) >= SHARE * np.maximum(n[o], n[k]))]
                    if len(o):
                        o = o[_estimate((sig[o] == sig[k]).mean(1)) >= LEAST_CLOSE_ESTIMATE]
                        o = o[bands[k][(bands[o] == bands[k]).argmax(1)] == key[k]]
                        out_a += [ids[k]] * len(o)
                        out_b += ids[o].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return (dealt.select("g", "key", "id", "component", "n", "side", "sig", "bands").repartition("g").sortWithinPartitions("g")
            .mapInArrow(tidy(task), "a long, b long").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Null and empty texts, and texts of blanks, have no shingles and link with nothing. A null
    doc_id links with nothing, has a null component and is kept. Rows that share a doc_id are one
    node. Ties have no order to settle; very long texts are hashed whole; no rows give no rows. Only ``doc_id`` and ``text`` are read. Documents with equal sets are one class from the
    start, so groups of copies are never compared among themselves.
    """
    small_batches(docs.sparkSession)
    feats = written(features(docs), "minhash")
    some = feats.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = some.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c"))
    copies = written(some.join(classes.filter("c > 1").select("h1", "h2", "rep"), ["h1", "h2"]).filter("doc_id <> rep").select("doc_id", "rep").distinct(), "copies")
    reps = some.join(copies, "doc_id", "left_anti")

    rows = reps.select("doc_id", F.explode("bands").alias("key"))
    buckets = rows.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m")).filter("m > 1")
    buckets = written(rows.join(buckets, "key").select("key", "m", F.col("doc_id").alias("id"), "rep"), "buckets")

    stars = buckets.filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct()
    slim = reps.select("doc_id", "n_shingles", "sig").dropDuplicates(["doc_id"])
    banded = reps.select(F.col("doc_id").alias("id"), "bands").dropDuplicates(["id"])
    likely = written(_likely(stars, slim), "likely")
    ids = likely.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(buckets.filter("m > 2").select(F.col("id").alias("doc_id"))).distinct()
    shingles = written(_shingle_table(docs, ids), "shingles")

    # First each document's likeliest partner; most others then lie in one component already.
    best = likely.groupBy("a").agg(F.max_by("b", F.struct("estimate", -F.col("b"))).alias("b"))
    links = written(_confirmed(best, shingles), "links")
    comp = components(links)
    label = lambda df, c: df.join(comp.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}")), c, "left").withColumn(f"c_{c}", F.coalesce(f"c_{c}", c))
    rest = label(label(likely.join(best, ["a", "b"], "left_anti"), "a"), "b").filter("c_a <> c_b").select("a", "b")
    # Then buckets whose members still lie in different components, compared within themselves.
    open_rows = label(buckets.filter("m > 2").select("key", "m", "id"), "id").withColumnRenamed("c_id", "component")
    open_keys = open_rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    inner = _inner_pairs(open_rows.join(open_keys, "key").join(shingles.select(F.col("doc_id").alias("id"), "n", "sig"), "id").join(banded, "id"))
    more = written(_confirmed(rest.unionByName(inner).distinct(), shingles), "links")
    # Components of components, and of copies with their first.
    merged = components(links.unionByName(more).unionByName(copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))))
    out = feats.select("doc_id", "n_shingles").join(merged.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
