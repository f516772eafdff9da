"""Hard negatives of embeddings by Fagin's threshold algorithm (operator 12).

Rows are dealt to blocks by a hash of their id, so a label with a third of all rows spreads like any
other. A block keeps, for each dimension, its rows sorted by component. An anchor reads those lists
from the end that its component's sign favours (sorted access), scores every row it meets by the
whole integer inner product (random access), and stops once the threshold, the score of a row that
would stand at every list's present place, falls strictly below the kth score of each of its
windows: no unseen row can then enter one, not even by a tie. Blocks' best rows meet in a small
ranking per anchor.

The first search finds the positives among rows of the anchor's label (one window, without bounds);
their scores bound the windows of the second, among all other labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import runs, small_batches, tidy, written

ANCHOR_EVERY, SHIFT_EVERY, LABELS, SCALE = 50, 7, 10, 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score in hundredths of the positive's.
LOW, HIGH = 50, 95
#: Components of a block, and anchors that travel together.
BLOCK, PACK = 1 << 19, 256
#: Places of every list that the first round reads; each further round reads three times as many.
DEPTH = 16
#: Integer vectors of this squared length or more take no part, so that a hundred scores fit a long.
LONGEST = 2.0 ** 56
_FAR = 1 << 62


def rows(vectors: DataFrame) -> DataFrame:
    """vec_id, label (shifted where the rule says so) and integer components of the rows that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0 ** 28 / SCALE))
    v = v.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("e") > 0) & fine)
    label = F.when(F.col("vec_id") % SHIFT_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    q = v.select("vec_id", label.alias("label"), F.transform("e", lambda x: F.floor(x * SCALE)).alias("q"))
    q = q.filter(F.aggregate("q", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")) < LONGEST)
    # Rows of one id are one row.
    return q.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("r")).select("vec_id", "r.label", "r.q")


_PACKED = "part long, pack int, kind int, d int, ids binary, labels binary, matrix binary, bounds binary"


def _packed(dealt: DataFrame, kind: int, most: int | None = None) -> DataFrame:
    """A part's rows of one length as one row of arrays, or as several of ``most`` rows at most."""
    d = dealt if "bounds" in dealt.columns else dealt.withColumn("bounds", F.array().cast("array<bigint>"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "part", 1):
            t = t.combine_chunks()
            part, q = t["part"].to_numpy(), t["q"].chunk(0)
            size = np.diff(q.offsets.to_numpy())
            flat = lambda c, at: pa.array([c.take(at).to_numpy(zero_copy_only=False).astype("<i8").tobytes()], pa.binary())
            lists = lambda c, at: pa.array([c.take(at).flatten().to_numpy(zero_copy_only=False).astype("<i8").tobytes()], pa.binary())
            for p in np.unique(part).tolist():
                for d in np.unique(size[part == p]).tolist():
                    k = np.flatnonzero((part == p) & (size == d))
                    for n, i in enumerate(range(0, len(k), most or len(k))):
                        at = pa.array(k[i:i + (most or len(k))])
                        yield pa.RecordBatch.from_arrays([
                            pa.array([p]), pa.array([n], pa.int32()), pa.array([kind], pa.int32()), pa.array([d], pa.int32()),
                            flat(t["vec_id"].chunk(0), at), flat(t["label"].chunk(0), at), lists(q, at), lists(t["bounds"].chunk(0), at)], names=["part", "pack", "kind", "d", "ids", "labels", "matrix", "bounds"])

    return d.select("part", "vec_id", "label", "q", "bounds").repartition("part").sortWithinPartitions("part", "vec_id").mapInArrow(tidy(task), _PACKED)


class Windows:
    """The best ``k`` rows of each of several score ranges, both ends included."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        #: The score under which a row is of no use to a window: of its kth row, or its lower end.
        self.kth = low.copy()
        self.top = high.max()

    def useful(self, scores: np.ndarray) -> np.ndarray:
        return np.flatnonzero((scores >= self.kth.min()) & (scores <= self.top))

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take rows in and keep those that are among a window's best; ties go to the smaller id."""
        s, i = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((i, -s))
        s, i = s[order], i[order]
        # Scores fall, so a window is a range of places.
        first = np.searchsorted(-s, -self.high, "left")
        last = np.minimum(np.searchsorted(-s, -self.low, "right"), first + self.k)
        edge = np.zeros(len(s) + 1, np.int64)
        np.add.at(edge, first, 1)
        np.add.at(edge, np.maximum(first, last), -1)
        self.kth = np.where(last - first >= self.k, s[np.clip(last - 1, 0, len(s) - 1)], self.low)
        keep = np.cumsum(edge[:-1]) > 0
        self.scores, self.ids = s[keep], i[keep]


class SortedLists:
    """Rows with, for each dimension, their order by component; scores are exact integers."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        self.ids, self.ints, self.floats = ids, matrix, matrix.astype(np.float64)
        order = np.argsort(matrix.T, 1, kind="stable")
        self.values = np.take_along_axis(matrix.T, order, 1)
        self.order = order.astype(np.int32)
        self.length = float(np.sqrt((self.floats ** 2).sum(1).max(initial=0.0)))

    def search(self, a: np.ndarray, w: Windows, allowed: np.ndarray) -> None:
        """Put into ``w`` the rows that ``allowed`` marks and that belong to its windows."""
        m = len(self.ids)
        up, down = np.flatnonzero(a > 0), np.flatnonzero(a < 0)
        # Doubles hold scores exactly as long as products of lengths stay under 2**52.
        small = float(np.sqrt((a.astype(np.float64) ** 2).sum())) * self.length < 2.0 ** 52
        matrix, vector = (self.floats, a.astype(np.float64)) if small else (self.ints, a)
        seen = np.zeros(m, bool)
        at, step = 0, DEPTH
        while at < m:
            # The threshold: no row at or below this place of every list scores more.
            if (a[up] * self.values[up, m - 1 - at]).sum() + (a[down] * self.values[down, at]).sum() < w.kth.min():
                return
            to = min(m, at + step)
            met = np.zeros(m, bool)
            if len(up) + len(down):
                met[self.order[up, m - to:m - at].ravel()] = True
                met[self.order[down, at:to].ravel()] = True
            else:
                met[:] = True  # no component counts: every score is 0
            new = np.flatnonzero(met & ~seen)
            if len(new):
                seen |= met
                scores = ((matrix if len(new) == m else matrix[new]) @ vector).astype(np.int64)
                near = w.useful(scores)
                near = near[allowed[new[near]]]
                if len(near):
                    w.add(scores[near], self.ids[new[near]])
                if seen.all():
                    return
            at, step = to, step * 3


def _array(cell: pa.Scalar, shape: tuple = (-1,)) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), "<i8").reshape(shape)


def _meetings(blocks: DataFrame, packs: DataFrame, parts: int) -> DataFrame:
    """Every block, followed by all packs of anchors, in one partition: the query set against all rows, in blocks.

    Anchors alone are copied, a row for each pack and block.
    """
    sent = packs.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return blocks.unionByName(sent.select(blocks.columns)).repartition("part").sortWithinPartitions("part", "kind")


def _searched(meet: DataFrame, find, schema: str) -> DataFrame:
    """What ``find`` gives for each pack and the block it meets; one block's lists are held, and one pack."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, {}
        for b in batches:
            for i in range(b.num_rows):
                row = {n: b.column(k)[i] for k, n in enumerate(b.schema.names)}
                if row["part"].as_py() != part:
                    part, held = row["part"].as_py(), {}
                d = row["d"].as_py()
                ids, labels, matrix = _array(row["ids"]), _array(row["labels"]), _array(row["matrix"], (-1, d))
                if row["kind"].as_py() == 0:
                    held[d] = (ids, labels, matrix, {})
                elif d in held:
                    found = [(np.full(len(w.ids), a), w.ids, w.scores) for a, w in find(held[d], ids, labels, matrix, _array(row["bounds"]))]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["anchor_id", "other_id", "score"])

    return meet.mapInArrow(tidy(task), schema)


_FOUND = "anchor_id long, other_id long, score long"


def _same_label(held, ids, labels, matrix, bounds) -> Iterator[tuple[int, Windows]]:
    """Each anchor's best rows of its own label in the block."""
    block_ids, block_labels, block, lists = held
    for a, label, vector in zip(ids.tolist(), labels.tolist(), matrix):
        if label not in lists:
            at = np.flatnonzero(block_labels == label)
            lists[label] = SortedLists(block_ids[at], block[at])
        own = lists[label]
        w = Windows(np.array([-_FAR]), np.array([_FAR]), POSITIVES)
        own.search(vector, w, own.ids != a)
        yield a, w


def _other_labels(held, ids, labels, matrix, bounds) -> Iterator[tuple[int, Windows]]:
    """Each anchor's best rows of other labels in the block, a window for each positive."""
    block_ids, block_labels, block, lists = held
    if not lists:
        lists[None] = SortedLists(block_ids, block)
    for a, label, vector, (low, high) in zip(ids.tolist(), labels.tolist(), matrix, bounds.reshape(-1, 2, POSITIVES)):
        live = low <= high
        if live.any():
            w = Windows(low[live], high[live], NEGATIVES)
            lists[None].search(vector, w, block_labels != label)
            yield a, w


def positives(blocks: DataFrame, packs: DataFrame, parts: int) -> DataFrame:
    """anchor_id, positive_id, positive_score: an anchor's first rows of its label."""
    found = _searched(_meetings(blocks, packs, parts), _same_label, _FOUND)
    w = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "other_id")
    return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= POSITIVES).select("anchor_id", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))


def _bounds(best: DataFrame) -> DataFrame:
    """vec_id, and the ends of an anchor's windows: all lower ones, then all upper ones; places without a window hold 1 and 0."""
    score = F.col("positive_score")
    ends = best.filter(score >= 0).groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(score).alias("s"))
    filled = lambda x, other: F.concat(x, F.array_repeat(F.lit(other).cast("long"), POSITIVES - F.size("s")))
    low, high = F.transform("s", lambda x: F.call_function("div", LOW * x + 99, F.lit(100))), F.transform("s", lambda x: F.call_function("div", HIGH * x, F.lit(100)))
    return ends.select("vec_id", F.concat(filled(low, 1), filled(high, 0)).alias("bounds"))


def mine(vectors: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows without vec_id, label or vector, with an empty vector, or with null or non-finite
    components take no part, nor do those whose integer vector is 2**28 long or longer, whose scores
    a long might not hold. Rows that share a vec_id are one row, that of the least label, then the
    least vector. Vectors of different lengths have no score. Ties go to the smaller vec_id. Anchors
    without a positive or a negative give no rows, and so do empty tables. Other columns are not read.
    """
    small_batches(vectors.sparkSession)
    v = written(rows(vectors), "negatives-rows")
    many, few = v.agg(F.sum(F.size("q")), F.sum(F.when(F.col("vec_id") % ANCHOR_EVERY == 0, 1))).first()
    parts, groups = max(1, -(-(many or 0) // BLOCK)), max(1, -(-(few or 0) // PACK))
    dealt = lambda d, n: d.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(n)))
    blocks = written(_packed(dealt(v, parts), 0), "negatives-blocks")
    anchors = dealt(v.filter(F.col("vec_id") % ANCHOR_EVERY == 0), groups)
    best = written(positives(blocks, _packed(anchors, 1, PACK), parts), "negatives-positives")
    bounded = anchors.join(_bounds(best), "vec_id")
    found = _searched(_meetings(blocks, _packed(bounded, 1, PACK), parts), _other_labels, _FOUND)
    p, s = F.col("positive_score"), F.col("score")
    w = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "other_id")
    pairs = best.join(found, "anchor_id").filter((LOW * p <= 100 * s) & (100 * s <= HIGH * p))
    return (pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= NEGATIVES)
            .select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", s.alias("negative_score")))
