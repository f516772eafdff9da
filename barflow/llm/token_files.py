"""Token ids in files compressed by Re-Pair, with random access by document (operator 10).

A shard holds documents in order, a file the shards of one task, one after the other; the manifest
says where each begins. Frequent pairs of neighbouring symbols are replaced by new symbols until
none is left; a shard keeps each rule's two symbols and the number of ids it expands to. No rule
spans a document's end, so a document's symbols are contiguous.

Layout of a shard, all little-endian: ``RPAIR001``; eight 64-bit numbers (first rule's symbol, rules,
documents, symbols, bytes a symbol, ids, 0, 0); rules as pairs of 32-bit symbols; expansion lengths
(32-bit); doc ids (64-bit); a byte for each document, 1 where the doc id is null; the documents'
first symbols and first ids (64-bit, one more than documents); the symbols.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import open_uri, shared_dir, small_batches, tidy, utf8_column
from .tokens import END_ID, first_free_id, word_ids

MAGIC = b"RPAIR001"
#: Ids of a shard at most (one document at least).
SHARD_IDS = 1 << 20
#: Words that a writing task remembers; its table then takes about 140 MB.
WORDS = 2 << 20
#: Pairs with fewer places get no rule: it would take more room than it saves.
LEAST_COUNT = 16

MANIFEST = "path string, at long, bytes long, partition int, shard int, n_docs long, n_ids long, n_symbols long, n_rules long"


def _frequent(pair: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places whose pair has LEAST_COUNT places or more, their pairs' ranks, and the pairs, most frequent first.

    In a run of one symbol every second place counts, as overlapping ones cannot both be replaced.
    """
    bits = int(np.clip(int(len(pair)).bit_length() + 1, 10, 22))
    bucket = (pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    # A pair is no more frequent than its bucket, so most rare ones go before any sort.
    may = np.flatnonzero((np.bincount(bucket, minlength=1 << bits) >= LEAST_COUNT)[bucket])
    pair, at = pair[may], at[may]
    twin = np.flatnonzero((pair >> np.uint64(32)) == (pair & np.uint64(0xFFFFFFFF)))
    if len(twin):
        k = np.arange(len(twin))
        fresh = np.concatenate([[True], np.diff(at[twin]) > 1])
        second = (k - np.maximum.accumulate(np.where(fresh, k, 0))) % 2 == 1
        stay = np.ones(len(at), bool)
        stay[twin[second]] = False
        pair, at = pair[stay], at[stay]
    pairs, of, count = np.unique(pair, return_inverse=True, return_counts=True)
    order = np.lexsort((pairs, -count))
    rank = np.empty(len(pairs), np.int64)
    rank[order] = np.arange(len(pairs))
    n = int((count >= LEAST_COUNT).sum())
    rank = rank[of]
    keep = rank < n
    return at[keep], rank[keep], pairs[order[:n]]


def grammar(ids: np.ndarray, first_rule: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols after Re-Pair and the rules' pairs, until no pair has LEAST_COUNT places.

    A round counts all pairs that may be frequent and replaces, most frequent pair first, every
    place that no better pair overlaps; a pair left with fewer than LEAST_COUNT places waits. The
    best pair always gets all its places, so each round makes a rule. Only places beside new
    symbols, and frequent ones that had to wait, are looked at again: other pairs only get rarer.
    """
    seq, rules = ids.astype(np.uint32), []
    at = np.arange(max(0, len(seq) - 1))
    while True:
        at = at[(seq[at] != END_ID) & (seq[at + 1] != END_ID)]
        if len(at) < LEAST_COUNT:
            break
        at, rank, pairs = _frequent(seq[at].astype(np.uint64) << np.uint64(32) | seq[at + 1], at)
        if not len(at):
            break
        best = np.full(len(seq) + 1, len(pairs), np.int32)
        best[at] = rank
        won = (best[at] < best[at - 1]) & (best[at] < best[at + 1])  # place -1 is the spare last one
        used = np.bincount(rank[won], minlength=len(pairs)) >= LEAST_COUNT
        won &= used[rank]
        name = np.zeros(len(pairs), np.uint32)
        name[used] = first_rule + len(rules) + np.arange(int(used.sum()))
        rules.extend(zip((pairs[used] >> np.uint64(32)).tolist(), (pairs[used] & np.uint64(0xFFFFFFFF)).tolist()))
        taken, waiting = at[won], at[~won]
        stay = np.ones(len(seq), bool)
        stay[taken + 1] = False
        seq[taken] = name[rank[won]]
        new = np.cumsum(stay) - 1
        seq = seq[stay]
        look = np.zeros(len(seq) + 1, bool)
        look[new[taken]] = look[new[taken] - 1] = True
        look[new[waiting[stay[waiting]]]] = True
        at = np.flatnonzero(look[:max(0, len(seq) - 1)])
    return seq, np.array(rules, np.uint32).reshape(-1, 2)


def expansions(rules: np.ndarray, first_rule: int) -> list[np.ndarray]:
    """Ids of each rule; a rule's symbols are ids or earlier rules."""
    out: list[np.ndarray] = []
    part = lambda s: np.array([s], np.uint32) if s < first_rule else out[s - first_rule]
    for x, y in rules.tolist():
        out.append(np.concatenate([part(x), part(y)]))
    return out


def expand(seq: np.ndarray, rules: np.ndarray, first_rule: int, exp: list[np.ndarray] | None = None) -> np.ndarray:
    """The ids that symbols stand for."""
    exp = expansions(rules, first_rule) if exp is None else exp
    size = np.array([len(x) for x in exp], np.int64)
    flat = np.concatenate([*exp, np.zeros(0, np.uint32)])
    at = np.cumsum(size) - size
    seq = seq.astype(np.int64)
    rule = seq >= first_rule
    n = np.ones(len(seq), np.int64)
    n[rule] = size[seq[rule] - first_rule]
    to = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), np.uint32)
    out[to[~rule]] = seq[~rule]
    m = n[rule]
    step = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
    out[np.repeat(to[rule], m) + step] = flat[np.repeat(at[seq[rule] - first_rule], m) + step]
    return out


def shard_bytes(doc_ids: pa.Array, ids: np.ndarray, offs: np.ndarray, first_rule: int) -> tuple[bytes, int, int]:
    """A shard, and its numbers of symbols and rules."""
    seq, rules = grammar(ids, first_rule)
    lengths = np.array([len(x) for x in expansions(rules, first_rule)], "<u4")
    ends = np.flatnonzero(seq == END_ID) + 1
    # An END_ID within a text would be a symbol too; documents end where their last one stands.
    if len(ends) != len(offs) - 1:
        ends = ends[np.searchsorted(np.flatnonzero(ids == END_ID), offs[1:] - 1)]
    starts = np.concatenate([[0], ends]).astype("<i8")
    small = first_rule + len(rules) <= 1 << 16
    body = seq.astype("<u2" if small else "<u4").tobytes()
    head = np.array([first_rule, len(rules), len(doc_ids), len(seq), 2 if small else 4, len(ids), 0, 0], "<i8")
    blob = b"".join([MAGIC, head.tobytes(), rules.astype("<u4").tobytes(), lengths.tobytes(),
                     doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(),
                     doc_ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(),
                     starts.tobytes(), offs.astype("<i8").tobytes(), body])
    return blob, len(seq), len(rules)


class Shard:
    """A shard read back; ``doc(k)`` decodes one document from its own symbols alone."""

    def __init__(self, blob: bytes):
        if blob[:8] != MAGIC:
            raise ValueError("not a Re-Pair token file")
        self.first_rule, n_rules, n_docs, n_sym, wide, self.n_ids, _, _ = np.frombuffer(blob, "<i8", 8, 8).tolist()
        at = 72

        def part(dtype: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, dtype, n, at)
            at += out.nbytes
            return out

        self.rules = part("<u4", 2 * n_rules).reshape(-1, 2)
        self.lengths = part("<u4", n_rules)
        self.doc_ids, self.null = part("<i8", n_docs), part("u1", n_docs).astype(bool)
        self.starts, self.first_ids = part("<i8", n_docs + 1), part("<i8", n_docs + 1)
        self.symbols = part(f"<u{wide}", n_sym)
        self.expansions = expansions(self.rules, self.first_rule)

    def all(self) -> np.ndarray:
        return expand(self.symbols, self.rules, self.first_rule, self.expansions)

    def doc(self, k: int) -> np.ndarray:
        return expand(self.symbols[self.starts[k]:self.starts[k + 1]], self.rules, self.first_rule, self.expansions)


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None) -> DataFrame:
    """Encode all documents, write them in ascending doc_id order, return the manifest of shards.

    Documents are dealt by ranges of doc_id; nulls come first, repeated doc_ids stay side by side
    in no set order. A null or empty text is its end id alone. No rows give no files. A task that
    runs again writes files of new names, and only those in the manifest count.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or shared_dir(spark, "token-files")
    vocabulary = first_free_id(tokenizer_path)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part = word_ids(tokenizer_path, WORDS), TaskContext.get().partitionId()
        uri = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.rpair"
        held: list = []
        told: list[dict] = []
        n = at = 0
        file = None

        def flush() -> None:
            nonlocal file, at
            doc = pa.concat_arrays([h[0] for h in held]).cast(pa.int64())
            offs = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(h[2]) for h in held]))])
            blob, sym, rules = shard_bytes(doc, np.concatenate([h[1] for h in held]), offs, vocabulary)
            file = file or open_uri(uri, "wb")
            file.write(blob)
            told.append(dict(path=uri, at=at, bytes=len(blob), partition=part, shard=len(told), n_docs=len(doc), n_ids=int(offs[-1]), n_symbols=sym, n_rules=rules))
            at += len(blob)

        try:
            for b in batches:
                ids, offs = table.encode(*utf8_column(b.column(1)))
                i = 0
                while i < b.num_rows:
                    j = max(i + (not held), int(np.searchsorted(offs, offs[i] + SHARD_IDS - n, "right")) - 1)
                    if j > i:
                        held.append((b.column(0).slice(i, j - i), ids[offs[i]:offs[j]], offs[i:j + 1] - offs[i]))
                        n += int(offs[j] - offs[i])
                    if j < b.num_rows:
                        flush()
                        held, n = [], 0
                    i = j
            if held:
                flush()
        finally:
            if file:
                file.close()
        # The manifest's rows come once the file is whole.
        types = [("path", pa.string()), ("at", pa.int64()), ("bytes", pa.int64()), ("partition", pa.int32()), ("shard", pa.int32())] + [(c, pa.int64()) for c in ("n_docs", "n_ids", "n_symbols", "n_rules")]
        yield pa.RecordBatch.from_pylist(told, pa.schema(types))

    manifest = (docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first())
                .sortWithinPartitions(F.col("doc_id").asc_nulls_first()).mapInArrow(tidy(task), MANIFEST))
    path = f"{folder}/manifest"
    manifest.write.parquet(path)
    return spark.read.schema(manifest.schema).parquet(path)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Documents of the files in order: doc_id, start (ids before it), n_tokens, ids (binary)."""
    spark = manifest.sparkSession
    small_batches(spark)
    # Ids before a shard: those of earlier partitions, one row for each writing task, and of earlier shards of its own.
    before = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    tasks = manifest.groupBy("partition").agg(F.sum("n_ids").alias("n")).select("partition", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("zero"))
    own = Window.partitionBy("partition").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("own", F.coalesce(F.sum("n_ids").over(own), F.lit(0))).join(tasks, "partition").select("path", "at", "bytes", (F.col("zero") + F.col("own")).alias("base"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, at, size, base in zip(*(c.to_pylist() for c in b.columns)):
                with open_uri(path, "rb") as f:
                    f.seek(at)
                    s = Shard(f.read(size))
                first = s.first_ids
                for i in range(0, len(s.doc_ids), 512):
                    k = slice(i, min(i + 512, len(s.doc_ids)))
                    lo, hi = first[:-1][k], first[1:][k]
                    # These documents' symbols alone are expanded.
                    raw = expand(s.symbols[s.starts[k.start]:s.starts[k.stop]], s.rules, s.first_rule, s.expansions).astype("<u4").tobytes()
                    zero = 4 * int(lo[0])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(s.doc_ids[k], mask=s.null[k]), pa.array(base + lo), pa.array(hi - lo),
                        pa.array([raw[4 * x - zero:4 * y - zero] for x, y in zip(lo.tolist(), hi.tolist())], pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"])

    return shards.repartition(n).mapInArrow(tidy(task), "doc_id long, start long, n_tokens long, ids binary")
