"""Audit of how corpus filters interact, by contracting contingency tensors (operator 11).

Each document fails some of five filters. Per part, the documents are counted in a tensor of
2x2x2x2x2 cells, an axis for each filter: 0 passes, 1 fails. A step of an order of filters selects
along each axis pass (filters before it), fail (its own) or all (the rest); ``einsum`` contracts the
tensor with those selections, for all orders and steps at once. Only the counts of 32 cells leave
Spark's grouping, so the 120 orders cost nothing per document.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Whitespace as the audit takes it, written for Java's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
FILTERS = "ABCDE"
#: Per cell: documents, those of good quality, toxic ones.
COUNTS = ("n", "good", "toxic")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_failures(text: Column) -> dict[str, Column]:
    """Whether a text fails A (short), B (repetitive), C (shouting) and D (symbols)."""
    found = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    upper = F.length(text) - F.length(F.translate(text, _UPPER, ""))
    return {
        "A": F.size(found) < 200,
        "B": 100 * F.size(F.array_distinct(found)) < 50 * F.size(found),
        "C": 100 * upper > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part and one boolean for each filter, a row for each document.

    E compares texts by SHA-256. The smallest doc_id of each text is found with partial minima, and
    a document is looked up by text and doc_id together, so thousands of copies never meet in one task.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *[x.alias(k) for k, x in text_failures(F.col("text")).items()])
    d = written(d, "failures")
    first = d.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    # A document without an id has no smaller one; its random key spreads such rows.
    key = F.coalesce("doc_id", F.xxhash64(F.lit("none"), F.monotonically_increasing_id()))
    d = d.withColumn("key", F.struct(F.col("doc_id").isNull().alias("none"), key.alias("id")))
    first = first.select("digest", F.struct(F.lit(False).alias("none"), F.col("doc_id").alias("id")).alias("key"), "first")
    return d.join(first, ["digest", "key"], "left").select("doc_id", "part", *FILTERS[:4], (F.col("doc_id").isNotNull() & F.col("first").isNull()).alias("E"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part and its list of (cell, n, good, toxic), 64 or fewer; bit 4 of a cell's number is a failed A, bit 0 a failed E."""
    f = failures(docs).withColumn("cell", sum(F.col(k).cast("int") * (16 >> i) for i, k in enumerate(FILTERS)))
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").filter("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)")
    told = told.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    count = lambda c: F.count(F.when(F.col(c), 1))
    every = f.groupBy("part", "cell").agg(F.count("*").alias("n"))
    # Labelled documents alone are joined; an inner join leaves out rows without an id.
    marked = f.join(told, "doc_id").groupBy("part", "cell").agg(F.lit(0).cast("long").alias("n"), count("good").alias("good"), count("toxic").alias("toxic"))
    none = F.lit(0).cast("long")
    counted = every.withColumn("good", none).withColumn("toxic", none).unionByName(marked)
    return counted.groupBy("part").agg(F.collect_list(F.struct("cell", *COUNTS)).alias("cells"))


#: Selections along an axis.
_PASS, _FAIL, _ALL = np.array([1, 0]), np.array([0, 1]), np.array([1, 1])
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def _selections() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each order and step, the vectors along the five axes: of kept, removed, and failing at all."""
    kept, removed, failing = (np.empty((len(ORDERS), 5, 5, 2), np.int64) for _ in range(3))
    for o, order in enumerate(ORDERS):
        for s, own in enumerate(order):
            for axis, f in enumerate(FILTERS):
                before = f in order[:s]
                kept[o, s, axis] = _PASS if before or f == own else _ALL
                removed[o, s, axis] = _PASS if before else _FAIL if f == own else _ALL
                failing[o, s, axis] = _FAIL if f == own else _ALL
    return kept, removed, failing


def _only() -> np.ndarray:
    """For each filter, the vectors that select what fails it alone."""
    return np.stack([np.stack([_FAIL if a == f else _PASS for a in range(5)]) for f in range(5)])


def contracted(tensors: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Counts of each tensor (first axis) under each row of five selections (first axis)."""
    v = vectors.reshape(-1, 5, 2)
    return np.einsum("tabcde,ia,ib,ic,id,ie->ti", tensors, *(v[:, k] for k in range(5)), optimize=True).astype(np.int64)


def audited(tensors: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of every order and step, flat, of one part's three tensors."""
    kept, removed, failing = _selections()
    own = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
    out = contracted(tensors, removed).reshape(3, len(ORDERS), 5)
    fails = contracted(tensors[:1], failing).reshape(len(ORDERS), 5)
    shapley = np.bincount(own.ravel(), weights=out[0].ravel(), minlength=5).astype(np.int64)
    return {
        "kept": contracted(tensors[:1], kept).ravel(), "removed": out[0].ravel(), "redundant": (fails - out[0]).ravel(), "unique_fails": contracted(tensors[:1], _only())[0][own].ravel(),
        "good_lost": out[1].ravel(), "toxic_lost": out[2].ravel(), "shapley": shapley[own].ravel(),
    }


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A null text is empty and a null source is the part ''. E fails a document whose text a smaller
    doc_id has; repeated rows of one doc_id do not fail each other, and a row without doc_id never
    fails E and has no label. Labels that contradict each other count as good or toxic if any row
    says so; null labels say nothing. Every row counts once. No documents give no rows. Other
    columns are not read.
    """
    parts = cells(docs, labels)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                t = np.zeros((len(COUNTS), 32), np.int64)
                for c in row.cells:
                    t[:, c["cell"]] += [c[k] for k in COUNTS]
                t = t.reshape(len(COUNTS), 2, 2, 2, 2, 2)
                yield pd.DataFrame({"part": row.part, "filter_order": np.repeat(ORDERS, 5), "step": np.tile(np.arange(1, 6, dtype=np.int32), len(ORDERS))} | audited(t))

    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return parts.mapInPandas(task, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in names))
