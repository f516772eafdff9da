"""Which labelled rows may be learned from, as a bounded sample chosen by hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(doc_id, mod: int):
    """crc32 of doc_id as text, modulo ``mod``; null where doc_id is null."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(mod))


def learnable(labels: DataFrame, column: str, mod: int, held: int, most: int) -> DataFrame:
    """doc_id and label of at most ``most`` learning rows, those with the smallest hash of doc_id.

    Rows whose remainder is ``held``, null labels and contradicting labels are left out.
    """
    return (labels.select("doc_id", F.col(column).alias("label")).filter(F.col("label").isin(0, 1) & (remainder("doc_id", mod) != held))
            .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("high")).filter("label = high").drop("high")
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
