"""Running numbers of a key's rows without gathering the key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import settled


def numbered(df: DataFrame, by: str, order: list[str], out: str = "n") -> DataFrame:
    """Add ``out``, 1 for a key's first row in ``order`` (a total order), however many rows the key has.

    Rows are dealt by ranges of (key, order) and written once, so that ranges stay as they are. A row's
    number is its number within its range and key, and the rows of the key in earlier ranges, from
    a table of one row for each key and range.
    """
    d = settled(df.repartitionByRange(by, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = d.groupBy(by, "_part").agg(F.count("*").alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    d = d.withColumn(out, F.row_number().over(Window.partitionBy(by, "_part").orderBy(*order)))
    key = F.coalesce(F.col(by).cast("string"), F.lit(""))
    d, counts = d.withColumn("_key", key).withColumn("_none", F.col(by).isNull()), counts.select(key.alias("_key"), F.col(by).isNull().alias("_none"), "_part", "_before")
    return d.join(counts, ["_key", "_none", "_part"]).withColumn(out, F.col(out) + F.col("_before")).drop("_key", "_none", "_part", "_before")
