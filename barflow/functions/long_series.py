"""Indicators over series too long for one task: kernel R1 as a distributed scan of affine maps.

Rows of a key are numbered without gathering it and dealt to blocks; a block is a group of its own,
and brings the last row of the block before along, for what looks one row back. Within a block a
recurrence y = d y' + u starts from nothing. The block as a whole is the map y -> d**m y + e, with e its
last value; the maps are scanned over a table of one row for each block, and what comes into a block is
added to its rows, times d**k at its kth row. So one series runs on all cores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import settled
from . import windows as w
from .numbering import numbered

#: Rows of a block, and blocks whose maps one window scans by the kernel itself.
ROWS = 1 << 16


def dealt(df: DataFrame, key: str, order: list[str], rows: int = ROWS) -> DataFrame:
    """Rows with their number ``rn`` in the key and the columns of ``indexed`` by block: ``symbol`` is key and block, ``_halo`` marks the copy of the row before."""
    d = numbered(df, key, order, "rn")
    d = d.withColumn("_symbol", F.col("symbol")) if "symbol" in df.columns else d
    last = F.floor((F.col("rn") - 1) / rows)
    d = d.withColumn("_key", F.when(F.col(key).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(key).cast("string")))).withColumn("_at", F.when(F.col("rn") % rows == 0, F.array(last, last + 1)).otherwise(F.array(last)))
    d = d.withColumn("_block", F.explode("_at")).drop("_at").withColumn("_halo", F.col("_block") > last)
    k = F.col("rn") - F.col("_block") * rows  # 0 for the row before, then 1, 2, ...
    d = d.withColumn("symbol", F.concat_ws("|", "_block", "_key")).withColumn("blk", F.floor(k / w.BLOCK).cast("long")).withColumn("pos", k % w.BLOCK)
    return d.withColumn("sup", F.floor(F.col("blk") / w.SUPER).cast("long"))


def linears(df: DataFrame, wanted: list[tuple[str, str, float, int]], rows: int = ROWS) -> DataFrame:
    """Kernel R1 over blocks of ``dealt``; see the module. ``x`` must not be null from row ``start`` on."""
    # The row before a block counts in its own block alone: its terms are nought here.
    masked = {f"_x{i}": F.when(F.col("_halo"), 0.0).otherwise(F.col(x)) for i, (x, _, _, _) in enumerate(wanted)}
    d = w.linears(df.withColumns(masked), [(f"_x{i}", name, gain, start) for i, (_, name, gain, start) in enumerate(wanted)]).drop(*masked)
    d = settled(d, "blocks")
    names = [name for _, name, _, _ in wanted]
    ends = d.filter("NOT _halo").groupBy("_key", "_block").agg(*[F.coalesce(F.max_by(n, "rn"), F.lit(0.0)).alias(n) for n in names])
    # y_b = D y_(b-1) + e is the kernel again, with gain 1 - D; the table has a row for each block.
    t = ends.withColumn("symbol", F.col("_key")).withColumn("rn", F.col("_block") + 1)
    t = t.withColumn("blk", F.floor((F.col("rn") - 1) / w.BLOCK).cast("long")).withColumn("pos", (F.col("rn") - 1) % w.BLOCK).withColumn("sup", F.floor(F.col("blk") / w.SUPER).cast("long"))
    decay = {name: (1.0 - gain) ** rows for _, name, gain, _ in wanted}
    slow = [n for n in names if decay[n] > 1e-300]
    t = w.linears(t.withColumns({f"_e_{n}": F.col(n) / (1.0 - decay[n]) for n in slow}), [(f"_e_{n}", f"_y_{n}", 1.0 - decay[n], 0) for n in slow]) if slow else t
    carry = t.select("_key", (F.col("_block") + 1).alias("_block"), *[F.col(f"_y_{n}" if n in slow else n).alias(f"_in_{n}") for n in names])
    d = d.join(carry, ["_key", "_block"], "left")
    k = F.col("rn") - F.col("_block") * rows
    added = {name: F.when(F.col("rn") >= start, F.col(name) + F.pow(F.lit(1.0 - gain), k) * F.coalesce(f"_in_{name}", F.lit(0.0))) for _, name, gain, start in wanted}
    return d.withColumns(added).drop(*[f"_in_{n}" for n in names])


def together(df: DataFrame, key: str, order: list[str], *recipes: w.Recipe, rows: int = ROWS) -> DataFrame:
    """Indicators of recipes that look at most one row back, over series of any length; adds ``rn``.

    A null key is a series like any other; ``order`` must be total. No rows give no rows.
    """
    d = w.together(dealt(df, key, order, rows), *recipes, run=lambda x, wanted: linears(x, wanted, rows))
    return d.filter("NOT _halo").drop("_key", "_block", "_halo", "blk", "pos", "sup", "symbol").withColumnRenamed("_symbol", "symbol")
