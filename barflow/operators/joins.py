"""As-of, range and matching joins."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: str, left_on: str, right_on: str, columns: list[str], tolerance: Column | None = None, prefix: str = "") -> DataFrame:
    """Each left row with the last right row of its key at or before its time; equal times match.

    Both sides stand in one series, right rows before left ones at equal times, and one window
    carries the last right row on: one shuffle and one sort, no growth in rows. Of right rows at
    equal times the one with the greatest values counts. Older ones than ``tolerance`` are null.
    """
    r = right.groupBy(by, F.col(right_on).alias("_t")).agg(F.max(F.struct(F.col(right_on).alias("_at"), *columns)).alias("_r"))
    rows = left.withColumn("_t", F.col(left_on)).withColumn("_side", F.lit(1)).unionByName(r.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    d = rows.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).filter("_side = 1")
    if tolerance is not None:
        d = d.withColumn("_r", F.when(F.col("_t") - F.col("_r._at") <= tolerance, F.col("_r")))
    return d.select(*left.columns, F.col("_r._at").alias(f"{prefix}source_time"), *[F.col(f"_r.{c}").alias(f"{prefix}{c}") for c in columns])


def latest_at(df: DataFrame, by: str, on: str, at: Column) -> DataFrame:
    """Each key's last row at or before a time."""
    return df.filter(F.col(on) <= at).groupBy(by).agg(F.max_by(F.struct(*[c for c in df.columns if c != by]), F.col(on)).alias("x")).select(by, "x.*")


def local_date(c: Column, zone: str = "America/New_York") -> Column:
    """the exchange's date of a UTC time."""
    return F.to_date(F.from_utc_timestamp(c, zone))


def fresh_in_session(df: DataFrame, on: str, source: str, columns: list[str], zone: str = "America/New_York") -> DataFrame:
    """Context of another local session becomes null; ``fresh`` tells which was kept."""
    same = F.coalesce(local_date(F.col(on), zone) == local_date(F.col(source), zone), F.lit(False))
    return df.withColumns({c: F.when(same, F.col(c)) for c in columns} | {"fresh": same})


def in_interval(intervals: DataFrame, points: DataFrame, by: str, start: str, end: str, on: str, unit: str = "MM") -> DataFrame:
    """Points of a key within closed intervals; intervals are dealt by calendar unit, so it is an equi-join."""
    step = {"MM": "INTERVAL 1 MONTH", "DD": "INTERVAL 1 DAY", "YEAR": "INTERVAL 1 YEAR"}[unit]
    cell = F.explode(F.sequence(F.trunc(F.col(start).cast("date"), unit) if unit != "DD" else F.col(start).cast("date"), F.col(end).cast("date"), F.expr(step))).alias("_cell")
    a = intervals.filter(F.col(start) <= F.col(end)).select("*", cell)
    b = points.withColumn("_cell", F.trunc(F.col(on).cast("date"), unit) if unit != "DD" else F.col(on).cast("date"))
    return a.join(b, [by, "_cell"]).filter(F.col(on).between(F.col(start), F.col(end))).drop("_cell")


def chosen(df: DataFrame, ids: DataFrame, by: str) -> DataFrame:
    """J06."""
    return df.join(ids.select(by).distinct(), by)


def exact_attach(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Many-to-one at equal keys; keys that stand several times on the right match nothing."""
    one = right.withColumn("_c", F.count("*").over(Window.partitionBy(*on))).filter("_c = 1").drop("_c")
    return left.join(one, on)


def superseded(filings: DataFrame, as_of: Column) -> DataFrame:
    """Filings that no amendment accepted by ``as_of`` replaces."""
    later = filings.filter(F.col("amends_accession").isNotNull() & (F.col("accepted_at") <= as_of)).select(F.col("amends_accession").alias("accession")).distinct()
    return filings.filter(F.col("accepted_at") <= as_of).join(later, "accession", "left_anti")


def membership(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """Every key of several sets with a flag for each."""
    d = None
    for name, s in sets.items():
        one = s.select(F.col(key), F.lit(name).alias("_set"))
        d = one if d is None else d.unionByName(one)
    return d.groupBy(key).agg(*[F.bool_or(F.col("_set") == n).alias(n) for n in sets])


def mutual_best(candidates: DataFrame, left: str, right: str, score: str, rounds: int | None = None) -> DataFrame:
    """Greedy one-to-one matching: pairs that are each other's best are taken, round by round.

    Ties go to the smaller ids. A round takes at least the best pair left; it ends when none is left.
    More than ``rounds`` rounds, if that is given, raise.
    """
    left_over, taken = candidates, None
    for k in itertools.count():
        if k == rounds:
            raise ValueError("matching needs more rounds")
        wl = Window.partitionBy(left).orderBy(F.col(score).desc(), left, right)
        wr = Window.partitionBy(right).orderBy(F.col(score).desc(), left, right)
        best = left_over.withColumn("_l", F.row_number().over(wl)).withColumn("_r", F.row_number().over(wr)).filter("_l = 1 AND _r = 1").drop("_l", "_r").checkpoint()
        if best.isEmpty():
            return taken if taken is not None else best
        taken = best if taken is None else taken.unionByName(best)
        left_over = left_over.join(best.select(left), left, "left_anti").join(best.select(right), right, "left_anti").checkpoint()


def multiset_match(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """One row: expected, observed and matched counts of keys, and matched / expected."""
    a = expected.groupBy(*keys).agg(F.count("*").alias("a"))
    b = observed.groupBy(*keys).agg(F.count("*").alias("b"))
    z = F.lit(0).cast("long")
    return (a.join(b, keys, "full").select(F.coalesce("a", z).alias("a"), F.coalesce("b", z).alias("b")).agg(F.coalesce(F.sum("a"), z).alias("expected"), F.coalesce(F.sum("b"), z).alias("observed"), F.coalesce(F.sum(F.least("a", "b")), z).alias("matched"))
            .withColumn("ratio", F.col("matched") / F.nullif(F.col("expected"), z)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; null if both are empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))
