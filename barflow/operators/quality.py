"""Cleaning, validation and data-quality rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRICES = ["open", "high", "low", "close"]
OHLCV = [*PRICES, "volume"]
#: Other names of a column in landed files, first match wins.
ALIASES = {
    "symbol": ["symbol", "ticker", "code"], "ts": ["ts", "timestamp", "datetime", "date", "time"], "open": ["open", "o"], "high": ["high", "h"], "low": ["low", "l"],
    "close": ["close", "adj_close", "c"], "volume": ["volume", "vol", "v"], "sector": ["sector"], "industry": ["industry"], "currency": ["currency"],
}


def resolve_aliases(df: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """Rename columns to their canonical names by ordered, case-insensitive aliases; others are dropped."""
    there = {c.lower().strip().replace(" ", "_"): c for c in reversed(df.columns)}
    picked = {k: next((there[a] for a in names if a in there), None) for k, names in (aliases or ALIASES).items()}
    return df.select([F.col(f"`{src}`").alias(k) for k, src in picked.items() if src])


def finite(c: str | Column) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def canonicalize(df: DataFrame, drop_duplicates: bool = False, drop_missing: bool = False, seq: str | None = None) -> DataFrame:
    """Canonical bars: aliases resolved, values cast, the last row (by ``seq``) wins on a repeated (symbol, ts).

    Text that is no number becomes null; missing volume is null.
    """
    keep = [F.col(seq).alias("src_seq")] if seq else []
    d = resolve_aliases(df.select("*", *keep), ALIASES | {"src_seq": ["src_seq"]})
    d = d.withColumns({c: F.expr(f"try_cast({c} AS double)") if c in d.columns else F.lit(None).cast("double") for c in OHLCV})
    if drop_missing:
        d = d.dropna(subset=PRICES)
    if drop_duplicates:
        w = Window.partitionBy("symbol", "ts").orderBy(F.col("src_seq").desc() if seq else F.lit(0))
        d = d.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return d


def quality_report(bars: DataFrame) -> DataFrame:
    """One row of counts for each symbol."""
    w = Window.partitionBy("symbol").orderBy("ts")
    d = bars.withColumn("ret", F.col("close") / F.nullif(F.lag("close").over(w), F.lit(0.0)) - 1).withColumn("dup", (F.col("ts") == F.lag("ts").over(w)).cast("int"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in OHLCV])
    odd = reduce(lambda a, b: a | b, [~finite(c) & F.col(c).isNotNull() for c in OHLCV])
    return d.groupBy("symbol").agg(
        F.count("*").alias("rows"), F.coalesce(F.sum("dup"), F.lit(0)).cast("long").alias("duplicates"), n(missing).alias("missing"), n(odd).alias("non_finite"),
        n(F.least(*PRICES) <= 0).alias("non_positive"), n(F.col("volume") < 0).alias("negative_volume"), n(F.col("high") < F.greatest("open", "close", "low")).alias("high_violations"),
        n(F.col("low") > F.least("open", "close", "high")).alias("low_violations"), n(F.col("volume") == 0).alias("zero_volume"), F.max(F.abs("ret")).alias("max_abs_return"))


def failures(report: DataFrame, max_return: float | None = None) -> DataFrame:
    """Symbols whose report fails, with the names of the failed checks."""
    names = ["duplicates", "missing", "non_finite", "non_positive", "negative_volume", "high_violations", "low_violations"]
    tests = [F.when(F.col(c) > 0, F.lit(c)) for c in names] + ([F.when(F.col("max_abs_return") > max_return, F.lit("extreme_return"))] if max_return is not None else [])
    return report.withColumn("failures", F.array_compact(F.array(*tests))).filter(F.size("failures") > 0)


def market_filter(bars: DataFrame, start: str, end: str) -> DataFrame:
    """Dated rows with positive finite prices and a consistent range; the date test reaches the scan."""
    ok = reduce(lambda a, b: a & b, [finite(c) & (F.col(c) > 0) for c in PRICES])
    return bars.filter(F.col("ts").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & ok & (F.col("volume") >= 0)
                       & (F.col("high") >= F.greatest("open", "close")) & (F.col("low") <= F.least("open", "close")))


def corporate_action_gate(bars: DataFrame, low: float = 0.25, high: float = 4.0) -> DataFrame:
    """Symbols with an overnight open or close ratio outside [low, high]: conflicts, extremes, first date."""
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("ts"))
    d = bars.withColumn("ro", F.col("open") / before).withColumn("rc", F.col("close") / before)
    bad = ~F.col("ro").between(low, high) | ~F.col("rc").between(low, high)
    return (d.groupBy("symbol").agg(F.sum(F.when(bad, 1).otherwise(0)).cast("long").alias("conflicts"), F.min(F.least("ro", "rc")).alias("min_ratio"), F.max(F.greatest("ro", "rc")).alias("max_ratio"), F.min(F.when(bad, F.col("ts"))).alias("first_conflict"))
            .filter("conflicts > 0"))


def exclude(bars: DataFrame, gone: DataFrame) -> DataFrame:
    """Bars of symbols that are not excluded."""
    return bars.join(gone.select("symbol"), "symbol", "left_anti")


def enough_history(bars: DataFrame, least: int) -> DataFrame:
    """Bars of symbols with at least ``least`` rows."""
    return bars.join(bars.groupBy("symbol").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("symbol"), "symbol", "left_semi")


def off_grid(df: DataFrame, minutes: int = 5) -> DataFrame:
    """Rows whose time is no multiple of ``minutes``."""
    return df.filter(F.pmod(F.unix_micros("ts"), F.lit(minutes * 60_000_000)) != 0)


def split_bad(df: DataFrame, most: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Good rows, bad rows, and one row of counts with ``failed`` where bad / all exceeds ``most``."""
    ok = reduce(lambda a, b: a & b, [finite(c) for c in OHLCV])
    d = df.withColumn("ok", ok)
    audit = d.agg(F.count("*").alias("rows"), F.sum((~F.col("ok")).cast("long")).alias("bad"))
    return d.filter("ok").drop("ok"), d.filter("NOT ok").drop("ok"), audit.withColumn("failed", F.col("bad") > (most if most is not None else 1.0) * F.col("rows"))


def conflicting_duplicates(df: DataFrame) -> DataFrame:
    """(symbol, ts) that stand with different values."""
    return df.groupBy("symbol", "ts").agg(F.count("*").alias("n"), F.count_distinct(F.struct(*OHLCV)).alias("versions")).filter("versions > 1")


def identical_once(df: DataFrame) -> DataFrame:
    """Equal rows once."""
    return df.dropDuplicates(["symbol", "ts", *OHLCV])


def flag(c: str, extra: tuple[str, ...] = ()) -> Column:
    """Text to boolean; unknown text is false."""
    return F.coalesce(F.lower(F.trim(F.col(c).cast("string"))).isin("true", "1", "yes", "y", "go", "buy", *extra), F.lit(False))


def causality_violations(df: DataFrame, known: str, happened: str) -> DataFrame:
    """Rows that were known before they happened."""
    return df.filter(F.col(known) < F.col(happened))


def null_fractions(df: DataFrame) -> DataFrame:
    """Share of nulls of each column, one row a column, in one pass."""
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("fraction")) for c in df.columns])).alias("x")).select("x.*")


def open_gap(bars: DataFrame) -> DataFrame:
    """Largest absolute gap of an open from the close before."""
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("ts"))
    return bars.withColumn("g", F.abs(F.col("open") / before - 1)).groupBy("symbol").agg(F.max("g").alias("max_open_gap"))


def usable(bars: DataFrame, least: int, now, days: int) -> DataFrame:
    """Rows, last time and whether both suffice at ``now``."""
    return bars.groupBy("symbol").agg(F.count("*").alias("rows"), F.max("ts").alias("last")).withColumn("usable", (F.col("rows") >= least) & (F.datediff(F.lit(now).cast("date"), "last") <= days))


def full_history(fine: DataFrame, coarse: DataFrame, start_days: int = 7, end_days: int = 2) -> DataFrame:
    """Symbols whose fine bars start at most 7 days after and end at most 2 days before the coarse ones."""
    a = fine.groupBy("symbol").agg(F.min("ts").alias("s"), F.max("ts").alias("e"))
    c = coarse.groupBy("symbol").agg(F.min("ts").alias("cs"), F.max("ts").alias("ce"))
    return a.join(c, "symbol").withColumn("eligible", (F.datediff("s", "cs") <= start_days) & (F.datediff("ce", "e") <= end_days)).select("symbol", "eligible")


def reasons(**tests: Column) -> Column:
    """Names of the tests that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in tests.items()]))


def term_hits(text: Column, hard: list[str], review: list[str]) -> Column:
    """Struct of status (hard, review, none) and the terms found, sorted."""
    found = lambda terms: F.array_sort(F.array_distinct(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(text), t))))
    h, r = found(hard), found(review)
    return F.struct(F.when(F.size(h) > 0, "hard").when(F.size(r) > 0, "review").otherwise("none").alias("status"), F.when(F.size(h) > 0, h).otherwise(r).alias("terms"))


def overlap_gate(audit: DataFrame, least: int = 5, median_bps: float = 50.0, p95: float | None = None, bad: float | None = None) -> DataFrame:
    """Passes of an overlap audit (A09); a missing value fails."""
    ok = (F.col("n") >= least) & (F.col("median_bps") <= median_bps)
    if p95 is not None:
        ok = ok & (F.col("p95_bps") <= p95)
    if bad is not None:
        ok = ok & (F.col("bad_fraction") <= bad)
    return audit.withColumn("passed", F.coalesce(ok, F.lit(False)))


def utc(c: Column, zone: str | None = None) -> Column:
    """a time as UTC: naive text counts as UTC (or as local to ``zone``), an offset in the text is honoured; text that is no time is null."""
    text = F.trim(c.cast("string"))
    aware = F.rlike(text, F.lit(r"(Z|[+-]\d{2}:?\d{2})$")) & F.rlike(text, F.lit(r"\d:\d{2}"))
    at = F.try_to_timestamp(F.when(aware, text).otherwise(F.concat(text, F.when(F.rlike(text, F.lit(r"\d:\d{2}")), F.lit("Z")).otherwise(F.lit("T00:00:00Z")))))
    return at if zone is None else F.when(aware, at).otherwise(F.to_utc_timestamp(at, zone))


def safe_divide(a: Column, b: Column, least: float = 1e-12) -> Column:
    """null where either is not finite or the divisor is within ``least`` of 0."""
    x, y = a.cast("double"), b.cast("double")
    return F.when(finite(x) & finite(y) & (F.abs(y) > least), x / y)
