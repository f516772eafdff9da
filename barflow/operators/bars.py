"""Resampling, provider merges and audits of bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ohlcv(by: str = "ts") -> list[Column]:
    """First, max, min, last and sum of a group of bars, ordered by ``by``."""
    return [F.min_by("open", by).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", by).alias("close"), F.sum("volume").alias("volume")]


def every_n(bars: DataFrame, n: int, session: Column) -> DataFrame:
    """Each n bars of a session become one; a session's incomplete last group is dropped."""
    w = Window.partitionBy("symbol", "_s").orderBy("ts")
    d = bars.withColumn("_s", session).withColumn("_g", F.floor((F.row_number().over(w) - 1) / n))
    return d.groupBy("symbol", "_s", "_g").agg(F.min("ts").alias("ts"), *ohlcv(), F.count("*").alias("n")).filter(F.col("n") == n).drop("_s", "_g", "n")


def weekly(bars: DataFrame, drop_partial: bool = True) -> DataFrame:
    """Weeks that end on Friday; the last week is dropped if its Friday is not reached."""
    friday = F.next_day(F.date_sub("ts", 1), "FRI")
    out = bars.groupBy("symbol", friday.alias("week")).agg(*ohlcv(), F.max("ts").alias("last"), F.count("*").alias("n"))
    newest = Window.partitionBy("symbol")
    if not drop_partial:
        return out.drop("last")
    return out.withColumn("_w", F.max("week").over(newest)).filter((F.col("week") < F.col("_w")) | (F.col("last") >= F.col("week"))).drop("last", "_w")


def by_grid(bars: DataFrame, source_minutes: int, target_minutes: int) -> DataFrame:
    """Buckets of the target length with flag ``complete``: every source bar stands at its place."""
    step, part = target_minutes * 60, source_minutes * 60
    t = F.unix_timestamp("ts")
    d = bars.withColumn("_b", F.floor(t / step) * step).withColumn("_o", t - F.floor(t / step) * step)
    want = F.sequence(F.lit(0).cast("long"), F.lit(step - part).cast("long"), F.lit(part).cast("long"))
    return (d.groupBy("symbol", F.timestamp_seconds("_b").alias("bucket")).agg(*ohlcv(), F.sort_array(F.collect_list("_o")).alias("o"))
            .withColumn("complete", F.col("o") == want).withColumnRenamed("bucket", "ts").drop("o"))


def in_session(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Bars that start within their date's session, with its open and close. Sessions are one row a date."""
    d = bars.withColumn("session_date", F.to_date("ts"))
    return d.join(sessions, "session_date").filter((F.col("ts") >= F.col("market_open")) & (F.col("ts") < F.col("market_close")))


def session_hourly(bars: DataFrame, sessions: DataFrame, source_minutes: int = 15, as_of: Column | None = None) -> DataFrame:
    """Hours anchored at the session's open; the last may be short; ``complete`` when all its source bars are there."""
    d = in_session(bars, sessions)
    o = F.unix_timestamp("market_open")
    d = d.withColumn("hour", F.floor((F.unix_timestamp("ts") - o) / 3600))
    start = o + F.col("hour") * 3600
    d = d.withColumn("ts0", F.timestamp_seconds(start)).withColumn("end", F.least(F.timestamp_seconds(start + 3600), F.col("market_close")))
    out = d.groupBy("symbol", "ts0", "end").agg(*ohlcv(), F.count("*").alias("n"))
    out = out.withColumn("expected", F.ceil((F.unix_timestamp("end") - F.unix_timestamp("ts0")) / (source_minutes * 60))).withColumn("complete", F.col("n") == F.col("expected"))
    return (out.filter(F.col("end") <= as_of) if as_of is not None else out).withColumnRenamed("ts0", "ts")


def coverage(bars: DataFrame, sessions: DataFrame, minutes: int) -> DataFrame:
    """Of the bars that sessions call for between a symbol's first and last date, how many are there."""
    span = bars.groupBy("symbol").agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b"))
    step = F.expr(f"INTERVAL {minutes} MINUTES")
    grid = span.join(sessions, (F.col("session_date") >= F.col("a")) & (F.col("session_date") <= F.col("b"))).select("symbol", F.explode(F.sequence("market_open", F.col("market_close") - step, step)).alias("ts"))
    return grid.join(bars.select("symbol", "ts", F.lit(1).alias("hit")), ["symbol", "ts"], "left").groupBy("symbol").agg(F.count("*").alias("expected"), F.count("hit").alias("matched")).withColumn("coverage", F.col("matched") / F.col("expected"))


def availability(bars: DataFrame, sessions: DataFrame, minutes: int) -> DataFrame:
    """The time a bar became known: its end, at most the session's close; bars outside sessions go."""
    end = F.timestamp_seconds(F.unix_timestamp("ts") + minutes * 60)
    return in_session(bars, sessions).withColumn("available", F.least(end, F.col("market_close"))).drop("session_date", "market_open", "market_close")


def decision_surface(known: DataFrame) -> DataFrame:
    """One row for each (symbol, available): the latest bar."""
    w = Window.partitionBy("symbol", "available").orderBy(F.col("ts").desc())
    return known.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def contiguous_context(bars: DataFrame, minutes: int, n: int) -> DataFrame:
    """Rolling OHLCV of n bars within runs without gaps; null until a run holds n."""
    w = Window.partitionBy("symbol").orderBy("ts")
    t = F.unix_timestamp("ts")
    d = bars.withColumn("_new", F.coalesce((t - F.lag(t).over(w) != minutes * 60).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(w))
    f = Window.partitionBy("symbol", "_run").orderBy("ts").rowsBetween(-n + 1, 0)
    full = F.count("*").over(f) == n
    return d.select("symbol", "ts", "close", F.when(full, F.first("open").over(f)).alias("ctx_open"), F.when(full, F.max("high").over(f)).alias("ctx_high"), F.when(full, F.min("low").over(f)).alias("ctx_low"), F.when(full, F.sum("volume").over(f)).alias("ctx_volume"))


def provider_merge(bars: DataFrame) -> DataFrame:
    """For each (symbol, ts) the row of the smallest priority, then source; never an average."""
    return bars.groupBy("symbol", "ts").agg(F.min_by(F.struct("source", "priority", "open", "high", "low", "close", "volume"), F.struct("priority", "source")).alias("x")).select("symbol", "ts", "x.*")


def disagreement(bars: DataFrame) -> DataFrame:
    """Where several sources have a close: how many, and (max - min) / midpoint in basis points."""
    return (bars.groupBy("symbol", "ts").agg(F.count("*").alias("n"), F.max("close").alias("hi"), F.min("close").alias("lo")).filter("n > 1")
            .withColumn("bps", 1e4 * (F.col("hi") - F.col("lo")) / ((F.col("hi") + F.col("lo")) / 2.0)).drop("hi", "lo"))


def overlap_audit(a: DataFrame, b: DataFrame, bad_bps: float = 100.0) -> DataFrame:
    """Absolute differences of closes at shared times, in basis points of the first: exact linear percentiles."""
    j = a.select("symbol", "ts", F.col("close").alias("x")).join(b.select("symbol", "ts", F.col("close").alias("y")), ["symbol", "ts"]).withColumn("d", 1e4 * F.abs(F.col("y") / F.col("x") - 1))
    p = F.percentile("d", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return j.groupBy("symbol").agg(F.count("*").alias("n"), p.alias("p"), F.max("d").alias("max_bps"), F.avg((F.col("d") > bad_bps).cast("double")).alias("bad_fraction")).select(
        "symbol", "n", F.col("p")[0].alias("median_bps"), F.col("p")[1].alias("p95_bps"), F.col("p")[2].alias("p99_bps"), "max_bps", "bad_fraction")


def last_wins(*frames: DataFrame) -> DataFrame:
    """Union in which a later frame's row replaces an earlier one's."""
    d = None
    for k, f in enumerate(frames):
        one = f.withColumn("_k", F.lit(k))
        d = one if d is None else d.unionByName(one, allowMissingColumns=True)
    w = Window.partitionBy("symbol", "ts").orderBy(F.col("_k").desc())
    return d.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_k")


def append_newer(base: DataFrame, new: DataFrame) -> DataFrame:
    """Base, and the rows of ``new`` after a symbol's last one (all rows of symbols that base lacks)."""
    last = base.groupBy("symbol").agg(F.max("ts").alias("_last"))
    fresh = new.join(last, "symbol", "left").filter(F.col("_last").isNull() | (F.col("ts") > F.col("_last"))).drop("_last")
    return base.unionByName(fresh)


def replace_tail(base: DataFrame, tail: DataFrame) -> DataFrame:
    """Base before the tail's first time, then the tail."""
    first = tail.groupBy("symbol").agg(F.min("ts").alias("_first"))
    return base.join(first, "symbol", "left").filter(F.col("_first").isNull() | (F.col("ts") < F.col("_first"))).drop("_first").unionByName(tail)


def filled_axis(df: DataFrame, key: str, date: str, value: str) -> DataFrame:
    """Every key at every date, 0 where there was nothing."""
    axis = df.select(key).distinct().crossJoin(df.select(date).distinct())
    return axis.join(df.groupBy(key, date).agg(F.sum(value).alias(value)), [key, date], "left").fillna(0.0, [value])


def split_adjust(bars: DataFrame, splits: DataFrame) -> DataFrame:
    """Prices before a split are divided by the product of later factors, volume multiplied.

    Splits meet bars as further rows of the same series, so one window gives the product.
    """
    s = splits.groupBy("symbol", F.col("effective_at").alias("ts")).agg(F.product("factor").alias("factor"))
    rows = bars.withColumn("_f", F.lit(1.0)).unionByName(s.select("symbol", "ts", F.col("factor").alias("_f"), F.lit(True).alias("_split")), allowMissingColumns=True)
    # Later rows only: a bar at the effective time is not adjusted.
    w = Window.partitionBy("symbol").orderBy(F.col("ts").cast("timestamp").cast("long")).rangeBetween(1, Window.unboundedFollowing)
    d = rows.withColumn("_p", F.coalesce(F.product("_f").over(w), F.lit(1.0))).filter("_split IS NULL").drop("_split", "_f")
    return d.withColumns({c: F.col(c) / F.col("_p") for c in ("open", "high", "low", "close")} | {"volume": F.col("volume") * F.col("_p")}).withColumnRenamed("_p", "split_factor")


def identity_summary(bars: DataFrame, least: int, sample: int | None = None, seed: int = 7) -> DataFrame:
    """A10: rows and first and last time of symbols with at least ``least`` rows; a seeded sample by hash order."""
    d = bars.groupBy("symbol").agg(F.count("*").alias("rows"), F.min("ts").alias("first"), F.max("ts").alias("last")).filter(F.col("rows") >= least)
    return d.orderBy(F.xxhash64("symbol", F.lit(seed))).limit(sample) if sample else d


def monthly_features(bars: DataFrame, momentum: int = 60, trend: int = 100) -> DataFrame:
    """A row for each symbol and month end: close over its mean, momentum, and the next month's return."""
    from ..functions import windows as w

    d = w.indexed(bars).withColumns({"mom": w.pct_change("close", momentum), "trend": F.col("close") > w.sma("close", trend), "nxt": w.lead("ts"), "entry": w.lead("open")})
    ends = d.filter(F.trunc("ts", "MM") != F.trunc("nxt", "MM"))
    m = Window.partitionBy("symbol").orderBy("ts")
    return ends.select("symbol", "ts", "close", "mom", "trend", (F.lead("entry").over(m) / F.col("entry") - 1).alias("next_return"))


def split_ratio(c: Column) -> Column:
    """factor of a split: "new/old", "new:old" or a number; null if it is none or not positive."""
    p = F.split(F.trim(c.cast("string")), "[/:]")
    a, b = F.get(p, F.lit(0)).try_cast("double"), F.coalesce(F.get(p, F.lit(1)).try_cast("double"), F.when(F.size(p) == 1, 1.0))
    return F.when((a > 0) & (b > 0), a / b)


def last_session(sessions: DataFrame, now: Column) -> DataFrame:
    """One row: the latest session that is over at ``now``."""
    return sessions.filter(F.col("market_close") <= now).agg(F.max("session_date").alias("session_date"))


def with_provenance(bars: DataFrame, provenance: DataFrame, default: str) -> DataFrame:
    """Source of each bar, carried over from earlier provenance, else ``default``."""
    return bars.join(provenance.select("symbol", "ts", F.col("source").alias("_s")), ["symbol", "ts"], "left").withColumn("source", F.coalesce("_s", F.lit(default))).drop("_s")
