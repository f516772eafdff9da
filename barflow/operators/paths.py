"""Resolution of hourly trades on finer bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import trades as t

_OUT = ["status", "failure", "failed_at", "signal", "exit_rn", "entry_time", "exit_time", "entry_price", "exit_price", "gross_return", "score", "duration_bars", "forced", "exit_reason"]


def fine_hours(hours: DataFrame, fine: DataFrame, sessions: DataFrame, minutes: int = 15) -> DataFrame:
    """For hours (symbol, ts): their fine bars in order, and whether all that the session calls for are there."""
    step = minutes * 60
    s = F.unix_timestamp
    d = hours.select("symbol", "ts").distinct().withColumn("session_date", F.to_date("ts")).join(sessions, "session_date", "left")
    inside = (F.col("ts") >= F.col("market_open")) & (F.col("ts") < F.col("market_close"))
    d = d.withColumn("_n", F.when(inside, F.ceil((F.least(s("ts") + 3600, s("market_close")) - s("ts")) / step)).otherwise(-1))
    want = d.withColumn("_t", F.explode_outer(F.when(F.col("_n") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), lambda k: F.timestamp_seconds(s(F.col("ts")) + k * step)))))
    got = want.join(fine.select("symbol", F.col("ts").alias("_t"), F.struct(F.col("ts").alias("at"), "open", "low").alias("_b")), ["symbol", "_t"], "left")
    return got.groupBy("symbol", "ts").agg(F.array_sort(F.collect_list("_b")).alias("fine"), (F.count("_b") == F.max("_n")).alias("whole"))


def resolved_pullbacks(bars: DataFrame, fine: DataFrame, sessions: DataFrame, atr_col: str, pullback_atr: float, stop_atr: float, valid: int, exit_lookback: int) -> DataFrame:
    """The pullback trades of K04 with fills and stops found on 15-minute bars.

    The limit fills at the first fine bar of the touched hour whose low reaches it; a stop counts from
    that bar on. An hour that is touched and lacks a fine bar, or whose fine bars do not reach the
    limit that the hour reached, makes the path incomplete: the symbol gives one row of that failure
    and no later trades. Rows: status TRADE or INCOMPLETE.
    """
    f, p = t.limit_fills(bars, atr_col, pullback_atr, stop_atr, valid, exit_lookback)
    h = fine_hours(f.select("symbol", F.col("entry_bar").alias("ts")), fine, sessions).withColumnRenamed("ts", "entry_bar")
    first = F.get(F.filter("fine", lambda b: b["low"] <= F.col("_limit")), 0)
    f = f.join(h, ["symbol", "entry_bar"], "left").withColumn("_f", F.when(F.col("whole"), first))
    f = f.withColumn("failure", F.when(~F.coalesce("whole", F.lit(False)), "ENTRY_TOUCH_HOUR_MISSING_15M").when(F.col("_f").isNull(), "ONE_HOUR_LOW_NOT_REPRODUCED_15M")).withColumn("failed_at", F.when(F.col("failure").isNotNull(), F.col("entry_bar")))
    f = f.withColumn("entry_price", F.least("_f.open", "_limit")).withColumn("entry_time", F.col("_f.at")).drop("fine", "whole").filter("failure IS NOT NULL OR entry_price > 0")
    touch = t.stop_touches(f.filter("failure IS NULL"), p)
    h = fine_hours(touch, fine, sessions)
    touch = touch.join(h, ["symbol", "ts"], "left").join(f.select("symbol", "signal", "entry_time"), ["symbol", "signal"])
    stop = F.get(F.filter("fine", lambda b: (b["at"] >= F.col("entry_time")) & (b["low"] <= F.col("_sp"))), 0)
    touch = touch.withColumn("_s", stop).withColumn("_gap", ~F.coalesce("whole", F.lit(False))).filter(F.col("_gap") | F.col("_s").isNotNull())
    hit = touch.groupBy("symbol", "signal").agg(F.min_by(F.struct("_gap", "ts", "rn", F.least("_s.open", "_sp").alias("price"), F.col("_s.at").alias("at")), "rn").alias("_m"))
    c = f.join(hit, ["symbol", "signal"], "left")
    gap = F.coalesce("_m._gap", F.lit(False))
    c = c.withColumn("failure", F.coalesce("failure", F.when(gap, "STOP_TOUCH_HOUR_MISSING_15M"))).withColumn("failed_at", F.coalesce("failed_at", F.when(gap, F.col("_m.ts"))))
    c = c.withColumn("_h", F.when(F.col("_m").isNotNull() & ~gap, F.struct(F.col("_m.rn").alias("rn"), F.col("_m.price").alias("price"), F.col("_m.at").alias("at"))))
    c = t.left_at(c, p).withColumn("status", F.when(F.col("failure").isNull(), "TRADE").otherwise("INCOMPLETE"))
    c = c.withColumn("exit_reason", F.when(F.col("_h").isNotNull(), "STOP_15M").when(F.col("forced"), "FORCED_END").otherwise("STRUCTURAL_1H_NEXT_OPEN"))

    # Nothing is taken after a path that is not whole.
    c = c.withColumn("exit_rn", F.when(F.col("failure").isNotNull(), F.lit((1 << 63) - 1)).otherwise(F.col("exit_rn")))
    out = t.non_overlapping(c.select("symbol", *_OUT), ["symbol"])
    bad = F.col("status") == "INCOMPLETE"
    return out.select("symbol", *[c if c in ("status", "failure", "failed_at", "signal") else F.when(~bad, F.col(c)).alias(c) for c in _OUT])


def path_summary(resolved: DataFrame, symbols: DataFrame, bps: float = 10.0) -> DataFrame:
    """Per symbol: trades, mean net return, whether its whole path was there, and the first failure."""
    cost = bps / 1e4
    net = (1.0 + F.col("gross_return")) * (1.0 - cost) / (1.0 + cost) - 1.0
    g = resolved.groupBy("symbol").agg(F.count("gross_return").alias("trades"), F.avg(net).alias("net_expectancy"), F.sum((F.col("exit_reason") == "STOP_15M").cast("long")).alias("stops"), F.max("failure").alias("failure"), F.max("failed_at").alias("failed_at"))
    d = symbols.select("symbol").distinct().join(g, "symbol", "left").fillna(0, ["trades", "stops"])
    return d.withColumn("path_complete", F.col("failure").isNull())
