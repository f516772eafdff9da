"""Composed jobs (Q rows): tables in, tables out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import windows as w
from ..operators import bars as ob
from ..operators import joins as j
from ..operators import metrics as m
from ..operators import panel as p
from ..operators import quality as q
from ..operators import signals as s
from ..operators import trades as t
from ..operators import validation as v


def timeframe_bundle(fine: DataFrame, daily: DataFrame) -> DataFrame:
    """15m, 1h, 2h, 4h, 1d and 1w bars in one table, complete buckets alone."""
    bars15 = fine.withColumn("timeframe", F.lit("15m"))
    out = [bars15]
    for name, n in (("1h", 4), ("2h", 8), ("4h", 16)):
        out.append(ob.by_grid(fine, 15, 15 * n).filter("complete").drop("complete").withColumn("timeframe", F.lit(name)))
    d = daily.withColumn("ts", F.col("ts").cast("timestamp"))
    out.append(d.withColumn("timeframe", F.lit("1d")))
    out.append(ob.weekly(daily).drop("n").withColumnRenamed("week", "ts").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("timeframe", F.lit("1w")))
    cols = ["timeframe", "symbol", "ts", "open", "high", "low", "close", "volume"]
    return reduce(lambda a, b: a.unionByName(b), [x.select(*cols) for x in out])


def state_features(bars: DataFrame, prefix: str) -> DataFrame:
    """Features of a timeframe's bars, known from 3 or 5 rows on."""
    d = w.indexed(bars).withColumn("_ret", w.pct_change("close"))
    d = w.ema(w.ema(d, "close", "_e5", 5), "close", "_e20", 20)
    d = d.withColumns({
        f"{prefix}_ret1": F.col("_ret"), f"{prefix}_ret3": w.pct_change("close", 3), f"{prefix}_range": (F.col("high") - F.col("low")) / F.nullif(F.col("close"), F.lit(0.0)),
        f"{prefix}_vol": F.when(F.count("_ret").over(w.frame(20)) >= 5, F.stddev_samp("_ret").over(w.frame(20))), f"{prefix}_ema5": F.col("close") / F.col("_e5") - 1, f"{prefix}_ema20": F.col("close") / F.col("_e20") - 1,
        f"{prefix}_trend": F.col("_e5") / F.col("_e20") - 1, f"{prefix}_volume": F.log1p("volume") - F.avg(F.log1p("volume")).over(w.frame(20))})
    return d.drop("_ret", "_e5", "_e20", "rn", "blk", "pos", "sup")


def causal_dataset(fine: DataFrame, coarse: DataFrame, sessions: DataFrame, minutes: int, context_minutes: int) -> DataFrame:
    """Q08, 3.1: decision rows of fine bars, each with the features of the last coarse bar known by then, if of the same session."""
    rows = ob.decision_surface(ob.availability(fine, sessions, minutes)).withColumnRenamed("available", "decision_time")
    ctx = ob.availability(state_features(coarse, "ctx"), sessions, context_minutes)
    feats = [c for c in ctx.columns if c.startswith("ctx_")]
    d = j.asof(rows, ctx, "symbol", "decision_time", "available", feats)
    d = j.fresh_in_session(d, "decision_time", "source_time", feats)
    return d.withColumn("leak", F.coalesce(F.col("source_time") > F.col("decision_time"), F.lit(False)))


def rl_features(bars: DataFrame, n: int = 20) -> DataFrame:
    """Log return, its robust z (rolling median and absolute deviation) and rolling z of volume; complete rows."""
    d = w.indexed(bars).withColumn("lr", F.log(F.col("close") / F.nullif(w.lag("close"), F.lit(0.0))))
    med = lambda c: F.when(F.count(c).over(w.frame(n)) >= n, F.percentile(c, 0.5).over(w.frame(n)))
    d = d.withColumn("_m", med("lr")).withColumn("_a", F.abs(F.col("lr") - F.col("_m"))).withColumn("_mad", med("_a"))
    d = d.withColumn("robust_z", (F.col("lr") - F.col("_m")) / F.nullif(1.4826 * F.col("_mad"), F.lit(0.0))).withColumn("volume_z", (F.col("volume") - w.sma("volume", n)) / F.nullif(w.rolling_std("volume", n), F.lit(0.0)))
    return d.select("symbol", "ts", "close", "lr", "robust_z", "volume_z").dropna()


def rsi2_bundle(bars: DataFrame) -> DataFrame:
    """RSI 2, ADX 5, means, bands, ATR and VWAP; rows that are fully warmed."""
    d = w.rolling_vwap(w.atr(w.adx(w.rsi(w.bollinger(w.indexed(bars)), "rsi2", 2, rule="fifty"), 5), "atr14", 14), 20)
    return d.withColumn("sma200", w.sma("close", 200)).filter("sma200 IS NOT NULL AND rsi2 IS NOT NULL AND adx IS NOT NULL")


def strategy_factory(bars: DataFrame, names: list[str], folds: DataFrame, max_hold: int = 20, bps: float = 3.0) -> DataFrame:
    """Trades of strategies, metrics by fold and segment, gate, test summary and status.

    Names are a handful of plans, not data; each is one pass over shared bars.
    """
    trades = t.from_several(w.indexed(bars), "strategy", {n: lambda x, n=n: s.signals(x, n) for n in names}, max_hold)
    key = F.concat_ws("|", "strategy", "fold")
    folded = m.trade_metrics(p.contained(trades, folds), ["strategy", "fold", "segment"], bps).withColumn("key", key)
    gated = v.fold_gate(folded).withColumn("strategy", F.split("key", r"\|")[0])
    out = gated.groupBy("strategy").agg(F.count("*").alias("folds"), F.sum(F.col("passed").cast("long")).alias("passed"), F.avg((F.col("test_net_expectancy") > 0).cast("double")).alias("positive"), F.percentile("test_net_expectancy", 0.5).alias("median"), F.min("test_net_expectancy").alias("worst"))
    return out.withColumn("status", v.survivor_status(F.col("folds"), F.col("positive"), F.col("median"), F.col("worst")))


def session_audit(bars: DataFrame) -> DataFrame:
    """Q09: per symbol: sessions, bars, and fewest and most bars of a session."""
    g = bars.groupBy("symbol", F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))
    return g.groupBy("symbol").agg(F.count("*").alias("sessions"), F.sum("n").alias("bars"), F.min("n").alias("fewest"), F.max("n").alias("most"))


def collect_and_derive(landed: DataFrame) -> DataFrame:
    """5-minute rows to complete 15-minute bars with their lineage."""
    good = q.identical_once(q.split_bad(landed)[0])
    return ob.by_grid(good, 5, 15).filter("complete").drop("complete").withColumns({"source_interval": F.lit("5m"), "derivation": F.lit("exact_3_bar"), "quality_status": F.lit("VALIDATED_OHLC"), "is_partial": F.lit(False)})


def synchronised(base: DataFrame, tail: DataFrame, limit_bps: float) -> DataFrame:
    """The tail replaces base from its start on, for symbols whose overlap audit passes; others keep base."""
    ok = q.overlap_gate(ob.overlap_audit(base, tail), 5, limit_bps).filter("passed").select("symbol")
    return ob.replace_tail(base, tail.join(ok, "symbol", "left_semi"))


def swing_evaluation(bars: DataFrame, predict: Column, hold: int, gap: int) -> DataFrame:
    """Q18-Q20: labels, purged periods and metrics of a prediction, by symbol and period."""
    d = w.indexed(bars).select("symbol", "ts", p.forward_open_to_close(hold).alias("label"), predict.alias("prediction")).dropna()
    d = d.join(p.purged(d, gap), "ts").withColumn("k", F.concat_ws("|", "symbol", "period"))
    return p.series_metrics(d, "prediction", "label", "k")
