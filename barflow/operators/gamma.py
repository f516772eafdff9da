"""Trades by gamma regime and order flow (K07), and the overlay they rest on.

An overlay row tells a symbol's net gamma exposure and walls at a time, and the order flow of a bar.
Bars take the last overlay row at or before them. With positive exposure a dip back to the put wall
is bought, with negative exposure a break of the call wall; each regime has its own stop and exits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as w
from ..sources.files import settled
from . import flow, joins
from .trades import non_overlapping

REVERSION, BREAKOUT = "positive_gex_mean_reversion", "negative_gex_breakout"


def snapshot_profile(gex: DataFrame, by: list[str]) -> DataFrame:
    """A22 for each snapshot (``by``): net exposure, and the strikes of the largest call and the least put exposure (the lower of equals)."""
    call, put = (F.sum(F.when(F.col("side") == side, F.col("gex")).otherwise(0.0)).alias(side) for side in ("call", "put"))
    k = gex.groupBy(*by, "strike").agg(call, put)
    return k.groupBy(*by).agg(F.sum(F.col("call") + F.col("put")).alias("net_gex"), F.max_by("strike", F.struct("call", -F.col("strike"))).alias("call_wall"), F.min_by("strike", F.struct("put", "strike")).alias("put_wall"))


def flow_features(ticks: DataFrame, seconds: int, tick: float, ratio: float = 3.0, share: float = 0.30) -> DataFrame:
    """A23, A24, W38-W40 side by side for each bar: delta, its turn upwards, the longest buy stack, and buying that absorbs.

    ``ticks`` has aggressor. Buys absorb where the lowest quarter of the bar's range took ``share`` of
    its volume as sells and the close is in the upper half.
    """
    levels = flow.footprint_levels(ticks, seconds, tick)
    bars = flow.footprint_bars(ticks, seconds)
    width = F.greatest(F.col("high") - F.col("low"), F.lit(tick))
    deep = levels.join(bars.select("symbol", "bar", "high", "low"), ["symbol", "bar"]).groupBy("symbol", "bar").agg(
        F.sum(F.when(F.col("level") <= F.col("low") + 0.25 * width, F.col("sell")).otherwise(0.0)).alias("_deep"), F.sum(F.col("buy") + F.col("sell")).alias("_all"))
    d = bars.join(deep, ["symbol", "bar"]).join(flow.imbalances(levels, ratio).select("symbol", "bar", F.col("buy_stack").alias("max_stacked_buy")), ["symbol", "bar"], "left")
    turned = F.coalesce(F.lag("delta").over(Window.partitionBy("symbol").orderBy("bar")), F.lit(0.0)) <= 0
    absorbs = (F.col("_all") > 0) & (F.col("_deep") >= share * F.col("_all")) & (F.col("close") >= F.col("low") + 0.5 * width)
    return d.select("symbol", F.col("bar").alias("ts"), "delta", F.coalesce("max_stacked_buy", F.lit(0)).alias("max_stacked_buy"), (turned & (F.col("delta") > 0)).alias("delta_flip_up"), absorbs.alias("buy_absorption"))


def overlaid(bars: DataFrame, overlay: DataFrame, columns: list[str], oldest: Column | None = None) -> DataFrame:
    """Bars with the overlay's last row at or before them; older ones than ``oldest`` (an interval) tell nothing."""
    return joins.asof(bars, overlay, "symbol", "ts", "ts", columns, oldest).drop("source_time")


def regime_features(bars: DataFrame, trend: int = 200, band: int = 20, deviations: float = 2.0, atr_n: int = 14, exit_ema: int = 5, vwap: int = 20) -> DataFrame:
    """Indexed bars with rsi, adx, trend_sma, bb_low, bb_high, vwap (rolling), atr, exit_ema and ema8."""
    d = w.together(w.indexed(bars), w.rsi_recipe("rsi", 2, rule="fifty"), w.adx_recipe(5), w.atr_recipe("atr", atr_n), w.ema_recipe("close", "exit_ema", exit_ema, 1, exit_ema), w.ema_recipe("close", "ema8", 8, 1, 8))
    return w.rolling_vwap(w.bollinger(d.withColumn("trend_sma", w.sma("close", trend)), band, deviations), vwap)


def regimes(bars: DataFrame, rsi_entry: float = 10.0, adx_entry: float = 25.0, breakout_rsi: float = 90.0, min_stacked: int = 3, wall_distance: float = 1.5) -> DataFrame:
    """Add ``regime``: which setup a bar completes, with its order flow, or null.

    Needs the features and net_gex, call_wall, put_wall, delta, max_stacked_buy, delta_flip_up and
    buy_absorption. Without any of the features or net_gex there is no setup; walls may be null.
    """
    c, no = F.col, F.lit(False)
    flows = (F.coalesce("max_stacked_buy", F.lit(0)) >= min_stacked) | (F.coalesce("delta_flip_up", no) & F.coalesce("buy_absorption", no))
    near = F.coalesce(F.abs(c("close") - c("put_wall")) <= wall_distance * c("atr"), F.lit(True))
    up, known = c("close") > c("trend_sma"), c("vwap").isNotNull() & c("bb_low").isNotNull() & c("atr").isNotNull()
    back = (c("net_gex") > 0) & up & (c("adx") >= adx_entry) & (c("rsi") <= rsi_entry) & (c("close") <= c("bb_low")) & (c("close") <= c("vwap")) & near & flows
    growing = (c("adx") >= adx_entry) & (c("adx") > w.lag("adx"))
    broke = F.coalesce((c("close") > c("call_wall")) & (w.lag("close") <= c("call_wall")), no) | (c("close") > c("bb_high"))
    out = (c("net_gex") < 0) & up & (c("rsi") >= breakout_rsi) & growing & broke & flows & (F.coalesce("delta", F.lit(0.0)) > 0)
    return bars.withColumn("regime", F.when(known, F.when(F.coalesce(back, no), REVERSION).when(F.coalesce(out, no), BREAKOUT)))


def regime_trades(bars: DataFrame, rsi_exit: float = 60.0, reversion_stop: float = 1.5, breakout_stop: float = 1.5, trail: float = 2.0, wall_buffer: float = 0.25,
                  reversion_hold: int = 12, breakout_hold: int = 40, slippage_bps: float = 5.0, fee: float = 0.001) -> DataFrame:
    """Next-open entry after a regime's setup; the first exit in this order at each bar.

    A stop: at the open where that lies beyond, else at its price; by ATR of the signal bar, for
    breakouts not lower than a buffer under a broken wall, and then trailing the highest high since the
    entry. Reversions leave at the call wall, at a close over the exit EMA or an RSI over its
    level (not on the entry bar), or at the last close they may hold; breakouts at a close under EMA8 or at
    theirs. What is open at the end leaves at the last close. A signal on an exit bar counts. ``bars``
    has regime and the features. Returns are net of fees and do not depend on the size.
    """
    c = F.col
    slip, last = slippage_bps / 1e4, F.max("rn").over(Window.partitionBy("symbol"))
    bars = settled(bars.select("symbol", "rn", "blk", "pos", "sup", "ts", "open", "high", "low", "close", "atr", "exit_ema", "ema8", "rsi", "call_wall", "regime"), "regimes")
    d = bars.withColumn("_n", last).withColumn("_next", w.lead("open")).withColumn("_at", w.lead("ts"))
    back = c("regime") == REVERSION
    e = d.filter(c("regime").isNotNull() & (c("rn") < c("_n"))).select("symbol", c("rn").alias("signal"), "regime", "call_wall", c("_at").alias("entry_time"), (c("_next") * (1.0 + slip)).alias("entry_price"), c("atr").alias("_atr"), "_n")
    by_atr = c("entry_price") - F.when(back, reversion_stop).otherwise(breakout_stop) * c("_atr")
    by_wall = c("call_wall") - wall_buffer * c("_atr")
    e = e.withColumn("_stop", F.when(~back & (by_wall < c("entry_price")), F.greatest(by_atr, by_wall)).otherwise(by_atr)).withColumn("_hold", F.when(back, reversion_hold).otherwise(breakout_hold))
    p = bars.select("symbol", "rn", "ts", "open", "high", "low", "close", "atr", "exit_ema", "ema8", "rsi")
    # A candidate meets the bars that it may hold, a bounded number.
    path = e.withColumn("rn", F.explode(F.sequence(c("signal") + 1, F.least(c("_n"), c("signal") + 1 + c("_hold"))))).join(p, ["symbol", "rn"])
    since = Window.partitionBy("symbol", "signal").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    path = path.withColumn("_trail", F.when(~back, F.max("high").over(since) - trail * c("atr"))).withColumn("_stop", F.greatest("_stop", F.max("_trail").over(since)))
    held, no = c("rn") - c("signal") - 1, F.lit(False)
    rules = [(c("open") <= c("_stop"), "stop_gap", c("open")), (c("low") <= c("_stop"), "stop_loss", c("_stop")),
             (back & (c("call_wall") > c("entry_price")) & (c("high") >= c("call_wall")), "call_wall_target", c("call_wall")),
             (back & (held >= 1) & (c("close") >= c("exit_ema")), "ema_recovery", c("close")), (back & (held >= 1) & (c("rsi") >= rsi_exit), "rsi_recovery", c("close")),
             (~back & (held >= 1) & (c("close") < c("ema8")), "ema8_trailing_exit", c("close")), (held >= c("_hold"), "time_exit", c("close")), (c("rn") == c("_n"), "end_of_data", c("close"))]
    hit = None
    for met, reason, price in rules:
        left = F.struct("rn", F.lit(reason).alias("reason"), (price * (1.0 - slip)).alias("price"), c("ts").alias("at"))
        hit = F.when(F.coalesce(met, no), left) if hit is None else hit.when(F.coalesce(met, no), left)
    first = path.withColumn("_h", hit).filter("_h IS NOT NULL").groupBy("symbol", "signal").agg(F.min_by("_h", "rn").alias("_h"))
    e = e.join(first, ["symbol", "signal"]).withColumn("exit_price", c("_h.price"))
    net = c("exit_price") * (1.0 - fee) - c("entry_price") * (1.0 + fee)
    out = e.select("symbol", "signal", c("_h.rn").alias("exit_rn"), "regime", "entry_time", c("_h.at").alias("exit_time"), "entry_price", "exit_price", (net / (c("entry_price") * (1.0 + fee))).alias("return_pct"), (c("_h.rn") - c("signal") - 1).alias("bars_held"), c("_h.reason").alias("exit_reason"))
    return non_overlapping(out, ["symbol"])
