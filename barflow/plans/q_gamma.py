"""Queries of gamma snapshots, order flow by bar and the trades of their regimes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import flow, gamma, joins
from ..sources.files import settled
from . import bindings as b
from . import gamma_sql as q
from .registry import query, shown

#: Looser than the defaults, as hourly prices of the event stream jump without a trend.
RULES = {"rsi_entry": 60.0, "adx_entry": 10.0, "breakout_rsi": 60.0, "min_stacked": 1, "wall_distance": 3.0}
_SQL_RULES = {"trend": 50, "deviations": 0.1, "rsi_entry": 60.0, "adx_entry": 10.0, "breakout_rsi": 60.0, "stacked": 1, "distance": 3.0}


def contracts(spark, sf_dir):
    """Parts as contracts of an event type (by part key) and day (by size); strikes lie about the last close at or before the day."""
    bars = b.bars(spark, sf_dir, 60)
    names = bars.select("symbol").distinct().withColumn("_k", (F.row_number().over(Window.orderBy("symbol")) - 1).cast("long"))  # a handful of event types
    p, key = b.table(spark, sf_dir, "part"), F.col("p_partkey")
    d = p.select((key % 5).alias("_k"), F.timestamp_seconds(F.lit(1704067200) + (F.col("p_size") - 1) % 30 * 86400).alias("ts"), (F.col("p_size") * 7 / 365.0).alias("years"), F.when(F.floor(key / 5) % 2 == 0, "call").otherwise("put").alias("side"),
                 (0.5 + key % 41 / 40.0).alias("_m"), (key % 97).cast("double").alias("open_interest"), (0.1 + key % 50 / 100.0).alias("implied_volatility"), F.lit(100.0).alias("contract_multiplier"), key.alias("_id"))
    d = joins.asof(d.join(names, "_k"), bars.select("symbol", "ts", "close"), "symbol", "ts", "ts", ["close"]).filter("close IS NOT NULL")
    return d.withColumn("spot", F.col("close")).withColumn("strike", F.col("_m") * F.col("close")).filter("open_interest > 0")


def snapshots(spark, sf_dir):
    """One row for each symbol and day."""
    return gamma.snapshot_profile(flow.gamma_exposure(contracts(spark, sf_dir)), ["symbol", "ts"])


def flows(spark, sf_dir):
    return gamma.flow_features(flow.aggressor(b.ticks(spark, sf_dir)), 3600, 5.0)


@query("o_snapshots", q.SNAPSHOTS + " SELECT symbol, ts, round(net_gex, 6) AS net_gex, round(call_wall, 6) AS call_wall, round(put_wall, 6) AS put_wall FROM snap")
def gamma_snapshots(spark, sf_dir):
    """Exposure and walls of each symbol's daily chain."""
    return shown(snapshots(spark, sf_dir), ["symbol", "ts"], ["net_gex", "call_wall", "put_wall"])


@query("o_flow", q.FLOWS + " SELECT symbol, ts, round(delta, 6) AS delta, stack AS max_stacked_buy, CAST(turned AS BIGINT) AS delta_flip_up, CAST(absorbs AS BIGINT) AS buy_absorption FROM fl")
def order_flow(spark, sf_dir):
    """Delta, stacks and absorption of each hour."""
    return shown(flows(spark, sf_dir), ["symbol", "ts"], ["delta", "max_stacked_buy", "delta_flip_up", "buy_absorption"])


def regime_bars(spark, sf_dir):
    bars = gamma.overlaid(b.bars(spark, sf_dir, 60), settled(snapshots(spark, sf_dir), "snapshots"), ["net_gex", "call_wall", "put_wall"], F.expr("INTERVAL 2 DAYS"))
    return gamma.regimes(gamma.regime_features(bars.join(flows(spark, sf_dir), ["symbol", "ts"], "left"), trend=50, deviations=0.1), **RULES)


@query("k_gamma_regime", q.trades_sql(**_SQL_RULES))
def regime_trades(spark, sf_dir):
    """Trades of both regimes on hourly bars of the event stream."""
    return shown(gamma.regime_trades(regime_bars(spark, sf_dir)), ["symbol", "entry_time", "exit_time", "regime", "exit_reason"], ["entry_price", "exit_price", "return_pct", "bars_held"])
