"""Option gamma and order flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def aggressor(ticks: DataFrame) -> DataFrame:
    """Side of a trade: given, else by quote, else by the last change of price, else buy."""
    w = Window.partitionBy("symbol").orderBy("ts", "event_id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    quote = F.when(F.col("price") >= F.col("ask"), 1.0).when(F.col("price") <= F.col("bid"), -1.0) if "bid" in ticks.columns else F.lit(None).cast("double")
    given = F.when(F.lower("side").isin("b", "buy"), 1.0).when(F.lower("side").isin("s", "sell"), -1.0) if "side" in ticks.columns else F.lit(None).cast("double")
    d = ticks.withColumn("_d", F.signum(F.nullif(F.col("price") - F.lag("price").over(w), F.lit(0.0))))
    return d.withColumn("aggressor", F.coalesce(given, quote, F.last("_d", ignorenulls=True).over(upto), F.lit(1.0))).drop("_d")


def footprint_levels(ticks: DataFrame, seconds: int, tick: float) -> DataFrame:
    """Buy and sell volume and trades for each bar and price level."""
    bar = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / seconds) * seconds)
    buy = F.col("aggressor") > 0
    return ticks.groupBy("symbol", bar.alias("bar"), (F.bround(F.col("price") / tick) * tick).alias("level")).agg(F.sum(F.when(buy, F.col("size")).otherwise(0.0)).alias("buy"), F.sum(F.when(buy, 0.0).otherwise(F.col("size"))).alias("sell"), F.count("*").alias("trades"))


def imbalances(levels: DataFrame, ratio: float = 3.0) -> DataFrame:
    """Diagonal imbalance with the neighbouring level, and the longest run of each side in a bar."""
    w = Window.partitionBy("symbol", "bar").orderBy("level")
    d = levels.withColumn("buy_imb", F.coalesce(F.col("buy") >= ratio * F.greatest(F.lag("sell").over(w), F.lit(1e-9)), F.lit(False)) & (F.col("buy") > 0)).withColumn("sell_imb", F.coalesce(F.col("sell") >= ratio * F.greatest(F.lead("buy").over(w), F.lit(1e-9)), F.lit(False)) & (F.col("sell") > 0))
    n = F.row_number().over(w)
    out = None
    for side in ("buy", "sell"):
        r = d.withColumn("_g", n - F.row_number().over(Window.partitionBy("symbol", "bar", f"{side}_imb").orderBy("level"))).filter(f"{side}_imb").groupBy("symbol", "bar", "_g").agg(F.count("*").alias("c")).groupBy("symbol", "bar").agg(F.max("c").alias(f"{side}_stack"))
        out = r if out is None else out.join(r, ["symbol", "bar"], "full")
    z = F.lit(0).cast("long")
    out = out.select("symbol", "bar", F.coalesce("buy_stack", z).alias("buy_stack"), F.coalesce("sell_stack", z).alias("sell_stack"))
    return out.withColumn("trigger", F.when((F.col("buy_stack") >= 3) & (F.col("buy_stack") > F.col("sell_stack")), "BUY").when((F.col("sell_stack") >= 3) & (F.col("sell_stack") > F.col("buy_stack")), "SELL").otherwise("NO"))


def footprint_bars(ticks: DataFrame, seconds: int) -> DataFrame:
    """OHLC, delta, its running sum and whether its sign turned."""
    bar = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / seconds) * seconds)
    k = F.struct("ts", "event_id")
    g = ticks.groupBy("symbol", bar.alias("bar")).agg(F.min_by("price", k).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", k).alias("close"), F.sum("size").alias("volume"), F.sum(F.col("aggressor") * F.col("size")).alias("delta"))
    w = Window.partitionBy("symbol").orderBy("bar")
    return g.withColumn("ratio", F.col("delta") / F.nullif(F.col("volume"), F.lit(0.0))).withColumn("cum_delta", F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("flip", F.signum("delta") * F.signum(F.lag("delta", 1, 0.0).over(w)) < 0)


def clean_chain(options: DataFrame, as_of: Column) -> DataFrame:
    """Contracts with a side, a strike, open interest, a volatility within (0.001, 5) and time left, in years of 365 days."""
    side = F.when(F.lower("option_type").isin("c", "call"), "call").when(F.lower("option_type").isin("p", "put"), "put")
    years = F.greatest((F.unix_micros("expiration") - F.unix_micros(as_of)) / 1e6, F.lit(1800.0)) / (365.0 * 86400)
    return options.withColumn("side", side).withColumn("years", years).filter(F.col("side").isNotNull() & (F.col("strike") > 0) & (F.col("open_interest") > 0) & (F.col("implied_volatility") > 0.001) & (F.col("implied_volatility") < 5) & (F.col("expiration") > as_of))


def gamma(spot: Column, strike: Column, vol: Column, years: Column, rate: float = 0.0) -> Column:
    """Black-Scholes gamma."""
    s = vol * F.sqrt(years)
    d1 = (F.log(spot / strike) + (rate + 0.5 * vol * vol) * years) / s
    return F.exp(-0.5 * d1 * d1) / F.sqrt(F.lit(6.283185307179586)) / (spot * s)


def gamma_exposure(chain: DataFrame) -> DataFrame:
    """Exposure of each contract for a 1 % move; puts count negative. Needs spot."""
    g = gamma(F.col("spot"), F.col("strike"), F.col("implied_volatility"), F.col("years"))
    return chain.withColumn("gex", F.when(F.col("side") == "call", 1.0).otherwise(-1.0) * g * F.col("open_interest") * F.col("contract_multiplier") * F.col("spot") * F.col("spot") * 0.01)


def strike_profile(gex: DataFrame) -> DataFrame:
    """By strike, then the walls: strikes of the largest call and the least put exposure (the lower of equals)."""
    k = gex.groupBy("symbol", "strike").agg(F.sum(F.when(F.col("side") == "call", F.col("gex")).otherwise(0.0)).alias("call"), F.sum(F.when(F.col("side") == "put", F.col("gex")).otherwise(0.0)).alias("put"))
    return k.groupBy("symbol").agg(F.sum(F.col("call") + F.col("put")).alias("net_gex"), F.sum(F.col("call") - F.col("put")).alias("gross_gex"), F.max_by("strike", F.struct("call", -F.col("strike"))).alias("call_wall"), F.min_by("strike", F.struct("put", "strike")).alias("put_wall"))


def scenario_curve(chain: DataFrame, points: int = 161, width: float = 0.2) -> DataFrame:
    """Net exposure at spots over +-width; the number of points is fixed."""
    i = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    d = chain.withColumn("i", i).withColumn("at", F.col("spot") * (1.0 - width + 2.0 * width * F.col("i") / (points - 1)))
    g = gamma(F.col("at"), F.col("strike"), F.col("implied_volatility"), F.col("years"))
    net = F.when(F.col("side") == "call", 1.0).otherwise(-1.0) * g * F.col("open_interest") * F.col("contract_multiplier") * F.col("at") * F.col("at") * 0.01
    return d.groupBy("symbol", "i").agg(F.first("spot").alias("spot"), F.first("at").alias("at"), F.sum(net).alias("net"))


def gamma_flip(curve: DataFrame) -> DataFrame:
    """Where the curve changes sign, by linear interpolation, nearest to spot."""
    w = Window.partitionBy("symbol").orderBy("i")
    d = curve.withColumn("_a", F.lag("at").over(w)).withColumn("_n", F.lag("net").over(w)).filter(F.signum("net") * F.signum("_n") < 0)
    x = F.col("_a") - F.col("_n") * (F.col("at") - F.col("_a")) / (F.col("net") - F.col("_n"))
    return d.withColumn("x", x).groupBy("symbol").agg(F.min_by("x", F.abs(F.col("x") - F.col("spot"))).alias("flip"))


def regime_action(net_gex: Column, trigger: Column, close: Column, flip: Column) -> Column:
    """Breakout with negative gamma, reversion with positive, else wait."""
    return F.when((net_gex < 0) & (trigger == "BUY") & (close > flip), "BREAKOUT_LONG").when((net_gex > 0) & (trigger == "BUY"), "REVERSION_LONG").otherwise("WAIT")
