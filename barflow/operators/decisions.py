"""Candidates, allocations and readiness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def lane(score: Column, risk: Column, cap: Column) -> Column:
    """GEM, CORE, TACTICAL or WATCHLIST."""
    return F.when((score >= 75) & (risk <= 40) & (cap < 2e9), "GEM").when((score >= 70) & (risk <= 50), "CORE").when(score >= 55, "TACTICAL").otherwise("WATCHLIST")


def ranked_candidates(df: DataFrame, most: int) -> DataFrame:
    """By lane, then score and symbol, the first ``most``."""
    order = F.when(F.col("lane") == "GEM", 0).when(F.col("lane") == "CORE", 1).when(F.col("lane") == "TACTICAL", 2).otherwise(3)
    return df.orderBy(order, F.col("total_score").desc(), "symbol").limit(most)


def reweighted(parts: dict[str, float]) -> Column:
    """weighted mean over the columns that are known, to 4 places; null if none is."""
    have = lambda c: F.when(F.col(c).isNotNull(), F.lit(parts[c])).otherwise(0.0)
    w = sum(have(c) for c in parts)
    return F.round(sum(have(c) * F.coalesce(F.col(c), F.lit(0.0)) for c in parts) / F.nullif(w, F.lit(0.0)), 4)


def liquidity_score(volume: Column) -> Column:
    """0 at 1e4 dollars a day, 100 at 1e8."""
    return clamp(25.0 * (F.log10(F.greatest(volume, F.lit(1.0))) - 4.0), 0.0, 100.0)


def technical_score(ret: Column, rsi: Column, hist: Column, vol: Column) -> Column:
    """Tanh-weighted score of a symbol's last row, within 1."""
    return clamp(0.4 * F.tanh(10.0 * ret) + 0.3 * F.tanh((rsi - 50.0) / 20.0) + 0.3 * F.tanh(100.0 * hist) - 0.2 * F.tanh(10.0 * vol), -1.0, 1.0)


def asset_view(technical: Column, news: Column, macro: Column, risk: Column) -> Column:
    """Missing parts count 0; risk takes up to half away."""
    z = F.lit(0.0)
    s = 0.5 * F.coalesce(technical, z) + 0.3 * F.coalesce(news, z) + 0.2 * F.coalesce(macro, z)
    return clamp(s * (1.0 - 0.5 * F.coalesce(risk, z)), -1.0, 1.0)


def allocation(views: DataFrame, k: int = 10, most: float = 0.2, cash: float = 0.05) -> DataFrame:
    """The k best positive views, weights by desirability, capped; what caps leave over stays cash."""
    w = Window.orderBy(F.col("view").desc(), "symbol")
    d = views.filter("view > 0").orderBy(F.col("view").desc(), "symbol").limit(k)
    t = d.agg(F.sum("view").alias("s"))
    return d.crossJoin(t).select("symbol", "view", F.least(F.col("view") / F.col("s") * (1.0 - cash), F.lit(most)).alias("weight"))


def proposals(rows: DataFrame) -> DataFrame:
    """Per symbol: strategies that signal, blockers, decision."""
    g = rows.groupBy("symbol").agg(F.count("*").alias("strategies"), F.sum((F.col("state") == "SIGNAL").cast("long")).alias("signals"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("blockers")))).alias("blockers"), F.max("score").alias("score"))
    return g.withColumn("decision", F.when(F.size("blockers") > 0, "BLOCKED").when(F.col("signals") >= 1, "PROPOSE").otherwise("WAIT"))


def signal_state(bars_since: Column, hold: int) -> Column:
    """D05, W47."""
    return F.when(bars_since.isNull(), "NONE").when(bars_since == 0, "SIGNAL").when(bars_since <= hold, "ACTIVE").otherwise("EXPIRED")


def bars_since(df: DataFrame, event: str) -> DataFrame:
    """Rows from each symbol's last event to its last row; null without events."""
    return df.groupBy("symbol").agg((F.max("rn") - F.max(F.when(F.col(event), F.col("rn")))).alias("bars_since"))


def intents(plan: DataFrame, held: DataFrame, least: float = 0.01) -> DataFrame:
    """BUY, SELL or HOLD from target and held weights."""
    d = plan.select("symbol", F.col("weight").alias("target")).join(held.select("symbol", F.col("weight").alias("now")), "symbol", "full").fillna(0.0, ["target", "now"])
    x = F.col("target") - F.col("now")
    return d.withColumn("intent", F.when(x > least, "BUY").when(x < -least, "SELL").otherwise("HOLD"))


def readiness(counts: DataFrame, gates: dict[str, int]) -> DataFrame:
    """One row: blockers of gates that are not met."""
    return counts.withColumn("blockers", F.array_compact(F.array(*[F.when(F.col(c) < n, F.lit(c)) for c, n in gates.items()]))).withColumn("ready", F.size("blockers") == 0)


def financial_ratios(reports: DataFrame, as_of: Column, limit: float = 0.3333) -> DataFrame:
    """the last report filed by ``as_of``: debt, cash and receivables to market value, and the failed ratios."""
    last = reports.filter(F.col("filing_date") <= as_of).groupBy("symbol").agg(F.max_by(F.struct("debt", "cash", "receivables", "market_cap"), F.struct("filing_date", "report_date")).alias("x")).select("symbol", "x.*")
    d = last.withColumns({f"{c}_ratio": F.col(c) / F.nullif(F.col("market_cap"), F.lit(0.0)) for c in ("debt", "cash", "receivables")})
    return d.withColumn("failures", F.array_compact(F.array(*[F.when(F.coalesce(F.col(f"{c}_ratio"), F.lit(9.0)) > limit, F.lit(c)) for c in ("debt", "cash", "receivables")])))


def attestation_valid(status: Column, expires: Column, issued: Column, now: Column, days: int = 365) -> Column:
    """an accepted status, not expired, not older than ``days``; unknown is not valid."""
    return F.coalesce(F.upper(status).isin("VALID", "APPROVED", "COMPLIANT") & (expires.isNull() | (expires >= now)) & (F.datediff(now, issued) <= days), F.lit(False))


def overlay_masks(df: DataFrame) -> DataFrame:
    """A row for each mask that a prediction's rank passes."""
    masks = {"ALL": F.lit(True), "PRED_POSITIVE": F.col("prediction") > 0, "TOP_HALF": F.col("pct") >= 0.6, "TOP2": F.col("ord") <= 2, "TOP1": F.col("ord") == 1, "POSITIVE_TOP2": (F.col("prediction") > 0) & (F.col("ord") <= 2)}
    return df.withColumn("mask", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in masks.items()]))))


def ledger_audit(ledger: DataFrame) -> DataFrame:
    """Days off by more than 1e-7 between nav changes and booked results, and the extremes."""
    w = Window.partitionBy("account").orderBy("date")
    d = ledger.withColumn("_e", F.col("nav") - F.lag("nav").over(w) - F.col("pnl"))
    return d.groupBy("account").agg(F.count("*").alias("days"), F.sum((F.abs("_e") > 1e-7).cast("long")).alias("off"), F.max(F.abs("_e")).alias("largest"), F.min("nav").alias("low"), F.max("nav").alias("high"))


def explained_day(trades: DataFrame, bars: DataFrame, day: Column) -> DataFrame:
    """Trades open on a day with the bar's return and the median dollar volume of 20 bars before."""
    w = Window.partitionBy("symbol").orderBy("ts")
    f = w.rowsBetween(-20, -1)
    b = bars.withColumn("dv", F.col("close") * F.col("volume")).withColumn("median_dv", F.when(F.count("dv").over(f) >= 20, F.percentile("dv", 0.5).over(f))).withColumn("ret", F.col("close") / F.lag("close").over(w) - 1).filter(F.col("ts") == day)
    t = trades.filter((F.to_date("entry_time") <= day) & (F.to_date("exit_time") >= day))
    return t.join(b.select("symbol", "ts", "ret", "median_dv"), "symbol")


def macro_summary(series: DataFrame) -> DataFrame:
    """Latest value and changes over 1, 5 and 20 observations."""
    w = Window.partitionBy("series").orderBy("ts")
    d = series.withColumns({f"change_{n}": F.col("value") - F.lag("value", n).over(w) for n in (1, 5, 20)})
    return d.groupBy("series").agg(F.max_by(F.struct("ts", "value", "change_1", "change_5", "change_20"), "ts").alias("x")).select("series", "x.*")


#: The screeners with lane, score bonus and filters beside the common ones.
SCREENERS = {
    "CORE_MOMENTUM": ("CORE", 2.0, [("market_cap", ">", 25e9)]),
    "GEM_QUALITY": ("GEM", 4.0, [("market_cap", "<", 25e9), ("earnings_share", ">", 0.0)]),
    "TACTICAL_MOMENTUM": ("TACTICAL", 3.0, [("five_day_return", ">", 2.0)]),
    "TACTICAL_PULLBACK": ("TACTICAL", 3.0, [("daily_return", "<", -2.0)]),
}
_COMMON = [("price", ">", 5.0), ("average_volume", ">", 300e3), ("market_cap", ">", 300e6)]


def screener_rows(securities: DataFrame) -> DataFrame:
    """A row for each screener that a security passes, with its part scores and research score.

    Reads symbol, price, average_volume, market_cap, daily_return, five_day_return, earnings_share;
    a row without price or market value scores nowhere, missing volume and returns count 0.
    """
    z = F.lit(0.0)
    d = securities.withColumns({c: F.coalesce(c, z) for c in ("average_volume", "daily_return", "five_day_return")}).filter(F.col("price").isNotNull() & F.col("market_cap").isNotNull())
    test = {">": lambda c, v: F.col(c) > v, "<": lambda c, v: F.col(c) < v}
    passes = lambda tests: F.coalesce(reduce(lambda a, b: a & b, [test[op](c, v) for c, op, v in [*_COMMON, *tests]]), F.lit(False))
    hits = F.array_compact(F.array(*[F.when(passes(t), F.struct(F.lit(n).alias("screener"), F.lit(lane_).alias("lane"), F.lit(bonus).alias("bonus"))) for n, (lane_, bonus, t) in SCREENERS.items()]))
    d = d.withColumn("_h", F.explode(hits)).select("*", "_h.*").drop("_h")
    day, week, volume, cap = F.col("daily_return"), F.col("five_day_return"), F.col("average_volume"), F.col("market_cap")
    back = 52.0 + F.least(F.abs(F.least(day, z)) * 4.0, F.lit(20.0)) + F.greatest(week, z) * 1.25
    d = d.withColumn("technical", clamp(F.when(F.col("screener") == "TACTICAL_PULLBACK", back).otherwise(50.0 + day * 2.0 + week * 1.5), 15.0, 95.0))
    d = d.withColumn("liquidity", F.when(volume <= 0, 20.0).otherwise(clamp(50.0 + 12.0 * F.log10(F.greatest(volume, F.lit(1e5)) / 1e5), 35.0, 95.0)))
    d = d.withColumn("risk", F.when(cap >= 25e9, 72.0).when(cap >= 5e9, 66.0).when(cap >= 1e9, 59.0).otherwise(50.0)).withColumn("fundamental", F.when(F.col("earnings_share").isNull(), 50.0).when(F.col("earnings_share") > 0, 68.0).otherwise(38.0))
    return d.withColumn("research_score", clamp(0.42 * F.col("technical") + 0.25 * F.col("liquidity") + 0.18 * F.col("fundamental") + 0.15 * F.col("risk") + F.col("bonus"), 0.0, 100.0))


def merged_screens(rows: DataFrame, most: int) -> DataFrame:
    """Each symbol's best row (the screener named first, of equals), with the screeners it passed; the ``most`` first: a top-k report."""
    place = sum(F.when(F.col("screener") == n, k).otherwise(0) for k, n in enumerate(SCREENERS))
    best = rows.groupBy("symbol").agg(F.max_by(F.struct("screener", "lane", "research_score", "technical", "liquidity"), F.struct("research_score", -place)).alias("x"), F.array_sort(F.collect_set("screener")).alias("screeners")).select("symbol", "x.*", "screeners")
    return best.orderBy(F.col("research_score").desc(), F.col("technical").desc(), F.col("liquidity").desc(), F.col("symbol").desc()).limit(most)


def to_hydrate(wanted: DataFrame, stored: DataFrame, least: int, now: str, days: int) -> DataFrame:
    """Q22: symbols of a plan whose stored bars do not suffice or are not there."""
    from .quality import usable

    return wanted.select("symbol").distinct().join(usable(stored, least, now, days).filter("usable"), "symbol", "left_anti")


def verification(reports: DataFrame, attested: DataFrame, as_of: Column) -> DataFrame:
    """Q23: per symbol: failed ratios of the last report filed, whether an attestation holds, and the status of both."""
    d = financial_ratios(reports, as_of).select("symbol", "failures").join(attested.select("symbol", attestation_valid(F.col("status"), F.col("expires"), F.col("issued"), as_of).alias("attested")), "symbol", "full")
    return d.withColumn("verdict", F.when(F.coalesce("attested", F.lit(False)), "ATTESTED").when(F.col("failures").isNull(), "NO_DATA").when(F.size("failures") == 0, "PASSED").otherwise("FAILED"))
