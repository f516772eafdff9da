"""Trade and return metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def net_return(gross: Column, bps: float) -> Column:
    """return after a cost of ``bps`` a side."""
    c = bps / 1e4
    return (1.0 + gross) * (1.0 - c) / (1.0 + c) - 1.0


def profit_factor(x: Column) -> Column:
    """Gains over losses as an aggregate; infinite without losses, 0 without both."""
    gain, loss = F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0)), F.coalesce(F.sum(F.when(x < 0, -x)), F.lit(0.0))
    return F.when(loss > 0, gain / F.nullif(loss, F.lit(0.0))).when(gain > 0, F.lit(float("inf"))).otherwise(0.0)


def trade_metrics(trades: DataFrame, keys: list[str], bps: float = 3.0) -> DataFrame:
    """A13, A14 (mergeable: only built-in aggregates): per key, over trades with a finite gross return."""
    g = F.col("gross_return")
    d = trades.filter(g.isNotNull() & ~F.isnan(g) & (F.abs(g) != float("inf"))).withColumn("_n", net_return(g, bps))
    n = F.col("_n")
    out = d.groupBy(*keys).agg(
        F.count("*").alias("trades"), F.avg(g).alias("gross_expectancy"), F.avg(n).alias("net_expectancy"), F.percentile(n, 0.5).alias("median_net_return"), profit_factor(n).alias("profit_factor"),
        F.avg((n > 0).cast("double")).alias("win_rate"), F.min(n).alias("worst_trade"), F.percentile(n, 0.1).alias("p10_trade"), F.stddev_samp(n).alias("return_std"),
        F.percentile("duration_bars", 0.5).alias("median_duration_bars"), F.avg(F.col("forced").cast("double")).alias("forced_ratio"))
    return out.withColumn("net_expectancy_bps", 1e4 * F.col("net_expectancy")).withColumn("expectancy_t_proxy", F.col("net_expectancy") / F.nullif(F.col("return_std"), F.lit(0.0)) * F.sqrt("trades"))


def accumulated(trades: DataFrame, keys: list[str], bps: float = 3.0) -> DataFrame:
    """The same by years: share of years with a positive mean."""
    d = trades.withColumn("_n", net_return(F.col("gross_return"), bps)).withColumn("year", F.year("exit_time"))
    y = d.groupBy(*keys, "year").agg(F.count("*").alias("c"), F.sum("_n").alias("s"), F.sum(F.col("_n") * F.col("_n")).alias("q"))
    m = F.sum("s") / F.sum("c")
    return y.groupBy(*keys).agg(F.sum("c").alias("trades"), m.alias("mean"), F.sqrt(F.greatest(F.sum("q") / F.sum("c") - m * m, F.lit(0.0))).alias("std"), F.avg((F.col("s") > 0).cast("double")).alias("positive_year_ratio"), F.count("*").alias("years"))


def daily_stream(trades: DataFrame, keys: list[str], weight: float = 1.0) -> DataFrame:
    """Per key and exit date: weighted return, turnover (both sides) and orders."""
    return trades.groupBy(*keys, F.to_date("exit_time").alias("date")).agg((F.sum("gross_return") * weight).alias("gross_return"), (F.count("*") * 2 * weight).cast("double").alias("turnover"), (F.count("*") * 2).cast("long").alias("orders"))


def costed(stream: DataFrame, bps: float = 3.0, fee: float = 1.0, capital: float = 1e5, weight: float = 1.0) -> DataFrame:
    """Weight * (gross - side cost * turnover) - orders * fee / capital."""
    return stream.withColumn("net_return", weight * (F.col("gross_return") - bps / 1e4 * F.col("turnover")) - F.col("orders") * fee / capital)


def normal_cdf(x: Column) -> Column:
    """F16: by the error function's series of five terms; absolute error under 1e-7."""
    # Abramowitz and Stegun 7.1.26, as published.
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + p * z)
    poly = F.lit(0.0)
    for k in reversed(a):
        poly = (poly + k) * t
    e = 1.0 - poly * F.exp(-z * z)
    return F.when(x >= 0, 0.5 * (1.0 + e)).otherwise(0.5 * (1.0 - e))


def probabilistic_sharpe(sharpe: Column, n: Column, skew: Column, kurt: Column, benchmark: float = 0.0) -> Column:
    """F16: chance that the true ratio is over ``benchmark``; kurtosis is 3 for normal returns."""
    d = 1.0 - skew * sharpe + (kurt - 1.0) / 4.0 * sharpe * sharpe
    return F.when(d > 0, normal_cdf((sharpe - benchmark) * F.sqrt(n - 1.0) / F.sqrt(d)))


def daily_metrics(stream: DataFrame, key: str, date: str = "date", r: str = "r") -> DataFrame:
    """Per key: totals, annualised ratios, drawdown and its length, positive shares, moments, PSR."""
    w = Window.partitionBy(key).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    d = stream.select(key, date, F.coalesce(F.col(r), F.lit(0.0)).alias("r")).withColumn("eq", F.product(1.0 + F.col("r")).over(w))
    d = d.withColumn("dd", F.col("eq") / F.max("eq").over(w) - 1.0)
    d = d.withColumn("_i", F.sum(F.when(F.col("dd") >= 0, 1).otherwise(0)).over(w))
    d = d.withColumn("_u", F.sum(F.when(F.col("dd") < 0, 1).otherwise(0)).over(Window.partitionBy(key, "_i")))
    years = stream.select(key, F.year(date).alias("y"), F.coalesce(F.col(r), F.lit(0.0)).alias("r")).groupBy(key, "y").agg(F.product(1.0 + F.col("r")).alias("p")).groupBy(key).agg(F.avg((F.col("p") > 1).cast("double")).alias("positive_year_ratio"), F.count("*").alias("years"))
    n, mean, sd = F.count("*").cast("double"), F.avg("r"), F.stddev_samp("r")
    a = d.groupBy(key).agg(
        F.count("*").alias("observations"), (F.max_by("eq", date) - 1.0).alias("total_return"), F.greatest(F.datediff(F.max(date), F.min(date)), F.lit(1)).alias("_days"), mean.alias("_m"), sd.alias("_s"), F.stddev_samp(F.when(F.col("r") < 0, F.col("r"))).alias("_ds"),
        F.min("dd").alias("maximum_drawdown"), F.max("_u").cast("long").alias("drawdown_duration"), profit_factor(F.col("r")).alias("daily_profit_factor"), F.avg((F.col("r") > 0).cast("double")).alias("positive_day_ratio"),
        (F.skewness("r") * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))).alias("skew"), (((n + 1) * (F.kurtosis("r") + 3) - 3 * (n - 1)) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) + 3).alias("kurtosis"))
    y = F.col("_days") / 365.2425
    per = F.col("observations") / y
    a = a.withColumn("cagr", F.when(F.col("total_return") > -1, F.pow(1.0 + F.col("total_return"), 1.0 / y) - 1.0).otherwise(-1.0))
    a = a.withColumn("sharpe", F.col("_m") / F.nullif(F.col("_s"), F.lit(0.0)) * F.sqrt(per)).withColumn("sortino", F.col("_m") / F.nullif(F.col("_ds"), F.lit(0.0)) * F.sqrt(per))
    a = a.withColumn("calmar", F.when(F.col("maximum_drawdown") < 0, F.col("cagr") / F.abs("maximum_drawdown")))
    a = a.withColumn("psr", probabilistic_sharpe(F.col("_m") / F.nullif(F.col("_s"), F.lit(0.0)), F.col("observations").cast("double"), F.col("skew"), F.col("kurtosis")))
    return a.join(years, key).drop("_days", "_m", "_s", "_ds")


def symbol_breadth(trades: DataFrame, key: str, bps: float = 3.0) -> DataFrame:
    """Share of symbols with a positive mean, and the largest symbol's share of trades."""
    s = trades.groupBy(key, "symbol").agg(F.avg(net_return(F.col("gross_return"), bps)).alias("m"), F.count("*").alias("c"))
    return s.groupBy(key).agg(F.count("*").alias("symbols"), F.avg((F.col("m") > 0).cast("double")).alias("positive_symbol_ratio"), (F.max("c") / F.sum("c")).alias("largest_share"))


def fold_summary(folds: DataFrame, key: str, value: str, least: int = 8) -> DataFrame:
    """Over folds with at least ``least`` trades: positive share, median, worst."""
    return folds.filter(F.col("trades") >= least).groupBy(key).agg(F.count("*").alias("folds"), F.avg((F.col(value) > 0).cast("double")).alias("positive_ratio"), F.percentile(value, 0.5).alias("median"), F.min(value).alias("worst"))


def side_by_side(metrics: DataFrame, key: str, split: str, names: list[str], columns: list[str]) -> DataFrame:
    """Each period's metrics as columns of one row."""
    return metrics.groupBy(key).pivot(split, names).agg(*[F.first(c).alias(c) for c in columns])


def selection_score(train: str = "train", valid: str = "valid", least: int = 20) -> Column:
    """Over columns <period>_profit_factor, _net_expectancy, _trades and _forced_ratio."""
    c = lambda p, n: F.col(f"{p}_{n}")
    tp, vp, te, ve = c(train, "profit_factor"), c(valid, "profit_factor"), c(train, "net_expectancy"), c(valid, "net_expectancy")
    s = (0.65 * F.log(F.greatest(vp, F.lit(1e-9))) + 0.25 * F.log(F.greatest(tp, F.lit(1e-9))) + 30.0 * ve + 10.0 * te + 0.05 * F.log1p(c(valid, "trades")) - 2.0 * c(valid, "forced_ratio")
         - F.when(te <= 0, 1.0).otherwise(0.0) - F.when(ve <= 0, 2.0).otherwise(0.0))
    return F.when(F.coalesce(c(valid, "trades"), F.lit(0)) < least, -1e12 + F.coalesce(c(valid, "trades"), F.lit(0))).when((tp <= 0) | (vp <= 0), F.lit(-1e12)).otherwise(s)


def validation_score(least: int = 20, drawdown: float = -0.30, capital: float = 1e5) -> dict[str, Column]:
    """F32: score and failed gates over columns trade_count, cagr, sharpe, calmar, daily_profit_factor, maximum_drawdown, turnover, positive_year_ratio, security_weight and sector_weight.

    A missing metric takes its worst value; a failed gate puts the score far below every other.
    """
    c = lambda n, worst: F.coalesce(F.when(F.isnan(n) | (F.abs(n) == float("inf")), None).otherwise(F.col(n)), F.lit(worst))
    n, cagr, pf, dd = F.coalesce("trade_count", F.lit(0)), c("cagr", -1.0), c("daily_profit_factor", 0.0), c("maximum_drawdown", -1.0)
    clip = lambda x: F.greatest(F.lit(-3.0), F.least(F.lit(3.0), x))
    gates = {"MINIMUM_VALIDATION_TRADES": n < least, "VALIDATION_CAGR_NOT_POSITIVE": cagr <= 0, "VALIDATION_PF_NOT_ABOVE_ONE": pf <= 1, "VALIDATION_DRAWDOWN_GATE": dd < drawdown}
    failures = F.array_compact(F.array(*[F.when(g, F.lit(k)) for k, g in gates.items()]))
    s = (clip(c("sharpe", -10.0)) + clip(c("calmar", -10.0)) + F.log(F.greatest(pf, F.lit(1e-9))) + 0.25 * c("positive_year_ratio", 0.0) - 2.0 * F.greatest(F.abs(dd) - 0.20, F.lit(0.0))
         - 0.01 * c("turnover", 0.0) / capital - 0.5 * F.greatest(c("security_weight", 1.0), c("sector_weight", 1.0)) - F.greatest(least - n, F.lit(0)) / float(least))
    return {"failures": failures, "score": F.when(F.size(failures) > 0, -1e12 + s).otherwise(s)}
