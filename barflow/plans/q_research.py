"""Queries of joins, metrics, labels, ranks and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import windows as w
from ..operators import joins as j
from ..operators import metrics as m
from ..operators import panel as p
from . import bindings as b
from .registry import query, shown

D, T = b.with_sql("daily"), b.with_sql("trades")
_NET = "(1 + gross_return) * (1 - 0.0003) / (1 + 0.0003) - 1"


@query("j_asof", "WITH " + b.bars_sql(60) + " SELECT t.event_id, t.symbol, b.close IS NOT NULL AS known, round(b.close, 6) AS ctx_close, b.ts AS ctx_source_time FROM ticks t ASOF LEFT JOIN (SELECT symbol, ts, close, CAST(to_timestamp(ts) AT TIME ZONE 'UTC' AS TIMESTAMP) AS k FROM bars) b ON t.symbol = b.symbol AND t.ts >= b.k")
def asof(spark, sf_dir):
    """Hourly bars to ticks, by the bar's start."""
    t = b.ticks(spark, sf_dir).select("event_id", "symbol", "ts")
    d = j.asof(t, b.bars(spark, sf_dir, 60), "symbol", "ts", "ts", ["close"], prefix="ctx_")
    return shown(d.withColumn("known", F.col("ctx_close").isNotNull()).select("event_id", "symbol", F.col("known"), "ctx_close", "ctx_source_time"), ["event_id", "symbol", "ctx_source_time", "known"], ["ctx_close"])


@query("j_asof_tolerance", D + ", q AS (SELECT symbol, ts FROM bars), c AS (SELECT symbol, ts AS k, close FROM bars WHERE rn % 5 = 0) SELECT q.symbol, CAST(q.ts AS VARCHAR) AS ts, round(CASE WHEN date_diff('day', c.k, q.ts) <= 10 THEN c.close END, 6) AS close FROM q ASOF LEFT JOIN c ON q.symbol = c.symbol AND q.ts >= c.k")
def tolerance(spark, sf_dir):
    """Every fifth daily bar to all days, at most 10 days old."""
    x = w.indexed(b.daily_bars(spark, sf_dir)).withColumn("day", F.datediff("ts", F.lit("1970-01-01")))
    d = j.asof(x.select("symbol", "ts", "day"), x.filter("rn % 5 = 0").select("symbol", "day", "close"), "symbol", "day", "day", ["close"], F.lit(10))
    return shown(d, ["symbol", "ts"], ["close"])


@query("j_latest_at", D + " SELECT symbol, CAST(max(ts) AS VARCHAR) AS ts, round(arg_max(close, ts), 6) AS close FROM bars WHERE ts <= DATE '1998-06-30' GROUP BY symbol")
def latest(spark, sf_dir):
    """J03."""
    return shown(j.latest_at(b.daily_bars(spark, sf_dir), "symbol", "ts", F.lit("1998-06-30").cast("date")).select("symbol", "ts", "close"), ["symbol", "ts"], ["close"])


@query("j_fresh", "WITH " + b.bars_sql(60) + ", c AS (SELECT symbol, ts AS k, close FROM bars WHERE rn % 3 = 0), x AS (SELECT b.symbol, b.ts, c.k, c.close FROM bars b ASOF LEFT JOIN c ON b.symbol = c.symbol AND b.ts >= c.k) SELECT symbol, ts, CAST(coalesce((ts - 18000) // 86400 = (k - 18000) // 86400, false) AS BIGINT) AS fresh, round(CASE WHEN (ts - 18000) // 86400 = (k - 18000) // 86400 THEN close END, 6) AS close FROM x")
def fresh(spark, sf_dir):
    """Every third hourly bar as context, valid on the same New York date (winter: UTC-5)."""
    x = w.indexed(b.bars(spark, sf_dir, 60)).select("symbol", "ts", "close", "rn")
    d = j.asof(x.select("symbol", "ts"), x.filter("rn % 3 = 0").select("symbol", "ts", "close"), "symbol", "ts", "ts", ["close"])
    return shown(j.fresh_in_session(d, "ts", "source_time", ["close"]), ["symbol", "ts"], ["fresh", "close"])


@query("j_interval", T + ", " + b.SQL["daily"] + " SELECT t.trade_id, count(*) AS n, round(avg(x.close), 6) AS mean_close FROM trades t JOIN bars x ON CAST(CAST(t.symbol AS BIGINT) % (SELECT count(*) FROM supplier) AS VARCHAR) = x.symbol AND x.ts BETWEEN CAST(t.entry_time AS DATE) AND CAST(t.exit_time AS DATE) GROUP BY t.trade_id")
def interval(spark, sf_dir):
    """Daily bars of a trade's supplier while it was open."""
    n = b.table(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    t = b.trades(spark, sf_dir).crossJoin(n).select("trade_id", (F.col("symbol").cast("long") % F.col("n")).cast("string").alias("symbol"), F.to_date("entry_time").alias("a"), F.to_date("exit_time").alias("z"))
    d = j.in_interval(t, b.daily_bars(spark, sf_dir).select("symbol", "ts", "close"), "symbol", "a", "z", "ts", "YEAR")
    return shown(d.groupBy("trade_id").agg(F.count("*").alias("n"), F.avg("close").alias("mean_close")), ["trade_id"], ["n", "mean_close"])


@query("j_membership", "SELECT n_nationkey, n_nationkey IN (SELECT s_nationkey FROM supplier) AS supplies, n_nationkey IN (SELECT c_nationkey FROM customer) AS buys FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier UNION SELECT c_nationkey FROM customer)")
def members(spark, sf_dir):
    """J14, D10."""
    k = lambda t, c: b.table(spark, sf_dir, t).select(F.col(c).cast("long").alias("n_nationkey"))
    return j.membership({"supplies": k("supplier", "s_nationkey"), "buys": k("customer", "c_nationkey")}, "n_nationkey").withColumn("n_nationkey", F.col("n_nationkey").cast("int"))


@query("u_multiset_match", "WITH a AS (SELECT l_partkey % 50 AS k, count(*) AS a FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), z AS (SELECT l_partkey % 50 AS k, count(*) AS z FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT CAST(sum(coalesce(a, 0)) AS BIGINT) AS expected, CAST(sum(coalesce(z, 0)) AS BIGINT) AS observed, CAST(sum(least(coalesce(a, 0), coalesce(z, 0))) AS BIGINT) AS matched, round(sum(least(coalesce(a, 0), coalesce(z, 0))) / sum(coalesce(a, 0)), 6) AS ratio FROM a FULL JOIN z USING (k)")
def multiset(spark, sf_dir):
    """U08."""
    li = b.table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("k"), "l_returnflag")
    return shown(j.multiset_match(li.filter("l_returnflag = 'A'"), li.filter("l_returnflag = 'R'"), ["k"]), [], ["expected", "observed", "matched", "ratio"])


@query("a_trade_metrics", T + f""", n AS (SELECT *, {_NET} AS net FROM trades)
SELECT hypothesis_id, count(*) AS trades, round(avg(gross_return), 6) AS gross_expectancy, round(avg(net), 6) AS net_expectancy, round(quantile_cont(net, 0.5), 6) AS median_net_return, round(sum(net) FILTER (net > 0) / -sum(net) FILTER (net < 0), 6) AS profit_factor, round(avg(CASE WHEN net > 0 THEN 1.0 ELSE 0 END), 6) AS win_rate, round(min(net), 6) AS worst_trade,
  round(quantile_cont(net, 0.1), 6) AS p10_trade, round(stddev_samp(net), 6) AS return_std, round(quantile_cont(duration_bars, 0.5), 6) AS median_duration_bars, round(avg(CASE WHEN forced THEN 1.0 ELSE 0 END), 6) AS forced_ratio, round(avg(net) / stddev_samp(net) * sqrt(count(*)), 6) AS expectancy_t_proxy FROM n GROUP BY hypothesis_id""")
def trade_metrics(spark, sf_dir):
    """A13, F17."""
    return shown(m.trade_metrics(b.trades(spark, sf_dir), ["hypothesis_id"]), ["hypothesis_id"], ["trades", "gross_expectancy", "net_expectancy", "median_net_return", "profit_factor", "win_rate", "worst_trade", "p10_trade", "return_std", "median_duration_bars", "forced_ratio", "expectancy_t_proxy"])


@query("a_accumulated", T + f""", y AS (SELECT hypothesis_id, year(exit_time) AS y, count(*) AS c, sum({_NET}) AS s, sum(({_NET}) * ({_NET})) AS q FROM trades GROUP BY 1, 2)
SELECT hypothesis_id, CAST(sum(c) AS BIGINT) AS trades, round(sum(s) / sum(c), 6) AS mean, round(sqrt(greatest(sum(q) / sum(c) - (sum(s) / sum(c)) * (sum(s) / sum(c)), 0)), 6) AS std, round(avg(CASE WHEN s > 0 THEN 1.0 ELSE 0 END), 6) AS positive_year_ratio, count(*) AS years FROM y GROUP BY 1""")
def accumulated(spark, sf_dir):
    """A14, Y05."""
    return shown(m.accumulated(b.trades(spark, sf_dir), ["hypothesis_id"]), ["hypothesis_id"], ["trades", "mean", "std", "positive_year_ratio", "years"])


@query("a_daily_stream", T + " , g AS (SELECT hypothesis_id, CAST(exit_time AS DATE) AS date, sum(gross_return) * 0.01 AS g, count(*) * 0.02 AS t, count(*) * 2 AS o FROM trades GROUP BY 1, 2) SELECT hypothesis_id, CAST(date AS VARCHAR) AS date, round(g, 6) AS gross_return, round(t, 6) AS turnover, o AS orders, round(g - 0.0003 * t - o / 1e5, 6) AS net_return FROM g")
def stream(spark, sf_dir):
    """A15, A40."""
    return shown(m.costed(m.daily_stream(b.trades(spark, sf_dir), ["hypothesis_id"], 0.01)), ["hypothesis_id", "date"], ["gross_return", "turnover", "orders", "net_return"])


_DAILY = """, s AS (SELECT hypothesis_id, CAST(exit_time AS DATE) AS date, 0.001 * avg(gross_return) AS r FROM trades GROUP BY 1, 2),
e AS (SELECT *, product(1 + r) OVER (PARTITION BY hypothesis_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS eq FROM s),
d AS (SELECT *, eq / max(eq) OVER (PARTITION BY hypothesis_id ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM e),
i AS (SELECT *, sum(CASE WHEN dd >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY hypothesis_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS i FROM d),
u AS (SELECT *, sum(CASE WHEN dd < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY hypothesis_id, i) AS u FROM i),
y AS (SELECT hypothesis_id, avg(CASE WHEN p > 1 THEN 1.0 ELSE 0 END) AS positive_year_ratio, count(*) AS years FROM (SELECT hypothesis_id, year(date) AS y, product(1 + r) AS p FROM s GROUP BY 1, 2) GROUP BY 1),
a AS (SELECT hypothesis_id, count(*) AS n, arg_max(eq, date) - 1 AS total, greatest(date_diff('day', min(date), max(date)), 1) / 365.2425 AS yrs, avg(r) AS m, stddev_samp(r) AS sd, stddev_samp(r) FILTER (r < 0) AS ds, min(dd) AS mdd, max(u) AS u, sum(r) FILTER (r > 0) / -sum(r) FILTER (r < 0) AS pf, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END) AS pos, skewness(r) AS skew, kurtosis(r) + 3 AS kurtosis FROM u GROUP BY 1)
SELECT a.hypothesis_id, n AS observations, round(total, 6) AS total_return, round(pow(1 + total, 1 / yrs) - 1, 6) AS cagr, round(m / sd * sqrt(n / yrs), 6) AS sharpe, round(m / ds * sqrt(n / yrs), 6) AS sortino, round(mdd, 6) AS maximum_drawdown, CAST(u AS BIGINT) AS drawdown_duration, round(pf, 6) AS daily_profit_factor, round(pos, 6) AS positive_day_ratio, round(skew, 4) AS skew, round(kurtosis, 4) AS kurtosis, round(positive_year_ratio, 6) AS positive_year_ratio, years FROM a JOIN y USING (hypothesis_id)"""


@query("a_daily_metrics", T + _DAILY.replace("round(skew, 4)", "round(skew, 6)").replace("round(kurtosis, 4)", "round(kurtosis, 6)"))
def daily_metrics(spark, sf_dir):
    """A day's return is a thousandth of the mean of its trades, so that it does not grow with their number."""
    s = b.trades(spark, sf_dir).groupBy("hypothesis_id", F.to_date("exit_time").alias("date")).agg((0.001 * F.avg("gross_return")).alias("r"))
    return shown(m.daily_metrics(s, "hypothesis_id"), ["hypothesis_id"], ["observations", "total_return", "cagr", "sharpe", "sortino", "maximum_drawdown", "drawdown_duration", "daily_profit_factor", "positive_day_ratio", "skew", "kurtosis", "positive_year_ratio", "years"])


@query("f_psr", T + """, s AS (SELECT hypothesis_id, CAST(exit_time AS DATE) AS d, 0.001 * sum(gross_return) AS r FROM trades GROUP BY 1, 2), a AS (SELECT hypothesis_id, avg(r) / nullif(stddev_samp(r), 0) AS sr, count(*) AS n, skewness(r) AS sk, kurtosis(r) + 3 AS ku FROM s GROUP BY 1),
z AS (SELECT hypothesis_id, sr * sqrt(n - 1) / sqrt(1 - sk * sr + (ku - 1) / 4 * sr * sr) AS z FROM a WHERE 1 - sk * sr + (ku - 1) / 4 * sr * sr > 0), t AS (SELECT *, 1 / (1 + 0.3275911 * abs(z) / sqrt(2.0)) AS t FROM z),
e AS (SELECT *, 1 - (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-z * z / 2) AS e FROM t) SELECT hypothesis_id, round(CASE WHEN z >= 0 THEN 0.5 * (1 + e) ELSE 0.5 * (1 - e) END, 6) AS psr FROM e""")
def psr(spark, sf_dir):
    """F16: probabilistic Sharpe ratio of each hypothesis."""
    s = b.trades(spark, sf_dir).groupBy("hypothesis_id", F.to_date("exit_time").alias("date")).agg((0.001 * F.sum("gross_return")).alias("r"))
    return shown(m.daily_metrics(s, "hypothesis_id"), ["hypothesis_id"], ["psr"])


@query("a_symbol_breadth", T + f", s AS (SELECT hypothesis_id, symbol, avg({_NET}) AS m, count(*) AS c FROM trades GROUP BY 1, 2) SELECT hypothesis_id, count(*) AS symbols, round(avg(CASE WHEN m > 0 THEN 1.0 ELSE 0 END), 6) AS positive_symbol_ratio, round(max(c) / sum(c), 6) AS largest_share FROM s GROUP BY 1")
def breadth(spark, sf_dir):
    """A20."""
    return shown(m.symbol_breadth(b.trades(spark, sf_dir), "hypothesis_id"), ["hypothesis_id"], ["symbols", "positive_symbol_ratio", "largest_share"])


_PER = "CASE WHEN CAST(entry_time AS DATE) <= DATE '1998-01-01' THEN 'train' WHEN CAST(entry_time AS DATE) <= DATE '2000-01-01' THEN 'validation' ELSE 'test' END"


@query("a_period_metrics", T + f", x AS (SELECT hypothesis_id, {_PER} AS period, count(*) AS c, avg({_NET}) AS e FROM trades GROUP BY 1, 2) SELECT hypothesis_id, max(c) FILTER (period = 'train') AS train_trades, round(max(e) FILTER (period = 'train'), 6) AS train_net_expectancy, max(c) FILTER (period = 'validation') AS validation_trades, round(max(e) FILTER (period = 'validation'), 6) AS validation_net_expectancy, max(c) FILTER (period = 'test') AS test_trades, round(max(e) FILTER (period = 'test'), 6) AS test_net_expectancy FROM x GROUP BY 1")
def periods(spark, sf_dir):
    """A39, A41, L10."""
    t = b.trades(spark, sf_dir).withColumn("period", p.period_of(F.to_date("entry_time"), "1998-01-01", "2000-01-01"))
    names = ["train", "validation", "test"]
    d = m.side_by_side(m.trade_metrics(t, ["hypothesis_id", "period"]), "hypothesis_id", "period", names, ["trades", "net_expectancy"])
    return shown(d, ["hypothesis_id"], [f"{n}_{c}" for n in names for c in ("trades", "net_expectancy")])


@query("v_selection_score", T + f""", x AS (SELECT symbol, {_PER} AS period, {_NET} AS net, forced FROM trades),
g AS (SELECT symbol, period, count(*) AS c, avg(net) AS e, avg(CASE WHEN forced THEN 1.0 ELSE 0 END) AS f, CASE WHEN coalesce(-sum(net) FILTER (net < 0), 0) > 0 THEN coalesce(sum(net) FILTER (net > 0), 0) / -sum(net) FILTER (net < 0) WHEN coalesce(sum(net) FILTER (net > 0), 0) > 0 THEN CAST('inf' AS DOUBLE) ELSE 0 END AS pf FROM x GROUP BY 1, 2),
h AS (SELECT symbol, max(c) FILTER (period = 'validation') AS vc, max(e) FILTER (period = 'validation') AS ve, max(f) FILTER (period = 'validation') AS vf, max(pf) FILTER (period = 'validation') AS vp, max(e) FILTER (period = 'train') AS te, max(pf) FILTER (period = 'train') AS tp FROM g GROUP BY 1),
k AS (SELECT symbol, CASE WHEN coalesce(vc, 0) < 3 THEN -1e12 + coalesce(vc, 0) WHEN tp <= 0 OR vp <= 0 THEN -1e12 ELSE 0.65 * ln(greatest(vp, 1e-9)) + 0.25 * ln(greatest(tp, 1e-9)) + 30 * ve + 10 * te + 0.05 * ln(1 + vc) - 2 * vf - CASE WHEN te <= 0 THEN 1 ELSE 0 END - CASE WHEN ve <= 0 THEN 2 ELSE 0 END END AS s FROM h)
SELECT symbol, round(CASE WHEN abs(s) = CAST('inf' AS DOUBLE) THEN NULL WHEN s < -1e11 THEN -1000 ELSE s END, 6) AS score FROM k""")
def selection(spark, sf_dir):
    """Score of each customer's trades, train against validation."""
    t = b.trades(spark, sf_dir).withColumn("period", p.period_of(F.to_date("entry_time"), "1998-01-01", "2000-01-01"))
    d = m.side_by_side(m.trade_metrics(t, ["symbol", "period"]), "symbol", "period", ["train", "validation"], ["trades", "net_expectancy", "profit_factor", "forced_ratio"])
    d = d.withColumn("score", m.selection_score("train", "validation", 3))
    return shown(d.withColumn("score", F.when(F.col("score") < -1e11, -1000.0).otherwise(F.col("score"))), ["symbol"], ["score"])


@query("l_labels", D + " SELECT symbol, CAST(ts AS VARCHAR) AS ts, round(lead(close, 6) OVER s / lead(close, 1) OVER s - 1, 6) AS hold5, round(lead(close, 5) OVER s / lead(open, 1) OVER s - 1, 6) AS open5 FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY ts)")
def labels(spark, sf_dir):
    """L01, L02."""
    return shown(w.indexed(b.daily_bars(spark, sf_dir)).withColumns({"hold5": p.forward_hold(5), "open5": p.forward_open_to_close(5)}), ["symbol", "ts"], ["hold5", "open5"])


_PANEL = D + ", r AS (SELECT symbol, ts, lead(close, 5) OVER (PARTITION BY symbol ORDER BY ts) / lead(open, 1) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS raw_return, close / lag(close, 3) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pred FROM bars)"


def _panel(spark, sf_dir):
    return w.indexed(b.daily_bars(spark, sf_dir)).select("symbol", "ts", p.forward_open_to_close(5).alias("raw_return"), w.pct_change("close", 3).alias("pred"))


def _by_day(spark, sf_dir):
    """The panel, dealt by day."""
    return _panel(spark, sf_dir).repartition(b.parts(spark, sf_dir, "lineitem"), "ts")


@query("l_panel", _PANEL + """, x AS (SELECT a.symbol, a.ts, a.raw_return - z.raw_return AS e FROM r a JOIN r z ON a.ts = z.ts AND z.symbol = '1' WHERE a.symbol <> '1' AND a.raw_return - z.raw_return IS NOT NULL)
SELECT symbol, CAST(ts AS VARCHAR) AS ts, section, round(e, 6) AS excess_return, round(label, 6) AS label FROM (SELECT *, count(*) OVER t AS section, e - avg(e) OVER t AS label FROM x WINDOW t AS (PARTITION BY ts)) WHERE section >= 3""")
def relative(spark, sf_dir):
    """Returns over supplier 1, centred by day."""
    r = _panel(spark, sf_dir)
    return shown(p.centred(p.relative_panel(r.filter("symbol <> '1'"), r.filter("symbol = '1'")), "excess_return"), ["symbol", "ts"], ["section", "excess_return", "label"])


@query("w_ranks", _PANEL + " SELECT symbol, CAST(ts AS VARCHAR) AS ts, round((rank() OVER (PARTITION BY ts ORDER BY pred) + (count(*) OVER (PARTITION BY ts, pred) - 1) / 2.0) / count(*) OVER (PARTITION BY ts) - 0.5, 6) AS pct, row_number() OVER (PARTITION BY ts ORDER BY pred DESC, symbol) AS ord FROM r WHERE pred IS NOT NULL")
def ranks(spark, sf_dir):
    """W31, W32, W33."""
    d = p.ordinal(p.rank_pct(_by_day(spark, sf_dir), "pred", "ts", "pct"), "pred", "ts", "symbol", "ord")
    return shown(d.withColumn("pct", F.col("pct") - 0.5), ["symbol", "ts"], ["pct", "ord"])


@query("v_information", _PANEL + """, x AS (SELECT * FROM r WHERE raw_return IS NOT NULL AND pred IS NOT NULL),
y AS (SELECT *, rank() OVER (PARTITION BY ts ORDER BY pred) + (count(*) OVER (PARTITION BY ts, pred) - 1) / 2.0 AS rp, rank() OVER (PARTITION BY ts ORDER BY raw_return) + (count(*) OVER (PARTITION BY ts, raw_return) - 1) / 2.0 AS rl, row_number() OVER (PARTITION BY ts ORDER BY pred DESC, symbol) AS o, row_number() OVER (PARTITION BY ts ORDER BY pred, symbol DESC) AS q FROM x)
SELECT CAST(ts AS VARCHAR) AS ts, count(*) AS n, round(CASE WHEN isnan(corr(rp, rl)) THEN NULL ELSE corr(rp, rl) END, 4) AS rank_ic, round(CASE WHEN isnan(corr(pred, raw_return)) THEN NULL ELSE corr(pred, raw_return) END, 4) AS ic, round(avg(raw_return) FILTER (o <= 1) - avg(raw_return) FILTER (q <= 1), 4) AS spread FROM y GROUP BY ts""")
def information(spark, sf_dir):
    """Daily rank and linear correlation of momentum with the label."""
    return shown(p.information(_by_day(spark, sf_dir), "pred", "raw_return"), ["ts"], ["n", "rank_ic", "ic", "spread"], 4)


@query("v_series_metrics", _PANEL + """, x AS (SELECT * FROM r WHERE raw_return IS NOT NULL AND pred IS NOT NULL), q AS (SELECT symbol, quantile_cont(pred, 0.2) AS a, quantile_cont(pred, 0.8) AS z FROM x GROUP BY 1),
h AS (SELECT x.*, a, z, CASE WHEN (pred > 0) = (raw_return > 0) THEN 1.0 ELSE 0 END AS hit FROM x JOIN q USING (symbol))
SELECT symbol, round(corr(pred, raw_return), 6) AS ic, round(avg(hit), 6) AS direction, round((avg(hit) FILTER (raw_return > 0) + avg(hit) FILTER (raw_return <= 0)) / 2, 6) AS balanced, round(avg(raw_return) FILTER (pred >= z) - avg(raw_return) FILTER (pred <= a), 6) AS quintile_spread FROM h GROUP BY symbol""")
def series(spark, sf_dir):
    """V10."""
    return shown(p.series_metrics(_panel(spark, sf_dir).dropna(), "pred", "raw_return", "symbol"), ["symbol"], ["ic", "direction", "balanced", "quintile_spread"])


@query("w_top_changes", _PANEL + ", o AS (SELECT ts, symbol FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY pred DESC NULLS LAST, symbol) AS k FROM r) WHERE k <= 5), t AS (SELECT ts, list_sort(list(symbol)) AS top FROM o GROUP BY ts) SELECT CAST(ts AS VARCHAR) AS ts, round(CASE WHEN lag(top) OVER (ORDER BY ts) IS NOT NULL THEN 1.0 - len(list_intersect(top, lag(top) OVER (ORDER BY ts))) / len(top) END, 6) AS turnover FROM t")
def changes(spark, sf_dir):
    """W49."""
    return shown(p.top_changes(_by_day(spark, sf_dir), "pred", 5), ["ts"], ["turnover"])


_DAYS = D + ", d AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM bars))"


@query("l_purged", _DAYS + " SELECT CAST(ts AS VARCHAR) AS ts, CASE WHEN i < floor(n * 0.6) - 6 THEN 'train' WHEN i >= floor(n * 0.6) AND i < floor(n * 0.8) - 6 THEN 'valid' ELSE 'test' END AS period FROM d WHERE i < floor(n * 0.6) - 6 OR i >= floor(n * 0.6) AND i < floor(n * 0.8) - 6 OR i >= floor(n * 0.8)")
def purged(spark, sf_dir):
    """L05."""
    return shown(p.purged(b.daily_bars(spark, sf_dir), 6), ["ts", "period"], [])


_FOLDS = ", f0 AS (SELECT fold, CAST(floor(n * 0.45) - 1 + fold * part AS BIGINT) AS te, part FROM (SELECT max(n) AS n, greatest(100, floor(max(n) * 0.1)) AS part FROM d), range(4) AS r(fold)), f1 AS (SELECT fold, unnest([{'s': 'train', 'a': 0, 'z': te}, {'s': 'valid', 'a': te + 7, 'z': CAST(te + 6 + part AS BIGINT)}, {'s': 'test', 'a': CAST(te + 13 + part AS BIGINT), 'z': CAST(te + 12 + 2 * part AS BIGINT)}]) AS x FROM f0 WHERE te + 12 + 2 * part < (SELECT max(n) FROM d)), folds AS (SELECT fold, x.s AS segment, a.ts AS start, z.ts AS \"end\" FROM f1 JOIN d a ON a.i = x.a JOIN d z ON z.i = x.z)"


@query("l_rolling_folds", _DAYS + _FOLDS + " SELECT CAST(fold AS BIGINT) AS fold, segment, CAST(start AS VARCHAR) AS start, CAST(\"end\" AS VARCHAR) AS \"end\" FROM folds")
def folds(spark, sf_dir):
    """L06, L07 on the days of daily bars."""
    return shown(p.rolling_folds(b.daily_bars(spark, sf_dir), 5, 4, 500, 100).withColumn("fold", F.col("fold").cast("long")), ["fold", "segment", "start", "end"], [])


@query("l_contained", _DAYS + _FOLDS + ", " + b.SQL["trades"] + f" SELECT CAST(fold AS BIGINT) AS fold, segment, count(*) AS trades, round(avg({_NET}), 6) AS net_expectancy FROM trades t JOIN folds f ON CAST(t.entry_time AS DATE) >= f.start AND CAST(t.exit_time AS DATE) <= f.\"end\" GROUP BY 1, 2")
def contained(spark, sf_dir):
    """L08 x A13."""
    f = p.rolling_folds(b.daily_bars(spark, sf_dir), 5, 4, 500, 100)
    t = b.trades(spark, sf_dir).withColumns({"entry_time": F.to_date("entry_time"), "exit_time": F.to_date("exit_time")})
    d = m.trade_metrics(p.contained(t, f), ["fold", "segment"]).withColumn("fold", F.col("fold").cast("long"))
    return shown(d, ["fold", "segment"], ["trades", "net_expectancy"])


@query("a_fold_summary", T + f", x AS (SELECT hypothesis_id, year(exit_time) AS fold, count(*) AS trades, avg({_NET}) AS e FROM trades GROUP BY 1, 2) SELECT hypothesis_id, count(*) AS folds, round(avg(CASE WHEN e > 0 THEN 1.0 ELSE 0 END), 6) AS positive_ratio, round(quantile_cont(e, 0.5), 6) AS median, round(min(e), 6) AS worst FROM x WHERE trades >= 8 GROUP BY 1")
def summary(spark, sf_dir):
    """A21, V22."""
    d = m.trade_metrics(b.trades(spark, sf_dir).withColumn("fold", F.year("exit_time")), ["hypothesis_id", "fold"])
    return shown(m.fold_summary(d, "hypothesis_id", "net_expectancy"), ["hypothesis_id"], ["folds", "positive_ratio", "median", "worst"])


@query("l_trimmed", T + " SELECT hypothesis_id, CAST(count(*) - 5 AS BIGINT) AS left_over FROM trades GROUP BY 1")
def trimmed(spark, sf_dir):
    """L09."""
    t = b.trades(spark, sf_dir).withColumn("k", F.struct("exit_time", "trade_id"))
    return p.trimmed(t, ["hypothesis_id"], "k", 5).groupBy("hypothesis_id").agg(F.count("*").alias("left_over"))


@query("l_common_start", D + " , s AS (SELECT max(m) AS m FROM (SELECT min(ts) AS m FROM bars GROUP BY symbol)) SELECT symbol, count(*) AS n FROM bars, s WHERE ts >= m GROUP BY symbol")
def start(spark, sf_dir):
    """L11."""
    return p.common_start(b.daily_bars(spark, sf_dir), "symbol", "ts").groupBy("symbol").agg(F.count("*").alias("n"))


@query("u_jaccard", "WITH k AS (SELECT o_custkey, list(DISTINCT o_orderpriority ORDER BY o_orderpriority) AS a FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), z AS (SELECT o_custkey, list(DISTINCT o_orderpriority ORDER BY o_orderpriority) AS b FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT o_custkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM k JOIN z USING (o_custkey)")
def jaccard(spark, sf_dir):
    """Of the priorities of a customer's open and finished orders."""
    o = b.table(spark, sf_dir, "orders")
    side = lambda s, n: o.filter(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias(n))
    return shown(side("O", "a").join(side("F", "b"), "o_custkey").withColumn("jaccard", j.jaccard(F.col("a"), F.col("b"))), ["o_custkey"], ["jaccard"])


@query("t_best_per_key", "SELECT p_brand, arg_max(p_partkey, p_size * 10000000 - p_partkey) AS p_partkey, CAST(max(p_size) AS BIGINT) AS p_size, list_sort(list_distinct(list(p_type))) AS reasons FROM part GROUP BY p_brand")
def best(spark, sf_dir):
    """T03."""
    d = b.table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_size").cast("long").alias("p_size"), F.array("p_type").alias("reasons"))
    return p.best_per_key(d, "p_brand", "p_size", "p_partkey", "reasons")


@query("entry_bars", "WITH " + b.bars_sql(15) + " , x AS (SELECT symbol, ts, close, CASE WHEN count(*) OVER f >= 20 THEN avg(close) OVER f END AS sma20, close / nullif(lag(close) OVER s, 0) - 1 AS ret FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY ts), f AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)) SELECT symbol, ts, round(close, 6) AS close, round(sma20, 6) AS sma20, round(ret, 6) AS ret, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ret DESC NULLS LAST, ts) AS k FROM x) WHERE k <= 10")
def entry_bars(spark, sf_dir):
    """15-minute bars with mean and return; the ten largest returns of each symbol."""
    x = w.indexed(b.bars(spark, sf_dir, 15)).withColumns({"sma20": w.sma("close", 20), "ret": w.pct_change("close")})
    return shown(p.ordinal(x, "ret", "symbol", "ts", "rank").filter("rank <= 10"), ["symbol", "ts"], ["close", "sma20", "ret", "rank"])
