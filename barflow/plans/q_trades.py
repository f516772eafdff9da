"""Queries of signals and trades."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import windows as w
from ..operators import bars as ob
from ..operators import metrics as m
from ..operators import paths as path
from ..operators import signals as s
from ..operators import trades as t
from . import bindings as b
from . import trade_sql as q
from .registry import query, shown
from .signal_sql import signal_sql

D, T = b.with_sql("daily"), b.with_sql("trades")
_TRADE = ["exit_time", "entry_price", "exit_price", "gross_return", "duration_bars", "forced"]


def _signalled(name):
    def run(spark, sf_dir):
        kind = {"spy_month_end": {"symbols": ("1", "2", "3")}, "tlt_thursday_dip": {"symbols": ("1", "2", "3")}}.get(name, {})
        d = s.signals(b.daily_bars(spark, sf_dir), name, **kind)
        return shown(d.filter(F.col("entry") | F.col("exit")).withColumn("ts", F.col("ts").cast("string")), ["symbol", "ts"], ["entry", "exit"])

    run.__doc__ = f"K08/K09 {name}: bars with an entry or an exit."
    return run


_X = D + ", x AS (SELECT *, lag(close) OVER s AS pc, lag(high) OVER s AS ph, lag(low) OVER s AS pl, lag(open) OVER s AS po, lag(low, 2) OVER s AS l2, lag(close, 2) OVER s AS c2, min(low) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS lo5, max(high) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS hi5 FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY ts))"
_MA = "avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS {n} PRECEDING)"
for _n in [*s.STRATEGIES, *s.TEMPLATES]:
    query(f"k_{_n}", signal_sql(_n))(_signalled(_n))


def _breakouts(spark, sf_dir):
    return s.signals(b.daily_bars(spark, sf_dir), "n_bar_breakout")


@query("k_trades", q.signal_trades("n_bar_breakout", 20) + q.SHOWN)
def trades(spark, sf_dir):
    """K01 with R2: trades of the breakout signal, at most 20 bars."""
    d = t.from_signals(_breakouts(spark, sf_dir), 20)
    return shown(d.withColumn("exit_time", F.col("exit_time").cast("string")), ["symbol", "entry_time"], _TRADE)


@query("k_trades_stop_target", q.stop_target_sql())
def stops(spark, sf_dir):
    """K01 with ATR stop and target: trades of the harami pattern."""
    d = t.from_signals(s.signals(b.daily_bars(spark, sf_dir), "bullish_harami"), 40, "stop", "target")
    return shown(d.withColumn("exit_time", F.col("exit_time").cast("string")), ["symbol", "entry_time"], _TRADE)


@query("k_first_profitable", q.first_profitable_sql())
def profitable(spark, sf_dir):
    """K02."""
    d = t.first_profitable(s.signals(b.daily_bars(spark, sf_dir), "rsi_first_profitable_close"), 60)
    return shown(d.withColumn("exit_time", F.col("exit_time").cast("string")), ["symbol", "entry_time"], _TRADE)


@query("k_trailing", q.trailing_sql())
def trailing(spark, sf_dir):
    """K03."""
    d = t.trailing(s.signals(b.daily_bars(spark, sf_dir), "triple_screen"), 0.2, 0.3, 60)
    return shown(d.withColumn("exit_time", F.col("exit_time").cast("string")), ["symbol", "entry_time"], _TRADE)


@query("k_pullback", q.pullback_sql())
def pullback(spark, sf_dir):
    """K04."""
    d = t.pullback(s.signals(b.daily_bars(spark, sf_dir), "market_structure_atr_pullback"), "atr", 0.5, 2.0, 10, 5)
    return shown(d.withColumn("exit_time", F.col("exit_time").cast("string")), ["symbol", "entry_time"], _TRADE)


@query("k_ma_position", D + f", x AS (SELECT *, CASE WHEN rn >= 30 AND {_MA.format(n=9)} > {_MA.format(n=29)} THEN 1.0 ELSE 0.0 END AS p, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM bars), y AS (SELECT symbol, ts, coalesce(lag(p) OVER (PARTITION BY symbol ORDER BY ts), 0) AS pos, coalesce(r, 0) AS r FROM x) SELECT symbol, CAST(ts AS VARCHAR) AS ts, round(pos, 6) AS position, round(pos * r - 0.0003 * abs(pos - coalesce(lag(pos) OVER (PARTITION BY symbol ORDER BY ts), 0)), 6) AS r FROM y")
def position(spark, sf_dir):
    """K10."""
    return shown(t.ma_position(w.indexed(b.daily_bars(spark, sf_dir)), 10, 30), ["symbol", "ts"], ["position", "r"])


@query("k_capacity", q.capacity_sql(50))
def capacity(spark, sf_dir):
    """At most 50 open trades of each hypothesis."""
    d = t.capacity_bounded(b.trades(spark, sf_dir).withColumn("score", F.col("entry_price")), ["hypothesis_id"], 50)
    return d.groupBy("hypothesis_id").agg(F.count("*").alias("trades"), F.sum("trade_id").alias("ids"))


@query("k_episodes", T + ", x AS (SELECT *, CASE WHEN entry_time > max(exit_time) OVER (PARTITION BY symbol ORDER BY entry_time, exit_time, trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 WHEN row_number() OVER (PARTITION BY symbol ORDER BY entry_time, exit_time, trade_id) = 1 THEN 1 ELSE 0 END AS n FROM trades), y AS (SELECT *, sum(n) OVER (PARTITION BY symbol ORDER BY entry_time, exit_time, trade_id ROWS UNBOUNDED PRECEDING) AS e FROM x) SELECT symbol, CAST(e AS BIGINT) AS episode, CAST(epoch(min(entry_time)) AS BIGINT) AS entry_time, CAST(epoch(max(exit_time)) AS BIGINT) AS exit_time, count(*) AS trades FROM y GROUP BY symbol, e")
def episodes(spark, sf_dir):
    """K12."""
    return shown(t.episodes(b.trades(spark, sf_dir), ["symbol"]), ["symbol", "episode", "entry_time", "exit_time"], ["trades"])


@query("k_lanes", q.lanes_sql())
def lanes(spark, sf_dir):
    """Trades of a customer in lanes; exits that equal the next entry need a second one."""
    return t.lanes(b.trades(spark, sf_dir), ["symbol"]).groupBy("lane").agg(F.count("*").alias("trades"), F.sum("trade_id").alias("ids"))


@query("k_replay_audit", T + ", x AS (SELECT *, coalesce(entry_time < max(exit_time) OVER (PARTITION BY hypothesis_id, symbol ORDER BY entry_time, exit_time, trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS o FROM trades), g AS (SELECT hypothesis_id, count(*) AS trades, count(*) FILTER (entry_time = exit_time) AS same_bar, count(*) FILTER (exit_time < entry_time) AS backwards, count(*) FILTER (o) AS \"overlaps\" FROM x GROUP BY 1) SELECT *, CASE WHEN backwards > 0 THEN 'INVALID' WHEN \"overlaps\" > 0 THEN 'LANES' WHEN same_bar > 0 THEN 'INTRABAR' ELSE 'DIRECT' END AS route FROM g")
def audit(spark, sf_dir):
    """K14."""
    return t.replay_audit(b.trades(spark, sf_dir), "hypothesis_id")


@query("k_rotation", D + f", x AS (SELECT *, close / lag(close, 60) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS mom, {_MA.format(n=99)} AS ma, lead(ts) OVER (PARTITION BY symbol ORDER BY ts) AS nx FROM bars), e AS (SELECT * FROM x WHERE date_trunc('month', ts) <> date_trunc('month', nx) AND rn >= 100 AND close > ma AND mom > 0) SELECT symbol, CAST(ts AS VARCHAR) AS ts, k AS rank, round(mom, 6) AS mom FROM (SELECT *, row_number() OVER (PARTITION BY date_trunc('month', ts) ORDER BY mom DESC, symbol) AS k FROM e) WHERE k <= 5")
def rotation(spark, sf_dir):
    """K16, W33."""
    return shown(t.rotation(ob.monthly_features(b.daily_bars(spark, sf_dir)), 5), ["symbol", "ts"], ["rank", "mom"])


@query("k_sweep", q.sweep_sql([(5, 5), (10, 5), (10, 10), (20, 5), (20, 10)], 20))
def sweep(spark, sf_dir):
    """Grid of breakout lengths, each one's trades and their metrics, ranked."""
    g = t.grid(spark, {"n": [5, 10, 20], "m": [5, 10]}).filter("m <= n")
    made = {f"{n}|{k}": lambda x, n=n, k=k: s.signals(x, "n_bar_breakout", n=n, m=k) for n in (5, 10, 20) for k in (5, 10) if k <= n}
    d = t.from_several(w.indexed(b.daily_bars(spark, sf_dir)), "_k", made, 20).withColumn("_k", F.split("_k", r"\|")).withColumns({"n": F.col("_k")[0].cast("long"), "m": F.col("_k")[1].cast("long")})
    d = m.trade_metrics(d, ["n", "m"]).join(g.select("n", "m", "hypothesis_id"), ["n", "m"])
    return shown(d, ["n", "m", "hypothesis_id"], ["trades", "net_expectancy", "profit_factor", "win_rate"])


@query("k_paths")
def paths(spark, sf_dir):
    """Hourly breakouts of the event stream resolved on 15-minute bars; gaps of that stream make paths incomplete."""
    hours = s.signals(b.bars(spark, sf_dir, 60), "market_structure_atr_pullback", n=5, atr_n=5)
    d = path.resolved_pullbacks(hours, b.bars(spark, sf_dir, 15), b.sessions(spark, sf_dir), "atr", 0.2, 1.0, 6, 3)
    return shown(path.path_summary(d, hours), ["symbol", "failed_at", "failure"], ["trades", "stops", "net_expectancy", "path_complete"])
