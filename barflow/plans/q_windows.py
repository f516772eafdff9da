"""Queries of window and recurrence rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import long_series as ls
from ..functions import windows as w
from . import bindings as b
from .registry import query, shown
from .signal_sql import BASE, NEXT, layered, rsi

D = b.with_sql("daily")

_MOVING = ["ret1", "ret5", "sma20", "min10", "max10", "don_hi", "sd20", "tr", "willr5", "roc10", "rvol20", "obv", "vwap20", "bb_z", "bb_pos", "bb_width", "stoch", "cci20", "mfi14"]


@query("w_moving", D + """,
x AS (SELECT *, lag(close) OVER s AS pc, (high + low + close) / 3.0 AS tp, lag((high + low + close) / 3.0) OVER s AS ptp FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY ts)),
y AS (SELECT symbol, ts, rn, close, volume, high, low, tp,
  close / pc - 1 AS ret1, close / lag(close, 5) OVER s - 1 AS ret5,
  CASE WHEN rn >= 20 THEN avg(close) OVER f20 END AS sma20, CASE WHEN rn >= 10 THEN min(low) OVER f10 END AS min10, CASE WHEN rn >= 10 THEN max(high) OVER f10 END AS max10,
  CASE WHEN rn >= 11 THEN max(high) OVER p10 END AS don_hi, CASE WHEN rn >= 20 THEN stddev_pop(close) OVER f20 END AS sd20,
  greatest(high - low, coalesce(abs(high - pc), high - low), coalesce(abs(low - pc), high - low)) AS tr,
  CASE WHEN rn >= 5 THEN -100.0 * (max(high) OVER f5 - close) / nullif(max(high) OVER f5 - min(low) OVER f5, 0) END AS willr5,
  close / lag(close, 10) OVER s - 1 AS roc10, CASE WHEN rn >= 21 THEN volume / avg(volume) OVER p20 END AS rvol20,
  sum(coalesce(sign(close - pc), 0) * volume) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS obv,
  CASE WHEN rn >= 20 THEN sum(tp * volume) OVER f20 / sum(volume) OVER f20 END AS vwap20,
  CASE WHEN rn >= 14 THEN 100.0 * (close - min(low) OVER f14) / nullif(max(high) OVER f14 - min(low) OVER f14, 0) END AS k,
  CASE WHEN rn >= 20 THEN avg(tp) OVER f20 END AS tm, list(tp) OVER f20 AS tps,
  CASE WHEN rn >= 14 THEN sum(CASE WHEN tp > ptp THEN tp * volume ELSE 0 END) OVER f14 END AS fp, CASE WHEN rn >= 14 THEN sum(CASE WHEN tp < ptp THEN tp * volume ELSE 0 END) OVER f14 END AS fn
  FROM x WINDOW s AS (PARTITION BY symbol ORDER BY ts), f20 AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING), f10 AS (PARTITION BY symbol ORDER BY ts ROWS 9 PRECEDING), f5 AS (PARTITION BY symbol ORDER BY ts ROWS 4 PRECEDING),
  f14 AS (PARTITION BY symbol ORDER BY ts ROWS 13 PRECEDING), p10 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), p20 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT symbol, CAST(ts AS VARCHAR) AS ts, round(ret1, 6) AS ret1, round(ret5, 6) AS ret5, round(sma20, 6) AS sma20, round(min10, 6) AS min10, round(max10, 6) AS max10, round(don_hi, 6) AS don_hi, round(sd20, 6) AS sd20, round(tr, 6) AS tr, round(willr5, 6) AS willr5,
  round(roc10, 6) AS roc10, round(rvol20, 6) AS rvol20, round(obv, 6) AS obv, round(vwap20, 6) AS vwap20, round((close - sma20) / nullif(sd20, 0), 6) AS bb_z, round((close - (sma20 - 2 * sd20)) / nullif(4 * sd20, 0), 6) AS bb_pos, round(4 * sd20 / nullif(sma20, 0), 6) AS bb_width,
  round(CASE WHEN count(k) OVER g3 >= 3 THEN avg(k) OVER g3 END, 6) AS stoch,
  round((tp - tm) / nullif(0.015 * list_sum(list_transform(tps, lambda q: abs(q - tm))) / 20.0, 0), 6) AS cci20, round(CASE WHEN fn = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + fp / nullif(fn, 0)) END, 6) AS mfi14
FROM y WINDOW g3 AS (PARTITION BY symbol ORDER BY ts ROWS 2 PRECEDING)""".replace("CASE WHEN fn = 0 THEN 100.0 ELSE", "CASE WHEN fp IS NULL THEN NULL WHEN fn = 0 THEN 100.0 ELSE"))
def moving(spark, sf_dir):
    """W01, W02, W04, W05, W09, W12, W15-W21, W23 over daily bars."""
    close, hi, lo = F.col("close"), F.col("_hi5"), F.col("_lo5")
    plain = w.Recipe({"tr": w.true_ranges(), "ret1": w.pct_change("close"), "ret5": w.pct_change("close", 5), "roc10": w.pct_change("close", 10)},
                     w.Moving({"sma20": ("mean", "close", 20), "min10": ("min", "low", 10), "max10": ("max", "high", 10), "don_hi": ("max", "high", 10, 1), "sd20": ("std", "close", 20), "_hi5": ("max", "high", 5), "_lo5": ("min", "low", 5), "_v20": ("mean", "volume", 20, 1)}),
                     {"willr5": -100.0 * (hi - close) / F.nullif(hi - lo, F.lit(0.0)), "rvol20": F.col("volume") / F.nullif(F.col("_v20"), F.lit(0.0))}, spare=("_hi5", "_lo5", "_v20"))
    x = w.together(w.indexed(b.daily_bars(spark, sf_dir)), plain, w.obv_recipe(), w.vwap_recipe(20, "vwap20"), w.bollinger_recipe(), w.stochastic_recipe(14, 3, "stoch"), w.cci_recipe(20, "cci20"), w.mfi_recipe(14, "mfi14"))
    return shown(x, ["symbol", "ts"], _MOVING)


_REC = """,
base AS (SELECT *, close - lag(close) OVER s AS d, high - lag(high) OVER s AS up, lag(low) OVER s - low AS dn, lag(close) OVER s AS pc FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY ts)),
src AS (SELECT symbol, ts, rn, close, greatest(d, 0) AS g, greatest(-d, 0) AS l, greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr,
  CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pm, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS mm FROM base),
one AS (
  SELECT symbol, ts, rn, close AS e20, CAST(NULL AS DOUBLE) AS ag, CAST(NULL AS DOUBLE) AS al, tr AS a14, tr AS a5, CAST(pm AS DOUBLE) AS sp, CAST(mm AS DOUBLE) AS sm, close AS f, close AS s FROM src WHERE rn = 1
  UNION ALL
  SELECT c.symbol, c.ts, c.rn, e20 * (1 - 2.0 / 21) + c.close * 2.0 / 21, CASE WHEN c.rn = 2 THEN g ELSE ag * 13.0 / 14 + g / 14.0 END, CASE WHEN c.rn = 2 THEN l ELSE al * 13.0 / 14 + l / 14.0 END,
    a14 * 13.0 / 14 + tr / 14.0, a5 * 0.8 + tr / 5.0, sp * 0.8 + pm / 5.0, sm * 0.8 + mm / 5.0, f * 11.0 / 13 + c.close * 2.0 / 13, s * 25.0 / 27 + c.close * 2.0 / 27
  FROM one JOIN src c ON c.symbol = one.symbol AND c.rn = one.rn + 1),
mid AS (SELECT *, 100.0 * sp / nullif(a5, 0) AS pdi, 100.0 * sm / nullif(a5, 0) AS mdi FROM one),
dx AS (SELECT *, coalesce(100.0 * abs(pdi - mdi) / nullif(pdi + mdi, 0), 0) AS dx, f - s AS macd FROM mid),
two AS (
  SELECT symbol, rn, CAST(NULL AS DOUBLE) AS adx, CAST(NULL AS DOUBLE) AS sig FROM dx WHERE rn = 1
  UNION ALL
  SELECT c.symbol, c.rn, CASE WHEN c.rn < 5 THEN NULL WHEN c.rn = 5 THEN c.dx ELSE adx * 0.8 + c.dx / 5.0 END, CASE WHEN c.rn < 26 THEN NULL WHEN c.rn = 26 THEN c.macd ELSE sig * 0.8 + c.macd * 0.2 END
  FROM two JOIN dx c ON c.symbol = two.symbol AND c.rn = two.rn + 1)
SELECT x.symbol, CAST(x.ts AS VARCHAR) AS ts, round(CASE WHEN x.rn >= 20 THEN e20 END, 3) AS ema20, round(CASE WHEN x.rn >= 15 THEN CASE WHEN ag = 0 THEN 0 WHEN al = 0 THEN 100 ELSE 100 - 100 / (1 + ag / al) END END, 3) AS rsi14,
  round(CASE WHEN x.rn >= 14 THEN a14 END, 3) AS atr14, round(CASE WHEN x.rn >= 5 THEN pdi END, 3) AS plus_di, round(CASE WHEN x.rn >= 5 THEN mdi END, 3) AS minus_di, round(CASE WHEN x.rn >= 9 THEN adx END, 3) AS adx5,
  round(CASE WHEN x.rn >= 26 THEN macd END, 3) AS macd, round(CASE WHEN x.rn >= 34 THEN sig END, 3) AS macd_signal, round(CASE WHEN x.rn >= 34 THEN macd - sig END, 3) AS macd_hist
FROM dx x JOIN two t ON t.symbol = x.symbol AND t.rn = x.rn"""


@query("w_recurrent", D.replace("WITH ", "WITH RECURSIVE ", 1) + _REC)
def recurrent(spark, sf_dir):
    """W03, W06, W10, W11, W13 (kernel R1) over daily bars of all symbols."""
    x = w.indexed(b.daily_bars(spark, sf_dir))
    x = w.together(x, w.ema_recipe("close", "ema20", 20, 1, 20), w.rsi_recipe("rsi14", 14), w.atr_recipe("atr14", 14), w.adx_recipe(5, "adx5"), w.macd_recipe())
    return shown(x, ["symbol", "ts"], ["ema20", "rsi14", "atr14", "plus_di", "minus_di", "adx5", "macd", "macd_signal", "macd_hist"], 3)


_LONG = _REC.replace("PARTITION BY symbol ORDER BY ts", "ORDER BY rn").replace("SELECT x.symbol, CAST(x.ts AS VARCHAR) AS ts, ", "SELECT x.ts AS event_id, ").replace("bars WINDOW", "ser WINDOW").replace("c.symbol, ", "").replace("symbol, ", "").replace("c.symbol = one.symbol AND ", "").replace("c.symbol = two.symbol AND ", "").replace("t.symbol = x.symbol AND ", "")


@query("w_recurrent_long", "WITH RECURSIVE ser AS (SELECT event_id AS ts, row_number() OVER (ORDER BY ts, event_id) AS rn, value AS close, value * 1.01 + 0.1 AS high, value * 0.99 - 0.1 AS low FROM events)" + _LONG)
def recurrent_long(spark, sf_dir):
    """W03, W06, W10, W11, W13 (kernel R1) over all events as one series, in blocks of 512 rows."""
    v = F.col("value")
    e = b.table(spark, sf_dir, "events").select(F.lit("all").alias("series"), "ts", "event_id", v.alias("close"), (v * 1.01 + 0.1).alias("high"), (v * 0.99 - 0.1).alias("low"))
    x = ls.together(e, "series", ["ts", "event_id"], w.ema_recipe("close", "ema20", 20, 1, 20), w.rsi_recipe("rsi14", 14), w.atr_recipe("atr14", 14), w.adx_recipe(5, "adx5"), w.macd_recipe(), rows=512)
    return shown(x, ["event_id"], ["ema20", "rsi14", "atr14", "plus_di", "minus_di", "adx5", "macd", "macd_signal", "macd_hist"], 3)


_FIFTY = "CASE WHEN ag2 IS NULL THEN NULL WHEN al2 = 0 AND ag2 = 0 THEN 50 WHEN al2 = 0 THEN 100 ELSE greatest(0, least(100, 100 - 100 / (1 + ag2 / al2))) END"
_RULES, _RULED = layered("WITH " + b.bars_sql(60), "bars", [BASE, NEXT, *rsi(2)])


@query("w_rsi_rules", _RULES + f" SELECT symbol, ts, round(r, 6) AS rsi_lab, round({_FIFTY}, 6) AS rsi_fifty, round(CASE WHEN ag2 IS NOT NULL THEN 100 - 100 / (1 + ag2 / nullif(al2, 0)) END, 6) AS rsi_null FROM {_RULED}")
def rsi_rules(spark, sf_dir):
    """W06, W07 and W08 side by side on hourly bars."""
    x = w.indexed(b.bars(spark, sf_dir, 60))
    x = w.rsi(w.rsi(w.rsi(x, "rsi_lab", 2), "rsi_fifty", 2, rule="fifty"), "rsi_null", 2, rule="null")
    return shown(x, ["symbol", "ts"], ["rsi_lab", "rsi_fifty", "rsi_null"])


@query("w_candles", D + """
, x AS (SELECT *, lag(open) OVER s AS po, lag(close) OVER s AS pc, lag(low) OVER s AS pl, lag(high) OVER s AS ph, lag(low, 2) OVER s AS l2, lag(close, 2) OVER s AS c2 FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, CAST(ts AS VARCHAR) AS ts, CAST(coalesce(pc < po AND close > open AND open <= pc AND close >= po, false) AS BIGINT) AS bull_engulf, CAST(coalesce(pc > po AND close < open AND open >= pc AND close <= po, false) AS BIGINT) AS bear_engulf,
 CAST(coalesce(pc < po AND close > open AND open > pc AND close < po, false) AS BIGINT) AS harami, CAST(coalesce(pc < po AND close > open AND open < pl AND close > (po + pc) / 2.0 AND close < po, false) AS BIGINT) AS piercing,
 CAST(coalesce(rn > 3 AND low < pl AND pl < l2, false) AS BIGINT) AS lower_lows, CAST(coalesce(rn > 3 AND close < pc AND pc < c2, false) AS BIGINT) AS lower_closes, CAST(coalesce(close > ph, false) AS BIGINT) AS over_high, CAST(coalesce(close > pc, false) AS BIGINT) AS up_close FROM x""")
def candles(spark, sf_dir):
    """W43, W44, W45 over daily bars."""
    x = w.candle_patterns(w.indexed(b.daily_bars(spark, sf_dir)))
    x = x.withColumns({"lower_lows": w.consecutive_lower("low", 3), "lower_closes": w.consecutive_lower("close", 3), "over_high": w.fast_exit(), "up_close": w.fast_exit("up_close")})
    return shown(x, ["symbol", "ts"], ["bull_engulf", "bear_engulf", "harami", "piercing", "lower_lows", "lower_closes", "over_high", "up_close"])


@query("w_equity", D + """
, r AS (SELECT symbol, ts, 0.01 * coalesce(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1, 0) AS r FROM bars),
e AS (SELECT *, product(1 + r) OVER s AS equity FROM r WINDOW s AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, greatest(1.0, max(equity) OVER s) AS peak FROM e WINDOW s AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, equity / peak - 1 AS drawdown, sum(CASE WHEN equity / peak - 1 >= 0 THEN 1 ELSE 0 END) OVER s AS i FROM p WINDOW s AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING))
SELECT symbol, CAST(ts AS VARCHAR) AS ts, round(ln(equity), 6) AS equity, round(drawdown, 6) AS drawdown, CAST(sum(CASE WHEN drawdown < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, i ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS underwater FROM d""")
def equity_curve(spark, sf_dir):
    """W35 on a hundredth of daily returns; equity as its logarithm."""
    x = w.indexed(b.daily_bars(spark, sf_dir)).withColumn("r", 0.01 * F.coalesce(w.pct_change("close"), F.lit(0.0)))
    return shown(w.equity(x, "r").withColumn("equity", F.log("equity")), ["symbol", "ts"], ["equity", "drawdown", "underwater"])


@query("w_session_vwap", "WITH " + b.bars_sql(60) + """
SELECT symbol, ts, round(sum((high + low + close) / 3.0 * volume) OVER w / sum(volume) OVER w, 6) AS session_vwap FROM bars WINDOW w AS (PARTITION BY symbol, ts // 86400 ORDER BY ts ROWS UNBOUNDED PRECEDING)""")
def session_vwap(spark, sf_dir):
    """W22 on hourly bars, by UTC day."""
    return shown(w.session_vwap(w.indexed(b.bars(spark, sf_dir, 60))), ["symbol", "ts"], ["session_vwap"])


@query("w_bar_spacing", "WITH " + b.bars_sql(60) + """
, g AS (SELECT symbol, ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS gap FROM bars)
SELECT symbol, round(quantile_cont(gap, 0.5), 6) AS spacing, CASE WHEN quantile_cont(gap, 0.5) < 86400 THEN 'session' ELSE 'rolling' END AS mode FROM g GROUP BY symbol""")
def spacing(spark, sf_dir):
    """W22 auto mode."""
    return shown(w.bar_spacing(b.bars(spark, sf_dir, 60)), ["symbol"], ["spacing", "mode"])
