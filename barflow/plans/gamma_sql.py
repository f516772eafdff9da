"""SQL of the gamma queries: snapshots of contracts, order flow, regimes, and the recursion over taken trades."""

from __future__ import annotations

from . import bindings as b
from .signal_sql import BASE, NEXT, adx, atr, ema, layered, moving, rsi

#: Contracts by symbol and day: strikes about the last close at or before the day.
CONTRACTS = """sy AS (SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS k FROM (SELECT DISTINCT symbol FROM bars)),
ct AS (SELECT sy.symbol, 1704067200 + (p_size - 1) % 30 * 86400 AS ts, p_size * 7 / 365.0 AS y, p_partkey // 5 % 2 = 0 AS is_call, 0.5 + p_partkey % 41 / 40.0 AS m, CAST(p_partkey % 97 AS DOUBLE) AS oi, 0.1 + p_partkey % 50 / 100.0 AS v FROM part JOIN sy ON sy.k = p_partkey % 5),
cs AS (SELECT ct.*, x.close AS s, ct.m * x.close AS k FROM ct ASOF JOIN bars x ON x.symbol = ct.symbol AND ct.ts >= x.ts),
cg AS (SELECT *, CASE WHEN is_call THEN 1 ELSE -1 END * exp(-0.5 * pow((ln(s / k) + 0.5 * v * v * y) / (v * sqrt(y)), 2)) / sqrt(6.283185307179586) / (s * v * sqrt(y)) * oi * 100 * s * s * 0.01 AS gex FROM cs WHERE oi > 0),
ck AS (SELECT symbol, ts, k, sum(CASE WHEN is_call THEN gex ELSE 0 END) AS c, sum(CASE WHEN is_call THEN 0 ELSE gex END) AS p FROM cg GROUP BY 1, 2, 3),
snap AS (SELECT symbol, ts, sum(c + p) AS net_gex, arg_max(k, {'c': c, 'k': -k}) AS call_wall, arg_min(k, {'p': p, 'k': k}) AS put_wall FROM ck GROUP BY 1, 2)"""

#: Order flow by hour, levels of 5.
FLOW = """tk AS (SELECT *, sign(nullif(price - lag(price) OVER (PARTITION BY symbol ORDER BY ts, event_id), 0)) AS d FROM ticks),
ag AS (SELECT *, coalesce(last_value(d IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 1.0) AS a, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS bar FROM tk),
lv AS (SELECT symbol, bar, round_even(price / 5.0, 0) * 5.0 AS level, sum(CASE WHEN a > 0 THEN size ELSE 0 END) AS buy, sum(CASE WHEN a > 0 THEN 0 ELSE size END) AS sell FROM ag GROUP BY 1, 2, 3),
im AS (SELECT *, buy > 0 AND buy >= 3 * greatest(coalesce(lag(sell) OVER w, 0), 1e-9) AS bi, row_number() OVER w AS n FROM lv WINDOW w AS (PARTITION BY symbol, bar ORDER BY level)),
st AS (SELECT symbol, bar, max(c) AS stack FROM (SELECT symbol, bar, count(*) AS c FROM (SELECT *, n - row_number() OVER (PARTITION BY symbol, bar, bi ORDER BY level) AS g FROM im) WHERE bi GROUP BY symbol, bar, g) GROUP BY 1, 2),
dp AS (SELECT lv.symbol, bar, sum(CASE WHEN level <= x.low + 0.25 * greatest(x.high - x.low, 5.0) THEN sell ELSE 0 END) AS deep, sum(buy + sell) AS whole FROM lv JOIN bars x ON x.symbol = lv.symbol AND x.ts = bar GROUP BY 1, 2),
dl AS (SELECT symbol, bar, sum(a * size) AS delta FROM ag GROUP BY 1, 2),
fl AS (SELECT dl.symbol, dl.bar AS ts, dl.delta, coalesce(st.stack, 0) AS stack, coalesce(lag(dl.delta) OVER (PARTITION BY dl.symbol ORDER BY dl.bar), 0) <= 0 AND dl.delta > 0 AS turned, dp.deep >= 0.3 * dp.whole AND x.close >= x.low + 0.5 * greatest(x.high - x.low, 5.0) AS absorbs
  FROM dl JOIN dp ON dp.symbol = dl.symbol AND dp.bar = dl.bar JOIN bars x ON x.symbol = dl.symbol AND x.ts = dl.bar LEFT JOIN st ON st.symbol = dl.symbol AND st.bar = dl.bar)"""

SNAPSHOTS = "WITH " + b.bars_sql(60) + ",\n" + CONTRACTS
FLOWS = "WITH " + b.bars_sql(60) + ",\n" + FLOW


def regimes_sql(trend: int, deviations: float, rsi_entry: float, adx_entry: float, breakout_rsi: float, stacked: int, distance: float) -> str:
    """Up to table z: bars with their features and regime."""
    bands = {"mid": moving("avg", "close", 20), "sd": moving("stddev_pop", "close", 20), "trend": moving("avg", "close", trend), "vw": f"({moving('sum', 'tp * volume', 20)}) / ({moving('sum', 'volume', 20)})"}
    head, source = layered("WITH RECURSIVE " + b.bars_sql(60), "bars", [BASE, NEXT, *rsi(2), *adx(5), atr(14) | bands | {"xe": ema(5), "e8": ema(8)},
                           {"fifty": "CASE WHEN ag2 IS NULL THEN NULL WHEN al2 = 0 AND ag2 = 0 THEN 50 WHEN al2 = 0 THEN 100 ELSE 100 - 100 / (1 + ag2 / al2) END", "padx": "lag(adx) OVER (PARTITION BY symbol ORDER BY ts)"}])
    flows = f"(stack >= {stacked} OR (turned AND absorbs))"
    known = "vw IS NOT NULL AND sd IS NOT NULL AND atr14 IS NOT NULL"
    return head + f""",
{CONTRACTS},
{FLOW},
j AS (SELECT q.symbol, q.rn, q.ts, q.open, q.high, q.low, q.close, q.adx, q.padx, q.pc, q.fifty AS rsi, q.trend, q.vw, q.mid, q.sd, q.atr14, q.xe, q.e8, CASE WHEN q.ts - n.ts <= 172800 THEN n.net_gex END AS net_gex, CASE WHEN q.ts - n.ts <= 172800 THEN n.call_wall END AS call_wall,
  CASE WHEN q.ts - n.ts <= 172800 THEN n.put_wall END AS put_wall, f.delta, f.stack, f.turned, f.absorbs FROM {source} q ASOF LEFT JOIN snap n ON n.symbol = q.symbol AND q.ts >= n.ts LEFT JOIN fl f ON f.symbol = q.symbol AND f.ts = q.ts),
z AS (SELECT *, max(rn) OVER (PARTITION BY symbol) AS n, lead(open) OVER (PARTITION BY symbol ORDER BY rn) AS nxt,
  CASE WHEN {known} THEN CASE WHEN net_gex > 0 AND close > trend AND adx >= {adx_entry} AND rsi <= {rsi_entry} AND close <= mid - {deviations} * sd AND close <= vw AND coalesce(abs(close - put_wall) <= {distance} * atr14, true) AND {flows} THEN 1
    WHEN net_gex < 0 AND close > trend AND rsi >= {breakout_rsi} AND adx >= {adx_entry} AND adx > padx AND (coalesce(close > call_wall AND pc <= call_wall, false) OR close > mid + {deviations} * sd) AND {flows} AND delta > 0 THEN 2 END END AS regime FROM j)"""


def trades_sql(**parameters) -> str:
    """Paths bounded by the regime's hold, first exit by rule, then the recursion."""
    return regimes_sql(**parameters) + """,
c AS (SELECT symbol, rn AS s, regime, call_wall, nxt * 1.0005 AS ep, atr14 AS a, n, CASE regime WHEN 1 THEN 12 ELSE 40 END AS hold FROM z WHERE regime IS NOT NULL AND rn < n),
c1 AS (SELECT *, CASE WHEN regime = 2 AND call_wall - 0.25 * a < ep THEN greatest(ep - 1.5 * a, call_wall - 0.25 * a) ELSE ep - 1.5 * a END AS sp0 FROM c),
pt AS (SELECT c1.*, p.rn, p.open, p.high, p.low, p.close, p.xe, p.e8, p.rsi, CASE WHEN c1.regime = 2 THEN max(p.high) OVER w - 2.0 * p.atr14 END AS tr FROM c1 JOIN z p ON p.symbol = c1.symbol AND p.rn BETWEEN c1.s + 1 AND least(c1.n, c1.s + 1 + c1.hold) WINDOW w AS (PARTITION BY c1.symbol, c1.s ORDER BY p.rn ROWS UNBOUNDED PRECEDING)),
ps AS (SELECT *, greatest(sp0, max(tr) OVER (PARTITION BY symbol, s ORDER BY rn ROWS UNBOUNDED PRECEDING)) AS sp, rn - s - 1 AS held FROM pt),
ph AS (SELECT *, CASE WHEN open <= sp THEN 'stop_gap' WHEN low <= sp THEN 'stop_loss' WHEN regime = 1 AND call_wall > ep AND high >= call_wall THEN 'call_wall_target' WHEN regime = 1 AND held >= 1 AND close >= xe THEN 'ema_recovery' WHEN regime = 1 AND held >= 1 AND rsi >= 60 THEN 'rsi_recovery'
  WHEN regime = 2 AND held >= 1 AND close < e8 THEN 'ema8_trailing_exit' WHEN held >= hold THEN 'time_exit' WHEN rn = n THEN 'end_of_data' END AS reason FROM ps),
fx AS (SELECT symbol, s, min(rn) AS e, arg_min(reason, rn) AS reason, arg_min(CASE reason WHEN 'stop_gap' THEN open WHEN 'stop_loss' THEN sp WHEN 'call_wall_target' THEN call_wall ELSE close END * 0.9995, rn) AS xp FROM ph WHERE reason IS NOT NULL GROUP BY 1, 2),
k AS (SELECT c1.symbol, c1.s, c1.regime, c1.ep, fx.e, fx.reason, fx.xp, row_number() OVER (PARTITION BY c1.symbol ORDER BY c1.s) AS k FROM c1 JOIN fx ON fx.symbol = c1.symbol AND fx.s = c1.s),
r AS (SELECT *, true AS taken, e AS last FROM k WHERE k = 1
  UNION ALL SELECT k.*, k.s >= r.last, CASE WHEN k.s >= r.last THEN k.e ELSE r.last END FROM r JOIN k ON k.symbol = r.symbol AND k.k = r.k + 1)
SELECT r.symbol, a.ts AS entry_time, x.ts AS exit_time, CASE regime WHEN 1 THEN 'positive_gex_mean_reversion' ELSE 'negative_gex_breakout' END AS regime, round(ep, 6) AS entry_price, round(xp, 6) AS exit_price, round((xp * 0.999 - ep * 1.001) / (ep * 1.001), 6) AS return_pct, CAST(e - s - 1 AS BIGINT) AS bars_held, reason AS exit_reason
FROM r JOIN bars a ON a.symbol = r.symbol AND a.rn = r.s + 1 JOIN bars x ON x.symbol = r.symbol AND x.rn = r.e WHERE taken"""
