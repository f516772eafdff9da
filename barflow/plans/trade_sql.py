"""SQL of the trade rules: candidates by windows and range joins, then a recursion for what was taken before."""

from __future__ import annotations

from . import bindings as b
from .signal_sql import atr, features_sql, recurrence

_S = "PARTITION BY symbol ORDER BY rn"


def _bars(name: str, more: str = "NULL") -> str:
    """Bars with en, ex, a further value ``v``, the count n and the next open."""
    sql, source, entry, exit_ = features_sql(name)
    return sql.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
s0 AS (SELECT symbol, rn, ts, open, high, low, close, coalesce({entry}, false) AS en, coalesce({exit_}, false) AS ex, {more} AS v FROM {source})"""


_MARKED = """,
s AS (SELECT *, max(rn) OVER (PARTITION BY symbol) AS n, lead(open) OVER (PARTITION BY symbol ORDER BY rn) AS nxt FROM s0),
m AS (SELECT *, min(CASE WHEN ex AND rn < n THEN rn END) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS xr FROM s)"""

#: From candidates f(symbol, s, er, e, ep, xp, forced) to trades.
_TAKEN = """,
k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY s) AS k FROM f),
r AS (SELECT *, true AS taken, e AS last FROM k WHERE k = 1
  UNION ALL SELECT k.*, k.s >= r.last, CASE WHEN k.s >= r.last THEN k.e ELSE r.last END FROM r JOIN k ON k.symbol = r.symbol AND k.k = r.k + 1)"""
SHOWN = """
SELECT r.symbol, CAST(a.ts AS VARCHAR) AS entry_time, CAST(z.ts AS VARCHAR) AS exit_time, round(ep, 6) AS entry_price, round(xp, 6) AS exit_price, round(xp / ep - 1, 6) AS gross_return, CAST(e - er AS BIGINT) AS duration_bars, CAST(forced AS BIGINT) AS forced
FROM r JOIN bars a ON a.symbol = r.symbol AND a.rn = r.er JOIN bars z ON z.symbol = r.symbol AND z.rn = r.e WHERE r.taken"""


def _with_levels(hold: int, stop: str, target: str) -> str:
    """Exits by signal or time, and before them by stop or target prices of the entry price ``ep`` and ``v``."""
    return f""",
c AS (SELECT symbol, rn AS s, nxt AS ep, v, least(coalesce(xr + 1, n), least(n, rn + 1 + {hold})) AS e0, xr IS NULL OR least(n, rn + 1 + {hold}) < coalesce(xr + 1, n) AS f0 FROM m WHERE en AND rn < n AND nxt > 0),
h AS (SELECT c.symbol, c.s, min(p.rn) AS hr, arg_min(CASE WHEN p.low <= {stop} THEN least(p.open, {stop}) ELSE greatest(p.open, {target}) END, p.rn) AS hp FROM c JOIN s p ON p.symbol = c.symbol AND p.rn BETWEEN c.s + 1 AND c.e0 WHERE coalesce(p.low <= {stop}, false) OR coalesce(p.high >= {target}, false) GROUP BY 1, 2),
f AS (SELECT c.symbol, c.s, c.s + 1 AS er, coalesce(h.hr, c.e0) AS e, c.ep, coalesce(h.hp, o.open) AS xp, c.f0 AND h.hr IS NULL AS forced FROM c LEFT JOIN h ON h.symbol = c.symbol AND h.s = c.s JOIN s o ON o.symbol = c.symbol AND o.rn = coalesce(h.hr, c.e0)
  WHERE coalesce(h.hp, o.open) > 0 AND (coalesce(h.hr, c.e0) > c.s + 1 OR h.hr IS NOT NULL))"""


def signal_trades(name: str, hold: int) -> str:
    """K01 without levels, up to its recursion r."""
    return _bars(name) + _MARKED + f""",
c AS (SELECT symbol, rn AS s, nxt AS ep, least(coalesce(xr + 1, n), least(n, rn + 1 + {hold})) AS e, xr IS NULL OR least(n, rn + 1 + {hold}) < coalesce(xr + 1, n) AS forced FROM m WHERE en AND rn < n AND nxt > 0),
f AS (SELECT c.symbol, c.s, c.s + 1 AS er, c.e, c.ep, o.open AS xp, c.forced FROM c JOIN s o ON o.symbol = c.symbol AND o.rn = c.e WHERE o.open > 0 AND c.e > c.s + 1)""" + _TAKEN


_ATR = lambda n: atr(n, "a")["a"]


def stop_target_sql() -> str:
    return _bars("bullish_harami", f"2.0 * ({_ATR(20)})") + _MARKED + _with_levels(40, "(c.ep - c.v)", "(c.ep + c.v)") + _TAKEN + SHOWN


def first_profitable_sql() -> str:
    return _bars("rsi_first_profitable_close") + _MARKED + """,
c AS (SELECT symbol, rn AS s, nxt AS ep, n, least(n - 1, rn + 60) AS lim FROM m WHERE en AND rn < n),
h AS (SELECT c.symbol, c.s, min(p.rn) AS at FROM c JOIN s p ON p.symbol = c.symbol AND p.rn BETWEEN c.s + 1 AND c.lim WHERE p.close > c.ep GROUP BY 1, 2),
g AS (SELECT c.*, h.at, coalesce(h.at + 1, least(c.n, c.lim + 1)) AS e FROM c LEFT JOIN h ON h.symbol = c.symbol AND h.s = c.s),
f AS (SELECT g.symbol, g.s, g.s + 1 AS er, g.e, g.ep, o.open AS xp, g.at IS NULL AS forced FROM g JOIN s o ON o.symbol = g.symbol AND o.rn = g.e WHERE o.open > 0 AND g.e > g.s + 1)""" + _TAKEN + SHOWN


def trailing_sql() -> str:
    return _bars("triple_screen") + _MARKED + """,
c AS (SELECT symbol, rn AS s, nxt AS ep, least(n, rn + 61) AS e0 FROM m WHERE en AND rn < n AND nxt > 0),
p AS (SELECT c.*, p.rn, p.open, p.high, p.low, greatest(ep, coalesce(max(p.high) OVER (PARTITION BY c.symbol, c.s ORDER BY p.rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ep)) * 0.8 AS sp FROM c JOIN s p ON p.symbol = c.symbol AND p.rn BETWEEN c.s + 1 AND c.e0),
h AS (SELECT symbol, s, min(rn) AS hr, arg_min(CASE WHEN low <= sp THEN least(open, sp) ELSE greatest(open, ep * 1.3) END, rn) AS hp FROM p WHERE low <= sp OR high >= ep * 1.3 GROUP BY 1, 2),
f AS (SELECT c.symbol, c.s, c.s + 1 AS er, coalesce(h.hr, c.e0) AS e, c.ep, coalesce(h.hp, o.open) AS xp, h.hr IS NULL AS forced FROM c LEFT JOIN h ON h.symbol = c.symbol AND h.s = c.s JOIN s o ON o.symbol = c.symbol AND o.rn = coalesce(h.hr, c.e0)
  WHERE coalesce(h.hp, o.open) > 0 AND (coalesce(h.hr, c.e0) > c.s + 1 OR h.hr IS NOT NULL))""" + _TAKEN + SHOWN


def pullback_sql() -> str:
    return _bars("market_structure_atr_pullback", _ATR(20)) + _MARKED + """,
u AS (SELECT *, close > max(high) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AND rn > 5 AND rn < n AS up FROM s),
u2 AS (SELECT *, min(CASE WHEN up THEN rn END) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x FROM u),
c AS (SELECT symbol, rn AS s, low - 0.5 * v AS lim, 2.0 * v AS sd FROM s WHERE en AND v IS NOT NULL),
g0 AS (SELECT c.symbol, c.s, c.sd, min(p.rn) AS er, arg_min(least(p.open, c.lim), p.rn) AS ep FROM c JOIN s p ON p.symbol = c.symbol AND p.rn BETWEEN c.s + 1 AND c.s + 10 WHERE p.low <= c.lim GROUP BY 1, 2, 3),
g AS (SELECT g0.*, e.x, e.n FROM g0 JOIN u2 e ON e.symbol = g0.symbol AND e.rn = g0.er WHERE ep > 0),
h AS (SELECT g.symbol, g.s, min(p.rn) AS hr, arg_min(least(p.open, g.ep - g.sd), p.rn) AS hp FROM g JOIN s p ON p.symbol = g.symbol AND p.rn BETWEEN g.er AND coalesce(g.x, g.n - 1) WHERE p.low <= g.ep - g.sd AND p.rn < g.n GROUP BY 1, 2),
f AS (SELECT g.symbol, g.s, g.er, coalesce(h.hr, g.x + 1, g.n) AS e, g.ep, coalesce(h.hp, CASE WHEN h.hr IS NULL AND g.x IS NULL THEN o.close ELSE o.open END) AS xp, h.hr IS NULL AND g.x IS NULL AS forced
  FROM g LEFT JOIN h ON h.symbol = g.symbol AND h.s = g.s JOIN s o ON o.symbol = g.symbol AND o.rn = coalesce(h.hr, g.x + 1, g.n))""" + _TAKEN + SHOWN


def setup_sql() -> str:
    sql, source, _, _ = features_sql("rsi_oversold")
    # The rule without gain and loss gives 50 here, not 0.
    return sql.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
y AS (SELECT *, CASE WHEN ag2 = 0 AND al2 = 0 THEN 50 ELSE r END AS q, {recurrence('tr', 1.0 / 14, 1, 14)} AS a FROM {source}),
z AS (SELECT *, last_value(CASE WHEN q < 10 THEN {{'rn': rn, 'high': high}} END IGNORE NULLS) OVER ({_S} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS st FROM y),
t AS (SELECT *, coalesce(rn - st.rn <= 5 AND close > st.high, false) AS ok FROM z),
s0 AS (SELECT symbol, rn, ts, open, high, low, close, ok AND NOT coalesce(lag(ok) OVER ({_S}), false) AS en, coalesce(q > 70, false) AS ex, a AS v FROM t)""" + _MARKED + _with_levels(20, "(c.ep - 2.0 * c.v)", "(c.ep + 3.0 * c.v)") + _TAKEN + SHOWN


def schedule_sql() -> str:
    return signal_trades("n_bar_breakout", 20) + """,
w AS (SELECT symbol, er AS at, 1 AS en, 0 AS ex FROM r WHERE taken UNION ALL SELECT symbol, e, 0, 1 FROM r WHERE taken)
SELECT w.symbol, CAST(p.ts AS VARCHAR) AS at, CAST(sum(en) AS BIGINT) AS entries, CAST(sum(ex) AS BIGINT) AS exits, CAST(sum(en) > 0 AND sum(ex) > 0 AS BIGINT) AS collision FROM w JOIN bars p ON p.symbol = w.symbol AND p.rn = w.at - 1 GROUP BY 1, 2"""


def capacity_sql(most: int) -> str:
    """The open set is a list in the recursion."""
    return b.with_sql("trades").replace("WITH ", "WITH RECURSIVE ", 1) + f""",
k AS (SELECT hypothesis_id, symbol, entry_time, exit_time, trade_id, row_number() OVER (PARTITION BY hypothesis_id ORDER BY entry_time, entry_price DESC, symbol, exit_time, trade_id) AS k FROM trades),
r AS (SELECT hypothesis_id, k, trade_id, true AS taken, [{{'s': symbol, 'x': exit_time}}] AS held FROM k WHERE k = 1
  UNION ALL SELECT k.hypothesis_id, k.k, k.trade_id, len(h) < {most} AND len(list_filter(h, lambda q: q.s = k.symbol)) = 0, CASE WHEN len(h) < {most} AND len(list_filter(h, lambda q: q.s = k.symbol)) = 0 THEN list_append(h, {{'s': k.symbol, 'x': k.exit_time}}) ELSE h END
  FROM (SELECT r.hypothesis_id AS rh, r.k AS rk, n.*, list_filter(r.held, lambda q: q.x > n.entry_time) AS h FROM r JOIN k n ON n.hypothesis_id = r.hypothesis_id AND n.k = r.k + 1) k)
SELECT hypothesis_id, count(*) AS trades, CAST(sum(trade_id) AS BIGINT) AS ids FROM r WHERE taken GROUP BY 1"""


def lanes_sql() -> str:
    """lanes' last exits are a list in the recursion."""
    return b.with_sql("trades").replace("WITH ", "WITH RECURSIVE ", 1) + """,
k AS (SELECT symbol, entry_time, exit_time, trade_id, row_number() OVER (PARTITION BY symbol ORDER BY entry_time, exit_time, trade_id) AS k FROM trades),
r AS (SELECT symbol, k, trade_id, CAST(1 AS BIGINT) AS lane, [exit_time] AS ends FROM k WHERE k = 1
  UNION ALL SELECT symbol, k, trade_id, lane, CASE WHEN lane > len(ends) THEN list_append(ends, exit_time) ELSE ends[1:lane - 1] || [exit_time] || ends[lane + 1:] END
  FROM (SELECT n.*, r.ends, coalesce(list_position(list_transform(r.ends, lambda q: q < n.entry_time), true), len(r.ends) + 1) AS lane FROM r JOIN k n ON n.symbol = r.symbol AND n.k = r.k + 1))
SELECT lane, count(*) AS trades, CAST(sum(trade_id) AS BIGINT) AS ids FROM r GROUP BY 1"""


def sweep_sql(pairs: list[tuple[int, int]], hold: int) -> str:
    """Each pair's breakout trades and their metrics; exits and entries by the pair's own windows."""
    values = ", ".join(f"({n}, {m})" for n, m in pairs)
    moving = lambda fn, c, k: f"CASE {k} " + " ".join(f"WHEN {x} THEN {fn}({c}) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN {x} PRECEDING AND 1 PRECEDING)" for x in sorted({v for p in pairs for v in p})) + " END"
    one = f"""(SELECT b.symbol || '|' || n || '|' || m AS symbol, b.rn, b.ts, b.open, b.high, b.low, b.close, n, m, hi, lo FROM
  (SELECT bars.*, g.n, g.m, {moving('max', 'high', 'g.n')} AS hi, {moving('min', 'low', 'g.m')} AS lo FROM bars CROSS JOIN (VALUES {values}) g(n, m)) b)"""
    one = one.replace("PARTITION BY symbol ORDER BY rn", "PARTITION BY symbol, g.n, g.m ORDER BY rn")
    return b.with_sql("daily").replace("WITH ", "WITH RECURSIVE ", 1) + f""",
s0 AS (SELECT symbol, rn, ts, open, high, low, close, coalesce(rn > n AND high > hi, false) AS en, coalesce(rn > m AND low < lo, false) AS ex, NULL AS v FROM {one})""" + _MARKED + f""",
c AS (SELECT symbol, rn AS s, nxt AS ep, least(coalesce(xr + 1, n), least(n, rn + 1 + {hold})) AS e, false AS forced FROM m WHERE en AND rn < n AND nxt > 0),
f AS (SELECT c.symbol, c.s, c.s + 1 AS er, c.e, c.ep, o.open AS xp, c.forced FROM c JOIN s o ON o.symbol = c.symbol AND o.rn = c.e WHERE o.open > 0 AND c.e > c.s + 1)""" + _TAKEN + """,
t AS (SELECT CAST(split_part(symbol, '|', 2) AS BIGINT) AS n, CAST(split_part(symbol, '|', 3) AS BIGINT) AS m, xp / ep * (1 - 0.0003) / (1 + 0.0003) - 1 AS net FROM r WHERE taken)
SELECT n, m, substr(sha256('{"n":' || n || ',"m":' || m || '}'), 1, 16) AS hypothesis_id, count(*) AS trades, round(avg(net), 6) AS net_expectancy, round(sum(CASE WHEN net > 0 THEN net ELSE 0 END) / nullif(-sum(CASE WHEN net < 0 THEN net ELSE 0 END), 0), 6) AS profit_factor, round(avg(CASE WHEN net > 0 THEN 1.0 ELSE 0 END), 6) AS win_rate FROM t GROUP BY 1, 2"""


def factory_sql(names: list[str], hold: int, bps: float = 3.0) -> str:
    """Q11: strategies' trades within folds, their metrics by segment, gate and status; folds of 500 days at least, parts of 100."""
    one = []
    for n in names:
        sql, source, entry, exit_ = features_sql(n)
        one.append(f"SELECT '{n}|' || symbol AS symbol, rn, ts, open, high, low, close, en, ex, NULL AS v FROM ({sql} SELECT *, coalesce({entry}, false) AS en, coalesce({exit_}, false) AS ex FROM {source})")
    cost = bps / 1e4
    return "WITH RECURSIVE s0 AS (" + " UNION ALL ".join(one) + ")" + _MARKED + f""",
c AS (SELECT symbol, rn AS s, nxt AS ep, least(coalesce(xr + 1, n), least(n, rn + 1 + {hold})) AS e, false AS forced FROM m WHERE en AND rn < n AND nxt > 0),
f AS (SELECT c.symbol, c.s, c.s + 1 AS er, c.e, c.ep, o.open AS xp, c.forced FROM c JOIN s o ON o.symbol = c.symbol AND o.rn = c.e WHERE o.open > 0 AND c.e > c.s + 1)""" + _TAKEN + f""",
d0 AS (SELECT DISTINCT ts FROM s0), dd AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM d0),
p0 AS (SELECT fold, CAST(floor(n * 0.45) - 1 + fold * part AS BIGINT) AS te, part FROM (SELECT max(n) AS n, CAST(greatest(100, floor(max(n) * 0.1)) AS BIGINT) AS part FROM dd HAVING max(n) >= 500), range(4) AS q(fold)),
p1 AS (SELECT fold, te, te + {hold} + 2 AS vs, te + {hold} + 1 + part AS ve, te + 2 * {hold} + 3 + part AS ss, te + 2 * {hold} + 2 + 2 * part AS se FROM p0), p2 AS (SELECT *, count(*) OVER () AS c FROM p1 WHERE se < (SELECT max(n) FROM dd)),
p3 AS (SELECT fold, unnest([{{'s': 'train', 'a': CAST(0 AS BIGINT), 'z': te}}, {{'s': 'valid', 'a': vs, 'z': ve}}, {{'s': 'test', 'a': ss, 'z': se}}]) AS x FROM p2 WHERE c >= 3), folds AS (SELECT fold, x.s AS segment, a.ts AS a, z.ts AS z FROM p3 JOIN dd a ON a.i = x.a JOIN dd z ON z.i = x.z),
t AS (SELECT split_part(r.symbol, '|', 1) AS strategy, a.ts AS entry, z.ts AS exit, r.xp / r.ep * (1 - {cost}) / (1 + {cost}) - 1 AS net FROM r JOIN s a ON a.symbol = r.symbol AND a.rn = r.er JOIN s z ON z.symbol = r.symbol AND z.rn = r.e WHERE r.taken),
g AS (SELECT strategy, fold, count(*) FILTER (segment = 'train') AS tc, avg(net) FILTER (segment = 'train') AS te, count(*) FILTER (segment = 'valid') AS vc, avg(net) FILTER (segment = 'valid') AS ve, avg(net) FILTER (segment = 'test') AS xe FROM t JOIN folds ON entry >= folds.a AND exit <= folds.z GROUP BY 1, 2),
u AS (SELECT strategy, count(*) AS folds, CAST(sum(CAST(coalesce(tc >= 8 AND vc >= 8 AND te > 0 AND ve > 0, false) AS BIGINT)) AS BIGINT) AS passed, avg(CASE WHEN xe > 0 THEN 1.0 WHEN xe <= 0 THEN 0.0 END) AS positive, quantile_cont(xe, 0.5) AS median, min(xe) AS worst FROM g GROUP BY 1)
SELECT strategy, CASE WHEN folds >= 3 AND positive = 1 AND worst > 0 THEN 'STRONG_SURVIVOR' WHEN folds >= 3 AND positive >= 0.75 AND median > 0 THEN 'PROVISIONAL_SURVIVOR' WHEN folds >= 2 AND positive >= 0.5 AND median > 0 THEN 'SURVIVOR' ELSE 'REJECT' END AS status, folds, passed, round(positive, 6) AS positive, round(median, 6) AS median, round(worst, 6) AS worst FROM u"""
