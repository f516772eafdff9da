"""SQL of the signal catalogues: features as layers of window expressions over daily bars.

A recurrence y = (1 - g) y' + g x is written as a closed form, (1 - g)**rn times a running sum of
g x (1 - g)**-rn, which double precision holds for series of up to about a thousand rows.
"""

from __future__ import annotations

from . import bindings as b

_W = "PARTITION BY symbol ORDER BY ts"


def lag(c: str, n: int = 1) -> str:
    return f"lag({c}, {n}) OVER ({_W})"


def moving(fn: str, c: str, n: int, shift: int = 0) -> str:
    f = f"OVER ({_W} ROWS BETWEEN {n - 1 + shift} PRECEDING AND {shift} PRECEDING)"
    return f"CASE WHEN count({c}) {f} >= {n} THEN {fn}({c}) {f} END"


def recurrence(x: str, gain: float, start: int, least: int) -> str:
    d = 1.0 - gain
    return f"CASE WHEN rn >= {least} THEN pow({d!r}, rn) * sum(CASE WHEN rn = {start} THEN ({x}) WHEN rn > {start} THEN {gain!r} * ({x}) ELSE 0 END * pow({d!r}, -rn)) OVER ({_W} ROWS UNBOUNDED PRECEDING) END"


def ema(n: int, x: str = "close", start: int = 1) -> str:
    return recurrence(x, 2.0 / (n + 1), start, start + n - 1)


BASE = {"pc": lag("close"), "ph": lag("high"), "pl": lag("low"), "po": lag("open"), "l2": lag("low", 2), "c2": lag("close", 2), "nx": f"lead(ts) OVER ({_W})", "tp": "(high + low + close) / 3.0"}
NEXT = {"ptp": lag("tp"), "g": "greatest(close - pc, 0)", "l": "greatest(pc - close, 0)", "tr": "greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0))",
         "pm": "CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END", "mm": "CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END"}


def rsi(n: int, name: str = "r") -> list[dict[str, str]]:
    return [{f"ag{n}": recurrence("g", 1.0 / n, 2, n + 1), f"al{n}": recurrence("l", 1.0 / n, 2, n + 1)},
            {name: f"CASE WHEN ag{n} IS NULL THEN NULL WHEN ag{n} = 0 THEN 0 WHEN al{n} = 0 THEN 100 ELSE 100 - 100 / (1 + ag{n} / al{n}) END"}]


def atr(n: int, name: str | None = None) -> dict[str, str]:
    return {name or f"atr{n}": recurrence("tr", 1.0 / n, 1, n)}


def adx(n: int) -> list[dict[str, str]]:
    return [{"_sp": recurrence("pm", 1.0 / n, 1, n), "_sm": recurrence("mm", 1.0 / n, 1, n), "_a": recurrence("tr", 1.0 / n, 1, n)}, {"pdi": "100 * _sp / nullif(_a, 0)", "mdi": "100 * _sm / nullif(_a, 0)"},
            {"dx": f"CASE WHEN rn >= {n} THEN coalesce(100 * abs(pdi - mdi) / nullif(pdi + mdi, 0), 0) END"}, {"adx": recurrence("dx", 1.0 / n, n, 2 * n - 1)}]


def macd(fast: int, slow: int, signal: int) -> list[dict[str, str]]:
    return [{"_f": ema(fast), "_w": ema(slow)}, {"macd": "_f - _w"}, {"hist": f"macd - ({ema(signal, 'macd', slow)})"}]


def crossed(x: str, name: str = "d") -> list[dict[str, str]]:
    return [{name: x}, {f"p{name}": lag(name)}]


def willr(n: int) -> str:
    return f"-100.0 * (({moving('max', 'high', n)}) - close) / nullif(({moving('max', 'high', n)}) - ({moving('min', 'low', n)}), 0)"


def rvol(n: int) -> str:
    return f"volume / nullif({moving('avg', 'volume', n, 1)}, 0)"


def sma(n: int, c: str = "close") -> str:
    return moving("avg", c, n)


_HIGH = "close > ph"
_UP, _DOWN = "d > 0 AND pd <= 0", "d < 0 AND pd >= 0"
_TREND = {"e": ema(100)}
_FLOWS = {"fp": moving("sum", "CASE WHEN tp > ptp THEN tp * volume ELSE 0 END", 14), "fn": moving("sum", "CASE WHEN tp < ptp THEN tp * volume ELSE 0 END", 14)}


def _back(x: str, entry: float, exit_at: float) -> tuple[str, str]:
    return f"{x} <= {entry} AND close > e", f"{x} >= {exit_at} OR close < e"


_MONTH = "date_trunc('month', ts) <> date_trunc('month', nx)"
_THREE = "symbol IN ('1', '2', '3')"

#: Name to layers over the base features, entry and exit.
SIGNALS: dict[str, tuple[list[dict[str, str]], str, str]] = {
    "rsi_oversold": (rsi(2), "r < 15", _HIGH),
    "rsi_adx": ([*rsi(2), *adx(5)], "r < 15 AND adx > 35", _HIGH),
    "rsi_first_profitable_close": (rsi(2), "r < 20", "false"),
    "rsi_threshold_exit": (rsi(2), "r < 15", "r > 75"),
    "rsi_ema_hist_flip": ([*rsi(3), {"e": ema(5, "r", 4)}, *crossed("r - e")], _UP, _DOWN),
    "cumulative_rsi": ([*rsi(2), {"s": moving("sum", "r", 2)}], "s < 20", _HIGH),
    "consecutive_lower_lows": ([], "rn > 3 AND low < pl AND pl < l2", _HIGH),
    "consecutive_lower_closes": ([], "rn > 3 AND close < pc AND pc < c2", _HIGH),
    "return_atr_compression": ([atr(5) | atr(10)], "close / pc - 1 <= -0.01 AND atr5 < atr10", _HIGH),
    "return_atr_expansion": ([atr(5) | atr(10)], "close / pc - 1 <= -0.01 AND atr5 > atr10", _HIGH),
    "ema_stretch_percent": ([{"e": ema(5)}], "(e - close) / CASE WHEN abs(e) > 1e-12 THEN e END > 0.01", _HIGH),
    "ema_stretch_atr": ([{"e": ema(5)} | atr(5)], "(e - close) / CASE WHEN abs(atr5) > 1e-12 THEN atr5 END > 0.5", _HIGH),
    "ema_decline": ([{"e": ema(5)}, {"pe": lag("e")}], "e / nullif(pe, 0) - 1 <= -0.005", _HIGH),
    "close_below_n_day_low": ([{"lo": moving("min", "low", 5, 1)}], "close < lo", _HIGH),
    "five_bar_contrarian": ([{"lo": moving("min", "low", 5, 1), "hi": moving("max", "high", 5, 1)}], "low < lo", "high > hi"),
    "seven_day_pullback": ([{"lo": moving("min", "low", 7, 1), "hi": moving("max", "high", 7, 1), "m": sma(200)}], "close < lo AND close > m", "close > hi"),
    "williams_r": ([{"w": willr(5), "m": sma(200)}], "w < -90 AND close > m", "w > -20"),
    "williams_macd": ([*macd(12, 26, 9), {"w": willr(5), "lo": moving("min", "hist", 5), "phist": lag("hist")}], "w < -90 AND hist <= lo", "hist > phist"),
    "n_bar_breakout": ([{"lo": moving("min", "low", 5, 1), "hi": moving("max", "high", 5, 1)}], "high > hi", "low < lo"),
    "ma_crossover": (crossed(f"({sma(50)}) - ({sma(200)})"), _UP, _DOWN),
    "asymmetric_ma_crossover": ([*crossed(f"({sma(70)}) - ({sma(210)})"), *crossed(f"({sma(110)}) - ({sma(230)})", "v")], _UP, "v < 0 AND pv >= 0"),
    "ma_channel": ([{"u": f"CAST(low > ({sma(10, 'high')}) AS INT)", "v": f"CAST(high < ({sma(10, 'low')}) AS INT)"}, {"um": moving("min", "u", 5), "vm": moving("min", "v", 5)}], "um = 1", "vm = 1"),
    "bollinger_breakout": ([{"m": sma(100), "sd": moving("stddev_pop", "close", 100)}], "close > m + 3 * sd", "close < m - sd"),
    "percent_flipper": ([{"u": f"coalesce(close >= ({moving('min', 'low', 50, 1)}) * 1.2, false)", "v": f"coalesce(close <= ({moving('max', 'high', 50, 1)}) * 0.8, false)"}, {"pu": lag("u"), "pv": lag("v")}],
                        "u AND NOT coalesce(pu, false)", "v AND NOT coalesce(pv, false)"),
    "market_structure_atr_pullback": ([{"hi": moving("max", "high", 63, 1)}], "close > hi", _HIGH),
    "bearish_engulfing_contrarian_long": ([], "pc > po AND close < open AND open >= pc AND close <= po", _HIGH),
    "bullish_engulfing_long": ([], "pc < po AND close > open AND open <= pc AND close >= po", _HIGH),
    "bullish_harami": ([], "pc < po AND close > open AND open > pc AND close < po", _HIGH),
    "piercing_line": ([], "pc < po AND close > open AND open < pl AND close > (po + pc) / 2 AND close < po", _HIGH),
    "spy_month_end": ([{"m": sma(200)}], f"{_THREE} AND {_MONTH} AND close > m", _HIGH),
    "tlt_thursday_dip": ([{"m": sma(5)}], f"{_THREE} AND isodow(ts) = 4 AND close < m", _HIGH),
    "rotational_momentum": ([{"mom": f"close / {lag('close', 60)} - 1", "m": sma(100)}, {"is_end": f"coalesce({_MONTH}, false)"}, {"ok": "coalesce(is_end AND close > m AND mom > 0, false)"},
                             {"k": "row_number() OVER (PARTITION BY date_trunc('month', ts), ok ORDER BY mom DESC NULLS LAST, symbol)"}], "ok AND k <= 5", "is_end"),
    "rsi_trend_reversion": ([*rsi(14), _TREND], *_back("r", 30, 55)),
    "stoch_trend_reversion": ([{"k": f"100.0 * (close - ({moving('min', 'low', 14)})) / nullif(({moving('max', 'high', 14)}) - ({moving('min', 'low', 14)}), 0)"}, {"ks": sma(3, "k")} | _TREND], *_back("ks", 20, 60)),
    "cci_trend_reversion": ([{"tm": sma(20, "tp"), "tps": f"list(tp) OVER ({_W} ROWS 19 PRECEDING)"} | _TREND, {"c": "(tp - tm) / nullif(0.015 * list_sum(list_transform(tps, lambda q: abs(q - tm))) / 20.0, 0)"}], *_back("c", -100, 0)),
    "mfi_trend_reversion": ([_FLOWS | _TREND, {"m": "CASE WHEN fp IS NULL THEN NULL WHEN fn = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + fp / fn) END"}], *_back("m", 20, 55)),
    "macd_adx_reentry": ([*macd(12, 26, 9), *adx(14), {"phist": lag("hist")} | _TREND], "hist > 0 AND phist <= 0 AND adx >= 20 AND pdi > mdi AND close > e", "(hist < 0 AND phist >= 0) OR close < e"),
    "roc_volume_momentum": ([{"q": f"close / {lag('close', 12)} - 1", "v": rvol(20)} | _TREND], "q >= 0.02 AND v >= 1.2 AND close > e", "q <= 0 OR close < e"),
    "bollinger_z_reversion": ([{"z": f"(close - ({sma(20)})) / nullif({moving('stddev_pop', 'close', 20)}, 0)"} | _TREND], *_back("z", -2, 0)),
    "squeeze_breakout": ([{"sd": moving("stddev_pop", "close", 20), "hi": moving("max", "high", 20, 1), "v": rvol(20), "e": ema(50)} | atr(20), {"tight": "CAST(2 * sd < 1.5 * atr20 AS INT)"}, {"t5": moving("max", "tight", 5)}],
                         "t5 = 1 AND close > hi AND v >= 1.2", "close < e"),
    "adx_rsi_pullback": ([*rsi(3), *adx(14), {"a": ema(20), "z": ema(50)}], "a > z AND adx >= 20 AND pdi > mdi AND r <= 30", "r >= 60 OR a < z"),
    "williams_trend_reversion": ([{"w": willr(14)} | _TREND], *_back("w", -80, -40)),
    "obv_breakout": ([{"o": f"sum(coalesce(sign(close - pc), 0) * volume) OVER ({_W} ROWS UNBOUNDED PRECEDING)", "hi": moving("max", "high", 20, 1), "v": rvol(20), "e": ema(50)}, {"oe": ema(20, "o")}], "close > hi AND o > oe AND v >= 1.0", "close < e"),
    "rolling_vwap_reclaim": ([*rsi(14), {"e": ema(100)}, *crossed(f"close - ({moving('sum', 'tp * volume', 20)}) / nullif({moving('sum', 'volume', 20)}, 0)")], f"{_UP} AND close > e AND r <= 65", f"({_DOWN}) OR close < e"),
    "donchian_adx_breakout": ([*adx(14), {"hi": moving("max", "high", 20, 1), "lo": moving("min", "low", 10, 1)}], "close > hi AND adx >= 20 AND pdi > mdi", "close < lo"),
    "multi_signal_ensemble": ([*rsi(14), *macd(12, 26, 9), *adx(14), {"v": rvol(20), "a": ema(20), "z": ema(50)},
                               {"n": "coalesce(CAST(a > z AS INT), 0) + coalesce(CAST(r > 50 AS INT), 0) + coalesce(CAST(hist > 0 AS INT), 0) + coalesce(CAST(adx >= 20 AS INT), 0) + coalesce(CAST(v >= 1.0 AS INT), 0)"}, {"pn": lag("n")}],
                              "n >= 4 AND NOT coalesce(pn >= 4, false)", "n <= 1"),
}

_WEEK = """wx AS (SELECT *, CAST(ts + CAST((12 - isodow(ts)) % 7 AS INTEGER) AS DATE) AS week FROM bars),
wg AS (SELECT symbol, week AS ts, arg_max(close, ts) AS close, max(ts) AS last FROM wx GROUP BY symbol, week),
wk AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM (SELECT *, max(ts) OVER (PARTITION BY symbol) AS w FROM wg) WHERE ts < w OR last >= ts)"""


def layered(head: str, source: str, layers: list[dict[str, str]], prefix: str = "x") -> tuple[str, str]:
    parts = [head]
    for k, layer in enumerate(layers):
        parts.append(f"{prefix}{k} AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in layer.items()) + f" FROM {source})")
        source = f"{prefix}{k}"
    return ",\n".join(parts), source


def features_sql(name: str) -> tuple[str, str, str, str]:
    """WITH clause, its last table, entry and exit of a catalogue entry."""
    head = b.with_sql("daily")
    if name == "triple_screen":
        weeks, last = layered(head + ",\n" + _WEEK, "wk", macd(12, 26, 9), "wl")
        days, source = layered(weeks, "bars", [BASE, {"bear": f"low - ({ema(13)})"}, {"pbear": lag("bear")}])
        joined = f",\nj AS (SELECT d.*, w.hist AS week_hist FROM {source} d ASOF LEFT JOIN {last} w ON d.symbol = w.symbol AND d.ts >= w.ts)"
        return days + joined, "j", "week_hist > 0 AND bear < 0 AND bear > pbear AND high > ph", "false"
    layers, entry, exit_ = SIGNALS[name]
    sql, source = layered(head, "bars", [BASE, NEXT, *layers])
    return sql, source, entry, exit_


def signal_sql(name: str) -> str:
    """Rows of bars with an entry or an exit."""
    sql, source, entry, exit_ = features_sql(name)
    return sql + f"\nSELECT * FROM (SELECT symbol, CAST(ts AS VARCHAR) AS ts, CAST(coalesce({entry}, false) AS BIGINT) AS entry, CAST(coalesce({exit_}, false) AS BIGINT) AS exit FROM {source}) WHERE entry + exit > 0"
