"""Signal catalogues (K08: 2.11, K09: 2.12) as boolean columns entry and exit over indexed bars.

``STRATEGIES`` and ``TEMPLATES`` map a name to its function and default parameters; own ones are
added by ``register_strategy`` (Y01, Y02). Features that one call asks for twice are computed once
(Y03).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import windows as w


@dataclass
class Features:
    """Features as columns of one frame; a request that was made before costs nothing."""

    df: DataFrame
    known: dict = field(default_factory=dict)

    def get(self, kind: str, *args) -> Column:
        key = (kind, *args)
        if key not in self.known:
            name = "_".join(map(str, ["f", kind, *args])).replace(".", "p").replace("-", "m")
            self.known[key] = name
            make = {"ema": lambda: w.ema(self.df, "close", name, args[0], 1, args[0]), "rsi": lambda: w.rsi(self.df, name, args[0]), "atr": lambda: w.atr(self.df, name, args[0])}
            if kind in make:
                self.df = make[kind]()
            elif kind in ("adx", "plus_di", "minus_di"):
                d = w.adx(self.df, args[0], "_adx")
                for k, c in (("adx", "_adx"), ("plus_di", "plus_di"), ("minus_di", "minus_di")):
                    n = f"f_{k}_{args[0]}"
                    self.known[(k, args[0])] = n
                    d = d.withColumnRenamed(c, n)
                self.df = d
            elif kind in ("macd", "macd_hist"):
                d = w.macd(self.df, *args)
                for k in ("macd", "macd_hist"):
                    n = "_".join(map(str, ["f", k, *args]))
                    self.known[(k, *args)] = n
                    d = d.withColumnRenamed(k, n)
                self.df = d.drop("macd_signal")
            elif kind == "ema_of":
                self.df = w.ema(self.df, args[0], name, args[1], args[2], args[1])
            else:
                plain = {"sma": lambda: w.sma(*args), "min": lambda: w.rolling_min(*args), "max": lambda: w.rolling_max(*args), "sd": lambda: w.rolling_std(*args), "willr": lambda: w.williams_r(*args),
                         "rvol": lambda: w.relative_volume(*args), "lag": lambda: w.lag(*args), "sum": lambda: w.rolling_sum(*args), "roc": lambda: w.pct_change("close", *args)}
                frames = {"stoch": w.stochastic, "cci": w.cci, "mfi": w.mfi, "vwap": w.rolling_vwap, "obv": w.obv}
                self.df = frames[kind](self.df, *args, name) if kind in frames else self.df.withColumn(name, plain[kind]())
        return F.col(self.known[key])

    def name(self, kind: str, *args) -> str:
        self.get(kind, *args)
        return self.known[(kind, *args)]

    def flag(self, name: str, c: Column) -> str:
        """Keep a condition as a column, so that windows can look at it."""
        self.df = self.df.withColumn(name, F.coalesce(c, F.lit(False)))
        return name

    def crossed(self, a: str | Column, b: str | Column, above: bool = True) -> Column:
        """W42 between two columns; their difference is kept to look one row back."""
        name = f"f_x{len(self.df.columns)}"
        self.df = self.df.withColumn(name, w.col(a) - w.col(b))
        x, before = F.col(name), w.lag(name)
        return (x > 0) & (before <= 0) if above else (x < 0) & (before >= 0)

    def done(self, entry: Column, exit_: Column, **more: Column) -> DataFrame:
        no = F.lit(False)
        return self.df.withColumns({"entry": F.coalesce(entry, no), "exit": F.coalesce(exit_, no)} | more)


STRATEGIES: dict[str, tuple[Callable, dict]] = {}
TEMPLATES: dict[str, tuple[Callable, dict]] = {}


def register_strategy(name: str, fn: Callable, **defaults) -> None:
    """``fn(features, **params)`` returns the frame with columns entry and exit."""
    STRATEGIES[name] = (fn, defaults)


def _strategy(name: str, **defaults):
    return lambda fn: (register_strategy(name, fn, **defaults), fn)[1]


def _template(name: str, **defaults):
    def add(fn):
        TEMPLATES[name] = (fn, defaults)
        return fn

    return add


def signals(bars: DataFrame, name: str, **params) -> DataFrame:
    """Indexed bars with entry and exit of a strategy or template, defaults replaced by ``params``."""
    fn, defaults = STRATEGIES.get(name) or TEMPLATES[name]
    d = bars if "rn" in bars.columns else w.indexed(bars)
    return fn(Features(d), **(defaults | params))


def close() -> Column:
    return F.col("close")


def high() -> Column:
    return F.col("high")


def low() -> Column:
    return F.col("low")


@_strategy("rsi_oversold", n=2, entry=15, exit_mode="previous_high", exit_rsi=75)
def rsi_oversold(f, n, entry, exit_mode, exit_rsi):
    r = f.name("rsi", n)
    return f.done(F.col(r) < entry, w.fast_exit(exit_mode, r, exit_rsi), score=-F.col(r))


@_strategy("rsi_adx", n=2, entry=15, adx_n=5, adx_min=35, direction="none", exit_mode="previous_high")
def rsi_adx(f, n, entry, adx_n, adx_min, direction, exit_mode):
    e = (f.get("rsi", n) < entry) & (f.get("adx", adx_n) > adx_min)
    if direction == "plus_di":
        e = e & (f.get("plus_di", adx_n) > f.get("minus_di", adx_n))
    elif direction == "sma200":
        e = e & (close() > f.get("sma", "close", 200))
    return f.done(e, w.fast_exit(exit_mode))


@_strategy("rsi_first_profitable_close", n=2, entry=20)
def rsi_first_profitable(f, n, entry):
    return f.done(f.get("rsi", n) < entry, F.lit(False))


@_strategy("rsi_threshold_exit", n=2, entry=15, exit_at=75)
def rsi_threshold_exit(f, n, entry, exit_at):
    r = f.get("rsi", n)
    return f.done(r < entry, r > exit_at)


@_strategy("rsi_ema_hist_flip", n=3, ema_n=5)
def rsi_hist_flip(f, n, ema_n):
    r = f.name("rsi", n)
    e = f.get("ema_of", r, ema_n, n + 1)
    up, down = f.crossed(r, e), f.crossed(r, e, False)
    return f.done(up, down)


@_strategy("cumulative_rsi", n=2, days=2, threshold=20, exit_mode="previous_high")
def cumulative_rsi(f, n, days, threshold, exit_mode):
    return f.done(f.get("sum", f.name("rsi", n), days) < threshold, w.fast_exit(exit_mode))


@_strategy("consecutive_lower_lows", days=3)
def lower_lows(f, days):
    return f.done(w.consecutive_lower("low", days), w.fast_exit())


@_strategy("consecutive_lower_closes", days=3)
def lower_closes(f, days):
    return f.done(w.consecutive_lower("close", days), w.fast_exit())


def _return_atr(f, down, fast, slow, regime):
    a, b = f.get("atr", fast), f.get("atr", slow)
    return f.done((w.pct_change("close") <= -down) & ((a < b) if regime == "compression" else (a > b)), w.fast_exit())


register_strategy("return_atr_compression", _return_atr, down=0.01, fast=5, slow=10, regime="compression")
register_strategy("return_atr_expansion", _return_atr, down=0.01, fast=5, slow=10, regime="expansion")


def _ema_stretch(f, n, mode, threshold, atr_n, exit_mode):
    e = f.get("ema", n)
    base = e if mode == "percent" else f.get("atr", atr_n)
    return f.done((e - close()) / F.when(F.abs(base) > 1e-12, base) > threshold, close() > e if exit_mode == "ema" else w.fast_exit(exit_mode))


register_strategy("ema_stretch_percent", _ema_stretch, n=5, mode="percent", threshold=0.01, atr_n=5, exit_mode="previous_high")
register_strategy("ema_stretch_atr", _ema_stretch, n=5, mode="atr", threshold=0.5, atr_n=5, exit_mode="previous_high")


@_strategy("ema_decline", n=5, threshold=0.005, exit_mode="previous_high")
def ema_decline(f, n, threshold, exit_mode):
    e = f.name("ema", n)
    return f.done(w.pct_change(e) <= -threshold, close() > F.col(e) if exit_mode == "ema" else w.fast_exit(exit_mode))


@_strategy("close_below_n_day_low", n=5, exit_mode="previous_high")
def close_below_low(f, n, exit_mode):
    return f.done(close() < f.get("min", "low", n, 1), w.fast_exit(exit_mode))


@_strategy("five_bar_contrarian", n=5, m=5)
def five_bar_contrarian(f, n, m):
    return f.done(low() < f.get("min", "low", n, 1), high() > f.get("max", "high", m, 1))


@_strategy("seven_day_pullback", n=7, m=7, trend=200, atr_n=20, stop_atr=2.0)
def seven_day_pullback(f, n, m, trend, atr_n, stop_atr):
    return f.done((close() < f.get("min", "low", n, 1)) & (close() > f.get("sma", "close", trend)), close() > f.get("max", "high", m, 1), stop=stop_atr * f.get("atr", atr_n))


@_strategy("williams_r", n=5, entry=-90, exit_at=-20, trend=200, atr_n=20, stop_atr=2.0)
def williams(f, n, entry, exit_at, trend, atr_n, stop_atr):
    r = f.get("willr", n)
    e = (r < entry) & (close() > f.get("sma", "close", trend)) if trend else r < entry
    return f.done(e, r > exit_at, stop=stop_atr * f.get("atr", atr_n))


@_strategy("williams_macd", n=5, entry=-90, fast=12, slow=26, signal=9, look=5)
def williams_macd(f, n, entry, fast, slow, signal, look):
    h = f.name("macd_hist", fast, slow, signal)
    return f.done((f.get("willr", n) < entry) & (F.col(h) <= f.get("min", h, look)), F.col(h) > w.lag(h))


@_strategy("n_bar_breakout", n=5, m=5)
def breakout(f, n, m):
    return f.done(high() > f.get("max", "high", n, 1), low() < f.get("min", "low", m, 1))


@_strategy("ma_crossover", fast=50, slow=200)
def ma_crossover(f, fast, slow):
    a, z = f.get("sma", "close", fast), f.get("sma", "close", slow)
    up, down = f.crossed(a, z), f.crossed(a, z, False)
    return f.done(up, down)


@_strategy("asymmetric_ma_crossover", entry_fast=70, entry_slow=210, exit_fast=110, exit_slow=230)
def asymmetric(f, entry_fast, entry_slow, exit_fast, exit_slow):
    up = f.crossed(f.get("sma", "close", entry_fast), f.get("sma", "close", entry_slow))
    down = f.crossed(f.get("sma", "close", exit_fast), f.get("sma", "close", exit_slow), False)
    return f.done(up, down)


@_strategy("ma_channel", n=10, confirm=5)
def ma_channel(f, n, confirm):
    up, down = low() > f.get("sma", "high", n), high() < f.get("sma", "low", n)
    f.df = f.df.withColumn("f_up", up.cast("int")).withColumn("f_down", down.cast("int"))
    return f.done(w.rolling_min("f_up", confirm) == 1, w.rolling_min("f_down", confirm) == 1)


@_strategy("bollinger_breakout", n=100, entry=3.0, exit_at=1.0, atr_n=20, stop_atr=3.0)
def bollinger_breakout(f, n, entry, exit_at, atr_n, stop_atr):
    m, s = f.get("sma", "close", n), f.get("sd", "close", n)
    return f.done(close() > m + entry * s, close() < m - exit_at * s, stop=stop_atr * f.get("atr", atr_n))


@_strategy("percent_flipper", n=50, x=0.20)
def flipper(f, n, x):
    up = f.flag("f_up", close() >= f.get("min", "low", n, 1) * (1 + x))
    down = f.flag("f_down", close() <= f.get("max", "high", n, 1) * (1 - x))
    edge = lambda c: F.col(c) & ~F.coalesce(w.lag(c), F.lit(False))
    return f.done(edge(up), edge(down))


@_strategy("triple_screen", fast=12, slow=26, signal=9, ema_n=13)
def triple_screen(f, fast, slow, signal, ema_n):
    """The weekly histogram is known from its Friday on, carried by an as-of join."""
    from ..operators.bars import weekly
    from ..operators.joins import asof

    wk = w.macd(w.indexed(weekly(f.df.select("symbol", "ts", "open", "high", "low", "close", "volume")).withColumnRenamed("week", "ts")), fast, slow, signal)
    f.df = asof(f.df, wk.select("symbol", "ts", F.col("macd_hist").alias("f_week")), "symbol", "ts", "ts", ["f_week"]).drop("source_time")
    bear = low() - f.get("ema", ema_n)
    f.df = f.df.withColumn("f_bear", bear)
    return f.done((F.col("f_week") > 0) & (F.col("f_bear") < 0) & (F.col("f_bear") > w.lag("f_bear")) & (high() > w.lag("high")), F.lit(False))


@_strategy("market_structure_atr_pullback", n=63, atr_n=20)
def structure(f, n, atr_n):
    return f.done(close() > f.get("max", "high", n, 1), w.fast_exit(), atr=f.get("atr", atr_n))


def _candle(f, pattern, atr_n, stop_atr, target_atr):
    f.df = w.candle_patterns(f.df)
    a = f.get("atr", atr_n)
    d = {k: v * a for k, v in (("stop", stop_atr), ("target", target_atr)) if v}
    return f.done(F.col(pattern), w.fast_exit(), **d)


register_strategy("bearish_engulfing_contrarian_long", _candle, pattern="bear_engulf", atr_n=20, stop_atr=0.0, target_atr=0.0)
register_strategy("bullish_engulfing_long", _candle, pattern="bull_engulf", atr_n=20, stop_atr=0.0, target_atr=0.0)
register_strategy("bullish_harami", _candle, pattern="harami", atr_n=20, stop_atr=2.0, target_atr=2.0)
register_strategy("piercing_line", _candle, pattern="piercing", atr_n=20, stop_atr=2.0, target_atr=2.0)


@_strategy("spy_month_end", symbols=("SPY",), trend=200)
def month_end(f, symbols, trend):
    last = F.trunc("ts", "MM") != F.trunc(w.lead("ts"), "MM")
    return f.done(F.col("symbol").isin(*symbols) & last & (close() > f.get("sma", "close", trend)), w.fast_exit())


@_strategy("tlt_thursday_dip", symbols=("TLT",), weekday=3, n=5)
def weekday_dip(f, symbols, weekday, n):
    return f.done(F.col("symbol").isin(*symbols) & (F.weekday("ts") == weekday) & (close() < f.get("sma", "close", n)), w.fast_exit())


@_strategy("rotational_momentum", momentum=60, trend=100, n=5)
def rotational(f, momentum, trend, n):
    """Entry at month ends of the n largest positive momenta over their trend; exit at every month end."""
    from pyspark.sql import Window

    end = f.flag("f_end", F.trunc("ts", "MM") != F.trunc(w.lead("ts"), "MM"))
    mom = f.name("roc", momentum)
    ok = f.flag("f_ok", F.col(end) & (close() > f.get("sma", "close", trend)) & (F.col(mom) > 0))
    rank = F.row_number().over(Window.partitionBy(F.trunc("ts", "MM"), F.col(ok)).orderBy(F.col(mom).desc_nulls_last(), "symbol"))
    return f.done(F.col(ok) & (rank <= n), F.col(end))


def _trend(f, n):
    return f.get("ema", n)


def _reversion(f, x, entry, exit_at, trend):
    e = _trend(f, trend)
    return f.done((x <= entry) & (close() > e), (x >= exit_at) | (close() < e))


@_template("rsi_trend_reversion", n=14, entry=30, exit_at=55, trend=100)
def t_rsi(f, n, entry, exit_at, trend):
    return _reversion(f, f.get("rsi", n), entry, exit_at, trend)


@_template("stoch_trend_reversion", n=14, smooth=3, entry=20, exit_at=60, trend=100)
def t_stoch(f, n, smooth, entry, exit_at, trend):
    return _reversion(f, f.get("stoch", n, smooth), entry, exit_at, trend)


@_template("cci_trend_reversion", n=20, entry=-100, exit_at=0, trend=100)
def t_cci(f, n, entry, exit_at, trend):
    return _reversion(f, f.get("cci", n), entry, exit_at, trend)


@_template("mfi_trend_reversion", n=14, entry=20, exit_at=55, trend=100)
def t_mfi(f, n, entry, exit_at, trend):
    return _reversion(f, f.get("mfi", n), entry, exit_at, trend)


@_template("macd_adx_reentry", fast=12, slow=26, signal=9, adx_n=14, adx_min=20, trend=100)
def t_macd(f, fast, slow, signal, adx_n, adx_min, trend):
    h, e = f.name("macd_hist", fast, slow, signal), _trend(f, trend)
    up, down = f.crossed(h, F.lit(0.0)), f.crossed(h, F.lit(0.0), False)
    return f.done(up & (f.get("adx", adx_n) >= adx_min) & (f.get("plus_di", adx_n) > f.get("minus_di", adx_n)) & (close() > e), down | (close() < e))


@_template("roc_volume_momentum", n=12, x=0.02, vol_n=20, vol_min=1.2, trend=100)
def t_roc(f, n, x, vol_n, vol_min, trend):
    e, r = _trend(f, trend), f.get("roc", n)
    return f.done((r >= x) & (f.get("rvol", vol_n) >= vol_min) & (close() > e), (r <= 0) | (close() < e))


@_template("bollinger_z_reversion", n=20, entry=-2.0, exit_at=0.0, trend=100)
def t_z(f, n, entry, exit_at, trend):
    return _reversion(f, (close() - f.get("sma", "close", n)) / F.nullif(f.get("sd", "close", n), F.lit(0.0)), entry, exit_at, trend)


@_template("squeeze_breakout", n=20, k=2.0, atr_k=1.5, look=20, vol_min=1.2, trend=50)
def t_squeeze(f, n, k, atr_k, look, vol_min, trend):
    e = _trend(f, trend)
    tight = k * f.get("sd", "close", n) < atr_k * f.get("atr", n)
    f.df = f.df.withColumn("f_tight", tight.cast("int"))
    return f.done((w.rolling_max("f_tight", 5) == 1) & (close() > f.get("max", "high", look, 1)) & (f.get("rvol", n) >= vol_min), close() < e)


@_template("adx_rsi_pullback", fast=20, slow=50, adx_n=14, adx_min=20, n=3, entry=30, exit_at=60)
def t_pullback(f, fast, slow, adx_n, adx_min, n, entry, exit_at):
    a, z, r = f.get("ema", fast), f.get("ema", slow), f.get("rsi", n)
    return f.done((a > z) & (f.get("adx", adx_n) >= adx_min) & (f.get("plus_di", adx_n) > f.get("minus_di", adx_n)) & (r <= entry), (r >= exit_at) | (a < z))


@_template("williams_trend_reversion", n=14, entry=-80, exit_at=-40, trend=100)
def t_williams(f, n, entry, exit_at, trend):
    return _reversion(f, f.get("willr", n), entry, exit_at, trend)


@_template("obv_breakout", look=20, n=20, vol_min=1.0, trend=50)
def t_obv(f, look, n, vol_min, trend):
    e, v = _trend(f, trend), f.name("obv")
    return f.done((close() > f.get("max", "high", look, 1)) & (F.col(v) > f.get("ema_of", v, n, 1)) & (f.get("rvol", n) >= vol_min), close() < e)


@_template("rolling_vwap_reclaim", n=20, rsi_n=14, rsi_max=65, trend=100)
def t_vwap(f, n, rsi_n, rsi_max, trend):
    e, v = _trend(f, trend), f.get("vwap", n)
    up, down = f.crossed("close", v), f.crossed("close", v, False)
    return f.done(up & (close() > e) & (f.get("rsi", rsi_n) <= rsi_max), down | (close() < e))


@_template("donchian_adx_breakout", n=20, m=10, adx_n=14, adx_min=20)
def t_donchian(f, n, m, adx_n, adx_min):
    return f.done((close() > f.get("max", "high", n, 1)) & (f.get("adx", adx_n) >= adx_min) & (f.get("plus_di", adx_n) > f.get("minus_di", adx_n)), close() < f.get("min", "low", m, 1))


@_template("multi_signal_ensemble", fast=20, slow=50, rsi_n=14, adx_n=14, k=4, m=1)
def t_ensemble(f, fast, slow, rsi_n, adx_n, k, m):
    tests = [f.get("ema", fast) > f.get("ema", slow), f.get("rsi", rsi_n) > 50, f.get("macd_hist", 12, 26, 9) > 0, f.get("adx", adx_n) >= 20, f.get("rvol", 20) >= 1.0]
    f.df = f.df.withColumn("f_votes", sum(F.coalesce(t.cast("int"), F.lit(0)) for t in tests))
    return f.done(F.coalesce(F.col("f_votes") >= k, F.lit(False)) & ~F.coalesce(w.lag("f_votes") >= k, F.lit(False)), F.col("f_votes") <= m)
