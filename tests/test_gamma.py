"""Trades by gamma regime against the rule bar by bar, and runs of overlapping candidates against a plain pass."""

import datetime as dt
import random

from pyspark.sql import functions as F

from barflow.functions import long_series
from barflow.functions import windows as w
from barflow.operators import gamma, trades

T0 = dt.datetime(2024, 1, 1)


def bar_rows(symbol, n, seed):
    r, price, out = random.Random(seed), 100.0, []
    for k in range(n):
        o = price + r.uniform(-1, 1)
        c = o + r.uniform(-3, 3)
        hi, lo = max(o, c) + r.uniform(0, 2), min(o, c) - r.uniform(0, 2)
        regime = r.choice([None] * 5 + [gamma.REVERSION, gamma.BREAKOUT])
        known = lambda x: x if r.random() > 0.15 else None
        out.append((symbol, T0 + dt.timedelta(hours=k), o, hi, lo, c, r.uniform(1, 4), known(c + r.uniform(-4, 4)), known(c + r.uniform(-4, 4)), known(r.uniform(0, 100)), known(c + r.uniform(-3, 8)), regime))
        price = c
    return out


def by_loop(rows):
    """One position at a time; stop, wall, recovery, time, in this order."""
    out, held, waiting = [], None, None
    for i, (symbol, ts, o, hi, lo, c, atr, xe, e8, rsi, wall, regime) in enumerate(rows):
        if held is None and waiting is not None:
            entry = o * 1.0005
            stop = entry - 1.5 * waiting[1]
            if waiting[0] == gamma.BREAKOUT and waiting[2] is not None and waiting[2] - 0.25 * waiting[1] < entry:
                stop = max(stop, waiting[2] - 0.25 * waiting[1])
            held, waiting = {"r": waiting[0], "e": entry, "stop": stop, "at": i, "hi": hi, "wall": waiting[2], "ts": ts}, None
        if held is not None:
            held["hi"] = max(held["hi"], hi)
            if held["r"] == gamma.BREAKOUT:
                held["stop"] = max(held["stop"], held["hi"] - 2.0 * atr)
            n, left = i - held["at"], None
            if o <= held["stop"]:
                left = ("stop_gap", o)
            elif lo <= held["stop"]:
                left = ("stop_loss", held["stop"])
            elif held["r"] == gamma.REVERSION:
                if held["wall"] is not None and held["wall"] > held["e"] and hi >= held["wall"]:
                    left = ("call_wall_target", held["wall"])
                elif n >= 1 and xe is not None and c >= xe:
                    left = ("ema_recovery", c)
                elif n >= 1 and rsi is not None and rsi >= 60:
                    left = ("rsi_recovery", c)
                elif n >= 12:
                    left = ("time_exit", c)
            elif n >= 1 and e8 is not None and c < e8:
                left = ("ema8_trailing_exit", c)
            elif n >= 40:
                left = ("time_exit", c)
            if left is None and i == len(rows) - 1:
                left = ("end_of_data", c)
            if left:
                out.append((symbol, held["ts"], ts, held["r"], left[0], round(held["e"], 6), round(left[1] * 0.9995, 6), n))
                held = None
        if held is None and waiting is None and regime is not None and i < len(rows) - 1:
            waiting = (regime, atr, wall)
    return out


def test_regime_trades_bar_by_bar(spark):
    data = [bar_rows(f"s{k}", n, k) for k, n in enumerate([1, 2, 60, 200, 350])]
    d = spark.createDataFrame([r for rows in data for r in rows], "symbol string, ts timestamp, open double, high double, low double, close double, atr double, exit_ema double, ema8 double, rsi double, call_wall double, regime string")
    got = gamma.regime_trades(w.indexed(d)).collect()
    got = sorted((r.symbol, r.entry_time, r.exit_time, r.regime, r.exit_reason, round(r.entry_price, 6), round(r.exit_price, 6), r.bars_held) for r in got)
    want = sorted(t for rows in data for t in by_loop(rows))
    assert got == want and {t[4] for t in want} >= {"stop_gap", "stop_loss", "call_wall_target", "ema_recovery", "ema8_trailing_exit"}
    assert gamma.regime_trades(w.indexed(d.limit(0))).count() == 0


def test_regimes_need_features_and_flow(spark):
    d = spark.createDataFrame([("a", T0, 10.0, 10.0, 12.0, 5.0, 30.0, 9.0, 12.0, 13.0, 1.0, 5.0, None, 9.5, 4, 1.0, False, False), ("a", T0 + dt.timedelta(hours=1), 10.0, 14.0, 12.0, 95.0, 31.0, 9.0, 12.0, 13.0, 1.0, -5.0, 13.0, None, 3, 1.0, False, False),
                               ("a", T0 + dt.timedelta(hours=2), 10.0, 14.0, 12.0, 95.0, 32.0, 9.0, 12.0, 13.0, None, -5.0, 13.0, None, 3, 1.0, False, False), ("a", T0 + dt.timedelta(hours=3), 10.0, 8.0, 7.0, 5.0, 32.0, 9.0, 12.0, 13.0, 1.0, 5.0, None, 20.0, 0, 1.0, True, True)],
                              "symbol string, ts timestamp, open double, close double, vwap double, rsi double, adx double, trend_sma double, bb_low double, bb_high double, atr double, net_gex double, call_wall double, put_wall double, max_stacked_buy int, delta double, delta_flip_up boolean, buy_absorption boolean")
    got = [r.regime for r in gamma.regimes(w.indexed(d)).orderBy("ts").collect()]
    assert got == [gamma.REVERSION, gamma.BREAKOUT, None, None]


def test_runs_of_candidates_as_one_pass(spark):
    r = random.Random(4)
    data = [(k % 5, s, s + r.randint(1, 12), r.random()) for k in range(600) for s in [r.randint(0, 900)]]
    data += [(9, s, s + 5, 0.5) for s in range(400)]  # one run: all overlap
    want = []
    for key in sorted({d[0] for d in data}):
        last = -1
        for d in sorted(d for d in data if d[0] == key):
            if d[1] >= last:
                want.append(d)
                last = d[2]
    got = trades.non_overlapping(spark.createDataFrame(data, "k int, signal long, exit_rn long, v double"), ["k"])
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)


def test_many_means_are_each_alone(spark):
    r = random.Random(1)
    d = w.indexed(spark.createDataFrame([("a", k, r.uniform(-1, 1)) for k in range(5000)], "symbol string, ts long, x double"))
    gains = [0.9999, 0.4, 0.2, 1 / 14, 2 / 201, 1 / 3000]
    both = w.linears(d, [("x", f"y{i}", g, 1 + 3 * i) for i, g in enumerate(gains)]).orderBy("rn").collect()
    for i, g in enumerate(gains):
        y = None
        for row in both:
            if row.rn >= 1 + 3 * i:
                y = row.x if y is None else (1 - g) * y + g * row.x
                assert abs(row[f"y{i}"] - y) < 1e-9
            else:
                assert row[f"y{i}"] is None


def test_one_long_series_is_scanned_by_blocks(spark):
    r = random.Random(9)
    rows = [(k, T0 + dt.timedelta(minutes=m), m, r.uniform(1, 2), r.uniform(2, 3), r.uniform(0, 1)) for k, n in (("a", 1300), ("b", 64), (None, 65), ("c", 1)) for m in range(n)]
    d = spark.createDataFrame(rows, "k string, ts timestamp, m int, close double, high double, low double").repartition(5)
    recipes = [w.ema_recipe("close", "e", 3000), w.ema_recipe("close", "f", 1, 7), w.ema_recipe("close", "late", 10, 200), w.rsi_recipe("rsi", 5), w.adx_recipe(4), w.atr_recipe("atr", 14)]
    names = ["e", "f", "late", "rsi", "adx", "plus_di", "atr"]
    whole = w.together(w.indexed(d.withColumn("symbol", F.coalesce("k", F.lit("-")))), *recipes)
    want = {(x.k, x.m): [x[c] for c in names] for x in whole.collect()}
    got = {(x.k, x.m): [x[c] for c in names] for x in long_series.together(d, "k", ["ts"], *recipes, rows=64).collect()}
    assert got.keys() == want.keys()
    for key, values in want.items():
        assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-8) for a, b in zip(values, got[key])), key
    assert long_series.together(d.limit(0), "k", ["ts"], *recipes, rows=64).count() == 0


def test_first_touch_of_a_falling_series(spark):
    r = random.Random(5)
    bars = [("s", k + 1, T0 + dt.timedelta(hours=k), 100.0 + r.gauss(0, 3) - k * 0.01, 99.0 + r.gauss(0, 3) - k * 0.01, 900) for k in range(900)]
    fills = [("s", k, k + 1, 100.0 - k * 0.01, r.choice([0.5, 3.0, 8.0, 12.0]), 900, r.choice([None, min(899, k + 1 + r.randint(0, 600))])) for k in range(1, 880, 3)]
    p = spark.createDataFrame(bars, "symbol string, rn long, ts timestamp, open double, low double, _n long")
    f = spark.createDataFrame(fills, "symbol string, signal long, fill long, entry_price double, _sd double, _n long, _x long")
    want = {}
    for _, signal, fill, price, sd, n, x in fills:
        end = min(x if x is not None else n - 1, n - 1)
        hit = next((b for b in bars if fill <= b[1] <= end and b[4] <= price - sd), None)
        if hit:
            want[signal] = (hit[1], min(hit[3], price - sd))
    assert {x.signal: (x._h.rn, x._h.price) for x in trades.first_touch(f, p, 32).collect()} == want and len(want) > 50


def test_absorbing_buyers(spark):
    ticks = [("a", 1, T0, 10.0, 1.0, 1.0), ("a", 2, T0 + dt.timedelta(minutes=1), 5.0, 4.0, -1.0), ("a", 3, T0 + dt.timedelta(minutes=2), 9.0, 3.0, 1.0), ("a", 4, T0 + dt.timedelta(hours=1), 9.0, 1.0, 1.0), ("a", 5, T0 + dt.timedelta(hours=1, minutes=1), 8.0, 2.0, -1.0)]
    d = spark.createDataFrame(ticks, "symbol string, event_id long, ts timestamp, price double, size double, aggressor double")
    got = [(r.delta, r.delta_flip_up, r.buy_absorption) for r in gamma.flow_features(d, 3600, 1.0).orderBy("ts").collect()]
    assert got == [(0.0, False, True), (-1.0, False, False)]
    assert gamma.flow_features(d.withColumn("size", F.col("size") * 1.0).limit(0), 3600, 1.0).count() == 0


def test_means_leave_a_caller_s_columns(spark):
    d = w.indexed(spark.createDataFrame([("a", k, float(k)) for k in range(9)], "symbol string, ts long, x double"))
    d = d.withColumns({c: F.col("x") for c in ("_ret", "_rsi", "_rl", "_rc_x")})
    assert set(w.linears(d, [("x", "y", 0.5, 1), ("_ret", "z", 0.01, 1)]).columns) == {*d.columns, "y", "z"}
