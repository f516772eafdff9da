"""Kernels and operators against pandas, sequential loops and hand frames."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barflow.functions import windows as w
from barflow.operators import bars as ob
from barflow.operators import joins as j
from barflow.operators import news as n
from barflow.operators import panel as p
from barflow.operators import quality as q
from barflow.operators import signals as s
from barflow.operators import trades as t
from barflow.operators import validation as v


def walk(rows=400, symbols=2, seed=7):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(symbols):
        c = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, rows)))
        o = np.concatenate([[100], c[:-1]])
        for i in range(rows):
            out.append((str(k), dt.datetime(2024, 1, 1) + dt.timedelta(days=i), float(o[i]), float(max(o[i], c[i]) * 1.01), float(min(o[i], c[i]) * 0.99), float(c[i]), float(rng.integers(1, 100))))
    return pd.DataFrame(out, columns=["symbol", "ts", "open", "high", "low", "close", "volume"])


@pytest.fixture(scope="module")
def frame():
    return walk()


@pytest.fixture(scope="module")
def bars(spark, frame):
    return spark.createDataFrame(frame)


@pytest.mark.parametrize("gain", [0.5, 1 / 3, 0.01, 1.0])
def test_linear_recurrence_is_ewm(spark, bars, frame, gain):
    got = w.linear(w.indexed(bars), "close", "y", gain).orderBy("symbol", "ts").toPandas()
    want = frame.groupby("symbol").close.transform(lambda x: x.ewm(alpha=gain, adjust=False).mean())
    np.testing.assert_allclose(got.y, want, rtol=1e-9)


@pytest.mark.parametrize("gain", [0.9995, 0.9, 0.5, 0.13, 0.04, 2 / 201, 0.001, 0.00005])
def test_long_recurrences_carry_over_superblocks(spark, gain):
    x = np.random.default_rng(4).normal(5, 1, 20_000)
    d = spark.createDataFrame(pd.DataFrame({"symbol": "a", "ts": np.arange(len(x)), "x": x}))
    got = w.linear(w.indexed(d), "x", "y", gain, 3).orderBy("ts").toPandas().y
    assert got[:2].isna().all()
    np.testing.assert_allclose(got[2:], pd.Series(x[2:]).ewm(alpha=gain, adjust=False).mean(), rtol=1e-9)


@pytest.mark.parametrize("make", [lambda d: w.rsi(d, "y", 14), lambda d: w.atr(d, "y", 14), lambda d: w.adx(d, 5, "y"), lambda d: w.macd(d).withColumn("y", F.col("macd_hist")), lambda d: w.cci(d, 20, "y"), lambda d: w.mfi(d, 14, "y"), lambda d: d.withColumn("y", w.williams_r(5))])
def test_a_prefix_gives_the_same_values(spark, frame, make):
    whole = make(w.indexed(spark.createDataFrame(frame))).select("symbol", "ts", "y").toPandas()
    cut = frame[frame.ts < dt.datetime(2024, 9, 1)]
    part = make(w.indexed(spark.createDataFrame(cut))).select("symbol", "ts", "y").toPandas()
    both = part.merge(whole, on=["symbol", "ts"])
    np.testing.assert_allclose(both.y_x, both.y_y, rtol=1e-9)


def test_non_overlap_is_the_sequential_rule(spark):
    rng = random.Random(3)
    rows, want = [], set()
    for g in range(10):
        cand = sorted({(rng.randrange(300), rng.randrange(1, 30)) for _ in range(60)})
        seen, last = {}, -1
        for sig, hold in cand:
            seen.setdefault(sig, sig + hold)
        for sig, out in sorted(seen.items()):
            rows.append((str(g), sig, out))
            if sig >= last:
                want.add((str(g), sig))
                last = out
    d = spark.createDataFrame(rows, "symbol string, signal long, exit_rn long")
    for c in ("entry_price", "exit_price", "gross_return", "score"):
        d = d.withColumn(c, F.lit(0.0))
    d = d.withColumns({"entry_time": F.lit(None).cast("date"), "exit_time": F.lit(None).cast("date"), "duration_bars": F.lit(1).cast("long"), "forced": F.lit(False)})
    assert {(r.symbol, r.signal) for r in t.non_overlapping(d, ["symbol"]).collect()} == want


def test_trades_wait_for_the_next_open_and_the_stop_counts_first(spark):
    rows = [("a", dt.datetime(2024, 1, k + 1), o, h, l, c, 1.0) for k, (o, h, l, c) in enumerate([(10.0, 11.0, 9.0, 10.0), (10.0, 12.0, 9.5, 11.0), (11.0, 14.0, 7.0, 12.0), (12.0, 13.0, 11.0, 12.0), (12.0, 13.0, 11.0, 12.0)])]
    d = w.indexed(spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double"))
    d = d.withColumns({"entry": F.col("rn") == 1, "exit": F.lit(False), "stop": F.lit(2.0), "target": F.lit(3.0)})
    got = t.from_signals(d, 3, "stop", "target").collect()
    assert [(r.entry_price, r.exit_price, r.duration_bars, r.forced) for r in got] == [(10.0, 8.0, 1, False)]


def test_asof_takes_equal_times_and_never_later_ones(spark):
    a = spark.createDataFrame([("x", 1), ("x", 5), ("x", 7), ("y", 5), (None, 5)], "k string, t long")
    b = spark.createDataFrame([("x", 5, 50.0), ("x", 6, 60.0), ("z", 1, 1.0)], "k string, t long, v double")
    got = {(r.k, r.t): r.v for r in j.asof(a, b, "k", "t", "t", ["v"]).collect()}
    assert got == {("x", 1): None, ("x", 5): 50.0, ("x", 7): 60.0, ("y", 5): None, (None, 5): None}
    old = {(r.k, r.t): r.v for r in j.asof(a, b, "k", "t", "t", ["v"], F.lit(0)).collect()}
    assert old[("x", 7)] is None and old[("x", 5)] == 50.0


def test_stories_follow_the_sequential_rule(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    items = [(k, k * rng.randrange(1, 3) * 3000, "p", " ".join(rng.sample(words, 4)), "t") for k in range(80)]
    got = {r.id: r.leader for r in n.stories(spark.createDataFrame(items, "id long, published long, provider string, title string, summary string"), 0.6).collect()}
    want, leaders = {}, []
    for i, at, _, title, _ in sorted(items, key=lambda x: (x[1], x[0])):
        tok = set(title.split())
        hit = [k for k, kat, kt in leaders if at - kat <= 36 * 3600 and len(tok & kt) >= 0.6 * len(tok | kt)]
        want[i] = hit[-1] if hit else i
        if not hit:
            leaders.append((i, at, tok))
    assert got == want


def test_a_long_row_of_stories_and_many_equal_titles(spark):
    # Each title is like its two neighbours alone, so every second one leads; far-off equal ones start anew.
    items = [(k, k * 3600, "p", f"w{k:03d} w{k + 1:03d} w{k + 2:03d} w{k + 3:03d}", "t") for k in range(500)]
    items += [(1000 + k, 10**7 + k * 60, "p", "same title here again", "t") for k in range(5000)]
    got = {r.id: r.leader for r in n.stories(spark.createDataFrame(items, "id long, published long, provider string, title string, summary string"), 0.6).collect()}
    assert all(got[k] == k - k % 2 for k in range(500))
    span = 36 * 60 + 1
    assert all(got[1000 + k] == 1000 + k // span * span for k in range(5000))


def test_a_chain_is_one_component(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(500)] + [(None, 3), (900, 900)], "a long, b long")
    got = v.components(e).collect()
    assert {r.component for r in got} == {0} and len(got) == 501


def test_lanes_are_first_fit_without_a_bound(spark):
    rng = random.Random(2)
    rows = [("k", s := rng.randrange(200), s + rng.randrange(0, 90), i) for i in range(300)]
    d = spark.createDataFrame(rows, "h string, entry_time long, exit_time long, trade_id long")
    ends, want = [], {}
    for _, a, z, i in sorted(rows, key=lambda r: (r[1], r[2], r[3])):
        lane = next((k for k, e in enumerate(ends) if e < a), len(ends))
        ends[lane:lane + 1] = [z]
        want[i] = lane + 1
    assert {r.trade_id: r.lane for r in t.lanes(d, ["h"]).collect()} == want and max(want.values()) > 16


def test_components_and_matching(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (9, 3)], "a long, b long")
    assert {(r.node, r.component) for r in v.components(e).collect()} == {(1, 1), (2, 1), (3, 1), (9, 1), (7, 7), (8, 7)}
    c = spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.8), ("b", "x", 0.85), ("b", "y", 0.7)], "l string, r string, s double")
    assert {(r.l, r.r) for r in j.mutual_best(c, "l", "r", "s").collect()} == {("a", "x"), ("b", "y")}


def test_average_rank_is_that_of_pandas(spark):
    x = pd.DataFrame({"ts": [1] * 6 + [2] * 4, "v": [3.0, 1.0, 3.0, 2.0, None, 3.0, 5.0, 5.0, 4.0, 6.0]})
    got = p.rank_pct(spark.createDataFrame(x), "v", "ts", "r").toPandas().dropna().sort_values(["ts", "v"]).r.tolist()
    want = x.dropna().assign(r=x.groupby("ts").v.rank(pct=True)).sort_values(["ts", "v"]).r.tolist()
    np.testing.assert_allclose(got, want)


def test_quality_and_split_adjustment(spark):
    b = spark.createDataFrame([("a", dt.date(2024, 1, 1), 10.0, 11.0, 9.0, 10.0, 5.0), ("a", dt.date(2024, 1, 2), 10.0, 9.0, 9.5, 10.0, -1.0), ("a", dt.date(2024, 1, 3), None, 6.0, 4.0, 5.0, 0.0)], "symbol string, ts date, open double, high double, low double, close double, volume double")
    r = q.quality_report(b).first()
    assert (r.rows, r.missing, r.negative_volume, r.high_violations, r.zero_volume) == (3, 1, 1, 1, 1)
    s_ = spark.createDataFrame([("a", dt.date(2024, 1, 3), 2.0)], "symbol string, effective_at date, factor double")
    got = {str(x.ts): x.close for x in ob.split_adjust(b, s_).collect()}
    assert got == {"2024-01-01": 5.0, "2024-01-02": 5.0, "2024-01-03": 5.0}


def test_registered_strategy_is_used(spark, bars):
    s.register_strategy("own", lambda f, n: f.done(F.col("rn") == n, F.lit(False)), n=3)
    assert s.signals(bars, "own").filter("entry").count() == 2
    del s.STRATEGIES["own"]


def test_empty_tables(spark, bars):
    none = bars.limit(0)
    assert w.macd(w.indexed(none)).count() == 0 and q.quality_report(none).count() == 0 and ob.weekly(none).count() == 0
    assert t.from_signals(s.signals(none, "n_bar_breakout"), 5).count() == 0


def test_novelty_is_the_largest_cosine_before(spark):
    rng = random.Random(8)
    rows = [(k % 2, k, " ".join(rng.choice("abcdefghij") * 2 for _ in range(rng.randrange(0, 9)))) for k in range(120)]
    got = {r.k: r.novelty for r in n.novelty(spark.createDataFrame(rows, "g int, k long, text string"), "g", "k", 7).collect()}
    for g in (0, 1):
        seen = []
        for _, k, text in (r for r in rows if r[0] == g):
            c = {x: text.split().count(x) for x in set(text.split())}
            size = lambda v: sum(x * x for x in v.values()) ** 0.5
            best = max([sum(x * o.get(y, 0) for y, x in c.items()) / (size(c) * size(o)) for o in seen[-7:] if c and o] or [0.0])
            assert abs(got[k] - max(0.1, 1 - best)) < 1e-9
            seen.append(c)


def test_bootstrap_quantiles_surround_the_mean(spark):
    x = np.random.default_rng(3).normal(0.001, 0.01, 300)
    d = spark.createDataFrame(pd.DataFrame({"key": "a", "i": np.arange(300), "r": x}))
    r = v.block_bootstrap(d, "key", "i", "r", runs=200, block=10).first()
    total = float(np.prod(1 + x) - 1)
    assert r.p05 < r.median < r.p95 and abs(r.median - total) < 0.1
    # With one block as long as the series every run holds each return once.
    r = v.block_bootstrap(d, "key", "i", "r", runs=5, block=300).first()
    np.testing.assert_allclose([r.p05, r.median, r.p95], total)


def test_folds_hold_trades_that_lie_within(spark):
    day = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(days=k)
    trades_ = [(k, day(a), day(a + n)) for k, (a, n) in enumerate((a, n) for a in range(0, 200, 7) for n in (0, 3, 40))]
    folds_ = [(0, "train", day(0), day(100)), (0, "test", day(101), day(150)), (1, "train", day(31), day(31)), (2, "none", day(9), day(3))]
    got = p.contained(spark.createDataFrame(trades_, "k int, entry_time timestamp, exit_time timestamp"), spark.createDataFrame(folds_, "fold int, segment string, start timestamp, end timestamp"))
    assert {(r.k, r.fold, r.segment) for r in got.collect()} == {(k, f, s_) for k, a, z in trades_ for f, s_, x, y in folds_ if a >= x and z <= y}
