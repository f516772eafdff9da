"""Pullback trades on hourly bars and their resolution on 15-minute bars, against sequential rules."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barflow.functions import windows as w
from barflow.operators import paths, trades

K, STOP, VALID, BACK = 0.3, 1.0, 6, 3


def market(seed, drop=()):
    """15-minute bars of 60 sessions of 6.5 hours from 14:30, and their hours (the last one short)."""
    rng = np.random.default_rng(seed)
    price, fine, hours = 100.0, [], []
    for d in range(60):
        start = dt.datetime(2024, 1, 1, 14, 30) + dt.timedelta(days=d)
        day = []
        for k in range(26):
            o = price * float(np.exp(rng.normal(0, 0.001)))
            price = o * float(np.exp(rng.normal(0, 0.004)))
            day.append((start + dt.timedelta(minutes=15 * k), o, max(o, price) * 1.001, min(o, price) * 0.999, price))
        for k in range(0, 26, 4):
            g = day[k:k + 4]
            hours.append((g[0][0], g[0][1], max(x[2] for x in g), min(x[3] for x in g), g[-1][4]))
        fine += day
    return hours, [x for i, x in enumerate(fine) if i not in drop]


def levels(hours):
    h = np.array([x[1:] for x in hours])
    hi = lambda n, j: h[j - n:j, 1].max() if j >= n else np.nan
    return h, [hi(5, j) for j in range(len(h))], [hi(BACK, j) for j in range(len(h))], [0.01 * x[4] for x in hours]


def sequential(hours, fine=None):
    h, before, leave, atr = levels(hours)
    by_hour = {}
    for x in fine or []:
        by_hour.setdefault(max(y[0] for y in hours if y[0] <= x[0]), []).append(x)
    whole = lambda j: len(by_hour.get(hours[j][0], [])) == (4 if (hours[j][0].hour, hours[j][0].minute) != (20, 30) else 2)
    out, last, n = [], -1, len(h)
    for b in range(n):
        if b < last or not h[b, 3] > before[b]:
            continue
        level = h[b, 2] - K * atr[b]
        j = next((j for j in range(b + 1, min(n, b + 1 + VALID)) if h[j, 2] <= level), None)
        if j is None:
            continue
        entry, at = min(h[j, 0], level), hours[j][0]
        if fine is not None:
            if not whole(j):
                return out, "ENTRY_TOUCH_HOUR_MISSING_15M"
            hit = next(x for x in by_hour[at] if x[3] <= level)
            entry, at = min(hit[1], level), hit[0]
        stop, end = entry - STOP * atr[b], (n - 1, hours[-1][0], h[-1, 3])
        for i in range(j, n - 1):
            if h[i, 2] <= stop:
                if fine is None:
                    end = (i, hours[i][0], min(h[i, 0], stop))
                    break
                if not whole(i):
                    return out, "STOP_TOUCH_HOUR_MISSING_15M"
                hit = next((x for x in by_hour[hours[i][0]] if x[0] >= at and x[3] <= stop), None)
                if hit:
                    end = (i, hit[0], min(hit[1], stop))
                    break
            if h[i, 3] > leave[i]:
                end = (i + 1, hours[i + 1][0], h[i + 1, 0])
                break
        out.append((at, end[1], entry, end[2]))
        last = end[0]
    return out, None


def frames(spark, hours, fine):
    cols = "ts timestamp, open double, high double, low double, close double"
    h = w.indexed(spark.createDataFrame(hours, cols).withColumns({"symbol": F.lit("a"), "volume": F.lit(1.0)}))
    h = h.withColumn("entry", F.coalesce(F.col("close") > w.rolling_max("high", 5, 1), F.lit(False))).withColumn("atr", 0.01 * F.col("close"))
    f = spark.createDataFrame(fine, cols).withColumn("symbol", F.lit("a"))
    days = sorted({x[0].date() for x in hours})
    s = spark.createDataFrame([(d, dt.datetime.combine(d, dt.time(14, 30)), dt.datetime.combine(d, dt.time(21, 0))) for d in days], "session_date date, market_open timestamp, market_close timestamp")
    return h, f, s


def same(got, want):
    assert len(got) == len(want) and len(want) > 10
    for r, (a, z, p, q) in zip(sorted(got, key=lambda r: r.entry_time), want):
        assert (r.entry_time, r.exit_time) == (a, z)
        np.testing.assert_allclose([r.entry_price, r.exit_price], [p, q])


def test_hourly_pullback_is_the_sequential_rule(spark):
    hours, fine = market(1)
    h, _, _ = frames(spark, hours, fine)
    same(trades.pullback(h, "atr", K, STOP, VALID, BACK).collect(), sequential(hours)[0])


@pytest.mark.parametrize("drop", [(), (700, 701, 702, 703, 900, 901)])
def test_resolved_pullback_is_the_sequential_rule(spark, drop):
    hours, fine = market(2, drop)
    h, f, s = frames(spark, hours, fine)
    got = paths.resolved_pullbacks(h, f, s, "atr", K, STOP, VALID, BACK)
    want, failure = sequential(hours, fine)
    rows = got.collect()
    same([r for r in rows if r.status == "TRADE"], want)
    assert [r.failure for r in rows if r.status == "INCOMPLETE"] == ([failure] if failure else [])
    one = paths.path_summary(got, h).first()
    assert one.trades == len(want) and one.path_complete == (failure is None)
