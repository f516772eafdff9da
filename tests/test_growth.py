"""Plans whose work grows with the rows: what they must not hold, and results that stay."""

import datetime as dt
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from barflow.functions import windows as w
from barflow.operators import news as n
from barflow.operators import panel as p
from barflow.operators import signals as s
from barflow.operators import trades as t
from barflow.plans import bindings as b
from barflow.plans import q_research, q_windows
from barflow.streaming import jobs

SF = "/root/testdata/sf0.001"


def _bars(spark, rows=300):
    out = [(k, dt.date(2020, 1, 1) + dt.timedelta(days=i), 10.0 + (i * 7 + len(k)) % 11, 22.0 + i % 5, 5.0 - i % 3, 10.0 + (i * 5) % 13, 1.0) for k in ("a", "bb") for i in range(rows)]
    return spark.createDataFrame(out, "symbol string, ts date, open double, high double, low double, close double, volume double")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_trades_join_nothing_and_fold_no_frame_to_the_end(spark):
    d = s.signals(_bars(spark), "n_bar_breakout").withColumns({"entry": F.col("rn") % 5 == 0, "exit": F.col("rn") % 7 == 0, "stop": F.lit(6.0), "target": F.lit(9.0)})
    for made in (t.from_signals(d, 20), t.from_signals(d, 20, "stop", "target"), t.first_profitable(d, 70), t.trailing(d, 0.2, 0.3, 60)):
        plan = _plan(made)
        assert "Join" not in plan
        assert "currentrow$(), unboundedfollowing$()" not in plan and "1, unboundedfollowing$()" not in plan


def test_several_strategies_in_one_pass_trade_as_each_alone(spark):
    d = w.indexed(_bars(spark))
    make = {"x": lambda x: s.signals(x, "consecutive_lower_lows"), "y": lambda x: s.signals(x, "close_below_n_day_low")}
    got = t.from_several(d, "strategy", make, 20)
    assert _plan(got).count("LocalRelation") + _plan(got).count("LogicalRDD") == 1
    for k, fn in make.items():
        alone = t.from_signals(fn(d), 20)
        assert sorted(got.filter(F.col("strategy") == k).select(alone.columns).collect()) == sorted(alone.collect())


def test_rows_ahead_cross_blocks_and_end_with_the_symbol(spark):
    d = w.indexed(_bars(spark, 200))
    got = {(r["symbol"], r["rn"]): [x["rn"] for x in r["_path"]] for r in w.with_ahead(d, F.col("rn") % 3 == 0, 150, "close").collect()}
    assert got == {(k, i): list(range(i + 1, min(200, i + 150) + 1)) for k in ("a", "bb") for i in range(3, 201, 3)}


def test_a_recurrence_looks_its_carries_up_in_few_windows(spark):
    assert _plan(w.ema(w.indexed(_bars(spark)), "close", "y", 20)).count("Window [") <= 5


def test_evidence_takes_no_texts_through_its_join(spark):
    news = spark.createDataFrame([(1, "x", 10, "long text")], "id long, provider string, published long, summary string")
    story = spark.createDataFrame([(1, 1)], "id long, leader long")
    d = n.story_evidence(news, story, 20)
    assert _plan(d).index("length(summary") > _plan(d).index("Join")
    assert [r["representative"] for r in d.collect()] == [1]


def test_moving_values_share_few_windows_and_fold_no_frame(spark):
    plan = _plan(q_windows.moving(spark, SF))
    assert plan.count("Window [") <= 7
    assert not [k for k in (2, 4, 9, 13, 19) if f"-{k}, currentrow$()" in plan]


@pytest.mark.parametrize("n", [1, 3, 14, 20, 130])
def test_moving_values_as_by_frames(spark, n):
    d = w.indexed(_bars(spark, 200).withColumns({"gaps": F.when(F.dayofmonth("ts") != 9, F.col("close") / 3), "flat": F.lit(0.1)}))
    wanted = {f"{k}_{c}_{shift}": (k, c, n, shift) for k in ("sum", "mean", "min", "max", "std", "list") for c in ("close", "gaps", "flat") for shift in (0, 3)}
    fold = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_pop, "list": F.collect_list}
    want = d.select("symbol", "rn", *[w.guarded(fold[k](c).over(w.frame(n, shift)), c, n, w.frame(n, shift)).alias(out) for out, (k, c, _, shift) in wanted.items()])
    got = w.moving(d, w.Moving(wanted)).select(want.columns)
    for x, y in zip(got.orderBy("symbol", "rn").collect(), want.orderBy("symbol", "rn").collect()):
        for c in want.columns[2:]:
            assert (x[c] is None) == (y[c] is None), (c, x, y)
            assert x[c] is None or x[c] == pytest.approx(y[c], rel=1e-12, abs=1e-9), (c, x, y)
            assert not c.startswith("std_flat") or not x[c]  # exactly


def test_bars_by_symbol_and_days_are_dealt_by_the_rows(spark, monkeypatch):
    monkeypatch.setattr(b, "ROWS", 100)
    rows = b.table(spark, SF, "lineitem").count()
    assert b.daily_bars(spark, SF).rdd.getNumPartitions() >= rows // 100
    assert q_research._by_day(spark, SF).rdd.getNumPartitions() >= rows // 100
    assert _plan(q_research.information(spark, SF)).count("RepartitionByExpression") == 2


def test_information_orders_days_from_one_side_alone(spark):
    d = _bars(spark, 30).select("symbol", "ts", F.col("close").alias("pred"), F.col("open").alias("y"))
    plan = p.information(d, "pred", "y")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Sort \[.*pred#\d+ DESC", plan)


def test_stories_in_the_stream_look_leaders_up(monkeypatch):
    steps = []
    monkeypatch.setattr(jobs, "one_by_one", lambda d, keys, order, out, step, kept: steps.append(step))
    monkeypatch.setattr(jobs, "_with_state", lambda news, rows, state, schema, path: rows)
    any_frame = type("Frame", (), {"__getattr__": lambda self, k: lambda *a, **b: self, "__invert__": lambda self: self})()
    monkeypatch.setattr(jobs, "F", any_frame)
    rng = random.Random(4)

    def leaders(rows, least, known=0):
        jobs.story_leaders(None, "", least)(any_frame, any_frame)
        state = {}
        return [steps[-1](state, {"id": i, "published": at, "tokens": t, "known": i < known}) for i, (at, t) in enumerate(rows)]

    def plainly(rows, least, known=0):
        held, out = [], []
        for i, (at, t) in enumerate(rows):
            held = [h for h in held if at - h[1] <= 36 * 3600]
            hit = next((k for k, _, o in reversed(held) if i >= known and t and len(set(t) & o) >= least * len(set(t) | o)), None)
            held += [(i, at, set(t))] if hit is None else []
            out.append(None if i < known else i if hit is None else hit)
        return out

    for least in (0.72, 0.5, 0.3):
        for words in (6, 16, 40):
            rows = [(k * 1800, rng.sample([f"w{x:04}"[:rng.choice([4, 5])] for x in range(words)], rng.randint(0, min(words, 12)))) for k in range(400)]
            assert leaders(rows, least, 20) == plainly(rows, least, 20)
    many = [(k // 20, [f"w{rng.randrange(3000)}" for _ in range(12)]) for k in range(12_000)]
    began = time.monotonic()
    assert leaders(many, 0.72) == list(range(12_000))
    assert time.monotonic() - began < 4
