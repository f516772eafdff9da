"""Capacity-bounded acceptance gathers no key's trades in a row, and is the sequential rule."""

import random
from datetime import datetime, timedelta

from barflow.operators import trades as t


def test_capacity_is_the_sequential_rule(spark):
    rng, day = random.Random(3), datetime(2024, 1, 1)
    rows = []
    for k in range(600):
        at = day + timedelta(days=rng.randrange(60))
        rows.append((rng.choice("ab"), f"s{rng.randrange(12)}", at, at + timedelta(days=rng.randrange(9)), float(rng.randrange(5)), k))
    d = spark.createDataFrame(rows, "h string, symbol string, entry_time timestamp, exit_time timestamp, score double, trade_id long")
    want = set()
    for key in "ab":
        held = []
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], -r[4], r[1], r[3], r[5])):
            held = [o for o in held if o[3] > r[2]]
            if len(held) < 4 and all(o[1] != r[1] for o in held):
                held.append(r)
                want.add(r[5])
    out = t.capacity_bounded(d, ["h"], 4)
    assert {r.trade_id for r in out.collect()} == want
    assert "collect_list" not in out._jdf.queryExecution().toString()


def test_lanes_and_capacity_over_idle_points(spark):
    rng, day = random.Random(8), datetime(2024, 1, 1)
    rows = []
    for k in range(500):
        at = day + timedelta(days=rng.randrange(400))
        rows.append((rng.choice("abc"), f"s{rng.randrange(6)}", at, None if rng.random() < 0.01 else at + timedelta(days=rng.randrange(4)), float(rng.randrange(5)), k))
    d = spark.createDataFrame(rows, "h string, symbol string, entry_time timestamp, exit_time timestamp, score double, trade_id long")
    first = lambda r: (r[3] is not None, r[3])  # noqa: E731  (no exit sorts first)
    lanes, taken = {}, set()
    for key in "abc":
        ends, held = [], []
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], first(r), r[5])):
            lane = next((k for k, e in enumerate(ends) if e is not None and e < r[2]), len(ends))
            ends[lane:lane + 1] = [r[3]]
            lanes[r[5]] = lane + 1
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], -r[4], r[1], first(r), r[5])):
            held = [o for o in held if o[3] is not None and o[3] > r[2]]
            if len(held) < 2 and all(o[1] != r[1] for o in held):
                held.append(r)
                taken.add(r[5])
    assert {r.trade_id: r.lane for r in t.lanes(d, ["h"]).collect()} == lanes and max(lanes.values()) > 2
    assert {r.trade_id for r in t.capacity_bounded(d, ["h"], 2).collect()} == taken
