"""Split events, reconciliation, hydration gates, bucket stores, running numbers and combinations against plain rules."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barflow.functions.numbering import numbered
from barflow.operators import filings as g
from barflow.operators import hydration as h
from barflow.operators import news as n
from barflow.operators import validation as v
from barflow.sources import files

DAY = dt.timedelta(days=1)
OPEN = dt.datetime(2024, 1, 2, 14, 30)
BAR = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"


def sessions(spark, days):
    rows = [((OPEN + k * DAY).date(), OPEN + k * DAY, OPEN + k * DAY + dt.timedelta(hours=6, minutes=30)) for k in range(days)]
    return spark.createDataFrame(rows, "session_date date, market_open timestamp, market_close timestamp")


def hourly(symbol, days, price=100.0, skip=()):
    return [(symbol, OPEN + d * DAY + dt.timedelta(hours=k), price, price + 1, price - 1, price, 10.0) for d in range(days) for k in range(7) if (d, k) not in skip]


def test_split_rows_of_all_shapes(spark):
    rows = [("A", "2024-01-05", 1.0, 10.0, "3/1"), ("A", "2024-01-05", None, None, "10/1"), ("A", "2024-01-05", None, None, "10:1"), ("A", None, 1.0, 2.0, None), ("A", "2024-02-01", 0.0, 2.0, None), ("A", "2024-02-02", None, None, "x/1"), ("A", "2024-02-03", None, None, "4"),
            ("B", "2024-03-01", None, None, "1:4"), (None, "2024-03-01", 1.0, 2.0, None), ("B", "2024-03-02", None, None, "0/1")]
    d = spark.createDataFrame(rows, "symbol string, split_date string, old_shares double, new_shares double, split string")
    got = sorted((r.symbol, str(r.split_date), r.factor, r.effective_at) for r in h.split_events(d).collect())
    assert got == [("A", "2024-01-05", 10.0, dt.datetime(2024, 1, 5, 5)), ("B", "2024-03-01", 0.25, dt.datetime(2024, 3, 1, 5))]
    assert h.split_events(d.limit(0)).count() == 0


def test_base_decides_whether_splits_apply(spark):
    fine = []
    for s, price in (("raw", 50.0), ("split", 50.0), ("wrong", 50.0), ("none", 50.0)):
        for d in range(4):
            x = price * (2 if d < 2 and s != "raw" else 1)
            fine += [(s, OPEN + d * DAY + dt.timedelta(minutes=15 * k), x, x, x, x, 1.0) for k in range(26)]
    base = [(s, OPEN + d * DAY + dt.timedelta(hours=k), 50.0, 50.0, 50.0, 50.0, 1.0) for s in ("raw", "split", "wrong") for d in range(4) for k in range(7)]
    events = spark.createDataFrame([("split", "2024-01-04", 1.0, 2.0, None), ("wrong", "2024-01-04", 1.0, 3.0, None)], "symbol string, split_date string, old_shares double, new_shares double, split string")
    chosen, audit = h.reconcile_splits(spark.createDataFrame(fine, BAR), spark.createDataFrame(base, BAR), h.split_events(events), sessions(spark, 4))
    assert {r.symbol: r.selection for r in audit.collect()} == {"raw": "RAW_ALREADY_COMPATIBLE", "split": "SPLIT_ADJUSTED", "wrong": "NONE", "none": "NONE"}
    got = {r.symbol: (r.n, r.low) for r in chosen.groupBy("symbol").agg(F.count("*").alias("n"), F.max("close").alias("low")).collect()}
    assert got == {"raw": (104, 50.0), "split": (104, 50.0)}


def test_each_gate_of_hydration(spark):
    days = 20
    raw = hourly("ok", days) + hourly("thin", 3) + hourly("holes", days, skip={(d, k) for d in range(days) for k in range(3)}) + [(s, t, o * (20 if t >= OPEN + 9 * DAY else 1), hi, lo, c * (20 if t >= OPEN + 9 * DAY else 1), vol) for s, t, o, hi, lo, c, vol in hourly("gap", days)]
    raw += [("twice", *r[1:]) for r in hourly("x", days)] + [("twice", OPEN, 99.0, 99.0, 99.0, 99.0, 1.0)] + hourly("kept", 2) + [("off", OPEN + k * DAY + dt.timedelta(minutes=1), 1.0, 1.0, 1.0, 1.0, 1.0) for k in range(days)]
    raw += [("split", t, o * (4 if t < OPEN + 9 * DAY else 1), 0.0 + hi * (4 if t < OPEN + 9 * DAY else 1), lo, c * (4 if t < OPEN + 9 * DAY else 1), vol) for _, t, o, hi, lo, c, vol in hourly("split", days)]
    events = spark.createDataFrame([("split", str((OPEN + 9 * DAY).date()), 1.0, 4.0, None)], "symbol string, split_date string, old_shares double, new_shares double, split string")
    names = spark.createDataFrame([(s,) for s in ("ok", "thin", "holes", "gap", "twice", "kept", "off", "split", "never", "stale")], "symbol string")
    stored = spark.createDataFrame(hourly("kept", days) + hourly("stale", 2), BAR)
    as_of = str((OPEN + (days - 1) * DAY).date())
    bars, out = h.hydrated(names, stored, spark.createDataFrame(raw, BAR), h.split_events(events), sessions(spark, days), as_of, 50)
    got = {r.symbol: (r.status, r.reason, r.rows, r.split_count) for r in out.collect()}
    assert got == {"ok": ("HYDRATED", None, 140, 0), "thin": ("REJECTED", "INSUFFICIENT_ROWS", 21, 0), "holes": ("REJECTED", "INSUFFICIENT_COVERAGE", 80, 0), "gap": ("REJECTED", "EXTREME_OPEN_GAP", 140, 0), "twice": ("REJECTED", "DUPLICATE_TIMESTAMPS", 141, 0),
                   "kept": ("EXISTING_USABLE", None, 140, 0), "off": ("REJECTED", "INSUFFICIENT_ROWS", 0, 0), "split": ("HYDRATED", None, 140, 1), "never": ("REJECTED", "NO_ROWS", 0, 0), "stale": ("REJECTED", "NO_ROWS", 0, 0)}
    assert {(r.symbol, r.close) for r in bars.collect()} == {("ok", 100.0), ("split", 100.0)}


def test_a_store_writes_changed_buckets_alone(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    rows = [(f"k{k}", 1, k) for k in range(40)] + [(None, 1, 7)]
    d = spark.createDataFrame(rows, "accession string, version int, x int")
    merge = lambda old, new: files.upserted(old, new, "accession", "version")
    first = files.store_buckets(d, path, "accession", merge, 8)
    assert len(first) == 8 and files.store_buckets(d, path, "accession", lambda old, new: new, 8) == []
    newer = spark.createDataFrame([("k3", 2, 100), ("k3", 2, 101)], d.schema)
    second = files.store_buckets(newer, path, "accession", merge, 8)
    assert len(second) == 1 and files.store_buckets(newer.limit(0), path, "accession", merge, 8) == []
    got = sorted((r.accession or "", r.version, r.x) for r in spark.read.parquet(f"{path}/data").collect())
    assert got == sorted([(f"k{k}", 1, k) for k in range(40) if k != 3] + [("", 1, 7), ("k3", 2, 100), ("k3", 2, 101)])
    marks = spark.read.parquet(f"{path}/manifest")
    assert marks.count() == 8 and marks.agg(F.sum("rows")).first()[0] == 42


def test_newest_partitions_prune(spark, tmp_path):
    d = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 3.0), ("a", 2, 4.0)], "symbol string, day int, x double")
    d.write.partitionBy("symbol", "day").parquet(str(tmp_path / "p"))
    got = files.newest_partitions(spark.read.parquet(str(tmp_path / "p")), "symbol", "day")
    assert sorted((r.symbol, r.day, r.x) for r in got.collect()) == [("a", 2, 2.0), ("a", 2, 4.0), ("b", 1, 3.0)]


def test_numbers_run_on_over_ranges(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), k, r.random()) for k in range(500)]
    got = numbered(spark.createDataFrame(rows, "k string, i int, x double").repartition(7), "k", ["x", "i"]).collect()
    want = {}
    for key in ("a", "b", None):
        for place, row in enumerate(sorted((x, i) for k, i, x in rows if k == key)):
            want[row[1]] = place + 1
    assert {x.i: x.n for x in got} == want and len(got) == 500


def test_combinations_by_moments(spark):
    r = random.Random(6)
    rows = [(s, dt.date(2024, 1, 1) + k * DAY, r.gauss(0.001 * j, 0.01)) for j, s in enumerate("abcde") for k in range(40) if r.random() < 0.7] + [("f", dt.date(2024, 1, 3), 0.0)]
    d = spark.createDataFrame(rows, "s string, day date, r double")
    dates = sorted({x[1] for x in rows})
    m = {s: np.array([sum(x[2] for x in rows if x[0] == s and x[1] == t) for t in dates]) for s in "abcdef"}
    found = v.combination_search(d, "s", "day", "r")
    got = {(x.strategies, x.mode): x for x in found.collect()}
    assert len(got) == 3 * sum(len(list(itertools.combinations("abcdef", k))) for k in (2, 3, 4))
    for (names, mode), row in got.items():
        ids = names.split("+")
        sd = np.array([m[s].std(ddof=1) for s in ids])
        mean = np.array([m[s].mean() for s in ids])
        with np.errstate(divide="ignore", invalid="ignore"):
            raw = {"equal": np.ones(len(ids)), "inverse_volatility": np.where(sd > 1e-12, 1 / sd, 0.0), "positive_sharpe": np.where(sd > 1e-12, np.maximum(mean / sd, 0.0), 0.0)}[mode]
        w = np.full(len(ids), 1 / len(ids))
        if mode != "equal" and raw.sum() > 0:
            w = np.clip(raw / raw.sum(), 0.1 / len(ids), 0.7)
            w /= w.sum()
        stream = sum(x * m[s] for x, s in zip(w, ids))
        np.testing.assert_allclose(row.weights, w, atol=1e-9)
        np.testing.assert_allclose([row.mean, row.sd], [stream.mean(), stream.std(ddof=1)], atol=1e-9)
        pairs = [np.corrcoef(m[x], m[y])[0, 1] for x, y in itertools.combinations(ids, 2) if "f" not in (x, y)]
        assert abs(row.correlation - (np.mean(pairs) if pairs else 0.0)) < 1e-9
    best = found.filter("strategies = 'a+c+e' AND mode = 'equal'")
    s = {x.day: x.r for x in v.combined_streams(d, best, "s", "day", "r").collect()}
    assert all(abs(s.get(t, 0.0) - (m["a"][i] + m["c"][i] + m["e"][i]) / 3) < 1e-12 for i, t in enumerate(dates))


def test_a_common_key_is_novel_by_its_last_texts(spark):
    r = random.Random(3)
    rows = [("one", k, " ".join(r.choice(["red", "blue", "green", "fish", "cat"]) for _ in range(r.randint(0, 4)))) for k in range(60)]
    got = {x.k: x.novelty for x in n.novelty(spark.createDataFrame(rows, "g string, k long, text string"), "g", "k", 5).collect()}
    for _, k, text in rows:
        c = lambda t: {x: t.split().count(x) for x in set(t.split())}
        a = c(text)
        best = 0.0
        for _, _, other in rows[max(0, k - 5):k]:
            o = c(other)
            if a and o:
                best = max(best, sum(x * o.get(y, 0) for y, x in a.items()) / (sum(x * x for x in a.values()) * sum(x * x for x in o.values())) ** 0.5)
        assert abs(got[k] - max(0.1, 1 - best)) < 1e-9
    assert n.novelty(spark.createDataFrame(rows, "g string, k long, text string").limit(0), "g", "k", 5).count() == 0


def test_direction_of_current_reports(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("1", "Item 2.02 they raised guidance", None), ("2", "Item 2.04 we raise guidance", None), ("3", "Item 2.05 material weakness and going concern", None), ("4", "nothing", None), ("5", "Item 9.99 x", None), ("6", "resigned", "5.02, 9.01"), ("7", None, None)]
    d = spark.createDataFrame([(a, "S", at, c, i) for a, c, i in rows], "accession string, symbol string, accepted_at timestamp, content string, items string")
    got = {(r.accession, r.item): (r.category, r.materiality, round(r.direction, 6), r.confidence) for r in g.item_events(d).collect()}
    assert got == {("1", "2.02"): ("earnings_or_financial_condition", 0.9, 0.75, 0.9), ("2", "2.04"): ("default_or_acceleration_trigger", 1.0, -0.95, 0.9), ("3", "2.05"): ("exit_or_disposal_costs", 0.8, -1.0, 0.9), ("4", "8.01"): ("other_material_event", 0.6, 0.0, 0.6),
                   ("5", "9.99"): ("unmapped_8k_item", 0.35, 0.0, 0.9), ("6", "5.02"): ("management_or_director_change", 0.75, -0.35, 0.9), ("6", "9.01"): ("financial_statements_and_exhibits", 0.15, 0.0, 0.9), ("7", "8.01"): ("other_material_event", 0.6, 0.0, 0.6)}
    own = spark.createDataFrame([("8.01", "mine", 1.0, -0.5)], "item string, category string, materiality double, base double")
    assert {r.category for r in g.item_events(d.filter("accession = '4'"), [("nothing", 0.25)], own).collect()} == {"mine"}


@pytest.mark.parametrize("r", [[0.1, -1.0, 0.2], [0.0] * 5, [None, 0.01, 0.02]])
def test_bootstrap_of_ruin_and_nothing(spark, r):
    d = spark.createDataFrame([("a", k, x) for k, x in enumerate(r)], "k string, i int, r double")
    got = v.block_bootstrap(d, "k", "i", "r", runs=20, block=len(r)).first()
    total = np.prod([1 + (x or 0.0) for x in r]) - 1
    np.testing.assert_allclose([got.p05, got.median, got.p95], total, atol=1e-12)
