"""Queries of landing jobs: split reconciliation, downloads, hydration, bucket stores and snapshots from files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars as ob
from ..operators import flow
from ..operators import hydration as h
from ..sources import files
from . import bindings as b
from . import q_gamma
from .gamma_sql import SNAPSHOTS
from .registry import query, shown

_FIVE = "sy AS (SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS k FROM (SELECT DISTINCT event_type AS symbol FROM events))"
#: Suppliers as split rows of event types: shares, a text, or nothing of use; many say the same.
_SPLITS = """raw AS (SELECT sy.symbol, DATE '2024-01-05' + CAST(s_suppkey % 20 AS INTEGER) AS day, CASE WHEN s_suppkey % 3 = 0 THEN 2.0 WHEN s_suppkey % 3 = 1 THEN 1.5 END AS factor FROM supplier JOIN sy ON sy.k = s_suppkey % 5),
sp AS (SELECT DISTINCT symbol, day, factor, epoch(day) + 18000 AS eff FROM raw WHERE factor IS NOT NULL)"""


def payload(spark, sf_dir):
    """Split rows in the shapes providers send."""
    names = b.table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol")).distinct()
    five = names.agg(F.array_sort(F.collect_list("symbol")).alias("x"))  # a handful of event types
    k = F.col("s_suppkey")
    d = b.table(spark, sf_dir, "supplier").crossJoin(F.broadcast(five)).filter(k % 5 < F.size("x"))
    return d.select(F.get("x", (k % 5).cast("int")).alias("symbol"), F.date_add(F.lit("2024-01-05"), (k % 20).cast("int")).cast("string").alias("split_date"), F.when(k % 3 == 0, 5.0).alias("old_shares"), F.when(k % 3 == 0, 10.0).alias("new_shares"), F.when(k % 3 == 1, "3/2").otherwise("none").alias("split"))


@query("f_split_events", f"WITH {_FIVE}, {_SPLITS} SELECT symbol, CAST(day AS VARCHAR) AS split_date, round(factor, 6) AS factor, CAST(eff AS BIGINT) AS effective_at FROM sp")
def split_events(spark, sf_dir):
    """Split rows as events, equal ones once."""
    return shown(h.split_events(payload(spark, sf_dir)), ["symbol", "split_date", "effective_at"], ["factor"])


_HOUR = """ins AS (SELECT x.symbol, x.ts, x.close, s.market_open + (x.ts - s.market_open) // 3600 * 3600 AS t0, s.market_close FROM bars x JOIN sessions s ON x.ts // 86400 = s.market_open // 86400 AND x.ts >= s.market_open AND x.ts < s.market_close),
hr AS (SELECT symbol, t0 AS ts, arg_max(close, ts) AS close FROM ins GROUP BY symbol, t0, market_close HAVING count(*) = ceil((least(t0 + 3600, market_close) - t0) / 900.0))"""
_AUDIT = """(SELECT symbol, count(*) AS n, quantile_cont(d, 0.5) AS med, quantile_cont(d, 0.95) AS p95, avg(CASE WHEN d > 100 THEN 1.0 ELSE 0 END) AS bad FROM (SELECT hr.symbol, 1e4 * abs((hr.close / {f}) / (hr.close / {g}) - 1) AS d FROM hr) GROUP BY symbol)"""
_FACTOR = "CASE WHEN hr.ts < 1705294800 THEN CASE hr.symbol WHEN 'click' THEN 2.0 WHEN 'view' THEN 3.0 ELSE 1.0 END ELSE 1.0 END"
_TRUE = "CASE WHEN hr.ts < 1705294800 AND hr.symbol IN ('click', 'view') THEN 2.0 ELSE 1.0 END"


@query("q_split_reconciliation", "WITH " + b.bars_sql(15) + ", " + b.SQL["sessions"] + f""", {_HOUR}, r AS {_AUDIT.format(f='1.0', g=_TRUE)}, a AS {_AUDIT.format(f=_FACTOR, g=_TRUE)}, y AS (SELECT DISTINCT symbol FROM bars),
j AS (SELECT y.symbol, CASE WHEN y.symbol IN ('click', 'view') THEN 1 ELSE 0 END AS events, r.n, r.med AS rm, a.med AS am, coalesce(r.n >= 5 AND r.med <= 50 AND r.p95 <= 100 AND r.bad <= 0.01, false) AS rok, coalesce(a.n >= 5 AND a.med <= 50 AND a.p95 <= 100 AND a.bad <= 0.01, false) AS aok FROM y LEFT JOIN r ON r.symbol = y.symbol LEFT JOIN a ON a.symbol = y.symbol)
SELECT symbol, CAST(events AS BIGINT) AS event_count, CASE WHEN rok THEN 'RAW_ALREADY_COMPATIBLE' WHEN events > 0 AND aok THEN 'SPLIT_ADJUSTED' ELSE 'NONE' END AS selection, n AS raw_rows, round(rm, 6) AS raw_median_bps, round(am, 6) AS adjusted_median_bps FROM j""")
def reconciliation(spark, sf_dir):
    """Q05: 15-minute bars against an hourly base in which two event types are split 2:1; of one, the provider tells another ratio."""
    fine, sessions = files.settled(b.bars(spark, sf_dir, 15), "fine"), b.sessions(spark, sf_dir)
    told = spark.createDataFrame([("click", "2024-01-15", 1.0, 2.0, None), ("view", "2024-01-15", None, None, "3:1")], "symbol string, split_date string, old_shares double, new_shares double, split string")
    true = spark.createDataFrame([("click", "2024-01-15", 1.0, 2.0, None), ("view", "2024-01-15", 1.0, 2.0, None)], told.schema)
    base = ob.session_hourly(ob.split_adjust(fine, h.split_events(true)).drop("split_factor"), sessions).filter("complete")
    _, audit = h.reconcile_splits(fine, base, h.split_events(told), sessions)
    return shown(audit, ["symbol", "selection"], ["event_count", "raw_rows", "raw_median_bps", "adjusted_median_bps"])


_PB = b.with_sql("providers")


@query("q_download", _PB + """, c AS (SELECT symbol, ts, CASE WHEN volume < 10 THEN NULL ELSE close END AS close, volume FROM pb WHERE source = 'N'), s AS (SELECT symbol, ts, close, volume FROM pb WHERE source = 'A'),
m AS (SELECT * FROM c WHERE close IS NOT NULL UNION ALL SELECT * FROM s WHERE (symbol, ts) NOT IN (SELECT (symbol, ts) FROM c WHERE close IS NOT NULL)), z AS (SELECT symbol, count(*) AS bad FROM c WHERE close IS NULL GROUP BY 1)
SELECT m.symbol, count(*) AS rows, coalesce(any_value(z.bad), 0) AS quarantined, round(sum(close * volume) / sum(volume), 6) AS vwap FROM m LEFT JOIN z ON z.symbol = m.symbol GROUP BY m.symbol""")
def download(spark, sf_dir):
    """A chunk of one source, bad rows in quarantine, merged over another's bars."""
    p = b.provider_bars(spark, sf_dir).drop("priority")
    chunk = p.filter("source = 'N'").drop("source").withColumn("close", F.when(F.col("volume") >= 10, F.col("close")))
    merged, bad, _ = h.merged_download(p.filter("source = 'A'").drop("source"), chunk)
    g = merged.groupBy("symbol").agg(F.count("*").alias("rows"), (F.sum(F.col("close") * F.col("volume")) / F.sum("volume")).alias("vwap"))
    d = g.join(bad.groupBy("symbol").agg(F.count("*").alias("quarantined")), "symbol", "left").fillna(0, ["quarantined"])
    return shown(d, ["symbol"], ["rows", "quarantined", "vwap"])


def session_bars(spark, sf_dir):
    """Hourly bars of the event stream that start at half past."""
    start = F.timestamp_seconds(F.floor((F.unix_timestamp("ts") - 1800) / 3600) * 3600 + 1800)
    k = F.struct("ts", "event_id")
    return b.ticks(spark, sf_dir).groupBy("symbol", start.alias("at")).agg(F.min_by("price", k).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", k).alias("close"), F.sum("size").alias("volume")).withColumnRenamed("at", "ts")


AS_OF = "2024-01-25"


def hydration(spark, sf_dir):
    raw = files.settled(session_bars(spark, sf_dir), "raw")
    symbols = raw.select("symbol").distinct()
    # One event type is stored to the end, one only up to the fifth day.
    stored = raw.filter((F.col("symbol") == "view") | ((F.col("symbol") == "click") & (F.to_date("ts") <= F.lit("2024-01-05").cast("date"))))
    return h.hydrated(symbols, stored, raw, h.split_events(payload(spark, sf_dir)), b.sessions(spark, sf_dir), AS_OF, 60, 0.8, most_gap=1e5)


_HYDRATED = "WITH " + b.SQL["ticks"] + ", " + b.SQL["sessions"] + f""", {_FIVE}, {_SPLITS},
bars AS (SELECT symbol, CAST(floor((epoch(ts) - 1800) / 3600) * 3600 + 1800 AS BIGINT) AS ts, arg_min(price, {{'a': ts, 'b': event_id}}) AS open, arg_max(price, {{'a': ts, 'b': event_id}}) AS close FROM ticks GROUP BY 1, 2),
st AS (SELECT symbol, count(*) AS n, max(ts) AS last FROM bars WHERE symbol = 'view' OR symbol = 'click' AND ts < 1704499200 GROUP BY 1), us AS (SELECT symbol, n FROM st WHERE n >= 60 AND date_diff('day', DATE '1970-01-01' + CAST(last // 86400 AS INTEGER), DATE '{AS_OF}') <= 14),
rw AS (SELECT * FROM bars WHERE symbol NOT IN (SELECT symbol FROM us)), sn AS (SELECT symbol, min(ts) // 86400 AS a, least(max(ts), epoch(TIMESTAMP '{AS_OF} 23:59:59')) // 86400 AS z FROM rw GROUP BY 1),
bk AS (SELECT market_open // 86400 AS d, unnest(range(CAST(market_open AS BIGINT), CAST(market_close AS BIGINT), 3600)) AS ts FROM sessions), ex AS (SELECT sn.symbol, bk.ts FROM sn JOIN bk ON bk.d BETWEEN sn.a AND sn.z WHERE bk.ts <= epoch(TIMESTAMP '{AS_OF} 23:59:59')),
hb AS (SELECT ex.symbol, ex.ts, r.close / coalesce((SELECT product(factor) FROM sp WHERE sp.symbol = r.symbol AND sp.eff > r.ts), 1) AS close FROM ex JOIN rw r ON r.symbol = ex.symbol AND r.ts = ex.ts),
g AS (SELECT ex.symbol, count(*) AS e, count(hb.ts) AS n FROM ex LEFT JOIN hb ON hb.symbol = ex.symbol AND hb.ts = ex.ts GROUP BY 1), c AS (SELECT symbol, count(*) AS n FROM sp GROUP BY 1)"""


@query("q_hydrated", _HYDRATED + """ SELECT y.symbol, CASE WHEN us.n IS NOT NULL THEN 'EXISTING_USABLE' WHEN g.n >= 60 AND g.n >= 0.8 * g.e THEN 'HYDRATED' ELSE 'REJECTED' END AS status, CASE WHEN us.n IS NOT NULL OR g.n >= 60 AND g.n >= 0.8 * g.e THEN NULL WHEN g.n < 60 THEN 'INSUFFICIENT_ROWS' ELSE 'INSUFFICIENT_COVERAGE' END AS reason,
CAST(coalesce(us.n, g.n) AS BIGINT) AS rows, CAST(CASE WHEN us.n IS NULL THEN coalesce(c.n, 0) ELSE 0 END AS BIGINT) AS split_count, round(CASE WHEN us.n IS NULL THEN g.n / g.e ELSE 1.0 END, 6) AS coverage FROM sy y LEFT JOIN us ON us.symbol = y.symbol LEFT JOIN g ON g.symbol = y.symbol LEFT JOIN c ON c.symbol = y.symbol""")
def outcome(spark, sf_dir):
    """Q07, Q22: outcome of hydration for each event type."""
    return shown(hydration(spark, sf_dir)[1], ["symbol", "status", "reason"], ["rows", "split_count", "coverage"])


@query("q_hydrated_store", _HYDRATED + """ SELECT hb.symbol, count(*) AS rows, round(sum(hb.close), 6) AS close, CAST(0 AS BIGINT) AS written_again FROM hb JOIN g ON g.symbol = hb.symbol WHERE g.n >= 60 AND g.n >= 0.8 * g.e GROUP BY 1""")
def stored(spark, sf_dir):
    """Hydrated bars in a bucket store; a second run of the same input writes no bucket."""
    path = files.shared_path(spark, "hydrated")
    bars = files.settled(hydration(spark, sf_dir)[0].select("symbol", "ts", "open", "high", "low", "close", "volume"), "hydrated-bars")
    merge = lambda old, new: ob.last_wins(old, new)
    files.store_buckets(bars, path, "symbol", merge, 16)
    again = files.store_buckets(bars, path, "symbol", merge, 16)
    d = files.read_buckets(spark, path, bars.schema).groupBy("symbol").agg(F.count("*").alias("rows"), F.sum("close").alias("close"))
    return shown(d.withColumn("written_again", F.lit(len(again)).cast("long")), ["symbol"], ["rows", "close", "written_again"])


@query("q_gamma_snapshots", SNAPSHOTS + """, lt AS (SELECT symbol, max(ts) AS ts FROM cg GROUP BY 1), cl AS (SELECT cg.* FROM cg JOIN lt ON lt.symbol = cg.symbol AND lt.ts = cg.ts),
u AS (SELECT cl.*, i, s * (0.8 + 0.4 * i / 160) AS spot_at FROM cl CROSS JOIN range(161) AS q(i)), cu AS (SELECT symbol, i, any_value(s) AS s, any_value(spot_at) AS spot_at, sum(CASE WHEN is_call THEN 1 ELSE -1 END * exp(-0.5 * pow((ln(spot_at / k) + 0.5 * v * v * y) / (v * sqrt(y)), 2)) / sqrt(6.283185307179586) / (spot_at * v * sqrt(y)) * oi * 100 * spot_at * spot_at * 0.01) AS net FROM u GROUP BY 1, 2),
w AS (SELECT *, lag(spot_at) OVER (PARTITION BY symbol ORDER BY i) AS a, lag(net) OVER (PARTITION BY symbol ORDER BY i) AS n FROM cu), fl AS (SELECT symbol, arg_min(a - n * (spot_at - a) / (net - n), abs(a - n * (spot_at - a) / (net - n) - s)) AS flip FROM w WHERE sign(net) * sign(n) < 0 GROUP BY 1),
ct2 AS (SELECT symbol, count(*) AS contracts, any_value(s) AS spot FROM cl GROUP BY 1)
SELECT c.symbol, c.contracts, snap.ts, round(c.spot, 6) AS spot, round(snap.net_gex, 6) AS net_gex, round(snap.call_wall, 6) AS call_wall, round(snap.put_wall, 6) AS put_wall, round(fl.flip, 6) AS flip FROM ct2 c JOIN lt ON lt.symbol = c.symbol JOIN snap ON snap.symbol = c.symbol AND snap.ts = lt.ts LEFT JOIN fl ON fl.symbol = c.symbol""")
def latest_snapshots(spark, sf_dir):
    """Contracts stored by symbol and day; each symbol's newest day, its exposure, walls and flip."""
    path = files.shared_path(spark, "chains")
    q_gamma.contracts(spark, sf_dir).withColumn("day", F.unix_timestamp("ts")).drop("ts", "close").write.partitionBy("symbol", "day").parquet(path)
    chain = files.newest_partitions(spark.read.schema("years double, side string, _m double, open_interest double, implied_volatility double, contract_multiplier double, spot double, strike double, symbol string, day long").parquet(path), "symbol", "day")
    about = chain.groupBy("symbol").agg(F.max("day").alias("ts"), F.count("*").alias("contracts"), F.max("spot").alias("spot"))
    d = about.join(flow.strike_profile(flow.gamma_exposure(chain)), "symbol").join(flow.gamma_flip(flow.scenario_curve(chain)), "symbol", "left")
    return shown(d, ["symbol", "ts"], ["contracts", "spot", "net_gex", "call_wall", "put_wall", "flip"])
