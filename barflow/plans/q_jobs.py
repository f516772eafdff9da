"""Queries of composed jobs, sources and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import windows as w
from ..operators import panel as p
from ..sources import files
from ..streaming import jobs as stream
from . import bindings as b
from . import jobs
from . import signal_sql as sig
from . import trade_sql as q
from .q_text import b_dir
from .registry import query, shown

D = b.with_sql("daily")


def _shared(spark, label: str) -> str:
    b_dir(spark)
    return f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/{label}-{uuid.uuid4().hex}"


_GRIDS = "".join(f" UNION ALL SELECT '{n}', symbol FROM (SELECT symbol, ts // {m * 60} AS g, list_sort(list(ts % {m * 60})) AS o FROM bars GROUP BY 1, 2) WHERE o = range(0, {m * 60}, 900)" for n, m in (("1h", 60), ("2h", 120), ("4h", 240)))


@query("q_bundle", "WITH " + b.bars_sql(15) + ", " + D.removeprefix("WITH ").replace("bars AS", "dbars AS") + """, wx AS (SELECT symbol, ts, CAST(ts + CAST((12 - isodow(ts)) % 7 AS INTEGER) AS DATE) AS week FROM dbars),
wg AS (SELECT symbol, week, max(ts) AS last FROM wx GROUP BY 1, 2), wk AS (SELECT * FROM (SELECT *, max(week) OVER (PARTITION BY symbol) AS w FROM wg) WHERE week < w OR last >= week),
a AS (SELECT '15m' AS timeframe, symbol FROM bars""" + _GRIDS + """ UNION ALL SELECT '1d', symbol FROM dbars UNION ALL SELECT '1w', symbol FROM wk) SELECT timeframe, count(*) AS bars, count(DISTINCT symbol) AS symbols FROM a GROUP BY 1""")
def bundle(spark, sf_dir):
    """Q01, A03, S18."""
    d = jobs.timeframe_bundle(b.bars(spark, sf_dir, 15), b.daily_bars(spark, sf_dir))
    return d.groupBy("timeframe").agg(F.count("*").alias("bars"), F.count_distinct("symbol").alias("symbols"))


_HOURS, _HOURED = sig.layered("WITH " + b.bars_sql(60), "bars", [{"ret1": "close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1", "e5": sig.recurrence("close", 2.0 / 6, 1, 1)}])


@query("q_causal_dataset", _HOURS + ", " + b.SQL["sessions"] + f""", fine AS (SELECT DISTINCT t.symbol, least(t.ts + 900, s.market_close) AS av FROM (SELECT DISTINCT symbol, CAST(floor(epoch(ts) / 900) * 900 AS BIGINT) AS ts FROM ticks) t JOIN sessions s ON t.ts // 86400 = s.market_open // 86400 AND t.ts >= s.market_open AND t.ts < s.market_close),
ctx AS (SELECT h.symbol, least(h.ts + 3600, s.market_close) AS av, ret1, close / e5 - 1 AS ema5 FROM {_HOURED} h JOIN sessions s ON h.ts // 86400 = s.market_open // 86400 AND h.ts >= s.market_open AND h.ts < s.market_close),
j AS (SELECT f.symbol, f.av, c.av AS src, ret1, ema5 FROM fine f ASOF LEFT JOIN ctx c ON f.symbol = c.symbol AND f.av >= c.av)
SELECT symbol, av AS decision_time, round(CASE WHEN src // 86400 = av // 86400 THEN ret1 END, 6) AS ctx_ret1, round(CASE WHEN src // 86400 = av // 86400 THEN ema5 END, 6) AS ctx_ema5, CAST(coalesce(src // 86400 = av // 86400, false) AS BIGINT) AS fresh, CAST(0 AS BIGINT) AS leak FROM j""")
def causal(spark, sf_dir):
    """Q08, J01, J04, W26, W29, W30."""
    d = jobs.causal_dataset(b.bars(spark, sf_dir, 15), b.bars(spark, sf_dir, 60), b.sessions(spark, sf_dir), 15, 60)
    return shown(d, ["symbol", "decision_time"], ["ctx_ret1", "ctx_ema5", "fresh", "leak"])


_KNOWN = "WITH " + b.SQL["ticks"] + ", " + b.SQL["sessions"] + ", " + ", ".join(f"""{n} AS (SELECT t.symbol, t.ts, least(t.ts + {m * 60}, s.market_close) AS av FROM (SELECT DISTINCT symbol, CAST(floor(epoch(ts) / {m * 60}) * {m * 60} AS BIGINT) AS ts FROM ticks) t
JOIN sessions s ON t.ts // 86400 = s.market_open // 86400 AND t.ts >= s.market_open AND t.ts < s.market_close)""" for n, m in (("fine", 15), ("coarse", 60))) + ", rows AS (SELECT DISTINCT symbol, av FROM fine), ctx AS (SELECT DISTINCT symbol, av FROM coarse)"


@query("q_leaks", _KNOWN + ", j AS (SELECT r.symbol, r.av, max(c.av) AS src FROM rows r LEFT JOIN ctx c ON c.symbol = r.symbol AND c.av <= r.av GROUP BY 1, 2) SELECT count(*) AS decisions, CAST(sum(CAST(src > av AS BIGINT)) AS BIGINT) AS leaks, CAST(sum(src) AS BIGINT) AS sources, count(src) AS known FROM (SELECT symbol, av, src FROM j)")
def no_leaks(spark, sf_dir):
    """Decisions, and the times of the context that each of them knows."""
    d = jobs.causal_dataset(b.bars(spark, sf_dir, 15), b.bars(spark, sf_dir, 60), b.sessions(spark, sf_dir), 15, 60)
    return d.agg(F.count("*").alias("decisions"), F.coalesce(F.sum(F.when(F.col("source_time").isNotNull(), F.col("leak").cast("long"))), F.lit(0)).alias("leaks"), F.sum(F.unix_timestamp("source_time")).alias("sources"), F.count("source_time").alias("known"))


@query("w_rl_features", D + """, x AS (SELECT symbol, ts, rn, volume, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS lr FROM bars), y AS (SELECT *, CASE WHEN count(lr) OVER f >= 20 THEN quantile_cont(lr, 0.5) OVER f END AS m, (volume - avg(volume) OVER f) / nullif(stddev_pop(volume) OVER f, 0) AS vz FROM x WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)),
z AS (SELECT *, abs(lr - m) AS a FROM y), k AS (SELECT *, CASE WHEN count(a) OVER f >= 20 THEN quantile_cont(a, 0.5) OVER f END AS mad FROM z WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING))
SELECT symbol, CAST(ts AS VARCHAR) AS ts, round((lr - m) / nullif(1.4826 * mad, 0), 6) AS robust_z, round(vz, 6) AS volume_z FROM k WHERE mad > 0 AND vz IS NOT NULL""")
def rl(spark, sf_dir):
    """W27, V23, Q10."""
    return shown(jobs.rl_features(b.daily_bars(spark, sf_dir)), ["symbol", "ts"], ["robust_z", "volume_z"])


_FIFTY = "CASE WHEN ag2 IS NULL THEN NULL WHEN al2 = 0 AND ag2 = 0 THEN 50 WHEN al2 = 0 THEN 100 ELSE greatest(0, least(100, 100 - 100 / (1 + ag2 / al2))) END"
_BUNDLE, _BUNDLED = sig.layered(D, "bars", [sig.BASE, sig.NEXT, *sig.rsi(2), *sig.adx(5), sig.atr(14) | {"m": sig.sma(200), "z": f"(close - ({sig.sma(20)})) / nullif({sig.moving('stddev_pop', 'close', 20)}, 0)", "v": f"({sig.moving('sum', 'tp * volume', 20)}) / nullif({sig.moving('sum', 'volume', 20)}, 0)"}])


@query("w_rsi2_bundle", _BUNDLE + f" SELECT symbol, CAST(ts AS VARCHAR) AS ts, round({_FIFTY}, 6) AS rsi2, round(adx, 6) AS adx, round(m, 6) AS sma200, round(z, 6) AS bb_z, round(atr14, 6) AS atr14, round(v, 6) AS vwap FROM {_BUNDLED} WHERE m IS NOT NULL AND ag2 IS NOT NULL AND adx IS NOT NULL")
def rsi2(spark, sf_dir):
    """W50, W51, Q29."""
    return shown(jobs.rsi2_bundle(b.daily_bars(spark, sf_dir)), ["symbol", "ts"], ["rsi2", "adx", "sma200", "bb_z", "atr14", "vwap"])


@query("q_factory", q.factory_sql(["n_bar_breakout", "close_below_n_day_low", "consecutive_lower_lows"], 20))
def factory(spark, sf_dir):
    """Q11, Q12, V01-V03."""
    d = b.daily_bars(spark, sf_dir)
    return shown(jobs.strategy_factory(d, ["n_bar_breakout", "close_below_n_day_low", "consecutive_lower_lows"], p.rolling_folds(d, 20, 4, 500, 100)), ["strategy", "status"], ["folds", "passed", "positive", "median", "worst"])


@query("q_session_audit", "WITH " + b.bars_sql(60) + ", g AS (SELECT symbol, ts // 86400 AS d, count(*) AS n FROM bars GROUP BY 1, 2) SELECT symbol, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS bars, min(n) AS fewest, max(n) AS most FROM g GROUP BY symbol")
def audit(spark, sf_dir):
    """Q09."""
    return jobs.session_audit(b.bars(spark, sf_dir, 60))


@query("q_collect", "WITH " + b.bars_sql(5) + ", g AS (SELECT symbol, ts // 900 * 900 AS t, arg_max(close, ts) AS close, list_sort(list(ts % 900)) AS o FROM bars GROUP BY 1, 2) SELECT symbol, CAST(t AS BIGINT) AS ts, round(close, 6) AS close, 'exact_3_bar' AS derivation FROM g WHERE o = [0, 300, 600]")
def collect(spark, sf_dir):
    """Q02, P18, A04."""
    return shown(jobs.collect_and_derive(b.bars(spark, sf_dir, 5)), ["symbol", "ts", "derivation"], ["close"])


@query("q_synchronise", b.with_sql("providers") + """, j AS (SELECT a.symbol, 1e4 * abs(z.close / a.close - 1) AS d FROM pb a JOIN pb z ON a.symbol = z.symbol AND a.ts = z.ts AND a.source = 'A' AND z.source = 'N'),
ok AS (SELECT symbol FROM j GROUP BY 1 HAVING count(*) >= 5 AND quantile_cont(d, 0.5) <= 5000), l AS (SELECT symbol, min(ts) AS m FROM pb WHERE source = 'N' AND symbol IN (SELECT symbol FROM ok) GROUP BY symbol)
SELECT p.symbol, p.source, count(*) AS bars FROM pb p LEFT JOIN l ON l.symbol = p.symbol WHERE p.source = 'N' AND l.m IS NOT NULL OR p.source = 'A' AND (l.m IS NULL OR p.ts < l.m) GROUP BY 1, 2""")
def synchronise(spark, sf_dir):
    """Q03, Q04, V20."""
    q = b.provider_bars(spark, sf_dir)
    d = jobs.synchronised(q.filter("source = 'A'"), q.filter("source = 'N'"), 5000.0)
    return d.groupBy("symbol", "source").agg(F.count("*").alias("bars"))


_SWING = D + """, x AS (SELECT symbol, ts, lead(close, 5) OVER w / nullif(lead(open, 1) OVER w, 0) - 1 AS y, close / nullif(lag(close, 3) OVER w, 0) - 1 AS p FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)), v AS (SELECT * FROM x WHERE y IS NOT NULL AND p IS NOT NULL),
d AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM v)), pe AS (SELECT ts, CASE WHEN i < floor(n * 0.6) - 6 THEN 'train' WHEN i >= floor(n * 0.6) AND i < floor(n * 0.8) - 6 THEN 'valid' WHEN i >= floor(n * 0.8) THEN 'test' END AS period FROM d),
k AS (SELECT v.*, symbol || '|' || period AS k FROM v JOIN pe USING (ts) WHERE period IS NOT NULL), q AS (SELECT k, quantile_cont(p, 0.2) AS a, quantile_cont(p, 0.8) AS z FROM k GROUP BY 1), h AS (SELECT k.*, a, z, CASE WHEN (p > 0) = (y > 0) THEN 1.0 ELSE 0 END AS hit FROM k JOIN q USING (k))"""


@query("q_swing", _SWING + " SELECT k, round(corr(p, y), 6) AS ic, round(avg(hit), 6) AS direction, round((avg(hit) FILTER (y > 0) + avg(hit) FILTER (y <= 0)) / 2, 6) AS balanced, round(avg(y) FILTER (p >= z) - avg(y) FILTER (p <= a), 6) AS quintile_spread FROM h GROUP BY k")
def swing(spark, sf_dir):
    """Q18, L02, L05, V10."""
    return shown(jobs.swing_evaluation(b.daily_bars(spark, sf_dir), w.pct_change("close", 3), 5, 6), ["k"], ["ic", "direction", "balanced", "quintile_spread"])


@query("s_stored_bars", D + " SELECT symbol, count(*) AS bars, round(sum(volume), 6) AS volume FROM bars GROUP BY symbol")
def stored(spark, sf_dir):
    """Written with a manifest, read back and checked."""
    path = _shared(spark, "bars")
    files.write_bars(b.daily_bars(spark, sf_dir), path)
    return shown(files.read_bars(spark, path).groupBy("symbol").agg(F.count("*").alias("bars"), F.sum("volume").alias("volume")), ["symbol"], ["bars", "volume"])


@query("s_json_lines", "SELECT count(*) AS good, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events")
def lines(spark, sf_dir):
    """S15, S06, F25."""
    good, bad = files.json_lines(b.table(spark, sf_dir, "events").select(F.col("props").alias("value")), "k long")
    return good.agg(F.count("*").alias("good"), F.sum("k").alias("total"))


@query("s_request_windows", "WITH s AS (SELECT o_custkey AS symbol, min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) + 1 AS z FROM orders GROUP BY 1) SELECT CAST(symbol AS VARCHAR) AS symbol, CAST(ceil(date_diff('day', a, z) / 590.0) AS BIGINT) AS windows FROM s")
def windows(spark, sf_dir):
    """Windows of 590 days over a customer's orders."""
    s = b.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("symbol")).agg(F.to_date(F.min("o_orderdate")).alias("start"), F.date_add(F.to_date(F.max("o_orderdate")), 1).alias("end"))
    return files.request_windows(s, 590).groupBy("symbol").agg(F.count("*").alias("windows"))


@query("s_master", "SELECT count(*) AS rows, round(avg(CASE WHEN n_name IS NOT NULL AND r_name IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS coverage FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def master(spark, sf_dir):
    """S23, J09."""
    s = b.table(spark, sf_dir, "supplier").join(b.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").join(b.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return shown(files.master_coverage(s.select(F.col("n_name").alias("exchange"), F.col("r_name").alias("category"))), [], ["rows", "coverage"])


def _source(spark, sf_dir, name: str):
    """A table's file as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


def _tick_stream(spark, sf_dir):
    src = _source(spark, sf_dir, "events")
    return src.select("event_id", F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), (1.0 + F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(0.0))).alias("size"))


def _streamed(spark, sf_dir, build, label: str, mode: str = "append"):
    """Run a stream over the events file to its end, into a table that is returned."""
    path = _shared(spark, label)
    out = build(_tick_stream(spark, sf_dir))
    run = out.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


def _batched(spark, label: str, build):
    """Run a stream of micro-batches that write path/out by epoch, to its end; the table they leave."""
    path = _shared(spark, label)
    run = build(path).start()
    run.awaitTermination()
    return spark.read.parquet(f"{path}/out")


def _point_bars(t):
    return t.select("symbol", "ts", *[F.col("price").alias(c) for c in ("open", "high", "low", "close")], F.col("size").alias("volume"))


@query("x_sliding", b.with_sql("ticks") + ", e AS (SELECT max(epoch_us(ts)) / 1e6 - 3600 AS w FROM ticks), g AS (SELECT symbol, CAST(unnest(range(CAST(floor(epoch(ts) / 900) * 900 AS BIGINT) - 6300, CAST(floor(epoch(ts) / 900) * 900 AS BIGINT) + 1, 900)) AS BIGINT) AS start, ts, price, size FROM ticks) SELECT symbol, start, round(arg_min(price, ts), 6) AS open, round(max(price), 6) AS high, round(min(price), 6) AS low, round(arg_max(price, ts), 6) AS close, round(sum(size), 6) AS volume, count(*) AS n FROM g, e GROUP BY symbol, start HAVING start + 7200 <= min(w)")
def sliding(spark, sf_dir):
    """Two-hour windows every quarter of an hour over the event stream, closed at its end."""
    return shown(_streamed(spark, sf_dir, lambda t: stream.sliding_context(_point_bars(t)), "sliding"), ["symbol", "start"], ["open", "high", "low", "close", "volume", "n"])


@query("x_runs", b.with_sql("ticks") + ", e AS (SELECT max(epoch_us(ts)) - 3600000000 AS w FROM ticks), d AS (SELECT *, epoch_us(ts) AS u, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY symbol ORDER BY ts) < 960000000 THEN 0 ELSE 1 END AS new FROM ticks), r AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS r FROM d) SELECT symbol, CAST(floor(min(u) / 1e6) AS BIGINT) AS start, count(*) AS n, round(max(price), 6) AS high, round(min(price), 6) AS low FROM r, e GROUP BY symbol, r HAVING max(u) + 960000000 <= min(w)")
def sessions_of_runs(spark, sf_dir):
    """Runs of events less than 16 minutes apart, closed at the stream's end."""
    return shown(_streamed(spark, sf_dir, lambda t: stream.runs(_point_bars(t)), "runs"), ["symbol", "start"], ["n", "high", "low"])


@query("x_context", "WITH " + b.bars_sql(60) + " SELECT t.event_id, CAST(b.ts AS BIGINT) AS ctx_source_time, round(b.close, 6) AS ctx_close FROM (SELECT *, epoch(ts) AS at FROM ticks) t ASOF LEFT JOIN bars b ON t.symbol = b.symbol AND t.at >= b.ts")
def context(spark, sf_dir):
    """Each micro-batch of events with the last hourly bar that began by then."""
    def build(path):
        w_ = stream.with_context(_tick_stream(spark, sf_dir), lambda: b.bars(spark, sf_dir, 60), lambda df, epoch: df.write.mode("overwrite").parquet(f"{path}/out/epoch={epoch}"))
        return w_.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)

    return shown(_batched(spark, "context", build), ["event_id", "ctx_source_time"], ["ctx_close"])


@query("x_stories", b.with_sql("news").replace("WITH ", "WITH RECURSIVE ", 1) + """, k AS (SELECT id, published, provider, list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda x: len(x) > 2)) AS t, row_number() OVER (PARTITION BY provider ORDER BY published, id) AS k FROM news),
r AS (SELECT provider, k, id, id AS leader, [{'i': id, 'p': published, 't': t}] AS held FROM k WHERE k = 1
  UNION ALL SELECT provider, k, id, coalesce(hit, id), CASE WHEN hit IS NULL THEN list_append(h, {'i': id, 'p': published, 't': t}) ELSE h END
  FROM (SELECT *, list_filter(h, lambda q: len(t) > 0 AND len(list_intersect(q.t, t)) >= 0.72 * len(list_distinct(list_concat(q.t, t))))[-1].i AS hit FROM (SELECT n.*, list_filter(r.held, lambda q: n.published - q.p <= 129600) AS h FROM r JOIN k n ON n.provider = r.provider AND n.k = r.k + 1)))
SELECT provider, id, leader FROM r""")
def stories(spark, sf_dir):
    """Leaders of items within their provider."""
    from ..operators import news as n

    d = _source(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("provider"), n.title_tokens(F.array_join(F.slice(F.split("text", r"\s+", 13), 1, 12), " ")).alias("tokens"), (F.lit(1704067200) + F.col("doc_id") % 720 * 3600).cast("long").alias("published"))
    return _batched(spark, "stories", lambda path: stream.story_leaders(d, path)).select("provider", "id", "leader")


@query("x_quarantine", "SELECT count(*) FILTER (event_type <> 'click') AS good, count(*) FILTER (event_type = 'click') AS bad, count(*) AS told FROM events")
def quarantine(spark, sf_dir):
    """Events without a price in good and bad files, with the batches' own counts."""
    path = _shared(spark, "quarantine")
    d = _point_bars(_tick_stream(spark, sf_dir)).withColumn("close", F.when(F.col("symbol") != "click", F.col("close")))
    stream.quarantined(d, f"{path}/good", f"{path}/bad", f"{path}/audit", f"{path}/checkpoint").start().awaitTermination()
    n = lambda k: spark.read.parquet(f"{path}/{k}")
    return n("good").agg(F.count("*").alias("good")).crossJoin(n("bad").agg(F.count("*").alias("bad"))).crossJoin(n("audit").agg(F.sum("rows").alias("told")))


@query("x_closed_bars", "WITH " + b.bars_sql(60) + ", e AS (SELECT max(epoch(ts)) - 600 AS w FROM events) SELECT symbol, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume FROM bars, e WHERE ts + 3600 <= w")
def closed(spark, sf_dir):
    """Hourly bars of the event stream that are closed at its end."""
    return shown(_streamed(spark, sf_dir, lambda t: stream.closed_bars(t, 60), "closed-bars"), ["symbol", "ts"], ["open", "high", "low", "close", "volume"])


@query("x_cumulative_delta", b.with_sql("ticks") + ", d AS (SELECT *, sign(nullif(price - lag(price) OVER (PARTITION BY symbol ORDER BY ts, event_id), 0)) AS d FROM ticks), a AS (SELECT symbol, ts, event_id, size, coalesce(last_value(d IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 1.0) AS g FROM d) SELECT event_id, round(g, 6) AS aggressor, round(sum(g * size) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS cum_delta FROM a")
def delta(spark, sf_dir):
    """X07."""
    return shown(_batched(spark, "delta", lambda path: stream.cumulative_delta(_tick_stream(spark, sf_dir), path)), ["event_id"], ["aggressor", "cum_delta"])


@query("x_once", "SELECT count(DISTINCT event_id) AS n FROM events")
def once(spark, sf_dir):
    """X03."""
    return _streamed(spark, sf_dir, lambda t: stream.once(t, ["event_id"]), "once").agg(F.count("*").alias("n"))


@query("f_split_ratio", "SELECT p_partkey, round(CASE WHEN p_size % 3 = 0 THEN p_size / 2.0 WHEN p_size % 3 = 1 THEN p_size END, 6) AS factor FROM part")
def ratios(spark, sf_dir):
    """sizes as ratio texts."""
    from ..operators.bars import split_ratio

    p_ = b.table(spark, sf_dir, "part")
    s = F.col("p_size").cast("string")
    text = F.when(F.col("p_size") % 3 == 0, F.concat(s, F.lit("/2"))).when(F.col("p_size") % 3 == 1, s).otherwise("none")
    return shown(p_.select("p_partkey", split_ratio(text).alias("factor")), ["p_partkey"], ["factor"])


@query("j_last_session", "WITH " + b.SQL["sessions"] + " SELECT CAST(max(session_date) AS VARCHAR) AS session_date FROM sessions WHERE market_close <= 1705276800")
def last_session(spark, sf_dir):
    """J18 at 2024-01-15."""
    from ..operators.bars import last_session as at

    return shown(at(b.sessions(spark, sf_dir), F.lit("2024-01-15").cast("timestamp")), ["session_date"], [])


@query("u_provenance", b.with_sql("providers") + ", " + "m AS (SELECT symbol, ts, arg_min(source, priority) AS source FROM pb GROUP BY 1, 2) SELECT source, count(*) AS bars FROM (SELECT coalesce(CASE WHEN source <> 'R' THEN source END, 'landed') AS source FROM m) GROUP BY 1")
def provenance(spark, sf_dir):
    """Bars that no A or N row stands behind are called landed."""
    from ..operators import bars as ob

    q = ob.provider_merge(b.provider_bars(spark, sf_dir))
    return ob.with_provenance(q.drop("source"), q.filter("source <> 'R'"), "landed").groupBy("source").agg(F.count("*").alias("bars"))


@query("s_screen", "SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, round(p_retailprice, 6) AS p_retailprice FROM part WHERE p_size >= 10 AND p_retailprice < 1500 ORDER BY p_retailprice DESC, p_partkey, p_size LIMIT 25")
def screen(spark, sf_dir):
    """A top-25 report."""
    p_ = b.table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("p_size"), "p_retailprice")
    return shown(files.screened(p_, [("p_size", ">=", 10), ("p_retailprice", "<", 1500.0)], "p_retailprice", 25), ["p_partkey"], ["p_size", "p_retailprice"])


@query("k_setup", q.setup_sql())
def setups(spark, sf_dir):
    """Low RSI as setup."""
    from ..operators import trades as t

    d = w.atr(w.rsi(w.indexed(b.daily_bars(spark, sf_dir)), "rsi", 2, rule="fifty"), "atr", 14)
    d = d.withColumn("setup", F.coalesce(F.col("rsi") < 10, F.lit(False))).withColumn("exit", F.coalesce(F.col("rsi") > 70, F.lit(False)))
    d = t.setup_trades(d, 5, 2.0, 3.0, 20)
    return shown(d.withColumn("exit_time", F.col("exit_time").cast("string")), ["symbol", "entry_time"], ["exit_time", "entry_price", "exit_price", "gross_return", "duration_bars", "forced"])


@query("k_schedule", q.schedule_sql())
def scheduled(spark, sf_dir):
    """Flags of the breakout trades."""
    from ..operators import signals as s
    from ..operators import trades as t

    d = b.daily_bars(spark, sf_dir)
    return shown(t.schedule(t.from_signals(s.signals(d, "n_bar_breakout"), 20), d), ["symbol", "at"], ["entries", "exits", "collision"])


@query("v_registry_union", "SELECT k, origin, CAST(count(*) OVER (PARTITION BY k) AS BIGINT) AS copies FROM (SELECT s_nationkey % 7 AS k, 'a' AS origin FROM supplier UNION ALL SELECT c_nationkey % 9, 'b' FROM customer)")
def union(spark, sf_dir):
    """V16."""
    from ..operators.validation import registry_union

    k = lambda t_, c, n: b.table(spark, sf_dir, t_).select((F.col(c) % n).alias("k"))
    return registry_union(k("supplier", "s_nationkey", 7), k("customer", "c_nationkey", 9), "k")


@query("v_audit_gates", b.with_sql("trades") + ", f AS (SELECT symbol AS key, year(exit_time) AS fold, product(1 + 0.01 * gross_return) - 1 AS r, sum(0.01 * gross_return) * 0.5 AS h, min(0.01 * gross_return) AS dd, count(*) AS n FROM trades GROUP BY 1, 2), g AS (SELECT key, count(*) AS folds, avg(CASE WHEN r > h THEN 1.0 ELSE 0 END) AS beats, min(dd) AS w, sum(n) AS t FROM f GROUP BY 1) SELECT key, folds, round(beats, 6) AS beats, CAST(folds >= 3 AND beats >= 0.5 AND w > -0.5 AND t > 0 AS BIGINT) AS passed FROM g")
def gates(spark, sf_dir):
    """V19, Q26."""
    from ..operators.validation import audit_gates

    t_ = b.trades(spark, sf_dir).withColumn("g", 0.01 * F.col("gross_return"))
    f = t_.groupBy(F.col("symbol").alias("key"), F.year("exit_time").alias("fold")).agg((F.product(1 + F.col("g")) - 1).alias("total_return"), (F.sum("g") * 0.5).alias("buy_hold_return"), F.min("g").alias("max_drawdown"), F.count("*").alias("trades"))
    return shown(audit_gates(f), ["key"], ["folds", "beats", "passed"])
