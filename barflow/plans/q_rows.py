"""Queries of single rows: landing, canonical forms, filings as XML, screens, scores and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import windows as w
from ..operators import decisions as d
from ..operators import filings as g
from ..operators import joins as j
from ..operators import metrics as m
from ..operators import news as n
from ..operators import panel as p
from ..operators import quality as q
from ..operators import validation as v
from ..sources import files
from . import bindings as b
from . import signal_sql as sig
from .q_jobs import _shared
from .q_text import _PAGE
from .registry import query, shown

D, T = b.with_sql("daily"), b.with_sql("trades")
_NET = "(1 + gross_return) * (1 - 0.0003) / (1 + 0.0003) - 1"
_text = lambda c: F.col(c).cast("string")


@query("s_canonical", D + ", x AS (SELECT symbol, ts, CASE WHEN rn % 7 = 0 THEN NULL ELSE open END AS open, close FROM bars) SELECT symbol, count(*) AS rows, count(open) AS opens, round(sum(open), 4) AS open_sum, round(sum(close), 4) AS close_sum, CAST(0 AS BIGINT) AS volumes FROM x GROUP BY 1")
def canonical(spark, sf_dir):
    """Landed columns of other names and as text, every seventh open no number; each row twice, the later one counts."""
    x = w.indexed(b.daily_bars(spark, sf_dir)).select(F.col("symbol").alias("Ticker"), F.col("ts").alias("Date"), F.when(F.col("rn") % 7 == 0, "n/a").otherwise(_text("open")).alias("O"), _text("high").alias("High"), _text("low").alias("low"), _text("close").alias("Adj Close"))
    landed = x.withColumn("k", F.lit(1)).unionByName(x.withColumn("k", F.lit(0)).withColumn("Adj Close", F.lit("0")))
    out = q.canonicalize(landed, drop_duplicates=True, seq="k")
    return shown(out.groupBy("symbol").agg(F.count("*").alias("rows"), F.count("open").alias("opens"), F.sum("open").alias("open_sum"), F.sum("close").alias("close_sum"), F.count("volume").alias("volumes")), ["symbol"], ["rows", "opens", "open_sum", "close_sum", "volumes"], 4)


@query("s_merged_scan", "SELECT o_orderstatus AS status, count(*) AS rows, count(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END) AS prices FROM orders GROUP BY 1")
def merged_scan(spark, sf_dir):
    """Files of two schemas as one table; the pending orders' file has no price."""
    o, path = b.table(spark, sf_dir, "orders"), _shared(spark, "scan")
    o.filter("o_orderstatus <> 'P'").write.parquet(f"{path}/a")
    o.filter("o_orderstatus = 'P'").drop("o_totalprice").write.parquet(f"{path}/b")
    return files.scan(spark, f"{path}/a", f"{path}/b").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("rows"), F.count("o_totalprice").alias("prices"))


@query("s_file_index", b.with_sql("providers") + " SELECT source AS provider, '1d' AS timeframe, count(*) AS rows FROM pb GROUP BY 1")
def file_index(spark, sf_dir):
    """Stored bars by provider and timeframe, found again from their paths."""
    path = _shared(spark, "index")
    b.provider_bars(spark, sf_dir).withColumn("provider", F.col("source")).withColumn("timeframe", F.lit("1d")).write.partitionBy("provider", "timeframe").parquet(path)
    return files.file_index(spark.read.parquet(path)).groupBy("provider", "timeframe").agg(F.sum("rows").alias("rows"))


@query("s_refresh_items", "SELECT source AS provider, lang AS symbol, count(*) AS items FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 4 <> 0 GROUP BY 1, 2")
def refresh_items(spark, sf_dir):
    """Documents as a refresh artifact: symbols to results to items; other domains and undated items drop."""
    x = b.table(spark, sf_dir, "documents")
    at = F.when(F.col("doc_id") % 4 != 0, F.lit("2024-01-01"))
    item = F.struct(F.col("doc_id").alias("id"), at.alias("published_at"))
    r = x.groupBy("lang", "source", F.when(F.col("doc_id") % 3 == 0, "filings").otherwise("news").alias("domain")).agg(F.collect_list(item).alias("items"))
    r = r.groupBy("lang").agg(F.collect_list(F.struct("domain", F.col("source").alias("provider"), "items")).alias("results"))
    return files.flattened(r.select(F.create_map("lang", "results").alias("symbols"))).groupBy("provider", "symbol").agg(F.count("*").alias("items"))


@query("s_payload_bars", D + " SELECT symbol, count(*) AS rows, round(max(close), 6) AS top FROM bars GROUP BY 1")
def payload(spark, sf_dir):
    """Landed names with capitals and blanks."""
    x = b.daily_bars(spark, sf_dir).withColumnsRenamed({"symbol": "Symbol ", "close": " Close", "open": "Open"})
    return shown(files.payload_bars(x).groupBy("symbol").agg(F.count("*").alias("rows"), F.max("close").alias("top")), ["symbol"], ["rows", "top"])


@query("s_attestations", "SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'EXPIRED' ELSE 'VALID' END AS status, count(*) AS symbols FROM supplier GROUP BY 1")
def attestations(spark, sf_dir):
    """A later file's row replaces an earlier one's."""
    s = b.table(spark, sf_dir, "supplier").select(_text("s_suppkey").alias("symbol"))
    late = s.filter(F.col("symbol").cast("int") % 3 == 0).withColumn("status", F.lit("EXPIRED"))
    return files.attestations(s.withColumn("status", F.lit("VALID")), late).groupBy("status").agg(F.count("*").alias("symbols"))


@query("s_staging", T + " SELECT hypothesis_id, CAST(date_part('year', exit_time) AS BIGINT) AS year, count(*) AS trades, round(sum(gross_return), 4) AS gross FROM trades GROUP BY 1, 2")
def staging(spark, sf_dir):
    """Trades appended by year to a staging table, read back."""
    t = b.trades(spark, sf_dir).withColumn("year", F.year("exit_time").cast("long"))
    back = files.staged(spark, _shared(spark, "staging"), [t.filter("year < 1996"), t.filter("year >= 1996")], ["year"])
    return shown(back.groupBy("hypothesis_id", "year").agg(F.count("*").alias("trades"), F.sum("gross_return").alias("gross")), ["hypothesis_id", "year"], ["trades", "gross"], 4)


@query("p_reasons", "SELECT reason, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN p_retailprice < 1000 THEN 'PRICE' END, CASE WHEN p_size < 10 THEN 'WARM_UP' END, CASE WHEN p_partkey % 5 = 0 THEN 'VOLUME' END], lambda x: x IS NOT NULL)) AS reason FROM part) GROUP BY 1")
def reasons(spark, sf_dir):
    """Reasons of each part, counted."""
    x = b.table(spark, sf_dir, "part").select(F.explode(q.reasons(PRICE=F.col("p_retailprice") < 1000, WARM_UP=F.col("p_size") < 10, VOLUME=F.col("p_partkey") % 5 == 0)).alias("reason"))
    return x.groupBy("reason").agg(F.count("*").alias("n"))


@query("f_utc", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) - CASE WHEN event_id % 3 = 1 THEN 7200 ELSE 0 END AS at FROM events")
def utc(spark, sf_dir):
    """times as naive text, with an offset of two hours, and with Z."""
    x = b.table(spark, sf_dir, "events")
    s = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("event_id") % 3 == 1, F.concat(s, F.lit("+02:00"))).when(F.col("event_id") % 3 == 2, F.concat(s, F.lit("Z"))).otherwise(s)
    return x.select("event_id", F.unix_timestamp(q.utc(text)).alias("at"))


@query("f_safe_divide", "SELECT l_returnflag AS flag, count(*) FILTER (l_discount > 1e-12) AS known, round(sum(l_tax / nullif(l_discount, 0)), 4) AS total FROM lineitem GROUP BY 1")
def divided(spark, sf_dir):
    """tax over discount; no discount gives none."""
    x = b.table(spark, sf_dir, "lineitem").withColumn("r", q.safe_divide(F.col("l_tax"), F.col("l_discount")))
    return shown(x.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("r").alias("known"), F.sum("r").alias("total")), ["flag"], ["known", "total"], 4)


@query("f_names", "WITH x AS (SELECT p_partkey, list_distinct(list_filter(regexp_extract_all(upper(p_name), '[A-Z0-9]+'), lambda x: x NOT IN ('INC', 'CORP', 'CO', 'LTD', 'LLC', 'LP', 'THE', 'TRUST', 'JR', 'SR'))) AS a, list_distinct(regexp_extract_all(upper(p_type || ' ' || p_name || ' inc'), '[A-Z0-9]+')) AS z0 FROM part), y AS (SELECT *, list_filter(z0, lambda x: x <> 'INC') AS z FROM x) SELECT p_partkey, round(greatest(len(list_intersect(a, z)) / len(a), len(list_intersect(a, z)) / len(z)), 6) AS overlap FROM y")
def names(spark, sf_dir):
    """a part's name against its type and name with a company form."""
    x = b.table(spark, sf_dir, "part")
    return shown(x.select("p_partkey", g.name_overlap(g.name_tokens(F.col("p_name")), g.name_tokens(F.concat_ws(" ", "p_type", "p_name", F.lit("inc")))).alias("overlap")), ["p_partkey"], ["overlap"])


@query("f_phrases", "SELECT doc_id, round(greatest(-1, least(1, 0.25 * (CAST(contains(lower(text), 'password') AS INT) + CAST(contains(lower(text), 'license') AS INT) - CAST(contains(lower(text), 'stupid') AS INT)))), 6) AS score FROM documents WHERE text IS NOT NULL")
def phrases(spark, sf_dir):
    """F08."""
    return shown(b.table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", g.phrase_score(F.col("text"), [("password", 0.25), ("license", 0.25), ("stupid", -0.25)]).alias("score")), ["doc_id"], ["score"])


_ROLES = ["CEO and director", "Chief Financial Officer", "coo", "President", "engineer", ""]


@query("f_roles", f"SELECT role, count(*) AS n FROM (SELECT CASE p_partkey % 6 WHEN 0 THEN 'CEO' WHEN 1 THEN 'CFO' WHEN 2 THEN 'COO' WHEN 3 THEN 'PRESIDENT' ELSE CASE WHEN p_size % 2 = 0 THEN 'OFFICER' WHEN p_size % 3 = 0 THEN 'DIRECTOR' WHEN p_size % 5 = 0 THEN 'TEN_PERCENT_OWNER' ELSE 'OTHER' END END AS role FROM part) GROUP BY 1")
def roles(spark, sf_dir):
    """F29."""
    x = b.table(spark, sf_dir, "part").withColumn("title", F.element_at(F.array(*map(F.lit, _ROLES)), (F.col("p_partkey") % 6 + 1).cast("int")))
    return x.select(g.role_priority(F.col("title"), F.col("p_size") % 2 == 0, F.col("p_size") % 3 == 0, F.col("p_size") % 5 == 0).alias("role")).groupBy("role").agg(F.count("*").alias("n"))


@query("f_planned", "SELECT doc_id % 5 = 0 AS planned, count(*) AS n FROM documents GROUP BY 1")
def planned(spark, sf_dir):
    """every fifth text with a mention of a plan behind it."""
    note = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 5 == 0, " under a Rule 10b5-1 plan").otherwise(" 10b5x1"))
    return b.table(spark, sf_dir, "documents").select(g.planned_sale(note).alias("planned")).groupBy("planned").agg(F.count("*").alias("n"))


@query("f_cleaned", "SELECT o_orderkey, lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, round(CASE WHEN o_orderkey % 4 <> 0 THEN round(o_totalprice, 2) END, 6) AS price, CASE WHEN o_orderkey % 3 <> 2 THEN CAST(epoch(CAST(o_orderdate AS DATE)) AS BIGINT) END AS at FROM orders")
def cleaned(spark, sf_dir):
    """numbers with signs, identifiers with letters, and dates of several forms."""
    o = b.table(spark, sf_dir, "orders")
    price = F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("$ "), F.format_number("o_totalprice", 2))).otherwise("none")
    at = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "MM/dd/yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("soon")
    x = o.select("o_orderkey", g.clean_cik(F.concat(F.lit("CIK "), _text("o_custkey"))).alias("cik"), g.safe_float(price).alias("price"), F.unix_timestamp(g.parsed_time(at)).alias("at"))
    return shown(x, ["o_orderkey", "cik"], ["price", "at"])


@query("f_financial", "WITH r AS (SELECT CAST(o_custkey AS VARCHAR) AS symbol, o_orderdate AS dt, o_orderkey, o_totalprice % 977 AS debt, o_totalprice % 389 AS cash, o_totalprice % 211 AS rec, CASE WHEN o_orderkey % 10 <> 0 THEN 1000.0 END AS cap FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1997-06-30'), l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC, o_orderkey DESC) AS k FROM r) SELECT symbol, array_to_string(list_filter([CASE WHEN coalesce(debt / cap, 9) > 0.3333 THEN 'debt' END, CASE WHEN coalesce(cash / cap, 9) > 0.3333 THEN 'cash' END, CASE WHEN coalesce(rec / cap, 9) > 0.3333 THEN 'receivables' END], lambda x: x IS NOT NULL), ',') AS failures FROM l WHERE k = 1")
def financial(spark, sf_dir):
    """orders as reports; the last one filed by a date."""
    x = _reports(spark, sf_dir)
    return d.financial_ratios(x, F.lit("1997-06-30").cast("date")).select("symbol", F.array_join("failures", ",").alias("failures"))


def _reports(spark, sf_dir):
    t = F.col("o_totalprice")
    return b.table(spark, sf_dir, "orders").select(_text("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("filing_date"), F.col("o_orderkey").alias("report_date"), (t % 977).alias("debt"), (t % 389).alias("cash"), (t % 211).alias("receivables"), F.when(F.col("o_orderkey") % 10 != 0, 1000.0).alias("market_cap"))


@query("q_verification", "WITH r AS (SELECT CAST(o_custkey AS VARCHAR) AS symbol, o_orderdate AS dt, o_orderkey, o_totalprice % 977 AS debt, o_totalprice % 389 AS cash, o_totalprice % 211 AS rec, CASE WHEN o_orderkey % 10 <> 0 THEN 1000.0 END AS cap FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1997-06-30'), l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC, o_orderkey DESC) AS k FROM r), f AS (SELECT symbol, coalesce(debt / cap, 9) > 0.3333 OR coalesce(cash / cap, 9) > 0.3333 OR coalesce(rec / cap, 9) > 0.3333 AS bad FROM l WHERE k = 1), a AS (SELECT CAST(c_custkey AS VARCHAR) AS symbol, c_custkey % 4 = 0 AND c_custkey % 12 <> 0 AS ok FROM customer) SELECT verdict, count(*) AS symbols FROM (SELECT CASE WHEN a.ok THEN 'ATTESTED' WHEN f.bad IS NULL THEN 'NO_DATA' WHEN NOT f.bad THEN 'PASSED' ELSE 'FAILED' END AS verdict FROM a FULL JOIN f USING (symbol)) GROUP BY 1")
def verification(spark, sf_dir):
    """Reports and attestations of customers as of 1997-06-30."""
    k = F.col("c_custkey")
    a = b.table(spark, sf_dir, "customer").select(_text("c_custkey").alias("symbol"), F.when(k % 4 == 0, "valid").otherwise("pending").alias("status"), F.when(k % 12 == 0, F.lit("1997-01-01").cast("date")).alias("expires"), F.lit("1997-01-01").cast("date").alias("issued"))
    return d.verification(_reports(spark, sf_dir), a, F.lit("1997-06-30").cast("date")).groupBy("verdict").agg(F.count("*").alias("symbols"))


@query("d_views", "SELECT p_partkey AS symbol, round(greatest(-1, least(1, (0.5 * (p_size / 25.0 - 1) + 0.3 * coalesce(CASE WHEN p_partkey % 3 <> 0 THEN 0.4 END, 0) + 0.2 * 0.1) * (1 - 0.5 * (p_retailprice % 100 / 100)))), 6) AS view FROM part")
def views(spark, sf_dir):
    """F23, D13."""
    x = b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol"), d.asset_view(F.col("p_size") / 25.0 - 1, F.when(F.col("p_partkey") % 3 != 0, 0.4), F.lit(0.1), F.col("p_retailprice") % 100 / 100).alias("view"))
    return shown(x, ["symbol"], ["view"])


@query("d_intents", "WITH t AS (SELECT p_partkey AS s, p_size / 100.0 AS w FROM part WHERE p_partkey % 3 <> 0), h AS (SELECT p_partkey AS s, p_partkey % 50 / 100.0 AS w FROM part WHERE p_partkey % 4 <> 0), x AS (SELECT coalesce(t.w, 0) - coalesce(h.w, 0) AS x FROM t FULL JOIN h ON t.s = h.s) SELECT CASE WHEN x > 0.015 THEN 'BUY' WHEN x < -0.015 THEN 'SELL' ELSE 'HOLD' END AS intent, count(*) AS n FROM x GROUP BY 1")
def intents(spark, sf_dir):
    """parts' sizes as target weights against held ones."""
    x = b.table(spark, sf_dir, "part")
    plan = x.filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("symbol"), (F.col("p_size") / 100.0).alias("weight"))
    held = x.filter("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("symbol"), (F.col("p_partkey") % 50 / 100.0).alias("weight"))
    return d.intents(plan, held, 0.015).groupBy("intent").agg(F.count("*").alias("n"))


@query("d_readiness", "SELECT c.n AS customers, s.n AS suppliers, CASE WHEN s.n < 1000000 THEN 'suppliers' ELSE '' END AS blockers, s.n >= 1000000 AS ready FROM (SELECT count(*) AS n FROM customer) c, (SELECT count(*) AS n FROM supplier) s")
def ready(spark, sf_dir):
    """Counts of tables against gates."""
    c = b.table(spark, sf_dir, "customer").agg(F.count("*").alias("customers")).crossJoin(b.table(spark, sf_dir, "supplier").agg(F.count("*").alias("suppliers")))
    return d.readiness(c, {"customers": 10, "suppliers": 1_000_000}).withColumn("blockers", F.array_join("blockers", ","))


@query("d_ledger", D + ", x AS (SELECT symbol, close AS nav, close - lag(close) OVER (PARTITION BY symbol ORDER BY ts) - (CASE WHEN rn % 50 = 0 THEN 1.0 ELSE 0.0 END) AS pnl, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS b FROM bars) SELECT symbol AS account, count(*) AS days, CAST(sum(CAST(abs(nav - b - pnl) > 1e-7 AS BIGINT)) AS BIGINT) AS off, round(max(abs(nav - b - pnl)), 6) AS largest FROM x GROUP BY 1")
def ledger(spark, sf_dir):
    """Closes as net values; every fiftieth result is booked one too low."""
    x = w.indexed(b.daily_bars(spark, sf_dir))
    x = x.select(F.col("symbol").alias("account"), F.col("ts").alias("date"), F.col("close").alias("nav"), (F.col("close") - w.lag("close") - F.when(F.col("rn") % 50 == 0, 1.0).otherwise(0.0)).alias("pnl"))
    return shown(d.ledger_audit(x), ["account"], ["days", "off", "largest"])


_SCREEN = "WITH s AS (SELECT p_partkey AS symbol, p_retailprice / 100 AS price, p_partkey * 40000.0 AS vol, p_retailprice * p_size * 1e6 AS cap, p_size / 5.0 - 5 AS d1, p_partkey % 11 - 4.0 AS d5, CASE WHEN p_partkey % 4 <> 0 THEN p_size - 20.0 END AS eps FROM part)"


@query("d_screens", _SCREEN + """, r AS (SELECT s.*, q.name, q.k, q.bonus FROM s JOIN (VALUES ('CORE_MOMENTUM', 0, 2.0), ('GEM_QUALITY', 1, 4.0), ('TACTICAL_MOMENTUM', 2, 3.0), ('TACTICAL_PULLBACK', 3, 3.0)) q(name, k, bonus) ON price > 5 AND vol > 300000 AND cap > 3e8 AND CASE k WHEN 0 THEN cap > 25e9 WHEN 1 THEN cap < 25e9 AND coalesce(eps > 0, false) WHEN 2 THEN d5 > 2 ELSE d1 < -2 END),
t AS (SELECT *, greatest(15, least(95, CASE WHEN k = 3 THEN 52 + least(abs(least(d1, 0)) * 4, 20) + greatest(d5, 0) * 1.25 ELSE 50 + d1 * 2 + d5 * 1.5 END)) AS tech, greatest(35, least(95, 50 + 12 * log10(greatest(vol, 1e5) / 1e5))) AS liq, CASE WHEN cap >= 25e9 THEN 72 WHEN cap >= 5e9 THEN 66 WHEN cap >= 1e9 THEN 59 ELSE 50 END AS risk, CASE WHEN eps IS NULL THEN 50 WHEN eps > 0 THEN 68 ELSE 38 END AS fund FROM r),
u AS (SELECT *, greatest(0, least(100, 0.42 * tech + 0.25 * liq + 0.18 * fund + 0.15 * risk + bonus)) AS sc FROM t), n AS (SELECT symbol, string_agg(name, ',' ORDER BY name) AS names FROM u GROUP BY symbol), z AS (SELECT u.*, names, row_number() OVER (PARTITION BY u.symbol ORDER BY sc DESC, k) AS o FROM u JOIN n ON n.symbol = u.symbol)
SELECT symbol, name AS screener, names AS screeners, round(sc, 6) AS research_score, round(tech, 6) AS technical FROM z WHERE o = 1 ORDER BY sc DESC, tech DESC, liq DESC, symbol DESC LIMIT 200""")
def screens(spark, sf_dir):
    """Parts as securities; a top-200 report."""
    k, s = F.col("p_partkey"), F.col("p_size")
    x = b.table(spark, sf_dir, "part").select(k.alias("symbol"), (F.col("p_retailprice") / 100).alias("price"), (k * 40000.0).alias("average_volume"), (F.col("p_retailprice") * s * 1e6).alias("market_cap"), (s / 5.0 - 5).alias("daily_return"), (k % 11 - 4.0).alias("five_day_return"), F.when(k % 4 != 0, s - 20.0).alias("earnings_share"))
    out = d.merged_screens(d.screener_rows(x), 200).withColumn("screeners", F.array_join("screeners", ","))
    return shown(out, ["symbol", "screener", "screeners"], ["research_score", "technical"])


@query("q_hydration", D + ", u AS (SELECT symbol FROM bars GROUP BY 1 HAVING count(*) >= 585 AND date_diff('day', max(ts), DATE '1998-12-10') <= 20) SELECT CAST(s_suppkey AS VARCHAR) AS symbol FROM supplier WHERE CAST(s_suppkey AS VARCHAR) NOT IN (SELECT symbol FROM u)")
def hydration(spark, sf_dir):
    """Suppliers whose stored bars do not suffice."""
    return d.to_hydrate(b.table(spark, sf_dir, "supplier").select(_text("s_suppkey").alias("symbol")), b.daily_bars(spark, sf_dir), 585, "1998-12-10", 20)


_STRENGTH = "greatest(CASE WHEN v > 0 THEN 0.15 ELSE 0.0 END, least(1.6, ln(1 + v / 25000.0) / 3.0))"


@query("f_insider_strength", f"""WITH e AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'P' WHEN 'F' THEN 'S' ELSE 'A' END AS code, o_totalprice AS v, o_custkey % 8 AS r, o_orderkey % 3 = 0 AS direct, o_orderpriority = '1-URGENT' AS plan, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 40 / 100.0 END AS fr, o_orderkey % 13 = 0 AS der FROM orders)
SELECT o_orderkey, round(CASE WHEN code = 'A' OR der THEN 0 ELSE CASE code WHEN 'P' THEN 1 ELSE -1 END * [1.5, 1.4, 1.3, 1.25, 1.15, 1.0, 0.8, 0.7][r + 1] * CASE WHEN direct THEN 1 ELSE 0.7 END * CASE WHEN plan AND code = 'S' THEN 0.35 WHEN plan THEN 0.7 ELSE 1 END * (0.75 * {_STRENGTH} + 0.25 * greatest(0, least(1.5, coalesce(fr, 0) * 5))) END, 6) AS strength,
round(CASE code WHEN 'P' THEN greatest(0.15, least(1.5, ln(1 + v / 100000.0) / 3.5)) * CASE WHEN r IN (0, 1) THEN 1.25 WHEN r = 5 THEN 1.1 ELSE 1 END WHEN 'S' THEN -greatest(0.15, least(1.5, ln(1 + v / 100000.0) / 3.5)) * CASE WHEN plan THEN 0.1 ELSE 1 END ELSE 0 END, 6) AS economic FROM e""")
def strength(spark, sf_dir):
    """orders as insider trades."""
    o, k = b.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    code = F.when(F.col("o_orderstatus") == "O", "P").when(F.col("o_orderstatus") == "F", "S").otherwise("A")
    role = F.element_at(F.array(*map(F.lit, g.ROLE_WEIGHTS)), (F.col("o_custkey") % 8 + 1).cast("int"))
    plan, value = F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice")
    x = o.select("o_orderkey", g.insider_strength(code, role, k % 13 == 0, k % 3 == 0, plan, value, F.when(k % 4 != 0, k % 40 / 100.0), F.lit(None).cast("double")).alias("strength"), g.economic_strength(code, role, plan, value, F.lit(0.0)).alias("economic"))
    return shown(x, ["o_orderkey"], ["strength", "economic"])


@query("f_source_quality", "WITH x AS (SELECT source, lang, count(*) AS n, avg(CASE WHEN text IS NOT NULL THEN 1.0 ELSE 0 END) AS c FROM documents GROUP BY 1, 2) SELECT source, lang, round((c + 0.5 + least(1, n / 100.0) + 1 + CASE lang WHEN 'en' THEN 1.0 WHEN 'de' THEN 0.75 ELSE 0.5 END) / 5, 6) AS quality FROM x")
def source_quality(spark, sf_dir):
    """sources by completeness, size and an authority by language."""
    x = b.table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.avg(F.col("text").isNotNull().cast("double")).alias("c"))
    who = n.authority(F.when(F.col("lang") == "en", "fred").when(F.col("lang") == "de", "rss").otherwise(F.col("lang")))
    return shown(x.withColumn("quality", n.source_quality(F.col("c"), F.lit(0.5), F.least(F.lit(1.0), F.col("n") / 100.0), F.lit(1.0), who)), ["source", "lang"], ["quality"])


@query("n_links", "WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(coalesce(text, ''), '[\\pL\\pN_]+')) AS ws, 'S' || doc_id % 4 AS told FROM documents), u AS (SELECT 'S0' AS symbol, 'token' AS alias, 'x' AS sector UNION ALL SELECT 'S1', 'stupid', 'y' UNION ALL SELECT 'S2', 'the', 'y'), a AS (SELECT doc_id, symbol, sector, list_contains(ws, alias) AS named, told = symbol AS told FROM w CROSS JOIN u) SELECT doc_id AS id, coalesce(string_agg(symbol, ',' ORDER BY symbol) FILTER (named), '') AS text_linked, coalesce(string_agg(symbol, ',' ORDER BY symbol) FILTER (NOT named AND told), '') AS provider_only FROM a WHERE named OR told GROUP BY 1")
def links(spark, sf_dir):
    """Documents linked to three symbols by words and by their provider's list; a fourth symbol lies outside the universe."""
    x = b.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("").alias("title"), F.coalesce("text", F.lit("")).alias("summary"), F.array(F.concat(F.lit("S"), (F.col("doc_id") % 4).cast("string"))).alias("symbols"))
    u = spark.createDataFrame([("S0", "token", "x"), ("S1", "stupid", "y"), ("S2", "the", "y")], "symbol string, alias string, sector string")
    return n.linked_symbols(x, u).select("id", F.array_join("text_linked", ",").alias("text_linked"), F.array_join("provider_only", ",").alias("provider_only"))


@query("t_median_seed", T + f" SELECT symbol, trade_id AS seed, round(n, 6) AS score FROM (SELECT *, {_NET} AS n, row_number() OVER (PARTITION BY symbol ORDER BY {_NET}, trade_id) AS i, count(*) OVER (PARTITION BY symbol) AS c FROM trades) WHERE i = c // 2 + 1")
def seeds(spark, sf_dir):
    """Trades of a customer as seeds."""
    x = b.trades(spark, sf_dir).select("symbol", F.col("trade_id").alias("seed"), m.net_return(F.col("gross_return"), 3.0).alias("score"))
    return shown(p.median_seed(x, "symbol", "score", "seed"), ["symbol", "seed"], ["score"])


@query("v_validation_score", T + """, x AS (SELECT symbol, count(*) AS n, avg(gross_return) AS m, stddev_samp(gross_return) AS s, sum(CASE WHEN gross_return > 0 THEN gross_return ELSE 0 END) / nullif(-sum(CASE WHEN gross_return < 0 THEN gross_return ELSE 0 END), 0) AS pf, 0.1 * min(gross_return) AS dd, sum(entry_price) AS t FROM trades GROUP BY 1),
y AS (SELECT symbol, n, coalesce(m, -1) AS cagr, coalesce(m / nullif(s, 0), -10) AS sh, coalesce(pf, 0) AS pf, coalesce(dd, -1) AS dd, t FROM x),
z AS (SELECT *, array_to_string(list_filter([CASE WHEN n < 8 THEN 'MINIMUM_VALIDATION_TRADES' END, CASE WHEN cagr <= 0 THEN 'VALIDATION_CAGR_NOT_POSITIVE' END, CASE WHEN pf <= 1 THEN 'VALIDATION_PF_NOT_ABOVE_ONE' END, CASE WHEN dd < -0.08 THEN 'VALIDATION_DRAWDOWN_GATE' END], lambda q: q IS NOT NULL), ',') AS failures,
greatest(-3, least(3, sh)) + greatest(-3, least(3, -10)) + ln(greatest(pf, 1e-9)) + 0.25 * 0.5 - 2 * greatest(abs(dd) - 0.2, 0) - 0.01 * t / 100000 - 0.5 * 0.4 - greatest(8 - n, 0) / 8.0 AS s FROM y) SELECT symbol, failures, round(CASE WHEN failures = '' THEN s END, 6) AS score FROM z""")
def validation(spark, sf_dir):
    """F32: customers' trades as results; the score where every gate holds."""
    r = F.col("gross_return")
    x = b.trades(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("trade_count"), F.avg(r).alias("cagr"), (F.avg(r) / F.nullif(F.stddev_samp(r), F.lit(0.0))).alias("sharpe"), (F.sum(F.when(r > 0, r).otherwise(0.0)) / F.nullif(-F.sum(F.when(r < 0, r).otherwise(0.0)), F.lit(0.0))).alias("daily_profit_factor"), (0.1 * F.min(r)).alias("maximum_drawdown"), F.sum("entry_price").alias("turnover"))
    x = x.withColumns({"calmar": F.lit(None).cast("double"), "positive_year_ratio": F.lit(0.5), "security_weight": F.lit(0.4), "sector_weight": F.lit(0.3)})
    x = x.select("symbol", *[c.alias(k) for k, c in m.validation_score(8, -0.08).items()])
    return shown(x.withColumn("score", F.when(F.size("failures") == 0, F.col("score"))).withColumn("failures", F.array_join("failures", ",")), ["symbol", "failures"], ["score"])


@query("v_verdicts", T + f", x AS (SELECT year(exit_time) AS fold, hypothesis_id AS variant, avg({_NET}) AS s FROM trades GROUP BY 1, 2) SELECT CAST(x.fold AS BIGINT) AS fold, x.variant, CASE WHEN x.s - z.s > 0.01 THEN 'IMPROVES' WHEN x.s - z.s < -0.01 THEN 'HURTS' ELSE 'NEUTRAL' END AS verdict FROM x JOIN x z ON z.fold = x.fold AND z.variant = '1-URGENT' WHERE x.variant <> '1-URGENT'")
def verdicts(spark, sf_dir):
    """Order priorities as variants against the first, by year."""
    x = m.trade_metrics(b.trades(spark, sf_dir).select("*", F.year("exit_time").cast("long").alias("fold"), F.col("hypothesis_id").alias("variant")), ["fold", "variant"])
    return v.classified_against(x, "1-URGENT", "net_expectancy", ["fold"], 0.01).select("fold", "variant", "verdict")


@query("v_promotion", T + f", x AS (SELECT symbol, year(exit_time) AS fold, avg({_NET}) AS e FROM trades GROUP BY 1, 2), f AS (SELECT symbol, count(*) AS n, avg(CASE WHEN e > 0 THEN 1.0 ELSE 0 END) AS pos, min(e) AS worst FROM x GROUP BY 1) SELECT verdict, count(*) AS symbols FROM (SELECT CASE WHEN CAST(symbol AS BIGINT) % 9 = 0 THEN 'REPLAY_MISMATCH' WHEN n >= 3 AND pos >= 0.75 AND worst > 0 THEN 'VALIDATED' WHEN n >= 2 AND pos >= 0.5 THEN 'RESEARCH' ELSE 'REJECTED' END AS verdict FROM f) GROUP BY 1")
def promotion(spark, sf_dir):
    """Customers as hypotheses; every ninth replays badly."""
    f = m.fold_summary(m.trade_metrics(b.trades(spark, sf_dir).withColumn("fold", F.year("exit_time")), ["symbol", "fold"]), "symbol", "net_expectancy", 1)
    x = v.promotion(F.col("folds"), F.col("positive_ratio"), F.col("worst"), F.when(F.col("symbol").cast("long") % 9 == 0, 0.5).otherwise(1.0))
    return f.select(x.alias("verdict")).groupBy("verdict").agg(F.count("*").alias("symbols"))


@query("v_evidence", "WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), z AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) SELECT c_custkey AS hypothesis_id, CAST(coalesce(a.n, 0) AS BIGINT) AS orders_rows, CASE WHEN a.n IS NULL THEN 'MISSING' ELSE 'P' END AS orders_status, CAST(coalesce(a.n, 0) = 1 AND coalesce(z.n, 0) = 1 AS BIGINT) AS complete FROM customer LEFT JOIN a ON a.k = c_custkey LEFT JOIN z ON z.k = c_custkey")
def evidence(spark, sf_dir):
    """Customers with two evidence tables."""
    base = b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("hypothesis_id"))
    o = b.table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("hypothesis_id"), F.col("o_orderstatus").alias("status"))
    s = b.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("hypothesis_id"), F.lit("OK").alias("status"))
    return shown(v.merged_evidence(base, {"orders": o, "suppliers": s}, "hypothesis_id"), ["hypothesis_id", "orders_status"], ["orders_rows", "complete"])


@query("j_chosen", D + " SELECT symbol, count(*) AS bars, count(DISTINCT date_trunc('month', ts)) AS months FROM bars WHERE symbol IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_nationkey < 12) GROUP BY 1")
def chosen(spark, sf_dir):
    """Bars of chosen suppliers, with distinct months."""
    ids = b.table(spark, sf_dir, "supplier").filter("s_nationkey < 12").select(_text("s_suppkey").alias("symbol"))
    return j.chosen(b.daily_bars(spark, sf_dir), ids, "symbol").groupBy("symbol").agg(F.count("*").alias("bars"), F.count_distinct(F.trunc("ts", "MM")).alias("months"))


_SCORED, _LAST = sig.layered(D, "bars", [sig.BASE, sig.NEXT, *sig.rsi(14), *sig.macd(12, 26, 9), {"ret": "close / nullif(pc, 0) - 1"}, {"sd": sig.moving("stddev_pop", "ret", 20)}])


@query("d_technical", _SCORED + f" SELECT symbol, round(greatest(-1, least(1, 0.4 * tanh(10 * ret) + 0.3 * tanh((r - 50) / 20) + 0.3 * tanh(100 * hist) - 0.2 * tanh(10 * sd))), 6) AS score FROM (SELECT *, max(rn) OVER (PARTITION BY symbol) AS n FROM {_LAST}) WHERE rn = n")
def technical(spark, sf_dir):
    """Features of each symbol's last bar, scored."""
    x = w.macd(w.rsi(w.indexed(b.daily_bars(spark, sf_dir)), "r", 14)).withColumn("ret", w.pct_change("close")).withColumn("sd", w.rolling_std("ret", 20))
    last = x.groupBy("symbol").agg(F.max_by(F.struct("ret", "r", "macd_hist", "sd"), "rn").alias("x")).select("symbol", "x.*")
    return shown(last.select("symbol", d.technical_score(F.col("ret"), F.col("r"), F.col("macd_hist"), F.col("sd")).alias("score")), ["symbol"], ["score"])


@query("g_forms", "SELECT family, count(*) AS n FROM (SELECT CASE page_id % 8 WHEN 0 THEN 'insider' WHEN 1 THEN 'insider' WHEN 2 THEN 'notice' WHEN 3 THEN 'institution' WHEN 4 THEN 'ownership' WHEN 5 THEN 'ownership' WHEN 6 THEN 'current' ELSE 'other' END AS family FROM pages) GROUP BY 1")
def forms(spark, sf_dir):
    """G06."""
    name = F.element_at(F.array(*map(F.lit, ["4", "3/A", "144", "13F-HR/A", "SC 13D", "SCHEDULE 13G/A", "8-K", "10-Q"])), (F.col("page_id") % 8 + 1).cast("int"))
    return b.table(spark, sf_dir, "pages").select(g.form_family(name).alias("family")).groupBy("family").agg(F.count("*").alias("n"))


@query("g_effective", "WITH f AS (SELECT o_custkey AS manager, year(o_orderdate) AS period, o_orderkey AS a, o_orderdate AS dt, CASE o_orderstatus WHEN 'O' THEN NULL WHEN 'F' THEN 'RESTATEMENT' ELSE 'NEW HOLDINGS' END AS am FROM orders), s AS (SELECT *, row_number() OVER (PARTITION BY manager, period ORDER BY dt, a) AS s FROM f), r AS (SELECT *, coalesce(max(CASE WHEN am IS NULL OR am = 'RESTATEMENT' THEN s END) OVER (PARTITION BY manager, period), 0) AS r FROM s) SELECT manager, CAST(period AS BIGINT) AS period, a AS accession FROM r WHERE s >= r")
def effective(spark, sf_dir):
    """Orders as filings of managers."""
    kind = F.when(F.col("o_orderstatus") == "F", "RESTATEMENT").when(F.col("o_orderstatus") == "P", "NEW HOLDINGS")
    f = b.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("manager"), F.year("o_orderdate").cast("long").alias("period"), F.col("o_orderkey").alias("accession"), F.col("o_orderdate").alias("accepted_at"), kind.alias("amendment"))
    return g.effective_filings(f).select("manager", "period", "accession")


@query("g_overlay", "SELECT p_partkey, round(CASE WHEN p_partkey % 6 = 0 THEN least(s, -0.35) ELSE s END, 6) AS overlay FROM (SELECT p_partkey, greatest(-1, least(1, 0.55 * (p_size / 25.0 - 1) + 0.15 * coalesce(CASE WHEN p_partkey % 2 = 0 THEN 0.5 END, 0) + 0.05 * -1)) AS s FROM part)")
def overlay(spark, sf_dir):
    """F24, G10, G12."""
    x = b.table(spark, sf_dir, "part")
    return shown(x.select("p_partkey", g.overlay({"insider": F.col("p_size") / 25.0 - 1, "notice": F.when(F.col("p_partkey") % 2 == 0, 0.5), "current": F.lit(-1.0)}, F.col("p_partkey") % 6 == 0).alias("overlay")), ["p_partkey"], ["overlay"])


def _xml(tag, *parts):
    return F.concat(F.lit(f"<{tag}>"), *parts, F.lit(f"</{tag}>"))


def _orders_xml(spark, sf_dir, row, outer, more=None):
    """Line items of an order as one XML text."""
    li = b.table(spark, sf_dir, "lineitem").withColumn("row", row)
    body = li.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "row"))), lambda x: x["row"]), "").alias("rows"))
    o = b.table(spark, sf_dir, "orders").join(body, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.select(F.col("o_orderkey").alias("accession"), _text("o_custkey").alias("symbol"), F.col("o_orderdate").alias("accepted_at"), _xml(outer, *([more] if more is not None else []), F.col("rows")).alias("content"))


@query("g_transactions_xml", "WITH x AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 'S' ELSE 'P' END AS c, l_quantity AS q, round(l_extendedprice, 2) AS p, CASE WHEN l_orderkey % 2 = 0 THEN 2 ELSE 1 END AS n FROM lineitem) SELECT CAST(o_custkey AS VARCHAR) AS symbol, c AS transaction_code, CAST(sum(n) AS BIGINT) AS events, round(sum(q), 4) AS shares, round(sum(q * p), 2) AS value_usd FROM x JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2")
def transactions_xml(spark, sf_dir):
    """Orders as Form 4 documents, every second one with two owners."""
    t = _xml("nonDerivativeTransaction", _xml("transactionDate", _xml("value", F.date_format("l_shipdate", "yyyy-MM-dd"))), _xml("transactionCoding", _xml("transactionCode", F.when(F.col("l_returnflag") == "R", "S").otherwise("P"))),
             _xml("transactionAmounts", _xml("transactionShares", _xml("value", _text("l_quantity"))), _xml("transactionPricePerShare", _xml("value", F.format_string("%.2f", "l_extendedprice")))))
    owner = _xml("reportingOwner", _xml("reportingOwnerId", _xml("rptOwnerCik", F.lit("1"))))
    two = F.when(F.col("o_orderkey") % 2 == 0, F.concat(owner, owner)).otherwise(owner)
    e = g.transactions_xml(_orders_xml(spark, sf_dir, t, "ownershipDocument", two))
    return shown(e.groupBy("symbol", "transaction_code").agg(F.count("*").alias("events"), F.sum("shares").alias("shares"), F.sum("value_usd").alias("value_usd")).withColumn("value_usd", F.round("value_usd", 2)), ["symbol", "transaction_code"], ["events", "shares", "value_usd"], 4)


@query("g_holdings_xml", "SELECT l_partkey % 50 AS cusip, count(*) AS rows, round(sum(round(l_extendedprice) * 1000), 2) AS value_usd, round(sum(l_quantity), 2) AS shares FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def holdings_xml(spark, sf_dir):
    """Orders as 13F tables; their values are in thousands, as all dates lie before 2023."""
    t = _xml("infoTable", _xml("cusip", _text("l_partkey").cast("long") % 50), _xml("value", F.format_string("%.0f", F.round("l_extendedprice"))), _xml("shrsOrPrnAmt", _xml("sshPrnamt", _text("l_quantity"))))
    e = g.holdings_xml(_orders_xml(spark, sf_dir, t, "informationTable"))
    return shown(e.groupBy(F.col("cusip").cast("long").alias("cusip")).agg(F.count("*").alias("rows"), F.sum("value_usd").alias("value_usd"), F.sum("shares").alias("shares")), ["cusip"], ["rows", "value_usd", "shares"], 2)


@query("g_notices_xml", "WITH x AS (SELECT DISTINCT l_orderkey, l_quantity, CAST(l_shipdate AS DATE) AS d FROM lineitem) SELECT CAST(o_custkey AS VARCHAR) AS symbol, count(*) AS sales, round(sum(l_quantity), 2) AS shares FROM x JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def notices_xml(spark, sf_dir):
    """Orders as Form 144, each block twice."""
    t = _xml("securitiesInformation", _xml("noOfUnitsSold", _text("l_quantity")), _xml("aggregateMarketValue", F.lit("1,000")), _xml("approxSaleDate", F.date_format("l_shipdate", "MM/dd/yyyy")))
    e = g.notices_xml(_orders_xml(spark, sf_dir, F.concat(t, t), "edgarSubmission"))
    return shown(e.groupBy("symbol").agg(F.count("*").alias("sales"), F.sum("shares").alias("shares")), ["symbol"], ["sales", "shares"], 2)


@query("g_owners_xml", "SELECT CAST(o_custkey AS VARCHAR) AS symbol, count(*) AS persons, round(sum(o_orderkey % 10 / 2.0), 4) AS percent, round(sum(l_quantity), 2) AS shares FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def owners_xml(spark, sf_dir):
    """Orders as 13D with a person for each line item; one percentage serves all."""
    t = F.concat(_xml("reportingPersonName", _text("l_linenumber")), _xml("aggregateAmountOwned", _text("l_quantity")))
    e = g.owners_xml(_orders_xml(spark, sf_dir, t, "edgarSubmission", _xml("percentOfClass", (F.col("o_orderkey") % 10 / 2.0).cast("string"))))
    return shown(e.groupBy("symbol").agg(F.count("*").alias("persons"), F.sum("percent_owned").alias("percent"), F.sum("shares").alias("shares")), ["symbol"], ["persons", "percent", "shares"], 4)


@query("g_resolved", "SELECT CAST(CASE WHEN l_partkey % 3 = 0 THEN l_partkey WHEN l_suppkey % 2 = 0 THEN l_suppkey + 1000000 END AS VARCHAR) AS symbol, count(*) AS rows FROM lineitem GROUP BY 1")
def resolved(spark, sf_dir):
    """Line items' parts as cusips, suppliers as ciks."""
    li = b.table(spark, sf_dir, "lineitem").select(_text("l_partkey").alias("cusip"), _text("l_suppkey").alias("cik"))
    by_part = b.table(spark, sf_dir, "part").filter("p_partkey % 3 = 0").select(_text("p_partkey").alias("symbol"), _text("p_partkey").alias("cusip"), F.lit(None).cast("string").alias("cik"))
    by_supplier = b.table(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").select((F.col("s_suppkey") + 1_000_000).cast("string").alias("symbol"), F.lit(None).cast("string").alias("cusip"), _text("s_suppkey").alias("cik"))
    return g.resolved_securities(li, by_part.unionByName(by_supplier)).groupBy("symbol").agg(F.count("*").alias("rows"))


@query("q_filing_snapshot", _PAGE.replace(", p AS (", ", pg AS (").replace("\np AS (", "\npg AS (") + ", p AS (SELECT page_id, CAST(page_id % 20 AS VARCHAR) AS symbol, page_id % 8 AS f, page_id % 5 AS i FROM pages WHERE page_id <= 150), k AS (SELECT * FROM p WHERE page_id NOT IN (SELECT page_id - 20 FROM p WHERE page_id % 7 = 0)), n AS (SELECT symbol, count(*) AS filings, count(*) FILTER (f < 2) AS insider, count(*) FILTER (f = 6) AS current FROM k GROUP BY 1), s AS (SELECT symbol, tanh(sum(m * d)) AS score FROM pg WHERE page_id <= 150 GROUP BY 1) SELECT n.symbol, filings, insider, current, round(score, 6) AS score FROM n LEFT JOIN s USING (symbol)")
def snapshot(spark, sf_dir):
    """Pages as filings of 20 symbols as of page 150; every seventh amends the one of 20 pages before."""
    from .q_text import PHRASES, _filings

    f = _filings(spark, sf_dir)
    k = F.col("accession").cast("long")
    name = F.element_at(F.array(*map(F.lit, ["4", "3/A", "144", "13F-HR/A", "SC 13D", "SCHEDULE 13G/A", "8-K", "10-Q"])), (k % 8 + 1).cast("int"))
    f = f.withColumn("form_type", name).withColumn("amends_accession", F.when(k % 7 == 0, (k - 20).cast("string")))
    as_of = F.timestamp_seconds(F.lit(1704067200 + 150 * 3600))
    return shown(g.universe_snapshot(f, g.item_events(f, PHRASES), as_of), ["symbol"], ["filings", "insider", "current", "score"])
