"""Queries of news, filings and order flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filings as g
from ..operators import flow as o
from ..operators import news as n
from . import bindings as b
from .registry import query, shown

N = b.with_sql("news")
NOW = 1704067200 + 720 * 3600
POS, NEG = ["the", "and", "que", "der"], ["of", "in", "en", "die"]
#: Letters beyond ASCII count as letters of a word here, as they do in Java's patterns.
_PLAIN = lambda c: f"regexp_replace(lower({c}), '[^\\x00-\\x7F]', 'x', 'g')"
_LEX = lambda c: f"tanh((len(regexp_extract_all({_PLAIN(c)}, '\\b(the|and|que|der)\\b')) - len(regexp_extract_all({_PLAIN(c)}, '\\b(of|in|en|die)\\b'))) / 3.0)"


@query("f_title_tokens", N + " SELECT id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda x: len(x) > 2))) AS tokens FROM news")
def tokens(spark, sf_dir):
    """F04."""
    return b.news(spark, sf_dir).select("id", F.array_sort(n.title_tokens(F.col("title"))).alias("tokens"))


@query("f_stable_id", N + " SELECT id, substr(sha256(provider || '|' || title), 1, 24) AS item_id FROM news")
def ids(spark, sf_dir):
    """F05, S12."""
    return b.news(spark, sf_dir).select("id", n.stable_id(F.col("provider"), F.col("title")).alias("item_id"))


@query("f_event_type", N + ", x AS (SELECT id, CAST(contains(lower(summary), 'password') AS INT) + CAST(contains(lower(summary), 'token') AS INT) AS a, CAST(contains(lower(summary), 'license') AS INT) + CAST(contains(lower(summary), 'copyright') AS INT) AS z FROM news) SELECT id, CASE WHEN a = 0 AND z = 0 THEN 'other' WHEN a >= z THEN 'secret' ELSE 'license' END AS type FROM x")
def types(spark, sf_dir):
    """F11."""
    return b.news(spark, sf_dir).select("id", n.event_type(F.col("summary"), {"secret": ["password", "token"], "license": ["license", "copyright"]}).alias("type"))


@query("f_decay", N + f" SELECT id, round(exp(-ln(2.0) * ({NOW} - published) / 3600.0 / 18.0), 6) AS half, round(greatest(0.05, least(1.0, exp(-ln(2.0) * greatest(0, ({NOW} - published) / 86400.0 - 45) / 180))), 6) AS fresh FROM news")
def decay(spark, sf_dir):
    """F14."""
    age = F.lit(NOW) - F.col("published")
    return shown(b.news(spark, sf_dir).select("id", n.half_life(age / 3600.0).alias("half"), n.freshness(age / 86400.0).alias("fresh")), ["id"], ["half", "fresh"])


_TITLED = N.replace("WITH ", "WITH RECURSIVE ", 1) + """, k AS (SELECT id, published, provider, summary, list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda x: len(x) > 2)) AS t, row_number() OVER (ORDER BY published, id) AS k FROM news),
r AS (SELECT k, id, id AS leader, CASE WHEN len(t) > 0 THEN [{'i': id, 'p': published, 't': t}] ELSE [] END AS held FROM k WHERE k = 1
  UNION ALL SELECT k, id, coalesce(hit, id), CASE WHEN hit IS NULL AND len(t) > 0 THEN list_append(h, {'i': id, 'p': published, 't': t}) ELSE h END
  FROM (SELECT *, list_filter(h, lambda q: len(list_intersect(q.t, t)) / CAST(len(list_distinct(list_concat(q.t, t))) AS DOUBLE) >= 0.72)[-1].i AS hit FROM (SELECT n.*, list_filter(r.held, lambda q: n.published - q.p <= 129600) AS h FROM r JOIN k n ON n.k = r.k + 1)))"""


@query("n_stories", _TITLED + " SELECT r.id, k.published, r.leader FROM r JOIN k ON k.k = r.k")
def stories(spark, sf_dir):
    """Leader of every item."""
    b_dir(spark)
    return n.stories(b.news(spark, sf_dir))


@query("n_evidence", _TITLED + f""", d AS (SELECT r.leader, k.*, row_number() OVER (PARTITION BY r.leader ORDER BY length(summary) DESC, published, k.id) AS o FROM r JOIN k ON k.k = r.k),
g AS (SELECT leader, max(id) FILTER (o = 1) AS representative, count(*) AS items, count(DISTINCT provider) AS p, max(published) AS last FROM d GROUP BY 1)
SELECT leader, representative, items, round(1.0 / items, 6) AS novelty, round(least(1.0, p / 3.0), 6) AS confirmation, round(exp(-greatest(0, {NOW} - last) / 3600.0 / 36.0), 6) AS decay, round(exp(-greatest(0, {NOW} - last) / 3600.0 / 36.0) * (0.5 + 0.5 * least(1.0, p / 3.0)), 6) AS score FROM g""")
def evidence(spark, sf_dir):
    """N02, Q25."""
    b_dir(spark)
    d = b.news(spark, sf_dir)
    return shown(n.story_evidence(d, n.stories(d), NOW), ["leader", "representative"], ["items", "novelty", "confirmation", "decay", "score"])


@query("n_signals", N + f""", x AS (SELECT id, published, title || ' ' || summary AS t FROM news), y AS (SELECT id, published, {_LEX('t')} AS s, unnest([{{'symbol': 'stupid', 'n': len(regexp_extract_all(t, '\\bstupid\\b'))}}, {{'symbol': 'token', 'n': len(regexp_extract_all(t, '\\btoken\\b'))}}]) AS h FROM x),
z AS (SELECT id, h.symbol AS symbol, h.n AS n, s, least(1.0, 0.4 + 0.2 * h.n) AS rel, exp(-ln(2.0) * ({NOW} - published) / 3600.0 / 18.0) AS decay FROM y WHERE h.n > 0)
SELECT id, symbol, n, round(rel, 6) AS relevance, round(s, 6) AS sentiment, round(decay, 6) AS decay, round(greatest(-1, least(1, s * rel * decay)), 6) AS score FROM z""")
def signals(spark, sf_dir):
    """Mentions of two words as symbols."""
    return shown(n.article_signals(b.news(spark, sf_dir), ["stupid", "token"], POS, NEG, NOW), ["id", "symbol"], ["n", "relevance", "sentiment", "decay", "score"])


@query("a_sentiment", N + f""", x AS (SELECT provider AS symbol, {_LEX("title || ' ' || summary")} AS s, exp(-ln(2.0) * ({NOW} - published) / 3600.0 / 18.0) AS w FROM news)
SELECT symbol, round(sum(w * s) / nullif(sum(w), 0), 6) AS sentiment, round(greatest(0, 1 - stddev_pop(s)), 6) AS agreement, round(1 - exp(-count(*) / 5.0), 6) AS confidence, count(*) AS articles FROM x GROUP BY 1""")
def sentiment(spark, sf_dir):
    """By provider."""
    d = b.news(spark, sf_dir).select(F.col("provider").alias("symbol"), n.lexicon_sentiment(F.concat_ws(" ", "title", "summary"), POS, NEG).alias("sentiment"), n.half_life((F.lit(NOW) - F.col("published")) / 3600.0).alias("weight"))
    return shown(n.aggregate_sentiment(d), ["symbol"], ["sentiment", "agreement", "confidence", "articles"])


@query("w_novelty", """WITH x AS (SELECT role, conv_id * 1000 + turn AS k, coalesce(text, '') AS t FROM conversations), n AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY k, t) AS n FROM x),
v AS (SELECT role, n, substr(md5(q), 1, 3) AS f, count(*) AS c FROM (SELECT role, n, unnest(list_filter(regexp_split_to_array(lower(t), '\\s+'), lambda q: q <> '')) AS q FROM n) GROUP BY 1, 2, 3), z AS (SELECT role, n, sqrt(sum(c * c)) AS z FROM v GROUP BY 1, 2),
p AS (SELECT a.role, a.n, max(s / (x.z * y.z)) AS s FROM (SELECT a.role, a.n, b.n AS m, sum(a.c * b.c) AS s FROM v a JOIN v b ON a.role = b.role AND a.f = b.f AND b.n < a.n AND a.n - b.n <= 128 GROUP BY 1, 2, 3) a JOIN z x ON x.role = a.role AND x.n = a.n JOIN z y ON y.role = a.role AND y.n = a.m GROUP BY 1, 2)
SELECT n.role, n.k, round(greatest(0.1, 1 - coalesce(s, 0)), 6) AS novelty FROM n LEFT JOIN p ON p.role = n.role AND p.n = n.n""")
def novelty(spark, sf_dir):
    """Conversation turns of a role, in order."""
    d = b.table(spark, sf_dir, "conversations").select("role", (F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "text")
    return shown(n.novelty(d, "role", "k"), ["role", "k"], ["novelty"])


def b_dir(spark) -> None:
    """Checkpoints go where the session says; only a session on one machine may use a local folder."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")

        spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="barflow-"))
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))


def _filings(spark, sf_dir):
    p = b.table(spark, sf_dir, "pages")
    item = F.element_at(F.array(*map(F.lit, ["1.01", "2.02", "4.02", "5.02", "8.01"])), (F.col("page_id") % 5 + 1).cast("int"))
    return p.select(F.col("page_id").cast("string").alias("accession"), (F.col("page_id") % 20).cast("string").alias("symbol"), F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 3600).alias("accepted_at"), F.concat(F.lit("Item "), item, F.lit(" "), n.html_text(F.col("html"))).alias("content"))


_HTML = "coalesce(html, '')"
for _pattern, _by in (("(?is)<script\\b.*?</script\\s*>", " "), ("(?is)<style\\b.*?</style\\s*>", " "), ("(?i)<br\\s*/?>|</(p|div|tr|li|h[1-6])\\s*>", "\n"), ("(?s)<[^>]+>", " ")):
    _HTML = f"regexp_replace({_HTML}, '{_pattern}', '{_by}', 'g')"
for _entity, _char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _HTML = f"replace({_HTML}, '{_entity}', '{_char}')"
_HTML = f"trim(regexp_replace(regexp_replace({_HTML}, '[ \\t\\r\\f]+', ' ', 'g'), ' ?\\n\\s*', '\n', 'g'))"


@query("f_html_text", f"SELECT page_id, CASE WHEN html IS NOT NULL THEN CAST(length({_HTML}) AS BIGINT) END AS chars FROM pages")
def html(spark, sf_dir):
    """F07."""
    return b.table(spark, sf_dir, "pages").select("page_id", F.length(n.html_text(F.col("html"))).cast("long").alias("chars"))


#: Phrases of the queries below; the pages' texts decide which occur.
PHRASES = [("the ", 0.3), ("que ", -0.5)]
_PAGE = f"""WITH p0 AS (SELECT CAST(page_id AS VARCHAR) AS accession, CAST(page_id % 20 AS VARCHAR) AS symbol, page_id, CASE WHEN html IS NULL THEN '8.01' ELSE ['1.01', '2.02', '4.02', '5.02', '8.01'][page_id % 5 + 1] END AS item, lower({_HTML}) AS t FROM pages),
p AS (SELECT *, CASE item WHEN '1.01' THEN 'material_agreement' WHEN '2.02' THEN 'earnings_or_financial_condition' WHEN '4.02' THEN 'nonreliance_or_restatement' WHEN '5.02' THEN 'management_or_director_change' ELSE 'other_material_event' END AS category,
  CASE item WHEN '1.01' THEN 0.7 WHEN '2.02' THEN 0.9 WHEN '4.02' THEN 1.0 WHEN '5.02' THEN 0.75 ELSE 0.6 END AS m, CASE WHEN item = '4.02' THEN least(-0.95, z) ELSE z END AS d, CASE WHEN item = '8.01' THEN 0.6 ELSE 0.9 END AS sure
  FROM (SELECT *, greatest(-1.0, least(1.0, CASE WHEN contains(t, 'the ') THEN 0.3 ELSE 0 END - CASE WHEN contains(t, 'que ') THEN 0.5 ELSE 0 END)) AS z FROM p0))"""


@query("g_items", _PAGE + " SELECT accession, symbol, item, category, round(m, 6) AS materiality, round(d, 6) AS direction, round(sure, 6) AS confidence FROM p")
def items(spark, sf_dir):
    """G05, F08, F09, F10 over pages as filings."""
    return shown(g.item_events(_filings(spark, sf_dir), PHRASES), ["accession", "symbol", "item", "category"], ["materiality", "direction", "confidence"])


@query("a_context", _PAGE + " SELECT symbol, round(tanh(sum(m * d)), 6) AS score, CAST(count(*) FILTER (m >= 0.7) AS BIGINT) AS material, CAST(bool_or(m >= 0.9 AND d <= -0.5) AS BIGINT) AS severe FROM p GROUP BY symbol")
def context(spark, sf_dir):
    """A31, F24."""
    return shown(g.context_score(g.item_events(_filings(spark, sf_dir), PHRASES)), ["symbol"], ["score", "material", "severe"])


def _insiders(spark, sf_dir):
    o_ = b.table(spark, sf_dir, "orders")
    return o_.select(F.col("o_orderkey").cast("string").alias("accession"), (F.col("o_custkey") % 40).cast("string").alias("symbol"), F.col("o_custkey").cast("string").alias("person_cik"), F.to_date("o_orderdate").alias("effective_at"), F.date_add(F.to_date("o_orderdate"), 2).alias("accepted_at"),
                     F.when(F.col("o_orderstatus") == "O", "P").otherwise("S").alias("transaction_code"), F.col("o_totalprice").alias("value_usd"), (F.col("o_totalprice") / 100).alias("shares"), (F.col("o_orderpriority") == "1-URGENT").alias("is_planned"), (F.col("o_totalprice") % 10).alias("percent_owned"))


_INS = "WITH e AS (SELECT CAST(o_orderkey AS VARCHAR) AS accession, o_orderkey, CAST(o_custkey % 40 AS VARCHAR) AS symbol, o_custkey AS person, CAST(o_orderdate AS DATE) AS eff, CAST(o_orderdate AS DATE) + 2 AS acc, CASE WHEN o_orderstatus = 'O' THEN 'P' ELSE 'S' END AS code, o_totalprice AS v, o_orderpriority = '1-URGENT' AS planned FROM orders)"


@query("a_insider_windows", _INS + ", x AS (SELECT *, date_diff('day', eff, DATE '1998-08-01') AS age FROM e WHERE acc <= DATE '1998-08-01') SELECT symbol, count(*) FILTER (age BETWEEN 0 AND 30 AND code = 'P') AS buys_30d, round(coalesce(sum(v) FILTER (age BETWEEN 0 AND 30 AND code = 'P'), 0), 6) AS buy_value_30d, count(DISTINCT CASE WHEN age BETWEEN 0 AND 30 AND code = 'P' THEN person END) AS buyers_30d, count(*) FILTER (age BETWEEN 0 AND 90 AND code = 'S') AS sells_90d, CAST(count(DISTINCT CASE WHEN age BETWEEN 0 AND 30 AND code = 'P' THEN person END) >= 3 AS BIGINT) AS cluster_buying FROM x GROUP BY symbol")
def insiders(spark, sf_dir):
    """Orders as insider trades, as of 1998-08-01."""
    return shown(g.insider_windows(_insiders(spark, sf_dir), F.lit("1998-08-01").cast("date")), ["symbol"], ["buys_30d", "buy_value_30d", "buyers_30d", "sells_90d", "cluster_buying"])


@query("a_transactions", _INS + " SELECT symbol, CAST(eff AS VARCHAR) AS effective_at, code AS transaction_code, count(*) AS parts, round(sum(v), 6) AS value_usd, CAST(bool_or(planned) AS BIGINT) AS is_planned FROM e GROUP BY 1, 2, 3")
def transactions(spark, sf_dir):
    """A26."""
    return shown(g.merged_transactions(_insiders(spark, sf_dir), ["symbol", "effective_at", "transaction_code"]), ["symbol", "effective_at", "transaction_code"], ["parts", "value_usd", "is_planned"])


@query("a_latest_version", _INS + " SELECT symbol, CAST(eff AS VARCHAR) AS effective_at, accession FROM (SELECT *, row_number() OVER (PARTITION BY symbol, eff ORDER BY acc DESC, accession DESC) AS k FROM e) WHERE k = 1")
def latest(spark, sf_dir):
    """A27, S16."""
    return shown(g.latest_version(_insiders(spark, sf_dir), ["symbol", "effective_at"]), ["symbol", "effective_at", "accession"], [])


@query("w_streak", _INS + ", x AS (SELECT *, sum(CASE WHEN code <> 'P' THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY eff DESC, accession DESC ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT symbol, count(*) FILTER (k = 0) AS streak FROM x GROUP BY symbol")
def streak(spark, sf_dir):
    """W46."""
    return g.streak(_insiders(spark, sf_dir), ["symbol"])


@query("a_ownership", "WITH e AS (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS accession, CAST(o_custkey % 40 AS VARCHAR) AS symbol, o_custkey AS person, CAST(o_orderdate AS DATE) AS acc, o_totalprice % 10 AS p FROM orders), x AS (SELECT *, lag(p) OVER (PARTITION BY symbol, person ORDER BY acc, accession) AS q, row_number() OVER (PARTITION BY symbol, person ORDER BY acc DESC, accession DESC) AS k FROM e) SELECT symbol, round(sum(p - coalesce(q, 0)), 6) AS delta, round(sum(p), 6) AS percent, count(*) AS holders FROM x WHERE k = 1 GROUP BY symbol")
def ownership(spark, sf_dir):
    """A28."""
    return shown(g.ownership_change(_insiders(spark, sf_dir)), ["symbol"], ["delta", "percent", "holders"])


@query("a_positions", """WITH p AS (SELECT l_suppkey AS manager, year(l_shipdate) AS period, l_partkey % 100 AS symbol, sum(l_quantity) AS shares FROM lineitem GROUP BY 1, 2, 3), k AS (SELECT *, dense_rank() OVER (PARTITION BY manager ORDER BY period DESC) AS k FROM p), two AS (SELECT DISTINCT manager FROM k WHERE k = 2),
j AS (SELECT coalesce(a.manager, z.manager) AS manager, a.shares AS now, z.shares AS before FROM (SELECT * FROM k WHERE k = 1) a FULL JOIN (SELECT * FROM k WHERE k = 2) z ON a.manager = z.manager AND a.symbol = z.symbol)
SELECT CASE WHEN before IS NULL THEN 'new' WHEN now IS NULL THEN 'closed' WHEN now > before THEN 'increase' WHEN now < before THEN 'decrease' ELSE 'unchanged' END AS change, count(*) AS n FROM j WHERE manager IN (SELECT manager FROM two) GROUP BY 1""")
def positions(spark, sf_dir):
    """Suppliers as managers, years as periods."""
    li = b.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("manager"), F.year("l_shipdate").alias("period"), (F.col("l_partkey") % 100).alias("symbol"), F.col("l_quantity").alias("shares"))
    return g.position_changes(li).groupBy("change").agg(F.count("*").alias("n"))


@query("g_moves", _PAGE + """, q AS (SELECT *, 1704067200 + page_id * 3600 AS seen FROM p), mv AS (SELECT symbol, max(seen) AS moved FROM q GROUP BY 1),
j AS (SELECT q.*, m * exp(-(moved // 86400 - seen // 86400) / 3.0) AS s FROM q JOIN mv USING (symbol) WHERE seen <= moved AND moved // 86400 - seen // 86400 <= 3)
SELECT symbol, accession, item, round(s, 6) AS score, c AS candidates FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY s DESC, accession DESC, item DESC) AS k, count(*) OVER (PARTITION BY symbol) AS c FROM j) WHERE k = 1""")
def moves(spark, sf_dir):
    """pages' items before a move of each symbol a week on."""
    e = g.item_events(_filings(spark, sf_dir), PHRASES)
    m = e.groupBy("symbol").agg(F.max("accepted_at").alias("moved_at"))
    return shown(g.attribute_moves(m, e), ["symbol", "accession", "item"], ["score", "candidates"])


TK = b.with_sql("ticks")
_AGG = TK + ", d AS (SELECT *, sign(nullif(price - lag(price) OVER (PARTITION BY symbol ORDER BY ts, event_id), 0)) AS d FROM ticks), a AS (SELECT symbol, ts, event_id, price, size, coalesce(last_value(d IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 1.0) AS aggressor FROM d)"


@query("w_aggressor", _AGG + " SELECT event_id, round(aggressor, 6) AS aggressor FROM a")
def aggressor(spark, sf_dir):
    """W41, O04."""
    return shown(o.aggressor(b.ticks(spark, sf_dir)), ["event_id"], ["aggressor"])


_LEV = _AGG + ", l AS (SELECT symbol, CAST(floor(epoch(ts) / 86400) * 86400 AS BIGINT) AS bar, round_even(price / 5.0, 0) * 5.0 AS level, sum(CASE WHEN aggressor > 0 THEN size ELSE 0 END) AS buy, sum(CASE WHEN aggressor > 0 THEN 0 ELSE size END) AS sell, count(*) AS trades FROM a GROUP BY 1, 2, 3)"


@query("a_footprint_levels", _LEV + " SELECT symbol, bar, round(level, 6) AS level, round(buy, 6) AS buy, round(sell, 6) AS sell, trades FROM l")
def levels(spark, sf_dir):
    """A23."""
    return shown(o.footprint_levels(o.aggressor(b.ticks(spark, sf_dir)), 86400, 5.0), ["symbol", "bar"], ["level", "buy", "sell", "trades"])


@query("w_imbalances", _LEV + """, dg AS (SELECT *, buy > 0 AND buy >= 3 * greatest(coalesce(lag(sell) OVER w, 0), 1e-9) AS bi, sell > 0 AND sell >= 3 * greatest(coalesce(lead(buy) OVER w, 0), 1e-9) AS si, row_number() OVER w AS n FROM l WINDOW w AS (PARTITION BY symbol, bar ORDER BY level)),
g AS (SELECT *, n - row_number() OVER (PARTITION BY symbol, bar, bi ORDER BY level) AS gb, n - row_number() OVER (PARTITION BY symbol, bar, si ORDER BY level) AS gs FROM dg),
x AS (SELECT symbol, bar, max(c) AS buy_stack FROM (SELECT symbol, bar, gb, count(*) AS c FROM g WHERE bi GROUP BY 1, 2, 3) GROUP BY 1, 2), y AS (SELECT symbol, bar, max(c) AS sell_stack FROM (SELECT symbol, bar, gs, count(*) AS c FROM g WHERE si GROUP BY 1, 2, 3) GROUP BY 1, 2),
z AS (SELECT coalesce(x.symbol, y.symbol) AS symbol, coalesce(x.bar, y.bar) AS bar, coalesce(buy_stack, 0) AS buy_stack, coalesce(sell_stack, 0) AS sell_stack FROM x FULL JOIN y ON x.symbol = y.symbol AND x.bar = y.bar)
SELECT *, CASE WHEN buy_stack >= 3 AND buy_stack > sell_stack THEN 'BUY' WHEN sell_stack >= 3 AND sell_stack > buy_stack THEN 'SELL' ELSE 'NO' END AS trigger FROM z""")
def imbalances(spark, sf_dir):
    """W38, W39, O06."""
    return shown(o.imbalances(o.footprint_levels(o.aggressor(b.ticks(spark, sf_dir)), 86400, 5.0)), ["symbol", "bar", "trigger"], ["buy_stack", "sell_stack"])


@query("a_footprint_bars", _AGG + ", g AS (SELECT symbol, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS bar, arg_min(price, ts) AS open, arg_max(price, ts) AS close, sum(size) AS volume, sum(aggressor * size) AS delta FROM a GROUP BY 1, 2) SELECT symbol, bar, round(open, 6) AS open, round(close, 6) AS close, round(delta, 6) AS delta, round(delta / volume, 6) AS ratio, round(sum(delta) OVER (PARTITION BY symbol ORDER BY bar ROWS UNBOUNDED PRECEDING), 6) AS cum_delta, CAST(sign(delta) * sign(lag(delta, 1, 0) OVER (PARTITION BY symbol ORDER BY bar)) < 0 AS BIGINT) AS flip FROM g")
def bars(spark, sf_dir):
    """A24, W40, O05."""
    return shown(o.footprint_bars(o.aggressor(b.ticks(spark, sf_dir)), 3600), ["symbol", "bar"], ["open", "close", "delta", "ratio", "cum_delta", "flip"])


def _chain(spark, sf_dir):
    """Parts as contracts of their brand: strike = retail price / 10, expiry by size, volatility by key."""
    p = b.table(spark, sf_dir, "part")
    d = p.select(F.col("p_brand").alias("symbol"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size") * 7).cast("timestamp").alias("expiration"), F.when(F.col("p_partkey") % 2 == 0, "C").otherwise("put").alias("option_type"), (F.col("p_retailprice") / 10).alias("strike"),
                 (F.col("p_partkey") % 97).cast("double").alias("open_interest"), (0.1 + F.col("p_partkey") % 50 / 100.0).alias("implied_volatility"), F.lit(100.0).alias("contract_multiplier"))
    spot = d.groupBy("symbol").agg(F.avg("strike").alias("spot"))
    return o.clean_chain(d.join(spot, "symbol"), F.lit("2024-01-01").cast("timestamp"))


_OPT = """WITH c AS (SELECT p_brand AS symbol, p_size * 7 / 365.0 AS y, p_partkey % 2 = 0 AS is_call, p_retailprice / 10 AS k, CAST(p_partkey % 97 AS DOUBLE) AS oi, 0.1 + p_partkey % 50 / 100.0 AS v, avg(p_retailprice / 10) OVER (PARTITION BY p_brand) AS s FROM part),
g AS (SELECT *, CASE WHEN is_call THEN 1 ELSE -1 END * exp(-0.5 * pow((ln(s / k) + 0.5 * v * v * y) / (v * sqrt(y)), 2)) / sqrt(6.283185307179586) / (s * v * sqrt(y)) * oi * 100 * s * s * 0.01 AS gex FROM c WHERE oi > 0 AND y > 0),
b AS (SELECT symbol, k, sum(CASE WHEN is_call THEN gex ELSE 0 END) AS c, sum(CASE WHEN is_call THEN 0 ELSE gex END) AS p FROM g GROUP BY 1, 2)"""


@query("o_profile", _OPT + " SELECT symbol, round(sum(c + p), 6) AS net_gex, round(sum(c - p), 6) AS gross_gex, round(arg_max(k, c), 6) AS call_wall, round(arg_min(k, p), 6) AS put_wall FROM b GROUP BY symbol")
def profile(spark, sf_dir):
    """O01, A22, F15, P09, P10."""
    return shown(o.strike_profile(o.gamma_exposure(_chain(spark, sf_dir))), ["symbol"], ["net_gex", "gross_gex", "call_wall", "put_wall"])


@query("o_flip", _OPT + """, u AS (SELECT g.*, i, s * (0.8 + 0.4 * i / 160) AS spot_at FROM g CROSS JOIN range(161) AS q(i)), cu AS (SELECT symbol, i, any_value(s) AS s, any_value(spot_at) AS spot_at, sum(CASE WHEN is_call THEN 1 ELSE -1 END * exp(-0.5 * pow((ln(spot_at / k) + 0.5 * v * v * y) / (v * sqrt(y)), 2)) / sqrt(6.283185307179586) / (spot_at * v * sqrt(y)) * oi * 100 * spot_at * spot_at * 0.01) AS net FROM u GROUP BY 1, 2),
w AS (SELECT *, lag(spot_at) OVER (PARTITION BY symbol ORDER BY i) AS a, lag(net) OVER (PARTITION BY symbol ORDER BY i) AS n FROM cu), x AS (SELECT symbol, s, a - n * (spot_at - a) / (net - n) AS x FROM w WHERE sign(net) * sign(n) < 0) SELECT symbol, round(arg_min(x, abs(x - s)), 6) AS flip FROM x GROUP BY 1""")
def flip(spark, sf_dir):
    """Flip of the scenario curve."""
    d = o.scenario_curve(_chain(spark, sf_dir))
    return shown(o.gamma_flip(d), ["symbol"], ["flip"])
