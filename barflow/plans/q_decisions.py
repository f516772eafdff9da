"""Queries of validation and decision rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions as d
from ..operators import joins as j
from ..operators import metrics as m
from ..operators import panel as p
from ..operators import signals as s
from ..operators import validation as v
from . import bindings as b
from .q_text import b_dir
from .registry import query, shown, six
from .signal_sql import features_sql

T, D = b.with_sql("trades"), b.with_sql("daily")
_NET = "(1 + gross_return) * (1 - 0.0003) / (1 + 0.0003) - 1"


def _folded(spark, sf_dir):
    t = b.trades(spark, sf_dir).withColumn("key", F.concat_ws("|", "hypothesis_id", F.year("exit_time").cast("string"))).withColumn("segment", F.element_at(F.array(F.lit("train"), F.lit("valid"), F.lit("test")), (F.month("exit_time") % 3 + 1).cast("int")))
    return m.trade_metrics(t, ["key", "segment"])


@query("v_fold_gate", T + f""", x AS (SELECT hypothesis_id || '|' || CAST(year(exit_time) AS VARCHAR) AS key, ['train', 'valid', 'test'][month(exit_time) % 3 + 1] AS segment, {_NET} AS n FROM trades), g AS (SELECT key, segment, count(*) AS c, avg(n) AS e FROM x GROUP BY 1, 2),
h AS (SELECT key, max(c) FILTER (segment = 'train') AS tc, max(e) FILTER (segment = 'train') AS te, max(c) FILTER (segment = 'valid') AS vc, max(e) FILTER (segment = 'valid') AS ve FROM g GROUP BY 1)
SELECT key, CAST(coalesce(tc >= 8 AND vc >= 8 AND te > 0 AND ve > 0, false) AS BIGINT) AS passed, round(least(te, ve), 6) AS robust FROM h""")
def gate(spark, sf_dir):
    """Thirds of a year as segments."""
    return shown(v.fold_gate(_folded(spark, sf_dir)), ["key"], ["passed", "robust"])


_GATED = T + f""", x AS (SELECT hypothesis_id || '|' || CAST(year(exit_time) AS VARCHAR) AS key, ['train', 'valid', 'test'][month(exit_time) % 3 + 1] AS segment, {_NET} AS n FROM trades), g AS (SELECT key, segment, count(*) AS c, avg(n) AS e FROM x GROUP BY 1, 2),
h AS (SELECT key, max(c) FILTER (segment = 'train') AS tc, max(e) FILTER (segment = 'train') AS te, max(c) FILTER (segment = 'valid') AS vc, max(e) FILTER (segment = 'valid') AS ve FROM g GROUP BY 1)"""


@query("v_top_per_family", _GATED + " SELECT family, key, round(robust, 6) AS robust FROM (SELECT split_part(key, '|', 1) AS family, key, least(te, ve) AS robust, row_number() OVER (PARTITION BY split_part(key, '|', 1) ORDER BY least(te, ve) DESC, key) AS k FROM h WHERE tc >= 8 AND vc >= 8 AND te > 0 AND ve > 0) WHERE k <= 2")
def top(spark, sf_dir):
    """T02."""
    g = v.fold_gate(_folded(spark, sf_dir)).withColumn("family", F.split("key", r"\|")[0])
    return shown(v.top_per_family(g, ["family"], 2), ["family", "key"], ["robust"])


@query("v_survivors", T + f""", x AS (SELECT symbol, year(exit_time) AS fold, avg({_NET}) AS e, count(*) AS c FROM trades GROUP BY 1, 2), f AS (SELECT symbol, count(*) AS folds, avg(CASE WHEN e > 0 THEN 1.0 ELSE 0 END) AS pos, quantile_cont(e, 0.5) AS med, min(e) AS worst FROM x WHERE c >= 1 GROUP BY 1)
SELECT symbol, CASE WHEN folds >= 3 AND pos = 1 AND worst > 0 THEN 'STRONG_SURVIVOR' WHEN folds >= 3 AND pos >= 0.75 AND med > 0 THEN 'PROVISIONAL_SURVIVOR' WHEN folds >= 2 AND pos >= 0.5 AND med > 0 THEN 'SURVIVOR' ELSE 'REJECT' END AS status FROM f""")
def survivors(spark, sf_dir):
    """Customers as hypotheses, years as folds."""
    f = m.fold_summary(m.trade_metrics(b.trades(spark, sf_dir).withColumn("fold", F.year("exit_time")), ["symbol", "fold"]), "symbol", "net_expectancy", 1)
    return f.select("symbol", v.survivor_status(F.col("folds"), F.col("positive_ratio"), F.col("median"), F.col("worst")).alias("status"))


@query("v_families", T + f""", x AS (SELECT symbol, year(exit_time) AS fold, avg({_NET}) AS e, count(*) AS c FROM trades GROUP BY 1, 2), f AS (SELECT symbol, count(*) AS folds, avg(CASE WHEN e > 0 THEN 1.0 ELSE 0 END) AS pos, quantile_cont(e, 0.5) AS med, min(e) AS worst FROM x WHERE c >= 1 GROUP BY 1)
SELECT substr(symbol, 1, 1) AS family, count(*) AS hypotheses, CAST(sum(CAST(folds >= 3 AND pos = 1 AND worst > 0 OR folds >= 3 AND pos >= 0.75 AND med > 0 OR folds >= 2 AND pos >= 0.5 AND med > 0 AS BIGINT)) AS BIGINT) AS survivors, round(max(med), 6) AS best, round(quantile_cont(med, 0.5), 6) AS typical FROM f GROUP BY 1""")
def families(spark, sf_dir):
    """V04, T04."""
    f = m.fold_summary(m.trade_metrics(b.trades(spark, sf_dir).withColumn("fold", F.year("exit_time")), ["symbol", "fold"]), "symbol", "net_expectancy", 1)
    f = f.withColumn("status", v.survivor_status(F.col("folds"), F.col("positive_ratio"), F.col("median"), F.col("worst"))).withColumn("family", F.substring("symbol", 1, 1))
    return shown(v.family_leaderboard(f), ["family"], ["hypotheses", "survivors", "best", "typical"])


_RED = T + """, e AS (SELECT DISTINCT hypothesis_id AS h, CAST(entry_time AS DATE) AS day, symbol FROM trades), n AS (SELECT h, count(*) AS n FROM e GROUP BY 1), same AS (SELECT a.h AS a, z.h AS b, count(*) AS bth FROM e a JOIN e z ON a.symbol = z.symbol AND a.day = z.day AND a.h < z.h GROUP BY 1, 2),
r AS (SELECT hypothesis_id AS h, CAST(exit_time AS DATE) AS day, avg(gross_return) AS r FROM trades GROUP BY 1, 2), c AS (SELECT x.h AS a, y.h AS b, count(*) AS days, corr(x.r, y.r) AS corr FROM r x JOIN r y ON x.day = y.day AND x.h < y.h GROUP BY 1, 2),
red AS (SELECT coalesce(c.a, same.a) AS a, coalesce(c.b, same.b) AS b, coalesce(bth, 0) / (x.n + y.n - coalesce(bth, 0)) AS jac, days, corr FROM c FULL JOIN same ON c.a = same.a AND c.b = same.b JOIN n x ON x.h = coalesce(c.a, same.a) JOIN n y ON y.h = coalesce(c.b, same.b))"""


@query("v_redundancy", _RED + " SELECT a, b, round(jac, 6) AS jaccard, days, round(corr, 6) AS corr, CAST(jac >= 0.5 OR coalesce(days >= 10 AND corr >= 0.8, false) AS BIGINT) AS redundant FROM red")
def redundant(spark, sf_dir):
    """V06, Q16."""
    return shown(v.redundancy(b.trades(spark, sf_dir), "hypothesis_id"), ["a", "b"], ["jaccard", "days", "corr", "redundant"])


@query("v_roster", _RED.replace("WITH ", "WITH RECURSIVE ", 1) + f""", ed AS (SELECT a, b FROM red WHERE jac >= 0.5 OR coalesce(days >= 10 AND corr >= 0.0, false)), n0 AS (SELECT a AS node, a AS comp FROM ed UNION SELECT b, b FROM ed),
cm AS (SELECT * FROM n0 UNION SELECT e.y, cm.comp FROM cm JOIN (SELECT a AS x, b AS y FROM ed UNION SELECT b, a FROM ed) e ON e.x = cm.node), cc AS (SELECT node, min(comp) AS comp FROM cm GROUP BY 1), m AS (SELECT hypothesis_id, avg({_NET}) AS e FROM trades GROUP BY 1)
SELECT m.hypothesis_id, coalesce(cc.comp, m.hypothesis_id) AS component, CASE WHEN row_number() OVER (PARTITION BY coalesce(cc.comp, m.hypothesis_id) ORDER BY e DESC, m.hypothesis_id) = 1 THEN 'CHAMPION' ELSE 'REDUNDANT' END AS roster FROM m LEFT JOIN cc ON cc.node = m.hypothesis_id""")
def roster(spark, sf_dir):
    """Components of strategies whose returns correlate over 0, champions by expectancy."""
    b_dir(spark)
    t = b.trades(spark, sf_dir)
    edges = v.redundancy(t, "hypothesis_id", corr=0.0).filter("redundant")
    h = m.trade_metrics(t, ["hypothesis_id"])
    return v.champions(h, v.components(edges), "hypothesis_id", "net_expectancy").select("hypothesis_id", "component", "roster")


@query("v_bootstrap", T + """, t AS (SELECT hypothesis_id AS h, CAST(exit_time AS DATE) AS day, 0.001 * avg(gross_return) AS r FROM trades GROUP BY 1, 2), d AS (SELECT h, r, row_number() OVER (PARTITION BY h ORDER BY day, r) AS i, count(*) OVER (PARTITION BY h) AS n FROM t),
k AS (SELECT DISTINCT h, n FROM d), s AS (SELECT h, n, run, j, CAST('0x' || substr(md5(h || '|' || run || '|' || j || '|7'), 1, 8) AS BIGINT) % n AS s FROM (SELECT h, n, run, unnest(range(CAST(ceil(n / 20.0) AS BIGINT))) AS j FROM k, range(100) AS q(run))),
o AS (SELECT h, run, (s + o) % n + 1 AS i FROM s, range(20) AS q(o) WHERE j * 20 + o < n), g AS (SELECT o.h, run, exp(sum(ln(1 + d.r))) AS g FROM o JOIN d ON d.h = o.h AND d.i = o.i GROUP BY 1, 2)
SELECT h AS hypothesis_id, round(quantile_cont(g, 0.05) - 1, 6) AS p05, round(quantile_cont(g, 0.5) - 1, 6) AS median, round(quantile_cont(g, 0.95) - 1, 6) AS p95, round(avg(CASE WHEN g < 1 THEN 1.0 ELSE 0.0 END), 6) AS loss_probability FROM g GROUP BY 1""")
def bootstrap(spark, sf_dir):
    """100 runs in blocks of 20 days; a day's return is a thousandth of the mean of its trades, so that it does not grow with their number."""
    t = b.trades(spark, sf_dir).groupBy("hypothesis_id", F.to_date("exit_time").alias("day")).agg((0.001 * F.avg("gross_return")).alias("r"))
    return shown(v.block_bootstrap(t, "hypothesis_id", "day", "r", 100), ["hypothesis_id"], ["p05", "median", "p95", "loss_probability"])


@query("v_combinations", T + """, s AS (SELECT hypothesis_id AS h, CAST(exit_time AS DATE) AS day, sum(gross_return) AS r FROM trades GROUP BY 1, 2), v AS (SELECT h, 1 / stddev_samp(r) AS iv FROM s GROUP BY 1),
c AS (SELECT x.h AS a, y.h AS b, m.mode, CASE WHEN m.mode = 'equal' THEN 0.5 ELSE x.iv / (x.iv + y.iv) END AS wa, CASE WHEN m.mode = 'equal' THEN 0.5 ELSE y.iv / (x.iv + y.iv) END AS wb FROM v x JOIN v y ON x.h < y.h CROSS JOIN (VALUES ('equal'), ('inverse_volatility')) m(mode)),
l AS (SELECT a, b, mode, a AS h, wa AS w FROM c UNION ALL SELECT a, b, mode, b, wb FROM c), d AS (SELECT a, b, mode, day, sum(w * r) AS r FROM l JOIN s ON s.h = l.h GROUP BY 1, 2, 3, 4) SELECT a, b, mode, count(*) AS days, round(avg(r), 6) AS mean FROM d GROUP BY 1, 2, 3""")
def combos(spark, sf_dir):
    """V17, V21."""
    t = b.trades(spark, sf_dir).groupBy("hypothesis_id", F.to_date("exit_time").alias("day")).agg(F.sum("gross_return").alias("r"))
    return shown(v.combinations(t, "hypothesis_id", "day", "r").groupBy("a", "b", "mode").agg(F.count("*").alias("days"), F.avg("r").alias("mean")), ["a", "b", "mode"], ["days", "mean"])


#: Halves of hypotheses as strategies, so that there are enough to combine by four.
_MANY = T + """, s AS (SELECT hypothesis_id || ' ' || trade_id % 2 AS h, CAST(exit_time AS DATE) AS day, 0.01 * sum(gross_return) AS r FROM trades GROUP BY 1, 2),
n AS (SELECT count(DISTINCT day) AS n FROM s), o AS (SELECT h, n, sum(r) / n AS m, sqrt((sum(r * r) - sum(r) * sum(r) / n) / (n - 1)) AS sd FROM s, n GROUP BY h, n),
ab AS (SELECT x.h AS a, y.h AS b, sum(x.r * y.r) AS ab FROM s x JOIN s y ON x.day = y.day GROUP BY 1, 2), cv AS (SELECT x.h AS a, y.h AS b, (coalesce(ab, 0) - x.n * x.m * y.m) / (x.n - 1) AS cov, (coalesce(ab, 0) - x.n * x.m * y.m) / (x.n - 1) / (x.sd * y.sd) AS cr FROM o x CROSS JOIN o y LEFT JOIN ab ON ab.a = x.h AND ab.b = y.h),
cb AS (SELECT [x.h, y.h] AS c FROM o x JOIN o y ON x.h < y.h UNION ALL SELECT [x.h, y.h, z.h] FROM o x JOIN o y ON x.h < y.h JOIN o z ON y.h < z.h UNION ALL SELECT [x.h, y.h, z.h, q.h] FROM o x JOIN o y ON x.h < y.h JOIN o z ON y.h < z.h JOIN o q ON z.h < q.h),
lg AS (SELECT c, len(c) AS k, md.mode, u.h, o.m, CASE md.mode WHEN 'equal' THEN 1.0 WHEN 'inverse_volatility' THEN 1 / o.sd ELSE greatest(o.m / o.sd, 0) END AS raw FROM (SELECT c, unnest(c) AS h FROM cb) u JOIN o ON o.h = u.h CROSS JOIN (VALUES ('equal'), ('inverse_volatility'), ('positive_sharpe')) md(mode)),
sh AS (SELECT *, CASE WHEN mode = 'equal' OR sum(raw) OVER w <= 0 THEN 1.0 / k ELSE least(0.7, greatest(0.1 / k, raw / sum(raw) OVER w)) END AS s FROM lg WINDOW w AS (PARTITION BY c, mode)),
wt AS (SELECT c, k, mode, h, m, s / sum(s) OVER (PARTITION BY c, mode) AS w FROM sh),
vr AS (SELECT x.c, x.mode, sum(x.w * y.w * cov) AS v, avg(CASE WHEN x.h < y.h THEN cr END) AS corr FROM wt x JOIN wt y ON x.c = y.c AND x.mode = y.mode JOIN cv ON cv.a = x.h AND cv.b = y.h GROUP BY 1, 2),
cs AS (SELECT array_to_string(wt.c, '+') AS strategies, wt.k AS size, wt.mode, wt.c, sum(w * m) AS mean, any_value(v) AS v, any_value(corr) AS corr, sum(w * m) / sqrt(any_value(v)) * sqrt(252.0) AS sharpe FROM wt JOIN vr ON vr.c = wt.c AND vr.mode = wt.mode GROUP BY wt.c, wt.k, wt.mode)"""


def _strategies(spark, sf_dir):
    name = F.concat_ws(" ", "hypothesis_id", (F.col("trade_id") % 2).cast("string"))
    return b.trades(spark, sf_dir).groupBy(name.alias("h"), F.to_date("exit_time").alias("day")).agg((0.01 * F.sum("gross_return")).alias("r"))


@query("v_combination_search", _MANY + " SELECT strategies, size, mode, round(corr, 6) AS correlation, round(mean, 6) AS mean, round(sqrt(v), 6) AS sd, round(sharpe, 4) AS sharpe FROM cs")
def combination_search(spark, sf_dir):
    """Combinations of two to four strategies in three weight modes."""
    d = v.combination_search(_strategies(spark, sf_dir), "h", "day", "r")
    return shown(d, ["strategies", "mode"], ["size", "correlation", "mean", "sd"]).join(shown(d, ["strategies", "mode"], ["sharpe"], 4), ["strategies", "mode"])


@query("v_combined_streams", _MANY + """, best AS (SELECT * FROM cs ORDER BY round(sharpe + 1.2345e-7, 6) DESC, strategies, mode LIMIT 5), st AS (SELECT b.strategies, b.mode, s.day, sum(w * s.r) AS r FROM best b JOIN wt ON wt.c = b.c AND wt.mode = b.mode JOIN s ON s.h = wt.h GROUP BY 1, 2, 3)
SELECT strategies, mode, CAST(day AS VARCHAR) AS day, round(r, 6) AS r FROM st""")
def combined_streams(spark, sf_dir):
    """Daily streams of the five combinations of the best Sharpe ratio, a report."""
    s = _strategies(spark, sf_dir)
    found = v.combination_search(s, "h", "day", "r")
    best = found.orderBy(six("sharpe").desc(), "strategies", "mode").limit(5)
    return shown(v.combined_streams(s, best, "h", "day", "r"), ["strategies", "mode", "day"], ["r"])


@query("v_weights", T + ", s AS (SELECT hypothesis_id, CAST(exit_time AS DATE) AS day, sum(gross_return) AS r FROM trades GROUP BY 1, 2), v AS (SELECT hypothesis_id, 1 / stddev_samp(r) AS iv FROM s GROUP BY 1), c AS (SELECT *, least(iv / sum(iv) OVER (), 0.4) AS c, count(*) OVER () AS n FROM v) SELECT hypothesis_id, round(1.0 / n, 6) AS equal, round(c / sum(c) OVER (), 6) AS inverse_volatility FROM c")
def weights(spark, sf_dir):
    """V21."""
    t = b.trades(spark, sf_dir).groupBy("hypothesis_id", F.to_date("exit_time").alias("day")).agg(F.sum("gross_return").alias("r"))
    return shown(v.weights(t, "hypothesis_id", "r"), ["hypothesis_id"], ["equal", "inverse_volatility"])


def _candidates(spark, sf_dir):
    c = b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol"), (F.col("p_size") * 2.0).alias("total_score"), (F.col("p_retailprice") * 1e7 / 10).alias("market_cap"), (F.col("p_partkey") % 100).cast("double").alias("risk_score"))
    return c.withColumn("lane", d.lane(F.col("total_score"), F.col("risk_score"), F.col("market_cap")))


_CANDS = "WITH c AS (SELECT p_partkey AS symbol, p_size * 2.0 AS s, p_retailprice * 1e7 / 10 AS cap, p_partkey % 100 AS risk FROM part), l AS (SELECT *, CASE WHEN s >= 75 AND risk <= 40 AND cap < 2e9 THEN 'GEM' WHEN s >= 70 AND risk <= 50 THEN 'CORE' WHEN s >= 55 THEN 'TACTICAL' ELSE 'WATCHLIST' END AS lane FROM c)"


@query("d_lanes", _CANDS + " SELECT symbol, lane FROM l")
def lanes(spark, sf_dir):
    """D01, D02."""
    return _candidates(spark, sf_dir).select("symbol", "lane")


@query("t_ranked_candidates", _CANDS + " SELECT symbol, lane, round(s, 6) AS total_score FROM l ORDER BY CASE lane WHEN 'GEM' THEN 0 WHEN 'CORE' THEN 1 WHEN 'TACTICAL' THEN 2 ELSE 3 END, s DESC, symbol LIMIT 50")
def ranked(spark, sf_dir):
    """A top-50 report."""
    return shown(d.ranked_candidates(_candidates(spark, sf_dir), 50), ["symbol", "lane"], ["total_score"])


@query("f_scores", "SELECT p_partkey, round(greatest(0, least(100, 25 * (log10(greatest(p_retailprice * 1e4, 1)) - 4))), 6) AS liquidity, round((0.6 * CASE WHEN p_size > 10 THEN p_size ELSE 0 END + 0.4 * p_retailprice / 100) / (CASE WHEN p_size > 10 THEN 0.6 ELSE 0 END + 0.4), 3) AS research FROM part")
def scores(spark, sf_dir):
    """F20, F21."""
    c = b.table(spark, sf_dir, "part").select("p_partkey", d.liquidity_score(F.col("p_retailprice") * 1e4).alias("liquidity"), F.when(F.col("p_size") > 10, F.col("p_size").cast("double")).alias("a"), (F.col("p_retailprice") / 100).alias("z"))
    have = F.when(F.col("a").isNotNull(), 0.6).otherwise(0.0)
    c = c.withColumn("research", (have * F.coalesce("a", F.lit(0.0)) + 0.4 * F.col("z")) / (have + 0.4))
    return c.select("p_partkey", F.round(F.col("liquidity") + 1.2345e-7, 6).alias("liquidity"), F.round(F.col("research") + 1.2345e-7, 3).alias("research"))


@query("d_allocation", D + ", v AS (SELECT symbol, tanh(arg_max(close, ts) / arg_min(close, ts) - 1) AS view FROM bars GROUP BY symbol), k AS (SELECT * FROM v WHERE view > 0 ORDER BY view DESC, symbol LIMIT 10) SELECT symbol, round(view, 6) AS view, round(least(view / sum(view) OVER () * 0.95, 0.2), 6) AS weight FROM k")
def allocation(spark, sf_dir):
    """The ten best views."""
    x = b.daily_bars(spark, sf_dir).groupBy("symbol").agg(F.tanh(F.max_by("close", "ts") / F.min_by("close", "ts") - 1).alias("view"))
    return shown(d.allocation(x), ["symbol"], ["view", "weight"])


@query("w_bars_since", D + ", x AS (SELECT *, max(high) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS hi FROM bars), y AS (SELECT symbol, max(rn) - max(rn) FILTER (rn > 5 AND high > hi) AS n FROM x GROUP BY symbol) SELECT symbol, n AS bars_since, CASE WHEN n IS NULL THEN 'NONE' WHEN n = 0 THEN 'SIGNAL' WHEN n <= 5 THEN 'ACTIVE' ELSE 'EXPIRED' END AS state FROM y")
def since(spark, sf_dir):
    """W47, D04, D05."""
    x = d.bars_since(s.signals(b.daily_bars(spark, sf_dir), "n_bar_breakout"), "entry")
    return x.select("symbol", F.col("bars_since").cast("long").alias("bars_since"), d.signal_state(F.col("bars_since"), 5).alias("state"))


def _since_sql(name: str) -> str:
    sql, source, entry, _ = features_sql(name)
    return f"({sql} SELECT symbol, max(rn) - max(rn) FILTER ({entry}) AS n FROM {source} GROUP BY symbol)"


@query("d_proposals", "WITH u AS (SELECT symbol, n FROM " + _since_sql("n_bar_breakout") + " UNION ALL SELECT symbol, n FROM " + _since_sql("close_below_n_day_low") + """) SELECT symbol, count(*) AS strategies, CAST(sum(CASE WHEN n = 0 THEN 1 ELSE 0 END) AS BIGINT) AS signals,
CASE WHEN CAST(symbol AS BIGINT) % 10 = 0 THEN 'BLOCKED' WHEN sum(CASE WHEN n = 0 THEN 1 ELSE 0 END) >= 1 THEN 'PROPOSE' ELSE 'WAIT' END AS decision FROM u GROUP BY 1""")
def proposals(spark, sf_dir):
    """States of two signals, symbols with large gaps blocked."""
    x = None
    for name in ("n_bar_breakout", "close_below_n_day_low"):
        one = d.bars_since(s.signals(b.daily_bars(spark, sf_dir), name), "entry").select("symbol", d.signal_state(F.col("bars_since"), 5).alias("state"), (-F.col("bars_since")).cast("double").alias("score"))
        x = one if x is None else x.unionByName(one)
    x = x.withColumn("blockers", F.when(F.col("symbol").cast("long") % 10 == 0, F.array(F.lit("gap"))).otherwise(F.array().cast("array<string>")))
    return d.proposals(x).select("symbol", "strategies", "signals", "decision")


@query("p_overlay_masks", "WITH e AS (SELECT vec_id, label, embedding[1] AS p FROM embeddings), r AS (SELECT *, (rank() OVER (PARTITION BY label ORDER BY p) + (count(*) OVER (PARTITION BY label, p) - 1) / 2.0) / count(*) OVER (PARTITION BY label) AS pct, row_number() OVER (PARTITION BY label ORDER BY p DESC, vec_id) AS o FROM e), m AS (SELECT vec_id, unnest(list_filter([CASE WHEN true THEN 'ALL' END, CASE WHEN p > 0 THEN 'PRED_POSITIVE' END, CASE WHEN pct >= 0.6 THEN 'TOP_HALF' END, CASE WHEN o <= 2 THEN 'TOP2' END, CASE WHEN o = 1 THEN 'TOP1' END, CASE WHEN p > 0 AND o <= 2 THEN 'POSITIVE_TOP2' END], lambda x: x IS NOT NULL)) AS mask FROM r) SELECT mask, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids FROM m GROUP BY mask")
def masks(spark, sf_dir):
    """First embedding component as prediction."""
    e = b.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("prediction"))
    r = p.ordinal(p.rank_pct(e, "prediction", "label", "pct"), "prediction", "label", "vec_id", "ord")
    return d.overlay_masks(r).groupBy("mask").agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids"))


@query("d_day", D + ", x AS (SELECT *, CASE WHEN count(*) OVER f >= 20 THEN quantile_cont(close * volume, 0.5) OVER f END AS mdv, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM bars WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) , " + b.SQL["trades"] + " SELECT t.trade_id, round(x.ret, 4) AS ret, round(x.mdv, 4) AS median_dv FROM trades t JOIN x ON t.symbol = x.symbol WHERE CAST(t.entry_time AS DATE) <= DATE '1998-06-15' AND CAST(t.exit_time AS DATE) >= DATE '1998-06-15' AND x.ts = DATE '1998-06-15'")
def day(spark, sf_dir):
    """Trades open on 1998-06-15."""
    return shown(d.explained_day(b.trades(spark, sf_dir).select("trade_id", "symbol", "entry_time", "exit_time"), b.daily_bars(spark, sf_dir), F.lit("1998-06-15").cast("date")), ["trade_id"], ["ret", "median_dv"], 4)


@query("a_macro", D + ", x AS (SELECT *, close - lag(close, 1) OVER w AS c1, close - lag(close, 5) OVER w AS c5, close - lag(close, 20) OVER w AS c20 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)) SELECT symbol AS series, CAST(max(ts) AS VARCHAR) AS ts, round(arg_max(close, ts), 4) AS value, round(arg_max(c1, ts), 4) AS change_1, round(arg_max(c5, ts), 4) AS change_5, round(arg_max(c20, ts), 4) AS change_20 FROM x GROUP BY symbol")
def macro(spark, sf_dir):
    """A37, D14."""
    return shown(d.macro_summary(b.daily_bars(spark, sf_dir).select(F.col("symbol").alias("series"), "ts", F.col("close").alias("value"))), ["series", "ts"], ["value", "change_1", "change_5", "change_20"], 4)


@query("j_mutual_best", """WITH RECURSIVE c AS (SELECT a.o_custkey AS c, a.o_orderkey AS n, z.o_orderkey AS s, least(a.o_totalprice, z.o_totalprice) / greatest(a.o_totalprice, z.o_totalprice) AS v FROM orders a JOIN orders z ON a.o_custkey = z.o_custkey AND a.o_orderstatus = 'O' AND z.o_orderstatus = 'F'),
k AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY v DESC, n, s) AS k FROM c WHERE v >= 0.65),
r AS (SELECT c, k, n, s, v, true AS taken, [n] AS ns, [s] AS ss FROM k WHERE k = 1
  UNION ALL SELECT k.c, k.k, k.n, k.s, k.v, ok, CASE WHEN ok THEN list_append(ns, k.n) ELSE ns END, CASE WHEN ok THEN list_append(ss, k.s) ELSE ss END FROM (SELECT k.*, r.ns, r.ss, NOT list_contains(r.ns, k.n) AND NOT list_contains(r.ss, k.s) AS ok FROM r JOIN k ON k.c = r.c AND k.k = r.k + 1) k)
SELECT n AS notice, s AS sale, round(v, 6) AS score FROM r WHERE taken""")
def matching(spark, sf_dir):
    """Orders of two states of a customer, matched by price."""
    b_dir(spark)
    o = b.table(spark, sf_dir, "orders")
    a = o.filter("o_orderstatus = 'O'").select("o_custkey", F.col("o_orderkey").alias("notice"), F.col("o_totalprice").alias("x"))
    z = o.filter("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderkey").alias("sale"), F.col("o_totalprice").alias("y"))
    c = a.join(z, "o_custkey").withColumn("score", F.least("x", "y") / F.greatest("x", "y")).filter("score >= 0.65").select("notice", "sale", "score")
    return shown(j.mutual_best(c, "notice", "sale", "score"), ["notice", "sale"], ["score"])
