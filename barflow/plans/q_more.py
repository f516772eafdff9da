"""Queries of rows that others only use: weekly context of days, crosses, panel sections, evidence ranks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import windows as w
from ..operators import bars as ob
from ..operators import joins as j
from ..operators import news as n
from ..operators import panel as p
from . import bindings as b
from . import signal_sql as sig
from .q_research import _PANEL, _by_day
from .q_text import NOW, _TITLED, b_dir
from .registry import query, shown, six

D = b.with_sql("daily")
_WEEKS, _LAST = sig.layered(D + ",\n" + sig._WEEK, "wk", sig.macd(12, 26, 9), "wl")


@query("w_weekly_histogram", _WEEKS + f" SELECT d.symbol, CAST(d.ts AS VARCHAR) AS ts, round(w.hist, 6) AS week_hist FROM bars d ASOF LEFT JOIN {_LAST} w ON d.symbol = w.symbol AND d.ts >= w.ts")
def weekly_histogram(spark, sf_dir):
    """MACD of complete weeks, known to days from their Friday on."""
    d = b.daily_bars(spark, sf_dir)
    weeks = w.macd(w.indexed(ob.weekly(d).withColumnRenamed("week", "ts")))
    out = j.asof(d, weeks.select("symbol", "ts", "macd_hist"), "symbol", "ts", "ts", ["macd_hist"]).drop("source_time")
    return shown(out.withColumnRenamed("macd_hist", "week_hist"), ["symbol", "ts"], ["week_hist"])


_MEANS, _MEANED = sig.layered(D, "bars", [{"a": sig.sma(5), "z": sig.sma(20)}, {"pa": sig.lag("a"), "pz": sig.lag("z")}])


@query("w_crosses", _MEANS + f" SELECT symbol, CAST(ts AS VARCHAR) AS ts, CAST(coalesce(a > z AND pa <= pz, false) AS BIGINT) AS above, CAST(coalesce(a < z AND pa >= pz, false) AS BIGINT) AS below FROM {_MEANED}")
def crosses(spark, sf_dir):
    """Where the mean of 5 days crosses that of 20."""
    d = w.indexed(b.daily_bars(spark, sf_dir)).withColumns({"a": w.sma("close", 5), "z": w.sma("close", 20)}).withColumns({"pa": w.lag("a"), "pz": w.lag("z")})
    c = F.col
    return shown(d.withColumns({"above": w.crossed_above(c("a"), c("z"), c("pa"), c("pz")), "below": w.crossed_below(c("a"), c("z"), c("pa"), c("pz"))}), ["symbol", "ts"], ["above", "below"])


@query("a_panel_sections", _PANEL + """, x AS (SELECT symbol, ts, raw_return AS e FROM r WHERE raw_return IS NOT NULL), s AS (SELECT ts, count(*) AS section FROM x GROUP BY 1 HAVING count(*) >= 3),
k AS (SELECT s.ts, s.section, x.symbol, x.e - avg(x.e) OVER (PARTITION BY x.ts) AS label FROM x JOIN s ON s.ts = x.ts), g AS (SELECT ts, any_value(section) AS section, count(DISTINCT symbol) AS symbols, abs(avg(label)) AS off FROM k GROUP BY 1)
SELECT CAST(count(*) AS BIGINT) AS times, CAST(min(section) AS BIGINT) AS smallest, CAST(max(section) AS BIGINT) AS largest, CAST(sum(CAST(section <> symbols AS BIGINT)) AS BIGINT) AS uneven, CAST(max(off) < 1e-9 AS BIGINT) AS centred FROM g""")
def sections(spark, sf_dir):
    """Of a centred panel: times, smallest and largest section, sections in which a symbol repeats, and whether all means vanish."""
    d = p.section_audit(p.centred(_by_day(spark, sf_dir).select("symbol", "ts", "raw_return"), "raw_return"))
    return shown(d, [], ["times", "smallest", "largest", "uneven", "centred"])


@query("t_evidence_ranks", _TITLED + f""", d AS (SELECT r.leader, k.* FROM r JOIN k ON k.k = r.k), g AS (SELECT leader, count(DISTINCT provider) AS p, max(published) AS last FROM d GROUP BY 1),
s AS (SELECT leader, exp(-greatest(0, {NOW} - last) / 3600.0 / 36.0) * (0.5 + 0.5 * least(1.0, p / 3.0)) AS score FROM g)
SELECT leader, row_number() OVER (ORDER BY round(score, 9) DESC, leader) AS rank FROM s QUALIFY rank <= 100""")
def ranks(spark, sf_dir):
    """The 100 stories of the best evidence, a report."""
    b_dir(spark)
    d = b.news(spark, sf_dir)
    e = n.story_evidence(d, n.stories(d), NOW).withColumn("_s", six("score", 9)).orderBy(F.desc("_s"), "leader").limit(100)
    return e.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("_s"), "leader")).cast("long")).select("leader", "rank")  # of 100 rows
