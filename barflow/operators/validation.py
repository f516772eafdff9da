"""Selection and validation of hypotheses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from ..sources.files import settled
from . import metrics as m


def fold_gate(folded: DataFrame, least: int = 8) -> DataFrame:
    """Per (hypothesis, fold): train and valid side by side, gate (both large enough and positive), robust score (the lower)."""
    d = m.side_by_side(folded, "key", "segment", ["train", "valid", "test"], ["trades", "net_expectancy", "profit_factor"])
    ok = (F.col("train_trades") >= least) & (F.col("valid_trades") >= least) & (F.col("train_net_expectancy") > 0) & (F.col("valid_net_expectancy") > 0)
    return d.withColumn("passed", F.coalesce(ok, F.lit(False))).withColumn("robust", F.least("train_net_expectancy", "valid_net_expectancy"))


def top_per_family(gated: DataFrame, by: list[str], k: int = 1) -> DataFrame:
    """The k best passed rows of each fold and family, ties by key."""
    w = Window.partitionBy(*by).orderBy(F.col("robust").desc(), "key")
    return gated.filter("passed").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")


def survivor_status(folds: Column, positive: Column, median: Column, worst: Column) -> Column:
    """STRONG, PROVISIONAL, SURVIVOR or REJECT from test folds."""
    return (F.when((folds >= 3) & (positive == 1.0) & (worst > 0), "STRONG_SURVIVOR").when((folds >= 3) & (positive >= 0.75) & (median > 0), "PROVISIONAL_SURVIVOR").when((folds >= 2) & (positive >= 0.5) & (median > 0), "SURVIVOR").otherwise("REJECT"))


def family_leaderboard(hypotheses: DataFrame) -> DataFrame:
    """V04, T04."""
    return hypotheses.groupBy("family").agg(F.count("*").alias("hypotheses"), F.sum((F.col("status") != "REJECT").cast("long")).alias("survivors"), F.max("median").alias("best"), F.percentile("median", 0.5).alias("typical"))


def redundancy(trades: DataFrame, key: str, least_days: int = 10, jaccard: float = 0.5, corr: float = 0.8) -> DataFrame:
    """Pairs of strategies whose entry days overlap or whose daily returns go together.

    Entries meet on (symbol, day) and mean returns on the exit day, so pairs come from what strategies share.
    """
    e = trades.select(key, "symbol", F.to_date("entry_time").alias("day")).distinct()
    n = e.groupBy(key).agg(F.count("*").alias("n"))
    a, b = e.withColumnRenamed(key, "a"), e.withColumnRenamed(key, "b")
    same = a.join(b, ["symbol", "day"]).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    r = trades.groupBy(key, F.to_date("exit_time").alias("day")).agg(F.avg("gross_return").alias("r"))
    x, y = r.withColumnRenamed(key, "a").withColumnRenamed("r", "ra"), r.withColumnRenamed(key, "b").withColumnRenamed("r", "rb")
    c = x.join(y, "day").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("days"), F.corr("ra", "rb").alias("corr"))
    d = same.join(c, ["a", "b"], "full").join(n.select(F.col(key).alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col(key).alias("b"), F.col("n").alias("nb")), "b")
    d = d.withColumn("jaccard", F.coalesce("both", F.lit(0)) / (F.col("na") + F.col("nb") - F.coalesce("both", F.lit(0))))
    return d.withColumn("redundant", (F.col("jaccard") >= jaccard) | F.coalesce((F.col("days") >= least_days) & (F.col("corr") >= corr), F.lit(False))).select("a", "b", "jaccard", "days", "corr", "redundant")


def components(edges: DataFrame) -> DataFrame:
    """Node and smallest node of its component, for every node of an edge between two.

    Each round ties the larger neighbours of a node, then the others, to its smallest one; rounds go
    on until one changes nothing, a few more than the logarithm of the longest chain. Edges with a
    null end and loops count for nothing.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), (F.col("a") != F.col("b")).alias("_two")).filter("_two").drop("_two").distinct().checkpoint()
    seen = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.crc32(F.concat_ws("|", "a", "b").cast("binary")))).first())
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        now = large.join(least, "a").select(F.explode(tied).alias("e")).select("e.a", "e.b").filter("a <> b").distinct().checkpoint()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def champions(hypotheses: DataFrame, comp: DataFrame, key: str, score: str) -> DataFrame:
    """The best of each component; others are redundant; those without links stand alone."""
    d = hypotheses.join(comp.withColumnRenamed("node", key), key, "left").withColumn("component", F.coalesce("component", key))
    w = Window.partitionBy("component").orderBy(F.col(score).desc(), key)
    return d.withColumn("roster", F.when(F.row_number().over(w) == 1, "CHAMPION").otherwise("REDUNDANT"))


def block_bootstrap(returns: DataFrame, key: str, order: str, r: str, runs: int = 500, block: int = 20, seed: int = 7) -> DataFrame:
    """Quantiles of compounded returns over circular block resamples, and how many lose.

    A block's return is a difference of prefix sums of log returns, so a block costs two or three
    look-ups, not its length. Starts come from an MD5 of key, run, block and seed. Null returns are 0;
    a return of -1 or less loses all. Ties of ``order`` stand by return. Keys of no rows give none.
    """
    x = F.coalesce(F.col(r).cast("double"), F.lit(0.0))
    d = numbered(returns.select(F.col(key).alias("_key0"), F.col(order).alias("_order"), x.alias("_r")), "_key0", ["_order", "_r"], "_i")
    upto = Window.partitionBy("_key0").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    lost = (F.col("_r") <= -1.0).cast("long")
    p = d.select("_key0", "_i", F.sum(F.when(F.col("_r") > -1.0, F.log1p("_r")).otherwise(0.0)).over(upto).alias("_p"), F.sum(lost).over(upto).alias("_lost"))
    n = d.groupBy("_key0").agg(F.count("*").alias("n"))
    starts = n.select("_key0", "n", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / block) - 1)).alias("j"))
    name = F.concat_ws("|", F.col("_key0").cast("string"), "run", "j", F.lit(seed))
    s = F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long") % F.col("n")
    starts = starts.withColumn("s", s).withColumn("e", F.col("s") + F.least(F.lit(block).cast("long"), F.col("n") - F.col("j") * block))
    at = lambda i, sign: F.struct(i.alias("_i"), F.lit(sign).alias("sign"))
    # From s to e; past the end, from s to the end and from the start on. Place 0 holds nothing.
    parts = F.when(F.col("e") <= F.col("n"), F.array(at(F.col("s"), -1), at(F.col("e"), 1))).otherwise(F.array(at(F.col("s"), -1), at(F.col("n"), 1), at(F.col("e") - F.col("n"), 1)))
    looked = starts.select("_key0", "run", F.inline(parts)).filter("_i > 0").groupBy("_key0", "run", "_i").agg(F.sum("sign").alias("sign"))
    g = looked.join(p, ["_key0", "_i"]).groupBy("_key0", "run").agg(F.sum(F.col("sign") * F.col("_p")).alias("_g"), F.sum(F.col("sign") * F.col("_lost")).alias("_lost"))
    g = n.select("_key0", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run")).join(g, ["_key0", "run"], "left")
    g = g.withColumn("g", F.when(F.col("_lost") > 0, 0.0).otherwise(F.exp(F.coalesce("_g", F.lit(0.0)))))
    q = F.percentile("g", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return g.groupBy(F.col("_key0").alias(key)).agg(q.alias("q"), F.avg((F.col("g") < 1).cast("double")).alias("loss_probability")).select(key, (F.col("q")[0] - 1).alias("p05"), (F.col("q")[1] - 1).alias("median"), (F.col("q")[2] - 1).alias("p95"), "loss_probability")


MODES = ("equal", "inverse_volatility", "positive_sharpe")


def moments(stream: DataFrame, key: str, date: str, r: str, start: Column | None = None, end: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Per strategy mean and deviation, and per pair (a <= b) the covariance, over the dates on which any strategy has a return; 0 where one has none.

    Returns two tables: (key, days, mean, sd) and (a, b, cov, corr). Pairs meet on dates that they share.
    """
    d = stream.groupBy(key, date).agg(F.sum(F.coalesce(F.col(r), F.lit(0.0))).alias("_r"))
    d = d.filter((F.col(date) >= start) if start is not None else F.lit(True)).filter((F.col(date) <= end) if end is not None else F.lit(True))
    days = d.agg(F.count_distinct(date).alias("days"))
    one = d.groupBy(key).agg(F.sum("_r").alias("_sum"), F.sum(F.col("_r") * F.col("_r")).alias("_squares")).join(F.broadcast(days))  # days is one row
    spread = F.sqrt(F.greatest(F.lit(0.0), (F.col("_squares") - F.col("_sum") * F.col("_sum") / F.col("days")) / F.nullif(F.col("days") - 1, F.lit(0))))
    one = one.select(key, "days", (F.col("_sum") / F.col("days")).alias("mean"), spread.alias("sd"))
    a, b = (d.select(F.col(key).alias(n), date, F.col("_r").alias(f"_r{n}")) for n in ("a", "b"))
    both = a.join(b, date).filter("a <= b").groupBy("a", "b").agg(F.sum(F.col("_ra") * F.col("_rb")).alias("_ab"))
    x, y = (one.select(F.col(key).alias(n), "days", F.col("mean").alias(f"_m{n}"), F.col("sd").alias(f"_s{n}")) for n in ("a", "b"))
    ids = x.join(F.broadcast(y.agg(F.array_sort(F.collect_list(F.struct("b", "_mb", "_sb"))).alias("_ys")))).select("a", "days", "_ma", "_sa", F.inline("_ys")).filter("a <= b")  # a catalogue of strategies, not data rows
    p = ids.join(both, ["a", "b"], "left")
    cov = (F.coalesce("_ab", F.lit(0.0)) - F.col("days") * F.col("_ma") * F.col("_mb")) / F.nullif(F.col("days") - 1, F.lit(0))
    return one, p.select("a", "b", cov.alias("cov"), F.when((F.col("_sa") > 1e-12) & (F.col("_sb") > 1e-12), cov / (F.col("_sa") * F.col("_sb"))).alias("corr"))


def combination_search(stream: DataFrame, key: str, date: str, r: str, sizes: tuple[int, ...] = (2, 3, 4), modes: tuple[str, ...] = MODES, start: Column | None = None, end: Column | None = None, year: float = 252.0) -> DataFrame:
    """All combinations of the strategies in ``stream``, by weight mode: weights, mean correlation, return and Sharpe ratio.

    Combinations grow by one strategy a level, each from its last one on, without a join; a
    strategy's raw weight is 1 / volatility or its Sharpe ratio if positive, bounded to 0.1 / size and
    0.7 of all, and equal where none is positive. A combination's mean and deviation come from
    its strategies' moments (w'm and w'Cw), so no combined stream is made; see
    ``combined_streams`` for those chosen. The strategies are those found eligible, a bounded list.
    """
    one, pairs = (settled(x, "moments") for x in moments(stream, key, date, r, start, end))
    ids = one.agg(F.array_sort(F.collect_list(key)).alias("ids"))
    level = ids.select("ids", F.explode(F.sequence(F.lit(1), F.size("ids"))).alias("last")).filter(F.col("last") <= F.size("ids")).withColumn("at", F.array("last"))
    found = None
    for size in range(1, max(sizes) + 1):
        if size > 1:
            more = F.when(F.col("last") < F.size("ids"), F.sequence(F.col("last") + 1, F.size("ids"))).otherwise(F.array().cast("array<int>"))
            level = level.select("ids", "at", F.explode(more).alias("last")).withColumn("at", F.concat("at", F.array("last")))
        if size in sizes:
            found = level if found is None else found.unionByName(level)
    c = found.select(F.transform("at", lambda i: F.element_at("ids", i)).alias("names")).withColumn("size", F.size("names")).withColumn("strategies", F.array_join(F.transform("names", lambda x: x.cast("string")), "+"))
    legs = c.select("strategies", "size", F.explode("names").alias(key)).join(one, key)
    raw = {"equal": F.lit(1.0), "inverse_volatility": F.when(F.col("sd") > 1e-12, 1.0 / F.col("sd")).otherwise(0.0), "positive_sharpe": F.when(F.col("sd") > 1e-12, F.greatest(F.col("mean") / F.col("sd"), F.lit(0.0))).otherwise(0.0)}
    legs = legs.select("strategies", "size", key, "mean", F.inline(F.array(*[F.struct(F.lit(m).alias("mode"), raw[m].alias("_raw")) for m in modes])))
    whole = Window.partitionBy("strategies", "mode")
    share = F.when(F.sum("_raw").over(whole) > 0, F.least(F.lit(0.7), F.greatest(0.1 / F.col("size"), F.col("_raw") / F.sum("_raw").over(whole)))).otherwise(1.0 / F.col("size"))
    share = F.when(F.col("mode") == "equal", 1.0 / F.col("size")).otherwise(share)
    legs = legs.withColumn("_w", share).withColumn("weight", F.col("_w") / F.sum("_w").over(whole))
    g = legs.groupBy("strategies", "size", "mode").agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col("weight").alias("w")))).alias("x"), F.sum(F.col("weight") * F.col("mean")).alias("mean"))
    # Of each two strategies (a <= b) both weights; twice for two different ones.
    two = F.flatten(F.transform("x", lambda a: F.transform(F.filter("x", lambda b: b["k"] >= a["k"]), lambda b: F.struct(a["k"].alias("a"), b["k"].alias("b"), (a["w"] * b["w"] * F.when(a["k"] == b["k"], 1.0).otherwise(2.0)).alias("ww")))))
    spread = g.select("strategies", "mode", F.inline(two)).join(pairs, ["a", "b"]).groupBy("strategies", "mode").agg(F.sum(F.col("ww") * F.col("cov")).alias("_var"), F.avg(F.when(F.col("a") != F.col("b"), F.col("corr"))).alias("correlation"))
    d = g.join(spread, ["strategies", "mode"]).withColumn("sd", F.sqrt(F.greatest(F.lit(0.0), F.col("_var"))))
    return d.select("strategies", "size", "mode", F.transform("x", lambda v: v["w"]).alias("weights"), F.coalesce("correlation", F.lit(0.0)).alias("correlation"), "mean", "sd", F.when(F.col("sd") > 1e-12, F.sqrt(F.lit(year)) * F.col("mean") / F.col("sd")).alias("sharpe"))


def combined_streams(stream: DataFrame, chosen: DataFrame, key: str, date: str, r: str) -> DataFrame:
    """The daily streams of ``chosen`` combinations (strategies, mode, weights), of all dates on which one of their strategies has a return."""
    named = F.arrays_zip(F.split("strategies", r"\+").alias("k"), F.col("weights").alias("w"))
    legs = chosen.select("strategies", "mode", F.inline(named)).withColumnRenamed("k", key)
    return legs.join(stream.withColumn(key, F.col(key).cast("string")), key).groupBy("strategies", "mode", date).agg(F.sum(F.col("w") * F.coalesce(F.col(r), F.lit(0.0))).alias("r"))


def combinations(stream: DataFrame, key: str, date: str, r: str, weights: DataFrame | None = None) -> DataFrame:
    """Pairs of strategies (a < b), equal or inverse-volatility weights, and the combined daily stream."""
    v = stream.groupBy(key).agg((1.0 / F.nullif(F.stddev_samp(r), F.lit(0.0))).alias("iv"))
    ids = v.select(F.col(key).alias("a"), F.col("iv").alias("va")).join(v.select(F.col(key).alias("b"), F.col("iv").alias("vb")), F.col("a") < F.col("b"))
    modes = ids.select("a", "b", F.explode(F.array(F.struct(F.lit("equal").alias("mode"), F.lit(0.5).alias("wa"), F.lit(0.5).alias("wb")), F.struct(F.lit("inverse_volatility").alias("mode"), (F.col("va") / (F.col("va") + F.col("vb"))).alias("wa"), (F.col("vb") / (F.col("va") + F.col("vb"))).alias("wb")))).alias("x")).select("a", "b", "x.*")
    legs = modes.select("a", "b", "mode", F.explode(F.array(F.struct(F.col("a").alias(key), F.col("wa").alias("w")), F.struct(F.col("b").alias(key), F.col("wb").alias("w")))).alias("y")).select("a", "b", "mode", f"y.{key}", "y.w")
    return legs.join(stream, key).groupBy("a", "b", "mode", date).agg(F.sum(F.col("w") * F.col(r)).alias("r"))


def weights(stream: DataFrame, key: str, r: str, most: float = 0.4) -> DataFrame:
    """Equal and inverse-volatility weights, clipped at ``most`` and normalised."""
    v = stream.groupBy(key).agg((1.0 / F.nullif(F.stddev_samp(r), F.lit(0.0))).alias("iv"))
    t = v.agg(F.sum("iv").alias("s"), F.count("*").alias("n"))
    d = v.crossJoin(t).withColumn("c", F.least(F.col("iv") / F.col("s"), F.lit(most)))
    return d.crossJoin(d.agg(F.sum("c").alias("cs"))).select(key, (1.0 / F.col("n")).alias("equal"), (F.col("c") / F.col("cs")).alias("inverse_volatility"))


def promotion(folds: Column, positive: Column, stress: Column, match: Column) -> Column:
    """V14, V22, V12."""
    return F.when(match < 0.99, "REPLAY_MISMATCH").when((folds >= 3) & (positive >= 0.75) & (stress > 0), "VALIDATED").when((folds >= 2) & (positive >= 0.5), "RESEARCH").otherwise("REJECTED")


def merged_evidence(base: DataFrame, evidence: dict[str, DataFrame], key: str) -> DataFrame:
    """Evidence tables joined to the list; ``complete`` where each gave exactly one row."""
    d, ok = base, F.lit(True)
    for name, e in evidence.items():
        one = e.groupBy(key).agg(F.count("*").alias(f"{name}_rows"), F.first("status").alias(f"{name}_status"))
        d = d.join(one, key, "left").fillna(0, [f"{name}_rows"]).fillna("MISSING", [f"{name}_status"])
        ok = ok & (F.col(f"{name}_rows") == 1)
    return d.withColumn("complete", ok)


def classified_against(df: DataFrame, base: str, score: str, by: list[str], margin: float = 0.0) -> DataFrame:
    """Each variant against BASE: IMPROVES, HURTS or NEUTRAL."""
    b = df.filter(F.col("variant") == base).select(*by, F.col(score).alias("_b"))
    d = F.col(score) - F.col("_b")
    return df.filter(F.col("variant") != base).join(b, by).withColumn("verdict", F.when(d > margin, "IMPROVES").when(d < -margin, "HURTS").otherwise("NEUTRAL")).drop("_b")


def registry_union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two registries as one, with how often each key stands in it."""
    d = a.withColumn("origin", F.lit("a")).unionByName(b.withColumn("origin", F.lit("b")), allowMissingColumns=True)
    return d.withColumn("copies", F.count("*").over(Window.partitionBy(key)))


def audit_gates(folds: DataFrame, least: int = 3) -> DataFrame:
    """Recorded fold results against buy-and-hold: folds, share that wins, worst drawdown, gate."""
    g = folds.groupBy("key").agg(F.count("*").alias("folds"), F.avg((F.col("total_return") > F.col("buy_hold_return")).cast("double")).alias("beats"), F.min("max_drawdown").alias("worst_drawdown"), F.sum("trades").alias("trades"))
    return g.withColumn("passed", (F.col("folds") >= least) & (F.col("beats") >= 0.5) & (F.col("worst_drawdown") > -0.5) & (F.col("trades") > 0))
