"""Labels, cross-sectional ranks, folds and panel evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as w


def forward_hold(h: int) -> Column:
    """Close h + 1 rows on over the next close."""
    return w.lead("close", h + 1) / F.nullif(w.lead("close", 1), F.lit(0.0)) - 1


def forward_open_to_close(h: int) -> Column:
    """Close h rows on over the next open."""
    return w.lead("close", h) / F.nullif(w.lead("open", 1), F.lit(0.0)) - 1


def relative_panel(returns: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(ts, symbol, raw_return) less the benchmark's return of the time."""
    b = benchmark.select("ts", F.col("raw_return").alias("benchmark_return"))
    return returns.join(b, "ts").withColumn("excess_return", F.col("raw_return") - F.col("benchmark_return"))


def centred(panel: DataFrame, value: str, least: int = 3) -> DataFrame:
    """Value less its time's mean, at times with at least ``least`` rows."""
    t = Window.partitionBy("ts")
    d = panel.filter(F.col(value).isNotNull()).withColumn("section", F.count("*").over(t)).filter(F.col("section") >= least)
    return d.withColumn("label", F.col(value) - F.avg(value).over(t))


def section_audit(centred_panel: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """One row for a centred panel: times, smallest and largest section, sections in which a symbol repeats, and whether all means vanish."""
    t = centred_panel.groupBy("ts").agg(F.count("*").alias("_n"), F.count_distinct("symbol").alias("_s"), F.abs(F.avg("label")).alias("_off"))
    return t.agg(F.count("*").alias("times"), F.min("_n").alias("smallest"), F.max("_n").alias("largest"), F.sum((F.col("_n") != F.col("_s")).cast("long")).alias("uneven"), (F.max("_off") < tolerance).alias("centred"))


def rank_pct(df: DataFrame, value: str, by: str, out: str) -> DataFrame:
    """Rank over count, ties at their average; null values get no rank."""
    v = Window.partitionBy(by).orderBy(value)
    ties = F.count("*").over(Window.partitionBy(by, value))
    n = F.count(value).over(Window.partitionBy(by))
    some = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).withColumn(out, (F.rank().over(v) + (ties - 1) / 2.0) / n)
    return some


def ordinal(df: DataFrame, value: str, by: str, tie: str, out: str) -> DataFrame:
    """1 for the greatest; ties by ``tie``; nulls last."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(by).orderBy(F.col(value).desc_nulls_last(), tie)).cast("long"))


def purged(times: DataFrame, gap: int, train: float = 0.6, valid: float = 0.2) -> DataFrame:
    """Distinct times in three periods with ``gap`` times left out before each border."""
    t = times.select("ts").distinct()
    # One row a time; the numbering is small beside the rows it labels.
    d = t.withColumn("i", F.row_number().over(Window.orderBy("ts")) - 1).crossJoin(t.agg(F.count("*").alias("n")))
    a, b = F.floor(F.col("n") * train), F.floor(F.col("n") * (train + valid))
    return d.withColumn("period", F.when(F.col("i") < a - gap, "train").when((F.col("i") >= a) & (F.col("i") < b - gap), "valid").when(F.col("i") >= b, "test")).filter("period IS NOT NULL").select("ts", "period")


def rolling_folds(times: DataFrame, hold: int, folds: int = 4, least_rows: int = 4000, least_part: int = 500) -> DataFrame:
    """(fold, segment, start, end) of an expanding train part and following valid and test parts.

    The train part starts with 0.45 of the times and grows by a test part each fold; valid and test
    are 0.1 each, ``least_part`` at least; hold + 1 times lie between parts. Fewer than
    ``least_rows`` times or three folds give no folds.
    """
    t = times.select("ts").distinct()
    d = t.withColumn("i", F.row_number().over(Window.orderBy("ts")) - 1)
    n = F.col("n")
    part = F.greatest(F.lit(least_part), F.floor(n * 0.1))
    f = t.agg(F.count("*").alias("n")).filter(n >= least_rows).select("n", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    f = f.withColumn("te", F.floor(n * 0.45) - 1 + F.col("fold") * part).withColumn("vs", F.col("te") + hold + 2).withColumn("ve", F.col("vs") + part - 1).withColumn("ss", F.col("ve") + hold + 2).withColumn("se", F.col("ss") + part - 1)
    f = f.filter("se < n").withColumn("_c", F.count("*").over(Window.partitionBy("n"))).filter("_c >= 3")
    seg = f.select("fold", F.explode(F.array(*[F.struct(F.lit(s).alias("segment"), F.col(a).cast("long").alias("a"), F.col(z).cast("long").alias("z")) for s, a, z in (("valid", "vs", "ve"), ("test", "ss", "se"))],
                                             F.struct(F.lit("train").alias("segment"), F.lit(0).cast("long").alias("a"), F.col("te").cast("long").alias("z")))).alias("x")).select("fold", "x.*")
    return seg.join(d.select(F.col("i").alias("a"), F.col("ts").alias("start")), "a").join(d.select(F.col("i").alias("z"), F.col("ts").alias("end")), "z").select("fold", "segment", "start", "end")


def contained(trades: DataFrame, folds: DataFrame) -> DataFrame:
    """Trades that start and end within a fold's segment; folds are dealt by month of entry, so it is an equi-join."""
    month = lambda c: F.trunc(F.col(c).cast("date"), "MM")
    cells = folds.filter(F.col("start") <= F.col("end")).select("*", F.explode(F.sequence(month("start"), month("end"), F.expr("INTERVAL 1 MONTH"))).alias("_m"))
    return trades.withColumn("_m", month("entry_time")).join(cells, "_m").filter((F.col("entry_time") >= F.col("start")) & (F.col("exit_time") <= F.col("end"))).drop("start", "end", "_m")


def trimmed(df: DataFrame, by: list[str], on: str, n: int) -> DataFrame:
    """A segment without its last n rows."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(on).desc()))).filter(F.col("_n") > n).drop("_n")


def period_of(c: Column, train_end: str, valid_end: str) -> Column:
    """L10."""
    return F.when(c <= F.lit(train_end).cast("date"), "train").when(c <= F.lit(valid_end).cast("date"), "validation").otherwise("test")


def common_start(frames: DataFrame, by: str, on: str) -> DataFrame:
    """Rows from the time on at which every key has begun."""
    first = frames.groupBy(by).agg(F.min(on).alias("m")).agg(F.max("m").alias("_from"))
    return frames.crossJoin(F.broadcast(first)).filter(F.col(on) >= F.col("_from")).drop("_from")


def information(panel: DataFrame, prediction: str, label: str, top: int = 1) -> DataFrame:
    """Per time: Spearman and Pearson correlation, spread of the top over the bottom rows."""
    d = panel.filter(F.col(prediction).isNotNull() & ~F.isnan(prediction) & F.col(label).isNotNull() & ~F.isnan(label))
    # One order serves the prediction's ranks and both ends: the place from above is told by that from below.
    below = Window.partitionBy("ts").orderBy(F.col(prediction), F.col("symbol").desc())
    d = d.withColumn("_b", F.row_number().over(below)).withColumn("_o", F.count("*").over(Window.partitionBy("ts")) - F.col("_b") + 1)
    d = rank_pct(rank_pct(d, prediction, "ts", "_rp"), label, "ts", "_rl")
    return d.groupBy("ts").agg(F.count("*").alias("n"), F.corr("_rp", "_rl").alias("rank_ic"), F.corr(prediction, label).alias("ic"),
                               (F.avg(F.when(F.col("_o") <= top, F.col(label))) - F.avg(F.when(F.col("_b") <= top, F.col(label)))).alias("spread"))


def series_metrics(df: DataFrame, prediction: str, label: str, by: str) -> DataFrame:
    """Per key: correlation, mean squared error, directional and balanced accuracy, spread of outer fifths."""
    p, y = F.col(prediction), F.col(label)
    q = df.groupBy(by).agg(F.percentile(prediction, F.array(F.lit(0.2), F.lit(0.8))).alias("_q"))
    d = df.join(q, by)
    hit = ((p > 0) == (y > 0)).cast("double")
    return d.groupBy(by).agg(F.corr(prediction, label).alias("ic"), F.avg((p - y) * (p - y)).alias("mse"), F.avg(hit).alias("direction"),
                             ((F.avg(F.when(y > 0, hit)) + F.avg(F.when(y <= 0, hit))) / 2.0).alias("balanced"),
                             (F.avg(F.when(p >= F.col("_q")[1], y)) - F.avg(F.when(p <= F.col("_q")[0], y))).alias("quintile_spread"))


def top_changes(df: DataFrame, value: str, k: int) -> DataFrame:
    """Per time the share of the top k that was not in the top k of the time before."""
    top = ordinal(df, value, "ts", "symbol", "_o").filter(F.col("_o") <= k).groupBy("ts").agg(F.array_sort(F.collect_list("symbol")).alias("top"))
    before = F.lag("top").over(Window.orderBy("ts"))  # one row a time
    return top.withColumn("turnover", 1.0 - F.size(F.array_intersect("top", before)) / F.size("top"))


def best_per_key(df: DataFrame, by: str, score: str, tie: str, reasons: str) -> DataFrame:
    """A key's best row, with the reasons of all its rows."""
    return df.groupBy(by).agg(F.max_by(F.struct(*[c for c in df.columns if c not in (by, reasons)]), F.struct(F.col(score), -F.col(tie))).alias("x"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(reasons)))).alias(reasons)).select(by, "x.*", reasons)


def median_seed(rows: DataFrame, by: str, score: str, seed: str) -> DataFrame:
    """Of a key's rows in order of score, then seed, the middle one (the upper of two)."""
    order, whole = Window.partitionBy(by).orderBy(score, seed), Window.partitionBy(by)
    return rows.withColumn("_i", F.row_number().over(order)).withColumn("_n", F.count("*").over(whole)).filter(F.col("_i") == F.floor(F.col("_n") / 2) + 1).drop("_i", "_n")
