"""Trades from signals (K01-K04, K06, K10-K13, K16-K18, kernel R2).

A signal's exit does not depend on earlier trades, so candidates are built by windows and bounded
range joins; of rules that depend on what was taken before, R2 folds runs of overlapping candidates, and
capacity and lanes pass a group's sorted rows one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as w
from ..functions.ordered import one_by_one
from ..sources.files import settled

_FIELDS = ["signal", "exit_rn", "entry_time", "exit_time", "entry_price", "exit_price", "gross_return", "score", "duration_bars", "forced"]


def non_overlapping(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """R2: in order of signal, those whose signal is not before the last taken one's exit.

    A running maximum of exits cuts a key's candidates where nothing is open: what stands before
    such a point decides nothing after it. A run between two points, candidates that overlap one
    another, is folded as an array in the JVM; runs are groups of their own. Ties of signal go to
    the earlier exit, then to the least row.
    """
    rest = ["signal", "exit_rn", *[c for c in candidates.columns if c not in (*keys, "signal", "exit_rn")]]
    w = Window.partitionBy(*keys).orderBy("signal", "exit_rn")
    open_until = F.max("exit_rn").over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = candidates.withColumn("_idle", F.coalesce((F.col("signal") >= open_until).cast("int"), F.lit(1)))
    d = d.withColumn("_run", F.sum("_idle").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = d.groupBy(*keys, "_run").agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("_c"))

    def step(state, row):
        return F.when(row["signal"] >= state["last"], F.struct(row["exit_rn"].alias("last"), F.concat(state["taken"], F.array(row)).alias("taken"))).otherwise(state)

    first = F.struct(F.lit(-1).cast("long").alias("last"), F.slice("_c", 1, 0).alias("taken"))
    return runs.select(*keys, F.inline(F.aggregate("_c", first, step, lambda state: state["taken"]))).select(*candidates.columns)


def from_signals(bars: DataFrame, max_hold: int, stop: str | None = None, target: str | None = None, score: str | None = None) -> DataFrame:
    """Next-open entry; exit at the open after the first exit signal, or after ``max_hold`` bars, or at the series' end.

    ``bars`` is indexed and has boolean columns entry and exit. ``stop`` and ``target`` name
    distances from the entry price; within the holding bars a stop counts before a target of the
    same bar, at the open where that lies beyond. Candidates that leave at their entry bar's open,
    or at no price, are void and do not block later ones.
    """
    d = _held(bars, [("entry", "exit")], max_hold)
    if not (stop or target):
        return _finished(d.filter("_c0 IS NOT NULL").select("symbol", "_c0.*", (F.col(score) if score else F.lit(0.0)).alias("score"), F.lit(False).alias("_hit")), ["symbol"])
    # Each candidate meets its own holding bars, which stand in its row: at most max_hold + 1.
    distance = lambda c: F.col(c) if c else F.lit(None).cast("double")
    c = d.withColumns({"_score": F.col(score) if score else F.lit(0.0), "_sd": distance(stop), "_td": distance(target)}).select("symbol", "sup", "blk", "pos", "rn", "ts", "open", "high", "low", "_c0", "_score", "_sd", "_td")
    c = w.with_ahead(c, F.col("_c0").isNotNull(), max_hold + 1, "ts", "open", "high", "low").select("symbol", "_c0.*", F.col("_score").alias("score"), "_sd", "_td", "_path")
    sp, tp = F.col("entry_price") - F.col("_sd"), F.col("entry_price") + F.col("_td")
    first = F.get(F.filter("_path", lambda b: (b["rn"] <= F.col("exit_rn")) & (F.coalesce(b["low"] <= sp, F.lit(False)) | F.coalesce(b["high"] >= tp, F.lit(False)))), 0)
    c = c.withColumn("_h", first).drop("_path")
    price = F.when(F.col("_h.low") <= sp, F.least("_h.open", sp)).when(F.col("_h.high") >= tp, F.greatest("_h.open", tp))
    return _finished(_hit(c, price), ["symbol"])


def from_several(bars: DataFrame, key: str, signals: dict, max_hold: int) -> DataFrame:
    """K01 without stops for several strategies, in one pass over indexed bars: trades with ``key``, by which they stay apart.

    ``signals`` maps a key to a function that adds entry and exit to bars.
    """
    flags = []
    for i, make in enumerate(signals.values()):
        flags.append((f"_entry{i}", f"_exit{i}"))
        bars = make(bars).withColumnsRenamed({"entry": f"_entry{i}", "exit": f"_exit{i}"})
    d = _held(bars, flags, max_hold)
    all_ = F.array(*[F.when(F.col(f"_c{i}").isNotNull(), F.struct(F.lit(k).alias(key), f"_c{i}.*")) for i, k in enumerate(signals)])
    c = d.select("symbol", F.explode(F.filter(all_, lambda x: x.isNotNull())).alias("_c")).select("symbol", "_c.*", F.lit(0.0).alias("score"), F.lit(False).alias("_hit"))
    return _finished(c, [key, "symbol"])


def _held(bars: DataFrame, flags: list[tuple[str, str]], max_hold: int) -> DataFrame:
    """For each pair of entry and exit flags, ``_c0`` and so on: the candidate that starts at a row (signal, entry and exit, forced), or null.

    All of it comes from windows of one order and one read backwards, so bars are sorted and not joined.
    """
    d = bars.withColumns({"_next": w.lead(F.struct("rn", "ts", "open")), "_hold": w.lead(F.struct("rn", "ts", "open"), max_hold + 1), "_last": w.newest(F.struct("rn", "ts", "open"))})
    d = d.withColumns({f"_x{i}": w.next_of(F.when(F.col(x), F.col("_next"))) for i, (_, x) in enumerate(flags)})
    limit = F.coalesce("_hold", "_last")
    out = {}
    for i, (entry, _) in enumerate(flags):
        natural = F.coalesce(f"_x{i}", "_last")
        left = F.when(natural["rn"] <= limit["rn"], natural).otherwise(limit)
        c = F.struct(F.col("rn").alias("signal"), F.col("_next.ts").alias("entry_time"), F.col("_next.open").alias("entry_price"), left["rn"].alias("exit_rn"), left["ts"].alias("exit_time"), left["open"].alias("exit_price"),
                     (F.col(f"_x{i}").isNull() | (limit["rn"] < natural["rn"])).alias("forced"))
        out[f"_c{i}"] = F.when(F.col(entry) & (F.col("_next.open") > 0), c)
    return d.withColumns(out)


def _hit(c: DataFrame, price: Column) -> DataFrame:
    """Candidates that leave at the bar ``_h``, where there is one, at ``price``."""
    hit = F.col("_h").isNotNull()
    return c.withColumns({"_hit": hit, "exit_rn": F.coalesce("_h.rn", "exit_rn"), "exit_time": F.when(hit, F.col("_h.ts")).otherwise(F.col("exit_time")), "exit_price": F.coalesce(price, "exit_price"), "forced": F.col("forced") & ~hit})


def _finished(c: DataFrame, keys: list[str]) -> DataFrame:
    """Returns of candidates, void ones dropped, then R2."""
    c = c.withColumn("gross_return", F.col("exit_price") / F.col("entry_price") - 1.0).withColumn("duration_bars", F.col("exit_rn") - F.col("signal") - 1)
    c = c.filter((F.col("exit_price") > 0) & ((F.col("duration_bars") > 0) | F.col("_hit")))
    return non_overlapping(c.select(*keys, *_FIELDS), keys)


def first_profitable(bars: DataFrame, max_hold: int, score: str | None = None) -> DataFrame:
    """Next-open entry, left at the open after the first close over the entry price, or by force after ``max_hold`` bars."""
    d = bars.withColumn("_score", F.col(score) if score else F.lit(0.0)).select("symbol", "sup", "blk", "pos", "rn", "ts", "open", "close", "entry", "_score")
    d = w.with_ahead(d, F.col("entry"), max_hold + 1, "ts", "open", "close").filter(F.size("_path") > 0)
    first, m = F.get("_path", 0), F.size("_path")
    # The last of these bars can only be left at.
    at = F.get(F.filter(F.slice("_path", F.lit(1), F.greatest(m - 1, F.lit(0))), lambda b: b["close"] > first["open"]), 0)["rn"]
    d = d.withColumn("_at", at).withColumn("_left", F.get("_path", F.coalesce(F.col("_at") - F.col("rn"), m - 1).cast("int")))
    c = d.select("symbol", F.col("rn").alias("signal"), first["ts"].alias("entry_time"), first["open"].alias("entry_price"), F.col("_left.rn").alias("exit_rn"), F.col("_left.ts").alias("exit_time"), F.col("_left.open").alias("exit_price"),
                 F.col("_at").isNull().alias("forced"), F.col("_score").alias("score"), F.lit(False).alias("_hit"))
    return _finished(c, ["symbol"])


def trailing(bars: DataFrame, stop_pct: float, target_pct: float, max_hold: int) -> DataFrame:
    """Next-open entry, a stop that trails the highest high since, a fixed target; the stop counts first.

    The trailing stop of a bar rests on the highs before it, from the entry price on.
    """
    d = bars.select("symbol", "sup", "blk", "pos", "rn", "ts", "open", "high", "low", "entry")
    d = w.with_ahead(d, F.col("entry"), max_hold + 1, "ts", "open", "high", "low").filter(F.get("_path", 0)["open"] > 0)
    first, left = F.get("_path", 0), F.get("_path", F.size("_path") - 1)
    c = d.select("symbol", F.col("rn").alias("signal"), first["ts"].alias("entry_time"), first["open"].alias("entry_price"), left["rn"].alias("exit_rn"), left["ts"].alias("exit_time"), left["open"].alias("exit_price"), F.lit(True).alias("forced"), F.lit(0.0).alias("score"), "_path")
    tp = F.col("entry_price") * (1.0 + target_pct)

    def step(s: Column, b: Column) -> Column:
        sp = s["hi"] * (1.0 - stop_pct)
        price = F.when(b["low"] <= sp, F.least(b["open"], sp)).when(b["high"] >= tp, F.greatest(b["open"], tp))
        out = F.struct(F.greatest(s["hi"], b["high"]).alias("hi"), F.when((b["low"] <= sp) | (b["high"] >= tp), F.struct(b["rn"].alias("rn"), b["ts"].alias("ts"), price.alias("price"))).alias("h"))
        return F.when(s["h"].isNotNull(), s).otherwise(out)

    kind = f"struct<rn:{dict(bars.dtypes)['rn']},ts:{dict(bars.dtypes)['ts']},price:double>"
    c = c.withColumn("_h", F.aggregate("_path", F.struct(F.col("entry_price").alias("hi"), F.lit(None).cast(kind).alias("h")), step, lambda s: s["h"])).drop("_path")
    return _finished(_hit(c, F.col("_h.price")), ["symbol"])


def limit_fills(bars: DataFrame, atr_col: str, pullback_atr: float, stop_atr: float, valid: int, exit_lookback: int) -> tuple[DataFrame, DataFrame]:
    """Signals whose limit order (low - k ATR, good for ``valid`` bars) is touched, with the first touching bar ``fill``; and the bars with their count ``_n`` and the next structural exit bar ``_x`` at or after each."""
    up = F.coalesce(F.col("close") > w.rolling_max("high", exit_lookback, 1), F.lit(False))
    score = F.col("score") if "score" in bars.columns else F.lit(0.0)
    d = bars.withColumn("_n", w.newest("rn")).withColumn("_x", w.next_of(F.when(up & (F.col("rn") < F.col("_n")), F.col("rn")), own=True))
    d = d.withColumn("_path", w.ahead(valid, "ts", "open", "low", "_x")).withColumn("_limit", F.when(F.col("entry") & F.col(atr_col).isNotNull(), F.col("low") - pullback_atr * F.col(atr_col)))
    d = d.withColumn("_f", F.get(F.filter("_path", lambda b: b["low"] <= F.col("_limit")), 0)).withColumn("_sd", stop_atr * F.col(atr_col)).withColumn("_score", score)
    # Bars and fills come from one pass.
    d = settled(d.select("symbol", "rn", "ts", "open", "high", "low", "close", "_n", "_x", "_limit", "_sd", "_score", "_f"), "pullback-bars")
    f = d.filter("_f IS NOT NULL").select("symbol", F.col("_f.rn").alias("fill"), F.col("rn").alias("signal"), "_limit", "_sd", F.col("_score").alias("score"), F.col("_f.open").alias("_open"), F.col("_f.ts").alias("entry_bar"), "_n", F.col("_f._x").alias("_x"))
    return f, d.drop("_limit", "_sd", "_score", "_f")


def stop_touches(f: DataFrame, p: DataFrame) -> DataFrame:
    """Bars from a fill to its structural exit whose low reaches the stop, entry_price - _sd."""
    path = f.select("symbol", "signal", (F.col("entry_price") - F.col("_sd")).alias("_sp"), F.explode(F.sequence("fill", F.greatest("fill", F.coalesce("_x", F.col("_n") - 1)))).alias("rn"))
    return path.join(p.select("symbol", "rn", "ts", "open", "low", "_n"), ["symbol", "rn"]).filter((F.col("low") <= F.col("_sp")) & (F.col("rn") < F.col("_n"))).drop("_n")


def first_touch(f: DataFrame, p: DataFrame, rows: int = 256) -> DataFrame:
    """Of each fill, the first bar up to its structural exit whose low reaches the stop: symbol, signal and ``_h`` (rn, price, at).

    A candidate meets the bars of its own block, then the least lows of later blocks, then the bars of
    the first block that reaches down to the stop, so a long wait costs a row for each block.
    """
    c = f.select("symbol", "signal", "fill", (F.col("entry_price") - F.col("_sd")).alias("_sp"), F.least(F.coalesce("_x", F.col("_n") - 1), F.col("_n") - 1).alias("_end")).filter(F.col("fill") <= F.col("_end"))
    block = lambda c: F.floor((F.col(c) - 1) / rows)
    c = c.withColumn("_own", block("fill")).withColumn("_last", block("_end"))
    bars = p.select("symbol", "rn", "ts", "open", "low")

    def hits(d: DataFrame, first: Column, last: Column) -> DataFrame:
        path = d.select("symbol", "signal", "_sp", F.explode(F.sequence(first, last)).alias("rn")).join(bars, ["symbol", "rn"]).filter(F.col("low") <= F.col("_sp"))
        return path.groupBy("symbol", "signal").agg(F.min_by(F.struct("rn", F.least("open", "_sp").alias("price"), F.col("ts").alias("at")), "rn").alias("_h"))

    near = hits(c, F.col("fill"), F.least("_end", (F.col("_own") + 1) * rows))
    lows = bars.groupBy("symbol", block("rn").alias("_b")).agg(F.min("low").alias("_low"))
    later = c.join(near, ["symbol", "signal"], "left_anti").filter("_own < _last")
    found = later.withColumn("_b", F.explode(F.sequence(F.col("_own") + 1, F.col("_last")))).join(lows, ["symbol", "_b"]).filter(F.col("_low") <= F.col("_sp"))
    found = found.groupBy("symbol", "signal", "_sp", "_end").agg(F.min("_b").alias("_b"))
    return near.unionByName(hits(found, F.col("_b") * rows + 1, F.least("_end", (F.col("_b") + 1) * rows)))


def left_at(c: DataFrame, p: DataFrame) -> DataFrame:
    """Exits of filled candidates: at the stop (_h: its bar, price, and time where that is finer than the bar), else at the open after the structural exit, else at the last close."""
    c = c.withColumn("exit_rn", F.coalesce("_h.rn", F.col("_x") + 1, "_n")).withColumn("forced", F.col("_h").isNull() & F.col("_x").isNull())
    x = p.select("symbol", F.col("rn").alias("exit_rn"), F.col("ts").alias("_xt"), F.col("open").alias("_xo"), F.col("close").alias("_xc"))
    c = c.join(x, ["symbol", "exit_rn"]).withColumn("exit_price", F.coalesce("_h.price", F.when(F.col("forced"), F.col("_xc")).otherwise(F.col("_xo")))).withColumn("exit_time", F.coalesce("_h.at", "_xt"))
    return c.withColumn("gross_return", F.col("exit_price") / F.col("entry_price") - 1.0).withColumn("duration_bars", F.col("exit_rn") - F.col("fill"))


def pullback(bars: DataFrame, atr_col: str, pullback_atr: float, stop_atr: float, valid: int, exit_lookback: int) -> DataFrame:
    """After a signal a limit order at its low - k ATR stands for ``valid`` bars; then a stop by ATR, before a close over the highest high of the ``exit_lookback`` bars before, left at the next open.

    Fills are at the open where that lies beyond the limit or the stop. ``bars`` is indexed, with
    entry, the ATR and, if there is one, a score.
    """
    f, p = limit_fills(bars, atr_col, pullback_atr, stop_atr, valid, exit_lookback)
    f = f.withColumn("entry_price", F.least("_open", "_limit")).filter("entry_price > 0").withColumn("entry_time", F.col("entry_bar"))
    hit = first_touch(f, p)
    return non_overlapping(left_at(f.join(hit, ["symbol", "signal"], "left"), p).select("symbol", *_FIELDS), ["symbol"])


def ma_position(bars: DataFrame, fast: int, slow: int, bps: float = 3.0) -> DataFrame:
    """Long while the fast mean is over the slow one, one bar late; return less turnover cost."""
    d = bars.withColumn("_p", F.coalesce((w.sma("close", fast) > w.sma("close", slow)).cast("double"), F.lit(0.0)))
    d = d.withColumn("position", F.coalesce(w.lag("_p"), F.lit(0.0))).withColumn("_r", F.coalesce(w.pct_change("close"), F.lit(0.0)))
    return d.withColumn("r", F.col("position") * F.col("_r") - bps / 1e4 * F.abs(F.col("position") - F.coalesce(w.lag("position"), F.lit(0.0)))).drop("_p", "_r")


def _idle_runs(trades: DataFrame, keys: list[str], order: list[str], free: Column, endless: bool) -> DataFrame:
    """Add ``_run``: a new number where nothing stands before in the key, or ``free`` holds of ``_until``, the latest exit before.

    A trade without an exit holds nothing, or with ``endless`` ends all new runs of its key.
    """
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = trades.withColumn("_until", F.max("exit_time").over(before)).withColumn("_held", F.coalesce(F.max(F.col("exit_time").isNull()).over(before), F.lit(False)))
    idle = F.col("_until").isNull() | F.coalesce(free, F.lit(False))
    d = d.withColumn("_idle", (idle & ~F.col("_held") if endless else idle).cast("int"))
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("_run", F.sum("_idle").over(upto)).drop("_until", "_held", "_idle")


def capacity_bounded(trades: DataFrame, keys: list[str], most: int) -> DataFrame:
    """By entry, then score, at most ``most`` open at once and one for each symbol; a slot frees at an exit not after the entry.

    Where no earlier trade of a key is open, taken or not, nothing before matters: the trades between
    two such points are a group of their own. They are sorted by Spark and pass one by one; only the
    open set is held.
    """

    def step(state: dict, row: dict) -> int | None:
        entry, held = row["entry_time"], state.setdefault("held", {})
        for symbol in [k for k, e in held.items() if entry is None or e is None or e <= entry]:
            del held[symbol]
        if len(held) >= most or row["symbol"] in held:
            return None
        held[row["symbol"]] = row["exit_time"]
        return 1

    order = ["entry_time", "_o", "symbol", "exit_time", "trade_id"]
    d = _idle_runs(trades.withColumn("_o", -F.col("score")), keys, order, F.col("entry_time") >= F.col("_until"), endless=False)
    taken = one_by_one(d, [*keys, "_run"], order, "_taken long", step, ["trade_id"])
    return trades.join(taken.drop("_taken", "_run"), [*keys, "trade_id"], "left_semi")


def episodes(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Holdings that touch or overlap become one episode."""
    before = Window.partitionBy(*keys).orderBy("entry_time", "exit_time", "trade_id").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy("entry_time", "exit_time", "trade_id").rowsBetween(Window.unboundedPreceding, 0)
    d = trades.withColumn("_new", F.coalesce((F.col("entry_time") > F.max("exit_time").over(before)).cast("int"), F.lit(1))).withColumn("episode", F.sum("_new").over(upto))
    return d.groupBy(*keys, "episode").agg(F.min("entry_time").alias("entry_time"), F.max("exit_time").alias("exit_time"), F.count("*").alias("trades"), (F.product(1.0 + F.col("gross_return")) - 1.0).alias("gross_return"))


def lanes(trades: DataFrame, keys: list[str]) -> DataFrame:
    """The first lane whose last exit lies before the entry, or a new one.

    Lanes count from 1 again where all earlier exits of a key lie before the entry, as any lane would
    do then; the trades between two such points are a group of their own. Only the lanes' last exits
    are held. A trade without an exit keeps its lane for good.
    """

    def step(state: dict, row: dict) -> int:
        ends = state.setdefault("ends", [])
        lane = next((k for k, e in enumerate(ends) if e is not None and row["entry_time"] is not None and e < row["entry_time"]), len(ends))
        ends[lane:lane + 1] = [row["exit_time"]]
        return lane + 1

    order = ["entry_time", "exit_time", "trade_id"]
    dealt = one_by_one(_idle_runs(trades, keys, order, F.col("entry_time") > F.col("_until"), endless=True), [*keys, "_run"], order, "lane long", step, ["trade_id"])
    return trades.join(dealt.drop("_run"), [*keys, "trade_id"])


def replay_audit(trades: DataFrame, key: str) -> DataFrame:
    """Counts of same-bar, backward and overlapping trades, and the route that follows."""
    before = Window.partitionBy(key, "symbol").orderBy("entry_time", "exit_time", "trade_id").rowsBetween(Window.unboundedPreceding, -1)
    d = trades.withColumn("_o", F.coalesce(F.col("entry_time") < F.max("exit_time").over(before), F.lit(False)))
    n = lambda c: F.sum(c.cast("long"))
    a = d.groupBy(key).agg(F.count("*").alias("trades"), n(F.col("entry_time") == F.col("exit_time")).alias("same_bar"), n(F.col("exit_time") < F.col("entry_time")).alias("backwards"), n(F.col("_o")).alias("overlaps"))
    return a.withColumn("route", F.when(F.col("backwards") > 0, "INVALID").when(F.col("overlaps") > 0, "LANES").when(F.col("same_bar") > 0, "INTRABAR").otherwise("DIRECT"))


def grid(spark, choices: dict[str, list], most: int | None = None, seed: int = 7) -> DataFrame:
    """Every combination of choices, or a seeded sample of ``most`` by hash order."""
    d = spark.range(1).drop("id")
    for name, values in choices.items():
        d = d.crossJoin(spark.createDataFrame([(v,) for v in values], [name]))
    d = d.withColumn("params", F.to_json(F.struct(*choices)))
    d = d.withColumn("hypothesis_id", F.substring(F.sha2("params", 256), 1, 16))
    return d.orderBy(F.xxhash64("params", F.lit(seed))).limit(most) if most else d


def rotation(monthly: DataFrame, n: int) -> DataFrame:
    """At each month end the n symbols of largest positive momentum over their trend."""
    rank = Window.partitionBy(F.trunc("ts", "MM")).orderBy(F.col("mom").desc_nulls_last(), "symbol")
    return monthly.filter(F.col("trend") & (F.col("mom") > 0)).withColumn("rank", F.row_number().over(rank).cast("long")).filter(F.col("rank") <= n)


def setup_trades(bars: DataFrame, wait: int, stop_atr: float, target_atr: float, max_hold: int) -> DataFrame:
    """A setup bar, confirmed within ``wait`` bars by a close over its high, then next-open entry with ATR stop and target.

    ``bars`` is indexed and has setup, exit and atr. The latest setup before a bar counts.
    """
    s = F.last(F.when(F.col("setup"), F.struct("rn", "high")), ignorenulls=True).over(w.before())
    d = bars.withColumn("_s", s).withColumn("_ok", F.coalesce((F.col("rn") - F.col("_s.rn") <= wait) & (F.col("close") > F.col("_s.high")), F.lit(False)))
    d = d.withColumn("entry", F.col("_ok") & ~F.coalesce(w.lag("_ok"), F.lit(False))).withColumn("stop", stop_atr * F.col("atr")).withColumn("target", target_atr * F.col("atr"))
    return from_signals(d.drop("_s", "_ok"), max_hold, "stop", "target")


def schedule(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Flags on the bar before each execution; a bar that would carry an entry and an exit is marked."""
    prev = bars.select("symbol", "ts", F.lag("ts").over(Window.partitionBy("symbol").orderBy("ts")).alias("at"))
    e = trades.select("symbol", F.explode(F.array(F.struct(F.col("entry_time").alias("ts"), F.lit("entry").alias("kind")), F.struct(F.col("exit_time").alias("ts"), F.lit("exit").alias("kind")))).alias("_e")).select("symbol", "_e.*")
    d = e.join(prev, ["symbol", "ts"]).filter("at IS NOT NULL")
    return d.groupBy("symbol", "at").agg(F.sum((F.col("kind") == "entry").cast("long")).alias("entries"), F.sum((F.col("kind") == "exit").cast("long")).alias("exits")).withColumn("collision", (F.col("entries") > 0) & (F.col("exits") > 0))
