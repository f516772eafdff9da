"""Structured Streaming jobs with the batch operators' semantics."""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import one_by_one


def closed_bars(ticks: DataFrame, minutes: int, delay: str = "10 minutes") -> DataFrame:
    """Bars that the watermark has closed; in append mode each is given once, late ticks never change it."""
    k = F.struct("ts", "event_id")
    return (ticks.withWatermark("ts", delay).groupBy("symbol", F.window("ts", f"{minutes} minutes").alias("w")).agg(F.min_by("price", k).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", k).alias("close"), F.sum("size").alias("volume"))
            .select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume"))


def once(events: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """A key's first row within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def sliding_context(bars: DataFrame, length: str = "2 hours", step: str = "15 minutes", delay: str = "1 hour") -> DataFrame:
    """OHLCV of overlapping windows, with the number of bars in each."""
    return (bars.withWatermark("ts", delay).groupBy("symbol", F.window("ts", length, step).alias("w")).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("n"))
            .select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "open", "high", "low", "close", "volume", "n"))


def runs(bars: DataFrame, gap: str = "16 minutes", delay: str = "1 hour") -> DataFrame:
    """Contiguous runs as session windows."""
    return bars.withWatermark("ts", delay).groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max("high").alias("high"), F.min("low").alias("low")).select("symbol", F.col("w.start").alias("start"), "n", "high", "low")


def with_context(stream: DataFrame, context: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None]):
    """Each micro-batch joined as-of to the stored context, which is read anew for it."""
    from ..operators.joins import asof

    def batch(df: DataFrame, epoch: int) -> None:
        sink(asof(df, context(), "symbol", "ts", "ts", ["close"], prefix="ctx_"), epoch)

    return stream.writeStream.foreachBatch(batch)


def _with_state(stream: DataFrame, rows: Callable[[DataFrame, DataFrame], DataFrame], state: Callable[[DataFrame, DataFrame], DataFrame], schema: str, path: str):
    """Micro-batches that know a small table of what came before.

    ``rows(batch, before)`` are written to path/out/epoch=n, and ``state(written, before)`` to
    path/state/epoch=n; a batch that runs again overwrites its own two folders.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        before = spark.read.schema(schema).parquet(f"{path}/state/epoch={epoch - 1}") if epoch else spark.createDataFrame([], schema)
        out = rows(df, before)
        out.write.mode("overwrite").parquet(f"{path}/out/epoch={epoch}")
        state(spark.read.schema(out.schema).parquet(f"{path}/out/epoch={epoch}"), before).write.mode("overwrite").parquet(f"{path}/state/epoch={epoch}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)


def cumulative_delta(ticks: DataFrame, path: str):
    """Aggressor by the tick rule and running delta of each symbol, over micro-batches, into path/out.

    Known from before are the last price, its last direction and the running delta of each symbol.
    Rows of a micro-batch are taken by time; a tick earlier than a batch before keeps its place of
    arrival.
    """
    w = Window.partitionBy("symbol").orderBy("ts", "event_id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)

    def rows(df: DataFrame, before: DataFrame) -> DataFrame:
        d = df.join(before, "symbol", "left")  # one row a symbol
        d = d.withColumn("_d", F.signum(F.nullif(F.col("price") - F.coalesce(F.lag("price").over(w), F.col("last")), F.lit(0.0))))
        d = d.withColumn("aggressor", F.coalesce(F.last("_d", ignorenulls=True).over(upto), F.col("sign"), F.lit(1.0)))
        return d.select("symbol", "event_id", "ts", "price", "aggressor", (F.coalesce("total", F.lit(0.0)) + F.sum(F.col("aggressor") * F.col("size")).over(upto)).alias("cum_delta"))

    def state(out: DataFrame, before: DataFrame) -> DataFrame:
        new = out.groupBy("symbol").agg(F.max_by(F.struct(F.col("price").alias("last"), F.col("aggressor").alias("sign"), F.col("cum_delta").alias("total")), F.struct("ts", "event_id")).alias("x")).select("symbol", "x.*")
        return new.unionByName(before.join(new, "symbol", "left_anti"))

    return _with_state(ticks, rows, state, "symbol string, last double, sign double, total double", path)


def story_leaders(news: DataFrame, path: str, least: float = 0.72, hours: int = 36):
    """Leader of each item among the provider's leaders of the last ``hours``, newest first, into path/out.

    Unlike the batch form, items are compared within their provider alone, in order of arrival.
    Known from before are each provider's recent leaders; rows pass one by one. Titles that are
    similar share two of their first tokens (longest first) at least, or one where one may be all they
    share: a leader is looked up by these, not among all that are held.
    """

    def marks(tokens: set[str]) -> list:
        """What two similar titles have in common: they share ceil(least * n) of n tokens, and so 2 of their first n - that + 2 in any order."""
        shared = math.ceil(least * len(tokens) - 1e-9)
        first = sorted(tokens, key=lambda x: (-len(x), x))[:len(tokens) - shared + 2]
        return [*itertools.combinations(first, 2), *(tokens if shared <= 1 else ())]

    def step(state: dict, row: dict) -> int | None:
        held, at, t = state.setdefault("held", {}), row["published"], set(row["tokens"] or ())
        queue, by_mark = state.setdefault("queue", []), state.setdefault("by_mark", {})
        while queue and at - queue[0][0] > hours * 3600:
            _, old = heapq.heappop(queue)
            for m in held.pop(old)[2]:
                by_mark[m].discard(old)
                if not by_mark[m]:
                    del by_mark[m]
        own = marks(t) if t else []
        hit = None
        if not row["known"]:
            found = set().union(*(by_mark.get(m, ()) for m in own))
            hit = max((k for k in found if len(t & held[k][1]) >= least * len(t | held[k][1])), default=None)
        if hit is None:
            state["n"] = n = state.get("n", 0) + 1  # the newest has the greatest number
            held[n] = (row["id"], t, own)
            heapq.heappush(queue, (at, n))
            for m in own:
                by_mark.setdefault(m, set()).add(n)
        return None if row["known"] else row["id"] if hit is None else held[hit][0]

    def rows(df: DataFrame, before: DataFrame) -> DataFrame:
        d = df.select("provider", "published", "id", "tokens").withColumn("known", F.lit(False)).unionByName(before.withColumn("known", F.lit(True)))
        return one_by_one(d.withColumn("new", ~F.col("known")), ["provider"], ["new", "published", "id", "tokens", "known"], "leader long", step, ["id", "published", "tokens"])

    def state(out: DataFrame, before: DataFrame) -> DataFrame:
        d = out.filter("id = leader").select("provider", "published", "id", "tokens").unionByName(before)
        newest = d.groupBy("provider").agg(F.max("published").alias("_m"))
        return d.join(newest, "provider").filter(F.col("_m") - F.col("published") <= hours * 3600).drop("_m")

    return _with_state(news, rows, state, "provider string, published long, id long, tokens array<string>", path)


def quarantined(stream: DataFrame, good: str, bad: str, audit: str, checkpoint: str):
    """Rows of each micro-batch to good or bad files, with an audit row; a batch that runs again overwrites its own."""
    from ..operators.quality import split_bad

    def batch(df: DataFrame, epoch: int) -> None:
        df.persist()
        ok, no, counts = split_bad(df)
        ok.write.mode("overwrite").parquet(f"{good}/epoch={epoch}")
        no.write.mode("overwrite").parquet(f"{bad}/epoch={epoch}")
        counts.write.mode("overwrite").parquet(f"{audit}/epoch={epoch}")
        df.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True)
