"""Streams run to their end give the batch result."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from barflow.operators import news as n
from barflow.plans import bindings as b
from barflow.streaming import jobs as x

SF = "/root/testdata/sf0.001"


def run(spark, out, tmp_path, mode="append"):
    q = out.writeStream.outputMode(mode).format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(str(tmp_path / "out"))


def stream(spark, df, tmp_path):
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def test_sliding_and_session_windows(spark, tmp_path):
    bars = b.bars(spark, SF, 15)
    (tmp_path / "a").mkdir()
    got = run(spark, x.sliding_context(stream(spark, bars, tmp_path), "2 hours", "1 hour"), tmp_path / "a")
    assert got.count() > 0 and got.filter("n > 8").count() == 0
    (tmp_path / "b").mkdir()
    assert run(spark, x.runs(spark.readStream.schema(bars.schema).parquet(str(tmp_path / "in"))), tmp_path / "b").count() > 0


def test_context_by_micro_batch(spark, tmp_path):
    t = b.ticks(spark, SF).select("event_id", "symbol", "ts")
    got = []
    q = x.with_context(stream(spark, t, tmp_path), lambda: b.bars(spark, SF, 60), lambda df, e: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(got) == t.count() and all(r.ctx_source_time <= r.ts for r in got if r.ctx_source_time)


def test_stream_stories_and_quarantine(spark, tmp_path):
    d = b.news(spark, SF).select("id", "provider", "published", n.title_tokens(F.col("title")).alias("tokens"))
    d.filter("id % 2 = 0").coalesce(1).write.parquet(str(tmp_path / "in"))
    d.filter("id % 2 = 1").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    x.story_leaders(src, str(tmp_path / "st")).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "st" / "out"))
    assert got.count() == d.count() and got.select("epoch").distinct().count() == 2
    assert got.alias("a").join(got.filter("id = leader").alias("z"), F.expr("a.leader = z.id AND a.provider = z.provider")).count() == d.count()
    bars = b.bars(spark, SF, 60)
    (tmp_path / "q").mkdir()
    q = x.quarantined(stream(spark, bars.withColumn("close", F.when(F.col("symbol") == "click", F.col("close"))), tmp_path / "q"), str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "audit"), str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "good")).count() + spark.read.parquet(str(tmp_path / "bad")).count() == bars.count()


def test_delta_goes_on_from_batch_to_batch(spark, tmp_path):
    t = b.ticks(spark, SF).orderBy("ts", "event_id").withColumn("k", F.row_number().over(Window.orderBy("ts", "event_id")))
    for part in ("k <= 300", "k > 300 AND k <= 301", "k > 301"):
        t.filter(part).drop("k").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(t.drop("k").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    x.cumulative_delta(src, str(tmp_path / "d")).start().awaitTermination()
    got = {r.event_id: (r.aggressor, round(r.cum_delta, 6)) for r in spark.read.parquet(str(tmp_path / "d" / "out")).collect()}
    last, want = {}, {}
    for r in t.orderBy("k").collect():
        price, sign, total = last.get(r.symbol, (None, 1.0, 0.0))
        if price is not None and r.price != price:
            sign = 1.0 if r.price > price else -1.0
        total += sign * r.size
        last[r.symbol] = (r.price, sign, total)
        want[r.event_id] = (sign, round(total, 6))
    assert got == want
