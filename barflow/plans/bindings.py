"""Tables of the library's own shapes, derived from the given tables; each with the SQL that derives the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a given table for each partition of what is dealt by a key.
ROWS = 150_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; timestamps without a zone become UTC timestamps once, here."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for f in df.schema.fields:
        if f.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return df


def parts(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Partitions for a key of a given table: they grow with its rows (told by the files' footers), so that a task's memory does not."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, name).count() // ROWS))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades from events: symbol = event_type, price = value, size = 1 + k."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), (1.0 + F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(0.0))).alias("size"))


def bars(spark: SparkSession, sf_dir: str, minutes: int) -> DataFrame:
    """Bars of ticks: first, max, min, last by (ts, event_id), summed size."""
    step = minutes * 60
    start = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / step) * step)
    key = F.struct("ts", "event_id")
    return (ticks(spark, sf_dir).groupBy("symbol", start.alias("ts0")).agg(
        F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"), F.sum("size").alias("volume"))
        .withColumnRenamed("ts0", "ts"))


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of line items: symbol = supplier, price = extended price / quantity; dealt by symbol, which serves the bars and all windows over them."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("symbol"), F.to_date("l_shipdate").alias("ts"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), "l_quantity",
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    li = li.repartition(parts(spark, sf_dir, "lineitem"), "symbol")
    return li.groupBy("symbol", "ts").agg(F.min_by("price", "k").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "k").alias("close"), F.sum("l_quantity").alias("volume"))


def provider_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars by source (the return flag), with priorities A=1, N=2, R=3."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("symbol"), F.to_date("l_shipdate").alias("ts"), F.col("l_returnflag").alias("source"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), "l_quantity",
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    return (li.groupBy("symbol", "ts", "source").agg(F.min_by("price", "k").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "k").alias("close"), F.sum("l_quantity").alias("volume"))
            .withColumn("priority", F.when(F.col("source") == "A", 1).when(F.col("source") == "N", 2).otherwise(3)))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of orders: a customer's order to the next one; gross return by total price."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders")
    o = o.select(F.col("o_orderpriority").alias("hypothesis_id"), F.col("o_custkey").cast("string").alias("symbol"), F.col("o_orderdate").alias("entry_time"), F.lead("o_orderdate").over(w).alias("exit_time"),
                 F.col("o_totalprice").alias("entry_price"), F.lead("o_totalprice").over(w).alias("exit_price"), F.col("o_orderkey").alias("trade_id"), (F.col("o_orderstatus") == "P").alias("forced"))
    return (o.filter("exit_time IS NOT NULL").withColumn("gross_return", F.col("exit_price") / F.col("entry_price") - 1.0)
            .withColumn("duration_bars", F.datediff("exit_time", "entry_time").cast("long")))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News of documents: title = first 12 words, provider = source, one hour by doc_id."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("source").alias("provider"), F.array_join(F.slice(F.split("text", r"\s+"), 1, 12), " ").alias("title"), F.col("text").alias("summary"),
                    (F.lit(1704067200) + F.col("doc_id") % 720 * 3600).cast("long").alias("published"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session for each event date: 14:30 to 21:00 UTC, every 7th date to 18:00."""
    d = table(spark, sf_dir, "events").select(F.to_date("ts").alias("session_date")).distinct()
    day = F.unix_timestamp(F.col("session_date").cast("timestamp"))
    hours = F.when(F.pmod(F.datediff("session_date", F.lit("1970-01-01")), F.lit(7)) == 0, 18 * 3600).otherwise(21 * 3600)
    return d.select("session_date", F.timestamp_seconds(day + 52200).alias("market_open"), F.timestamp_seconds(day + hours).alias("market_close"))


# The same tables in SQL, as bodies of a WITH clause.
SQL = {
    "ticks": "ticks AS (SELECT event_id, event_type AS symbol, ts, value AS price, 1.0 + coalesce(CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS size FROM events)",
    "daily": """li AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS ts, l_returnflag AS source, l_extendedprice / l_quantity AS price, l_quantity, l_orderkey * 10 + l_linenumber AS k FROM lineitem),
bars AS (SELECT symbol, ts, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close, sum(l_quantity) AS volume, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM li GROUP BY symbol, ts)""",
    "providers": """li AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS ts, l_returnflag AS source, l_extendedprice / l_quantity AS price, l_quantity, l_orderkey * 10 + l_linenumber AS k FROM lineitem),
pb AS (SELECT symbol, ts, source, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close, sum(l_quantity) AS volume, CASE source WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS priority FROM li GROUP BY symbol, ts, source)""",
    "trades": """t0 AS (SELECT o_orderpriority AS hypothesis_id, CAST(o_custkey AS VARCHAR) AS symbol, o_orderdate AS entry_time, lead(o_orderdate) OVER w AS exit_time, o_totalprice AS entry_price, lead(o_totalprice) OVER w AS exit_price, o_orderkey AS trade_id, o_orderstatus = 'P' AS forced
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
trades AS (SELECT *, exit_price / entry_price - 1.0 AS gross_return, CAST(date_diff('day', CAST(entry_time AS DATE), CAST(exit_time AS DATE)) AS BIGINT) AS duration_bars FROM t0 WHERE exit_time IS NOT NULL)""",
    "news": "news AS (SELECT doc_id AS id, source AS provider, array_to_string(regexp_split_to_array(text, '\\s+')[1:12], ' ') AS title, text AS summary, 1704067200 + doc_id % 720 * 3600 AS published FROM documents)",
    "sessions": """sd AS (SELECT DISTINCT CAST(ts AS DATE) AS session_date FROM events),
sessions AS (SELECT session_date, CAST(epoch(session_date) AS BIGINT) + 52200 AS market_open, CAST(epoch(session_date) AS BIGINT) + CASE WHEN date_diff('day', DATE '1970-01-01', session_date) % 7 = 0 THEN 64800 ELSE 75600 END AS market_close FROM sd)""",
}


def bars_sql(minutes: int) -> str:
    step = minutes * 60
    return SQL["ticks"] + f""",
bars AS (SELECT symbol, CAST(floor(epoch(ts) / {step}) * {step} AS BIGINT) AS ts, arg_min(price, (ts, event_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, event_id)) AS close, sum(size) AS volume,
  row_number() OVER (PARTITION BY symbol ORDER BY CAST(floor(epoch(ts) / {step}) * {step} AS BIGINT)) AS rn FROM ticks GROUP BY symbol, CAST(floor(epoch(ts) / {step}) * {step} AS BIGINT))"""


def with_sql(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
