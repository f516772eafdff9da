"""Landing, storing and checking tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scan(spark: SparkSession, *paths: str, kind: str = "parquet") -> DataFrame:
    """Files of different schemas as one table, by name; missing columns are null."""
    read = {"parquet": lambda p: spark.read.option("mergeSchema", True).parquet(p), "csv": lambda p: spark.read.option("header", True).csv(p), "json": lambda p: spark.read.json(p)}[kind]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [read(p) for p in paths])


def manifest(df: DataFrame, order: str = "ts") -> DataFrame:
    """Rows, first and last time, and an order-free checksum of all rows."""
    return df.agg(F.count("*").alias("rows"), F.min(order).cast("string").alias("start"), F.max(order).cast("string").alias("end"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string").alias("checksum")).withColumn("columns", F.array(*map(F.lit, sorted(df.columns))))


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path under spark.checkpoint.dir, which driver and executors share; only a session on one machine may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="barflow-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settled(df: DataFrame, label: str) -> DataFrame:
    """A table that several parts of a plan read, written once to the shared folder: neither planned nor computed again."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_bars(df: DataFrame, path: str, order: str = "ts") -> None:
    """Parquet by timeframe if there is one, with its manifest beside it."""
    w = df.write.mode("overwrite")
    (w.partitionBy("timeframe") if "timeframe" in df.columns else w).parquet(f"{path}/data")
    manifest(df.select(*sorted(df.columns)), order).write.mode("overwrite").parquet(f"{path}/manifest")


def read_bars(spark: SparkSession, path: str, order: str = "ts") -> DataFrame:
    """The stored bars, if they still are what the manifest says; else an error."""
    df = spark.read.parquet(f"{path}/data")
    want = spark.read.parquet(f"{path}/manifest").first()
    got = manifest(df.select(*sorted(df.columns)), order).first()
    if want != got:
        raise ValueError(f"stored bars differ from their manifest: {got} is not {want}")
    return df


def json_lines(raw: DataFrame, schema: str, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Parsed rows, and rows that do not parse with their text."""
    d = raw.withColumn("_x", F.from_json(column, schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("_x").isNull() | F.col("_x._corrupt").isNotNull()
    return d.filter(~bad).select("_x.*").drop("_corrupt"), d.filter(bad).select(F.col(column).alias("text"))


def flattened(payload: DataFrame, domain: str = "news") -> DataFrame:
    """Items of a refresh artifact: symbols to results to items of one domain, undated ones dropped."""
    d = payload.select(F.explode("symbols").alias("symbol", "results")).select("symbol", F.explode("results").alias("r")).filter(F.col("r.domain") == domain).select("symbol", "r.provider", F.explode("r.items").alias("i"))
    return d.select("symbol", "provider", "i.*").filter(F.col("published_at").isNotNull())


def landed_items(*columns: str) -> Column:
    """The first of several array columns that is there."""
    return F.coalesce(*map(F.col, columns))


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored table, or None where nothing is stored yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def store_buckets(new: DataFrame, path: str, key: str, merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = 64) -> list[int]:
    """Merge rows into a table of hash buckets of ``key``; returns the buckets that were written.

    Only buckets that ``new`` has keys of are read; of those, the ones whose rows changed are replaced
    whole by dynamic partition overwrite, with their row count and checksum in a manifest beside the
    data. So a run that was stopped is simply run again, and unchanged input writes nothing. The merged
    rows stand in the shared folder before anything is replaced. A null key has a bucket too. The
    number of buckets must not change between runs.
    """
    spark = new.sparkSession
    dealt = settled(new.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")), "store-new")
    touched = [r["bucket"] for r in dealt.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
    if not touched:
        return []
    old, marks = _stored(spark, f"{path}/data"), _stored(spark, f"{path}/manifest")
    merged = dealt if old is None else merge(old.filter(F.col("bucket").isin(touched)), dealt)
    merged = settled(merged.select(dealt.columns), "store-merged")
    now = merged.groupBy("bucket").agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*sorted(dealt.columns)).cast("decimal(38,0)")).cast("string").alias("checksum"))
    changed = now if marks is None else now.join(marks.select("bucket", "rows", "checksum"), ["bucket", "rows", "checksum"], "left_anti")
    ids = sorted(r["bucket"] for r in changed.select("bucket").collect())
    if ids:
        merged.filter(F.col("bucket").isin(ids)).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/data")
        now.filter(F.col("bucket").isin(ids)).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/manifest")
    return ids


def read_buckets(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of a bucket store; none where nothing was stored yet."""
    d = _stored(spark, f"{path}/data")
    return spark.createDataFrame([], schema) if d is None else d.select(schema.names)


def newest_partitions(df: DataFrame, by: str, at: str) -> DataFrame:
    """Q28: of a table stored by ``by`` and ``at``, each key's rows of its newest ``at``.

    The newest ones come from the names of the partitions; the rows are then read by partition
    pruning, so files of older ones are not opened.
    """
    last = df.select(by, at).distinct().groupBy(by).agg(F.max(at).alias(at))
    return df.join(last, [by, at], "left_semi")


def upserted(stored: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """All events of a key come from its newest version alone."""
    d = stored.unionByName(new, allowMissingColumns=True)
    w = Window.partitionBy(key)
    return d.withColumn("_v", F.max(version).over(w)).filter(F.col(version) == F.col("_v")).drop("_v")


def attestations(*files: DataFrame) -> DataFrame:
    """A later file's row of a symbol replaces an earlier one's."""
    d = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn("_k", F.lit(k)) for k, f in enumerate(files)])
    w = Window.partitionBy("symbol").orderBy(F.col("_k").desc())
    return d.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_k")


def master_coverage(master: DataFrame) -> DataFrame:
    """Share of securities with exchange and category."""
    return master.agg(F.count("*").alias("rows"), F.avg((F.col("exchange").isNotNull() & F.col("category").isNotNull()).cast("double")).alias("coverage"))


def request_windows(spans: DataFrame, days: int) -> DataFrame:
    """Half-open windows of at most ``days`` that cover (symbol, start, end)."""
    w = spans.select("symbol", "end", F.explode(F.sequence("start", F.date_sub("end", 1), F.expr(f"INTERVAL {days} DAYS"))).alias("a"))
    return w.select("symbol", F.col("a").alias("start"), F.least(F.date_add("a", days), F.col("end")).alias("end"))


def random_walk(spark: SparkSession, symbols: int, rows: int, seed: int = 42) -> DataFrame:
    """Synthetic bars for scale tests alone; no registered query uses them."""
    d = spark.range(symbols * rows).select((F.col("id") % symbols).cast("string").alias("symbol"), F.timestamp_seconds(F.floor(F.col("id") / symbols) * 3600).alias("ts"), F.randn(seed).alias("_z"))
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("close", 100.0 * F.exp(0.01 * F.sum("_z").over(w)))
    d = d.withColumn("open", F.coalesce(F.lag("close").over(Window.partitionBy("symbol").orderBy("ts")), F.col("close")))
    return d.select("symbol", "ts", "open", (F.greatest("open", "close") * 1.001).alias("high"), (F.least("open", "close") * 0.999).alias("low"), "close", (1000.0 + 100.0 * F.abs("_z")).alias("volume"))


def file_index(df: DataFrame) -> DataFrame:
    """One row for each file behind a table, with provider, symbol and interval of its partition path."""
    p = df.select(F.input_file_name().alias("path")).groupBy("path").agg(F.count("*").alias("rows"))
    part = lambda k: F.nullif(F.regexp_extract("path", rf"/{k}=([^/]+)/", 1), F.lit(""))
    return p.select("path", "rows", part("provider").alias("provider"), part("symbol").alias("symbol"), part("timeframe").alias("timeframe"))


def screened(df: DataFrame, queries: list[tuple[str, str, float]], sort: str, most: int) -> DataFrame:
    """Rows that pass (field, operator, value) tests, the ``most`` first by ``sort``: a top-k report."""
    ops = {">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, "=": lambda c, v: c == v}
    for f, op, v in queries:
        df = df.filter(ops[op](F.col(f), F.lit(v)))
    return df.orderBy(F.col(sort).desc(), *[c for c in df.columns if c != sort]).limit(most)


def payload_bars(df: DataFrame) -> DataFrame:
    """Landed bars with lower-case names of one word; the rest is canonicalisation."""
    return df.withColumnsRenamed({c: c.lower().strip().replace(" ", "_") for c in df.columns})


def staged(spark: SparkSession, path: str, parts: list[DataFrame], by: list[str]) -> DataFrame:
    """Parts appended to a staging table that is partitioned by ``by``; the whole table read back. Order is the reader's to ask for."""
    for part in parts:
        part.write.mode("append").partitionBy(*by).parquet(path)
    return spark.read.schema(parts[0].schema).parquet(path)
