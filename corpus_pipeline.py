"""A corpus pipeline over ``documents``: quality, near duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last
return the columns of ``documents``. ``run`` writes every stage's rows before the next one reads them.
Null and empty texts are judged by the classifier like others and pass the later stages unchanged
but for null texts, which the secrets stage makes empty; null doc_ids pass; repeated rows stand for
themselves except among near duplicates; empty tables give empty stages; further columns of the
input are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barflow.llm import decontaminate, minhash, packing, quality, secrets
from barflow.llm.common import written
from barflow.llm.queries import table, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    scored = quality.score(docs, table(spark, sf_dir, "labels"), keep=COLUMNS[1:])
    return scored.filter("predicted = 1").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id.

    Rows equal in doc_id and text are one document. Different texts that share a doc_id are documents of
    their own: the least text keeps the doc_id, the others stand behind all doc_ids, in the order of a
    hash. Rows without a doc_id link with nothing and stay.
    """
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1 AND doc_id IS NOT NULL").select("doc_id")
    repeated = written(repeated, "repeated-ids")  # its size is known then, and most often next to nothing
    several = docs.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text")) == 1
    behind = F.lit(1 << 62).bitwiseOR(F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 62) - 1)))
    nodes = docs.join(repeated, "doc_id", "left_anti").select(F.col("doc_id").cast("long").alias("node"), *COLUMNS)
    nodes = nodes.unionByName(several.select(F.when(first, F.col("doc_id").cast("long")).otherwise(behind).alias("node"), *COLUMNS))
    gone = minhash.near_duplicates(nodes.select(F.col("node").alias("doc_id"), "text")).filter("NOT kept").select(F.col("doc_id").alias("node")).distinct()
    return nodes.join(gone, "node", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    leaking = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()  # a null doc_id matches nothing and stays
    return docs.join(leaking, "doc_id", "left_anti").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark; n_chars is counted anew."""
    found = secrets.scan(docs, keep=["lang", "source"])
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.length("redacted").cast("long").alias("n_chars"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 token ids."""
    return packing.pack(docs, tokenizer_path()).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_windows),
]

#: SQL cannot express a trained classifier or a tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
