"""Registered queries of the llm operators: thin wrappers with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer_path() -> str:
    """The vocabulary file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_pages, read_pages

    return read_pages(spark, archive_pages(table(spark, sf_dir, "pages")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    return scan(table(spark, sf_dir, "documents")).drop("redacted")


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    p = pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_token_files, write_token_files

    back = read_token_files(write_token_files(table(spark, sf_dir, "documents"), tokenizer_path()))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import mine

    return mine(table(spark, sf_dir, "embeddings"))


def op13_word_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_trees import remove_later

    return remove_later(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


OP1_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT payload_digest, max(page_id) AS first_page FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN p.page_id < f.first_page THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.page_id < f.first_page THEN f.first_page END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 1000
"""


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') || chr(10) ELSE array_to_string(ws[i:i + 4], ' ') END AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.i >= 75 * (x.n + y.n - p.i)
), c AS (
  SELECT doc_id AS node, doc_id AS comp FROM documents
  UNION
  SELECT l.b AS node, c.comp FROM c JOIN l ON l.a = c.node
), m AS (SELECT node, min(comp) AS component_id FROM c GROUP BY node)
SELECT m.node AS doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, m.node = m.component_id AS kept
FROM m LEFT JOIN n ON n.doc_id = m.node
"""


OP6_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
f AS (SELECT * FROM e WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.93),
c AS (SELECT vec_id AS node, vec_id AS comp FROM embeddings UNION SELECT l.b, c.comp FROM c JOIN l ON l.a = c.node),
m AS (SELECT node, min(comp) AS component_id FROM c GROUP BY node), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT m.node AS vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, m.component_id, m.node = m.component_id AS kept FROM m LEFT JOIN n ON n.a = m.node
"""


OP11_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents
), w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY x) AS first FROM t
), q AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id
), d AS (
  SELECT w.part, CAST(coalesce(q.good, false) AS INT) AS good, CAST(coalesce(q.toxic, false) AS INT) AS toxic,
    [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 2 * length(x), regexp_matches(x, '[#$%&*|]'), coalesce(w.doc_id > first, false)] AS fails
  FROM w LEFT JOIN q ON q.doc_id = w.doc_id
), c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY part, fails
), l AS (SELECT unnest([1, 2, 3, 4, 5]) AS f
), o AS (
  SELECT [a.f, b.f, c.f, d.f, e.f] AS ord FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), s AS (SELECT ord, l.f AS step, ord[l.f] AS own, ord[1:l.f - 1] AS before FROM o, l
), r AS (
  SELECT c.part, s.ord, s.step, s.own,
    sum(CASE WHEN len(list_filter(before, lambda k: fails[k])) = 0 AND NOT fails[own] THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN len(list_filter(before, lambda k: fails[k])) = 0 AND fails[own] THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN len(list_filter(before, lambda k: fails[k])) > 0 AND fails[own] THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails[own] AND len(list_filter(fails, lambda k: k)) = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN len(list_filter(before, lambda k: fails[k])) = 0 AND fails[own] THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN len(list_filter(before, lambda k: fails[k])) = 0 AND fails[own] THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY c.part, s.ord, s.step, s.own
)
SELECT part, array_to_string(list_transform(ord, lambda k: 'ABCDE'[k:k]), '') AS filter_order, CAST(step AS INT) AS step,
  CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
"""


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5
)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER w AS INT) AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) QUALIFY row_number() OVER w <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op4_minhash": OP4_SQL, "op6_embeddings": OP6_SQL, "op11_filter_audit": OP11_SQL, "op12_hard_negatives": OP12_SQL}
