"""News, evidence and text scoring."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from ..functions.ordered import one_by_one
from .joins import jaccard
from .validation import components


def title_tokens(c: Column) -> Column:
    """distinct alphanumeric tokens longer than two letters."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1)), lambda x: F.length(x) > 2))


def stable_id(*parts: Column, n: int = 24) -> Column:
    """the first ``n`` hex digits of the SHA-256 of the delimited parts."""
    return F.substring(F.sha2(F.concat_ws("|", *parts).cast("binary"), 256), 1, n)


def lexicon_sentiment(c: Column, positive: list[str], negative: list[str]) -> Column:
    """tanh((positive - negative words) / 3)."""
    words = lambda terms: F.regexp_count(F.lower(c), F.lit(r"\b(" + "|".join(terms) + r")\b"))
    return F.tanh((words(positive) - words(negative)) / 3.0)


def half_life(hours: Column, h: float = 18.0) -> Column:
    """0.5 ** (age / h)."""
    return F.exp(-F.log(F.lit(2.0)) * F.greatest(hours, F.lit(0.0)) / h)


def freshness(days: Column) -> Column:
    """full for 45 days, then halved each 180, at least 0.05."""
    return F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.exp(-F.log(F.lit(2.0)) * F.greatest(F.lit(0.0), days - 45.0) / 180.0)))


def event_type(c: Column, terms: dict[str, list[str]]) -> Column:
    """the type with most of its terms in the text; the first of equals; ``other`` without any."""
    scores = [F.struct(sum(F.contains(F.lower(c), F.lit(t)).cast("int") for t in words).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (name, words) in enumerate(terms.items())]
    best = F.array_max(F.array(*scores))
    return F.when(best["n"] > 0, best["name"]).otherwise("other")


def mentions(c: Column, alias: str) -> Column:
    """how often an alias stands in the text between word borders."""
    return F.regexp_count(c, F.lit(r"\b\Q" + alias + r"\E\b"))


def html_text(c: Column) -> Column:
    """scripts and styles out, block ends to line ends, tags out, entities named here decoded, blanks joined."""
    x = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    x = F.regexp_replace(x, r"(?i)<br\s*/?>|</(p|div|tr|li|h[1-6])\s*>", "\n")
    x = F.regexp_replace(x, r"(?s)<[^>]+>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[ \t\r\f]+", " "), r" ?\n\s*", "\n"))


def _titled(news: DataFrame, hours: int) -> DataFrame:
    """Items with their title's tokens and node: items of equal tokens in one stretch of ``hours`` share a node."""
    d = news.select("id", "published", F.array_sort(title_tokens(F.col("title"))).alias("t")).withColumn("b", F.floor(F.col("published") / (hours * 3600)))
    return d.withColumn("node", F.when(F.size("t") > 0, F.concat_ws(" ", F.col("b").cast("string"), F.array_join("t", " "))))


def similar_titles(titled: DataFrame, least: float) -> DataFrame:
    """N01 edges between nodes (a, b) of one stretch or of neighbouring ones whose tokens are similar; b is not later.

    Titles meet on their rarest tokens alone: sets of n and m tokens with a similarity of t share
    one of the first n - ceil(t * n) + 1 in any common order, so no frequent token brings all its
    titles together. Equal titles of a stretch are one node, however many there are.
    """
    d = titled.filter("node IS NOT NULL").select("node", "t", "b").distinct()
    one = d.select("node", F.explode("t").alias("w"))
    df = one.groupBy("w").agg(F.count("*").alias("df"))
    ranked = one.join(df, "w").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("o"))
    n = F.size("o")
    a = ranked.select("node", F.explode(F.slice("o", F.lit(1), n - F.ceil(F.lit(least) * n).cast("int") + 1)).alias("x")).select("node", "x.w").join(d, "node")
    z = a.select("w", F.col("b").alias("b2"), F.explode(F.array("b", F.col("b") + 1)).alias("b"), F.col("node").alias("node2"), F.col("t").alias("t2"))
    once = (F.col("b2") < F.col("b")) | (F.col("node") > F.col("node2"))
    return a.join(z, ["w", "b"]).filter(once & (jaccard(F.col("t"), F.col("t2")) >= least)).select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct()


def stories(news: DataFrame, least: float = 0.72, hours: int = 36) -> DataFrame:
    """Id and leader of each item: an item leads unless an earlier leader is similar; others join the newest similar leader.

    Items that similar titles tie together, however long the chain, are sorted by time and pass one
    by one; held are the leaders of the last ``hours`` alone. Titles without tokens lead themselves.
    Nodes are told by 64-bit hashes there (odds near 1e-19 a pair to take two for one).
    """
    d = _titled(news, hours)
    edges = similar_titles(d, least).checkpoint()
    comp = components(edges)
    near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.collect_set("b").alias("near"))
    d = d.join(comp.withColumnRenamed("component", "c"), "node", "left").join(near.withColumnRenamed("a", "node"), "node", "left")
    d = d.withColumn("c", F.coalesce("c", "node", F.col("id").cast("string")))
    # From here on titles are only told apart: numbers travel with the items, not the titles of all that are similar.
    d = d.select("id", "published", F.xxhash64("c").alias("c"), F.when(F.col("node").isNotNull(), F.xxhash64("node")).alias("node"), F.transform("near", lambda x: F.xxhash64(x)).alias("near"))

    # No leader outlives a gap of more than ``hours``, so what stands after one is a group of its own.
    w = Window.partitionBy("c").orderBy("published", "id")
    idle = F.coalesce((F.col("published") - F.lag("published").over(w) > hours * 3600).cast("int"), F.lit(1))
    d = d.withColumn("_idle", idle).withColumn("stretch", F.sum("_idle").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_idle")

    def step(state: dict, row: dict) -> int:
        at, who = row["published"], row["id"]
        if row["node"] is None:
            return who
        leaders = state.setdefault("leaders", {})  # oldest first
        while leaders and at - (oldest := next(iter(leaders.items())))[1][0] > hours * 3600:
            del leaders[oldest[0]]
        nodes = {row["node"], *(row["near"] or [])}
        hit = next((k for k, (_, node) in reversed(leaders.items()) if node in nodes), None)
        if hit is None:
            leaders[who] = (at, row["node"])
        return who if hit is None else hit

    return one_by_one(d, ["c", "stretch"], ["published", "id", "node", "near"], "leader long", step, ["id", "published"]).drop("c", "stretch")


def story_evidence(news: DataFrame, story: DataFrame, now: int) -> DataFrame:
    """Per story: representative (longest text, first in time), providers, confirmation, novelty, decay and score."""
    d = news.select("id", "provider", "published", F.length("summary").alias("_length")).join(story.select("id", "leader"), "id")  # texts stay where they are
    g = d.groupBy("leader").agg(F.max_by("id", F.struct("_length", -F.col("published"), -F.col("id"))).alias("representative"), F.array_sort(F.collect_set("provider")).alias("providers"), F.count("*").alias("items"), F.max("published").alias("last"))
    g = g.withColumn("novelty", 1.0 / F.col("items")).withColumn("confirmation", F.least(F.lit(1.0), F.size("providers") / 3.0)).withColumn("decay", F.exp(-F.greatest(F.lit(0), F.lit(now) - F.col("last")) / 3600.0 / 36.0))
    return g.withColumn("score", F.col("decay") * (0.5 + 0.5 * F.col("confirmation")))


def aggregate_sentiment(signals: DataFrame, by: str = "symbol") -> DataFrame:
    """Weighted mean, agreement (1 - deviation, at least 0) and confidence by volume."""
    g = signals.groupBy(by).agg((F.sum(F.col("weight") * F.col("sentiment")) / F.nullif(F.sum("weight"), F.lit(0.0))).alias("sentiment"), F.stddev_pop("sentiment").alias("_s"), F.count("*").alias("articles"))
    return g.withColumn("agreement", F.greatest(F.lit(0.0), 1.0 - F.col("_s"))).withColumn("confidence", 1.0 - F.exp(-F.col("articles") / 5.0)).drop("_s")


def article_signals(news: DataFrame, aliases: list[str], positive: list[str], negative: list[str], now: int) -> DataFrame:
    """A row for each article and alias that it mentions: relevance, sentiment, decay, score."""
    text = F.concat_ws(" ", "title", "summary")
    hits = F.array(*[F.struct(F.lit(a).alias("symbol"), mentions(text, a).alias("n")) for a in aliases])
    d = news.select("id", "published", lexicon_sentiment(text, positive, negative).alias("sentiment"), F.explode(F.filter(hits, lambda x: x["n"] > 0)).alias("x")).select("id", "published", "sentiment", "x.symbol", "x.n")
    d = d.withColumn("relevance", F.least(F.lit(1.0), 0.4 + 0.2 * F.col("n"))).withColumn("decay", half_life((F.lit(now) - F.col("published")) / 3600.0))
    return d.withColumn("score", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("sentiment") * F.col("relevance") * F.col("decay"))))


def novelty(texts: DataFrame, by: str, order: str, last: int = 128) -> DataFrame:
    """1 - the largest cosine to the ``last`` texts before of the key, at least 0.1; 1 for the first.

    Words are hashed to 4,096 places. Texts of a key are numbered without gathering it and stand in
    blocks of ``last``; a block meets the one before it as two matrices of counts, whose product holds
    all cosines that can matter. A block is a group of its own, so a common key is spread. A text
    without words has no cosine; ties of ``order`` stand in the order of their text.
    """
    d = texts.select(F.col(by).alias("_by"), F.col(order).alias("_order"), F.coalesce("text", F.lit("")).alias("text"))
    d = numbered(d, "_by", ["_order", "text"]).withColumn("_b", F.floor((F.col("n") - 1) / last))
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "")
    d = d.withColumn("_w", F.transform(words, lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 3), 16, 10).cast("int"))).drop("text")
    # A text stands in its block, and as an earlier one in the next.
    d = d.select("*", F.explode(F.array(F.struct(F.col("_b").alias("g"), F.lit(False).alias("old")), F.struct((F.col("_b") + 1).alias("g"), F.lit(True).alias("old")))).alias("_at")).select("_by", "_order", "n", "_w", "_at.*")

    def counts(rows: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(rows), 4096))
        np.add.at(out, (np.repeat(np.arange(len(rows)), [len(x) for x in rows]), np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)), 1.0)
        return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-300)

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n", ignore_index=True)
        new = ~pdf["old"].to_numpy()
        x, n = counts(list(pdf["_w"])), pdf["n"].to_numpy()
        gap = n[new][:, None] - n[None, :]
        near = np.where((gap > 0) & (gap <= last), x[new] @ x.T, 0.0)
        out = pdf.loc[new, ["_by", "_order"]].copy()
        out["novelty"] = np.maximum(0.1, 1.0 - near.max(1, initial=0.0))
        return out

    kind = dict(d.dtypes)
    return d.groupBy("_by", "g").applyInPandas(block, f"_by {kind['_by']}, _order {kind['_order']}, novelty double").toDF(by, order, "novelty")


#: How far a source is trusted; others 0.5.
AUTHORITY = {
    "ibkr": 1.00, "sec_edgar": 1.00, "fred": 1.00, "us_treasury_fiscaldata": 1.00, "eodhd": 0.90, "polygon": 0.90, "fmp": 0.90, "thetadata": 0.90, "finnhub": 0.85, "twelvedata": 0.85, "alphavantage": 0.85,
    "marketstack": 0.75, "openexchangerates": 0.85, "currencylayer": 0.75, "marketaux": 0.75, "currents": 0.65, "yfinance": 0.70, "rss": 0.75,
}


def authority(source: Column, table: dict[str, float] | None = None) -> Column:
    """a source's authority by lookup, by ``table`` where a caller has feeds of its own; 0.5 where it is not listed."""
    known = F.create_map(*[F.lit(x) for pair in (table or AUTHORITY).items() for x in pair])
    return F.coalesce(F.element_at(known, F.coalesce(source, F.lit(""))), F.lit(0.5))


def source_quality(completeness: Column, freshness_: Column, consistency: Column, provenance: Column, authority_: Column) -> Column:
    """plain mean of the five parts."""
    return (completeness + freshness_ + consistency + provenance + authority_) / 5.0


def linked_symbols(news: DataFrame, universe: DataFrame) -> DataFrame:
    """An item's symbols by where they come from: named in the text by an alias, or by the provider alone; all within the universe.

    ``news(id, title, summary, symbols array)``, ``universe(symbol, alias, sector)``. An alias is one
    word, so texts meet aliases by an equi-join on their words; no pair of item and alias is made up.
    """
    words = F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", "title", "summary"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))
    text = news.select("id", F.explode(words).alias("alias")).join(universe.select("alias", "symbol"), "alias").select("id", "symbol").distinct().withColumn("named", F.lit(True))
    told = news.select("id", F.explode("symbols").alias("symbol")).distinct().join(universe.select("symbol").distinct(), "symbol", "left_semi").withColumn("told", F.lit(True))
    d = text.join(told, ["id", "symbol"], "full").join(universe.groupBy("symbol").agg(F.min("sector").alias("sector")), "symbol")
    some = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("symbol"))))
    return d.groupBy("id").agg(some(F.col("named").isNotNull()).alias("text_linked"), some(F.col("named").isNull()).alias("provider_only"), F.array_sort(F.collect_set("sector")).alias("sectors"))
