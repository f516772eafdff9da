"""Filings and ownership events."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: 8-K items with category, materiality and base direction.
ITEMS = [
    ("1.01", "material_agreement", 0.70, 0.00),
    ("1.02", "agreement_termination", 0.75, -0.20),
    ("1.03", "bankruptcy_or_receivership", 1.00, -1.00),
    ("2.01", "acquisition_or_disposition", 0.90, 0.00),
    ("2.02", "earnings_or_financial_condition", 0.90, 0.00),
    ("2.03", "new_direct_obligation", 0.75, -0.05),
    ("2.04", "default_or_acceleration_trigger", 1.00, -0.95),
    ("2.05", "exit_or_disposal_costs", 0.80, -0.45),
    ("2.06", "material_impairment", 0.90, -0.75),
    ("3.01", "delisting_or_listing_failure", 0.95, -0.90),
    ("3.02", "unregistered_equity_sale", 0.80, -0.45),
    ("3.03", "security_holder_rights_change", 0.75, -0.20),
    ("4.01", "auditor_change", 0.75, -0.15),
    ("4.02", "nonreliance_or_restatement", 1.00, -0.95),
    ("5.01", "change_in_control", 1.00, 0.00),
    ("5.02", "management_or_director_change", 0.75, 0.00),
    ("5.03", "charter_bylaw_or_fiscal_year_change", 0.55, 0.00),
    ("5.07", "shareholder_vote", 0.55, 0.00),
    ("5.08", "director_nomination_deadline", 0.45, 0.00),
    ("6.01", "abs_informational_material", 0.45, 0.00),
    ("6.02", "change_of_servicer_or_trustee", 0.55, 0.00),
    ("6.03", "credit_enhancement_or_support_change", 0.70, -0.10),
    ("6.04", "failure_to_make_distribution", 0.95, -0.90),
    ("6.05", "securities_act_update", 0.50, 0.00),
    ("7.01", "regulation_fd_disclosure", 0.60, 0.00),
    ("8.01", "other_material_event", 0.60, 0.00),
    ("9.01", "financial_statements_and_exhibits", 0.15, 0.00),
]
#: Items whose direction the text may move either way, and the item of a filing that names none.
OPEN_ITEMS, NO_ITEM = ["2.02", "7.01", "8.01", "5.02", "1.01", "2.01"], "8.01"
#: Phrases of a current report, as patterns over lower-case text, and their weights.
PHRASES = [
    (r"\brais(?:e[sd]?|ing)\s+(?:full[- ]year\s+)?guidance\b", 0.75),
    (r"\bincreas(?:e[sd]?|ing)\s+(?:full[- ]year\s+)?guidance\b", 0.70),
    (r"\bexceed(?:ed|s|ing)?\s+(?:analyst|market|our)?\s*(?:expectations|estimates)\b", 0.55),
    (r"\brecord\s+(?:revenue|sales|earnings|bookings|backlog|cash flow)\b", 0.45),
    (r"\bspecial\s+dividend\b", 0.45),
    (r"\bshare\s+repurchase\s+(?:program|authorization)\b", 0.35),
    (r"\bcompleted\s+(?:the\s+)?acquisition\b", 0.25),
    (r"\bbankrupt(?:cy)?\b|\bchapter\s+(?:7|11)\b", -1.00),
    (r"\bgoing\s+concern\b", -0.90),
    (r"\bdefault(?:ed)?\b|\bacceleration\s+of\s+(?:debt|obligations)\b", -0.90),
    (r"\bmaterial\s+weakness\b", -0.75),
    (r"\brestat(?:e|ed|ement|ing)\b|\bshould\s+no\s+longer\s+be\s+relied\s+upon\b", -0.90),
    (r"\bimpairment\s+(?:charge|loss)\b", -0.70),
    (r"\blower(?:ed|s|ing)?\s+(?:full[- ]year\s+)?guidance\b", -0.75),
    (r"\bwithdraw(?:s|n|ing)?\s+(?:full[- ]year\s+)?guidance\b", -0.80),
    (r"\bmiss(?:ed|es|ing)?\s+(?:analyst|market)?\s*(?:expectations|estimates)\b", -0.55),
    (r"\bdelist(?:ed|ing)?\b|\bnoncompliance\s+with\s+(?:nasdaq|nyse)\b", -0.85),
    (r"\bresign(?:ed|ation)?\b|\bterminated\s+for\s+cause\b", -0.35),
    (r"\bdata\s+breach\b|\bcybersecurity\s+incident\b", -0.55),
    (r"\bunregistered\s+sale\s+of\s+equity\b|\bprivate\s+placement\b", -0.35),
]


def clean_cik(c: Column) -> Column:
    """digits, padded to 10; longer ones stay whole."""
    d = F.regexp_replace(c, r"\D", "")
    return F.when(F.length(d) >= 10, d).otherwise(F.lpad(d, 10, "0"))


def safe_float(c: Column) -> Column:
    """number in text with currency signs and thousands separators; else null."""
    return F.regexp_replace(c.cast("string"), r"[,$%\s]", "").try_cast("double")


def parsed_time(c: Column) -> Column:
    """the format that fits; the signs in a text leave at most two to try, as a format that fails is slow."""
    at = lambda f: F.try_to_timestamp(c, F.lit(f))
    has = lambda x: F.contains(c, F.lit(x))
    return (F.when(has("/"), at("MM/dd/yyyy")).when(has("T"), at("yyyy-MM-dd'T'HH:mm:ss")).when(has(":"), at("yyyy-MM-dd HH:mm:ss"))
            .when(has("-"), F.coalesce(at("yyyy-MM-dd"), at("yyyyMMddHHmmss"))).otherwise(at("yyyyMMddHHmmss")))


def item_numbers(c: Column) -> Column:
    """distinct item numbers, ascending."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?i)\bItem\s+(\d\.\d{2})\b"), F.lit(1))))


def phrase_score(c: Column, phrases: list[tuple[str, float]] = PHRASES) -> Column:
    """the weights of the phrases that occur, each once, summed and kept within 1; 0 for a null text."""
    found = sum(F.when(F.rlike(F.lower(F.coalesce(c, F.lit(""))), F.lit(p)), w).otherwise(0.0) for p, w in phrases)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), found))


def item_events(filings: DataFrame, phrases: list[tuple[str, float]] = PHRASES, items: DataFrame | None = None) -> DataFrame:
    """A row for each filing and item: category, materiality, direction by item and text, confidence.

    Items come from the column ``items`` (text with item numbers) where it names any, else from the
    content; a filing without any has 8.01. The text moves the direction of open items both ways and
    can only worsen one that is negative by itself. ``items`` is the item table (item, category,
    materiality, base) and replaces ITEMS; what it lacks is ``unmapped_8k_item`` with 0.35 and 0.
    """
    known = items if items is not None else filings.sparkSession.createDataFrame(ITEMS, "item string, category string, materiality double, base double")
    told = F.regexp_extract_all(F.coalesce(F.col("items"), F.lit("")), F.lit(r"\b(\d\.\d{2})\b"), F.lit(1)) if "items" in filings.columns else F.array().cast("array<string>")
    d = filings.select("accession", "symbol", "accepted_at", phrase_score(F.col("content"), phrases).alias("_text"), F.array_sort(F.array_distinct(told)).alias("_told"), item_numbers(F.coalesce("content", F.lit(""))).alias("_read"))
    numbers = F.when(F.size("_told") > 0, F.col("_told")).when(F.size("_read") > 0, F.col("_read")).otherwise(F.array(F.lit(NO_ITEM)))
    d = d.withColumn("item", F.explode(numbers)).join(F.broadcast(known), "item", "left")  # a table of item numbers
    base = F.coalesce("base", F.lit(0.0))
    direction = F.when(F.col("item").isin(OPEN_ITEMS), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), base + F.col("_text")))).when(base < 0, F.least(base, F.least("_text", F.lit(0.0)))).otherwise(base)
    sure = F.when((F.col("item") != NO_ITEM) | (F.size("_told") > 0), 0.90).otherwise(0.60)
    return d.select("accession", "symbol", "accepted_at", "item", F.coalesce("category", F.lit("unmapped_8k_item")).alias("category"), F.coalesce("materiality", F.lit(0.35)).alias("materiality"), direction.alias("direction"), sure.alias("confidence"))


def context_score(events: DataFrame) -> DataFrame:
    """Per symbol: tanh of materiality-weighted directions, counts, categories, severe flag."""
    return events.groupBy("symbol").agg(F.tanh(F.sum(F.col("materiality") * F.col("direction"))).alias("score"), F.sum((F.col("materiality") >= 0.7).cast("long")).alias("material"), F.array_sort(F.collect_set("category")).alias("categories"), F.bool_or((F.col("materiality") >= 0.9) & (F.col("direction") <= -0.5)).alias("severe"))


def insider_windows(events: DataFrame, as_of: Column, days: tuple[int, ...] = (7, 30, 90)) -> DataFrame:
    """Per symbol, of trades known by ``as_of``: buys and sells by transaction date, distinct people, cluster flag."""
    d = events.filter(F.col("accepted_at") <= as_of).withColumn("age", F.datediff(as_of, "effective_at"))
    aggs = []
    for n in days:
        near = F.col("age").between(0, n)
        for side, code in (("buy", "P"), ("sell", "S")):
            hit = near & (F.col("transaction_code") == code)
            aggs += [F.sum(hit.cast("long")).alias(f"{side}s_{n}d"), F.coalesce(F.sum(F.when(hit, F.col("value_usd"))), F.lit(0.0)).alias(f"{side}_value_{n}d"), F.count_distinct(F.when(hit, F.col("person_cik"))).alias(f"{side}ers_{n}d")]
    return d.groupBy("symbol").agg(*aggs).withColumn("cluster_buying", F.col("buyers_30d") >= 3)


def latest_version(events: DataFrame, keys: list[str]) -> DataFrame:
    """Of events with equal keys the last accepted one."""
    w = Window.partitionBy(*keys).orderBy(F.col("accepted_at").desc(), F.col("accession").desc())
    return events.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def merged_transactions(events: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of shares and value, any flag, number and accessions of the parts."""
    return events.groupBy(*keys).agg(F.sum("shares").alias("shares"), F.sum("value_usd").alias("value_usd"), F.bool_or("is_planned").alias("is_planned"), F.count("*").alias("parts"), F.array_sort(F.collect_set("accession")).alias("accessions"))


def streak(events: DataFrame, by: list[str], code: str = "P") -> DataFrame:
    """Length of the run of ``code`` from the latest event back."""
    w = Window.partitionBy(*by).orderBy(F.col("effective_at").desc(), F.col("accession").desc()).rowsBetween(Window.unboundedPreceding, 0)
    d = events.withColumn("_o", F.sum((F.col("transaction_code") != code).cast("long")).over(w))
    return d.groupBy(*by).agg(F.sum((F.col("_o") == 0).cast("long")).alias("streak"))


def ownership_change(events: DataFrame) -> DataFrame:
    """Per symbol: sum of the latest changes in percent owned over people, and how many hold."""
    w = Window.partitionBy("symbol", "person_cik").orderBy("accepted_at", "accession")
    r = Window.partitionBy("symbol", "person_cik").orderBy(F.col("accepted_at").desc(), F.col("accession").desc())
    d = events.withColumn("_p", F.lag("percent_owned").over(w)).withColumn("_n", F.row_number().over(r)).filter("_n = 1")
    return d.groupBy("symbol").agg(F.sum(F.col("percent_owned") - F.coalesce("_p", F.lit(0.0))).alias("delta"), F.sum("percent_owned").alias("percent"), F.count("*").alias("holders"))


def position_changes(positions: DataFrame) -> DataFrame:
    """A manager's last two periods: new, increased, decreased, closed or unchanged positions."""
    p = Window.partitionBy("manager").orderBy(F.col("period").desc())
    d = positions.groupBy("manager", "period", "symbol").agg(F.sum("shares").alias("shares")).withColumn("_k", F.dense_rank().over(p)).filter("_k <= 2")
    cur = d.filter("_k = 1").select("manager", "symbol", F.col("shares").alias("now"))
    old = d.filter("_k = 2").select("manager", "symbol", F.col("shares").alias("before"))
    two = d.filter("_k = 2").select("manager").distinct()
    j = cur.join(old, ["manager", "symbol"], "full").join(two, "manager", "left_semi")
    kind = F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "closed").when(F.col("now") > F.col("before"), "increase").when(F.col("now") < F.col("before"), "decrease").otherwise("unchanged")
    return j.withColumn("change", kind)


def effective_filings(filings: DataFrame) -> DataFrame:
    """Per manager and period the base filing, replaced by the last restatement, with later new holdings added."""
    w = Window.partitionBy("manager", "period").orderBy("accepted_at", "accession")
    all_ = Window.partitionBy("manager", "period")
    reset = F.col("amendment").isNull() | (F.col("amendment") == "RESTATEMENT")
    d = filings.withColumn("_s", F.row_number().over(w)).withColumn("_r", F.max(F.when(reset, F.col("_s"))).over(all_))
    return d.filter((F.col("_s") >= F.coalesce("_r", F.lit(0))) & (reset | (F.col("amendment") == "NEW HOLDINGS"))).drop("_s", "_r")


def name_tokens(c: Column) -> Column:
    """upper-case tokens of a name without company forms."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.upper(c), F.lit("([A-Z0-9]+)"), F.lit(1))), F.array(*map(F.lit, ["INC", "CORP", "CO", "LTD", "LLC", "LP", "THE", "TRUST", "JR", "SR"])))


def name_overlap(a: Column, b: Column) -> Column:
    """the larger share of common tokens."""
    n = F.size(F.array_intersect(a, b))
    return F.greatest(n / F.nullif(F.size(a), F.lit(0)), n / F.nullif(F.size(b), F.lit(0)))


def role_priority(title: Column, officer: Column, director: Column, owner: Column) -> Column:
    """F29."""
    return (F.when(F.rlike(title, F.lit(r"(?i)\b(CEO|chief executive)\b")), "CEO").when(F.rlike(title, F.lit(r"(?i)\b(CFO|chief financial)\b")), "CFO").when(F.rlike(title, F.lit(r"(?i)\b(COO|chief operating)\b")), "COO")
            .when(F.rlike(title, F.lit(r"(?i)\bpresident\b")), "PRESIDENT").when(officer, "OFFICER").when(director, "DIRECTOR").when(owner, "TEN_PERCENT_OWNER").otherwise("OTHER"))


def planned_sale(footnotes: Column) -> Column:
    """F30."""
    return F.coalesce(F.rlike(footnotes, F.lit(r"(?i)\b10b5[- ]?1\b")), F.lit(False))


def _xml_rows(filings: DataFrame, kept: list[str], schema: str, read: Callable[[ET.Element], list[tuple]]) -> DataFrame:
    """The rows that ``read`` gives for the root of each content, beside the kept columns.

    A text is parsed once, whatever is read from it. Names count without their namespaces; null and
    empty texts give no rows, a broken one raises.
    """
    kinds = dict(filings.dtypes)
    names, types = zip(*[c.split() for c in schema.split(", ")])
    arrow = [{"string": pa.string(), "long": pa.int64()}[t] for t in types]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, x in enumerate(b.column(len(kept)).to_pylist()):
                if x:
                    root = ET.fromstring(x)
                    if "xmlns" in x:
                        for e in root.iter():
                            e.tag = e.tag.rpartition("}")[2]
                    found = read(root)
                    at += [i] * len(found)
                    rows += found
            left = b.take(pa.array(at, pa.int64()))
            columns = zip(*rows) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([*left.columns[:len(kept)], *[pa.array(c, t) for c, t in zip(columns, arrow)]], names=[*kept, *names])

    return filings.select(*kept, "content").mapInArrow(task, ", ".join([*[f"`{c}` {kinds[c]}" for c in kept], schema]))


def _below(e: ET.Element, name: str, child: str | None = None) -> str | None:
    """The first text of the descendants (or of their ``child``) of this name; null where there is none."""
    for x in e.iter(name):
        if text := x.findtext(child) if child else x.text:
            return text
    return None


def _texts(e: ET.Element, name: str) -> list[str]:
    return [x.text for x in e.iter(name) if x.text]


def transactions_xml(filings: DataFrame) -> DataFrame:
    """Transactions of Forms 3, 4 and 5, one row for each owner and transaction; value and shares are shared among owners."""

    def read(root: ET.Element) -> list[tuple]:
        owners = [c for o in root.iter("reportingOwner") for c in _texts(o, "rptOwnerCik")]
        told = [(_below(t, "transactionDate", "value"), _below(t, "transactionCode"), _below(t, "transactionShares", "value"), _below(t, "transactionPricePerShare", "value")) for t in root.iter("nonDerivativeTransaction")]
        return [(o, len(owners), k, *t) for k, t in enumerate(told) for o in owners]

    d = _xml_rows(filings, ["accession", "symbol", "accepted_at"], "person_cik string, owners long, k long, date string, code string, shares string, price string", read)
    share = 1.0 / F.col("owners")
    shares, price = safe_float(F.col("shares")), safe_float(F.col("price"))
    return d.select("accession", "symbol", "accepted_at", "person_cik", F.col("k").cast("int").alias("k"), F.to_date("date").alias("effective_at"), F.col("code").alias("transaction_code"), (shares * share).alias("shares"), price.alias("price"), (shares * price * share).alias("value_usd"))


def holdings_xml(filings: DataFrame) -> DataFrame:
    """Rows of a 13F information table; values before 2023-01-03 are in thousands."""

    def read(root: ET.Element) -> list[tuple]:
        return [(k, t.findtext("cusip") or None, t.findtext("value") or None, _below(t, "sshPrnamt")) for k, t in enumerate(root.iter("infoTable"))]

    d = _xml_rows(filings, ["accession", "accepted_at"], "k long, cusip string, value string, shares string", read)
    factor = F.when(F.col("accepted_at") < F.lit("2023-01-03").cast("timestamp"), 1000.0).otherwise(1.0)
    return d.select("accession", F.col("k").cast("int").alias("k"), "cusip", (safe_float(F.col("value")) * factor).alias("value_usd"), safe_float(F.col("shares")).alias("shares"))


def form_family(c: Column) -> Column:
    """The form's name without /A, and its family."""
    base = F.regexp_replace(F.upper(F.trim(c)), r"/A$", "")
    return F.when(base.isin("3", "4", "5"), "insider").when(base == "144", "notice").when(F.startswith(base, F.lit("13F")), "institution").when(F.rlike(base, F.lit("13[DG]")), "ownership").when(base == "8-K", "current").otherwise("other")


def overlay(parts: dict[str, Column], severe: Column) -> Column:
    """Weighted sum of insider, notice, ownership, institution and current parts within 1; at most -0.35 where severe."""
    weight = {"insider": 0.55, "notice": 0.15, "ownership": 0.08, "institution": 0.17, "current": 0.05}
    s = sum(w * F.coalesce(parts[k], F.lit(0.0)) for k, w in weight.items() if k in parts)
    s = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s))
    return F.when(severe, F.least(s, F.lit(-0.35))).otherwise(s)


def attribute_moves(moves: DataFrame, events: DataFrame, days: int = 3) -> DataFrame:
    """Per move the events of its symbol accepted within ``days`` before, best first."""
    j = moves.join(events, "symbol").filter((F.col("accepted_at") <= F.col("moved_at")) & (F.datediff("moved_at", "accepted_at") <= days))
    score = F.col("materiality") * F.exp(-F.datediff("moved_at", "accepted_at") / 3.0)
    return j.groupBy("symbol", "moved_at").agg(F.sort_array(F.collect_list(F.struct(score.alias("score"), "accession", "item")), asc=False).alias("c")).select("symbol", "moved_at", F.col("c")[0]["accession"].alias("accession"), F.col("c")[0]["item"].alias("item"), F.col("c")[0]["score"].alias("score"), F.size("c").cast("long").alias("candidates"))


def notices_xml(filings: DataFrame) -> DataFrame:
    """Planned sales of Form 144, repeated blocks once; a block without any of the values is none."""

    def read(root: ET.Element) -> list[tuple]:
        told = [tuple(t.findtext(c) or None for c in ("noOfUnitsSold", "aggregateMarketValue", "approxSaleDate")) for t in root.iter("securitiesInformation")]
        return [t for t in told if any(t)]

    d = _xml_rows(filings, ["accession", "symbol", "accepted_at"], "shares string, value string, date string", read)
    return d.select("accession", "symbol", "accepted_at", safe_float(F.col("shares")).alias("shares"), safe_float(F.col("value")).alias("value_usd"), F.to_date(parsed_time(F.col("date"))).alias("effective_at")).dropDuplicates()


def owners_xml(filings: DataFrame) -> DataFrame:
    """Reporting persons of 13D and 13G with percent and shares by position; a single value serves all."""

    def read(root: ET.Element) -> list[tuple]:
        names, *told = [_texts(root, c) for c in ("reportingPersonName", "reportingPersonCIK", "percentOfClass", "aggregateAmountOwned")]
        return [(k, n, *[v[0] if len(v) == 1 else v[k] if k < len(v) else None for v in told]) for k, n in enumerate(names)]

    d = _xml_rows(filings, ["accession", "symbol", "accepted_at"], "k long, person_name string, cik string, percent string, shares string", read)
    return d.select("accession", "symbol", "accepted_at", F.col("k").cast("int").alias("k"), "person_name", clean_cik(F.col("cik")).alias("person_cik"), safe_float(F.col("percent")).alias("percent_owned"), safe_float(F.col("shares")).alias("shares"))


#: Weight of an insider's role; others as "other".
ROLE_WEIGHTS = {"ceo": 1.50, "cfo": 1.40, "coo": 1.30, "president": 1.25, "officer": 1.15, "director": 1.00, "ten_percent_owner": 0.80, "other": 0.70}


def insider_strength(code: Column, role: Column, derivative: Column, direct: Column, planned: Column, value: Column, fraction: Column, allocation: Column) -> Column:
    """strength of an open-market trade: role, ownership form, plan, logarithmic size and share of prior holdings; sales count negative, others 0."""
    clip = lambda x, lo, hi: F.greatest(lo, F.least(F.lit(hi), x))
    roles = F.create_map(*[F.lit(x) for pair in ROLE_WEIGHTS.items() for x in pair])
    weight = F.coalesce(F.element_at(roles, F.lower(F.coalesce(role, F.lit("other")))), F.lit(ROLE_WEIGHTS["other"]))
    plan = F.when(planned & (code == "S"), 0.35).when(planned, 0.70).otherwise(1.0)
    money = F.abs(F.coalesce(value, F.lit(0.0)))
    size = clip(F.log1p(money / 25_000.0) / 3.0, F.when(money > 0, 0.15).otherwise(0.0), 1.60)
    owned = clip(F.coalesce(fraction, F.lit(0.0)) * 5.0, F.lit(0.0), 1.50)
    share = F.when(F.coalesce(allocation, F.lit(0.0)) == 0, 1.0).otherwise(allocation)
    s = F.when(code == "P", 1.0).otherwise(-1.0) * weight * F.when(direct, 1.0).otherwise(0.70) * plan * share * (0.75 * size + 0.25 * owned)
    return F.when(code.isin("P", "S") & ~F.coalesce(derivative, F.lit(False)), s).otherwise(0.0)


def economic_strength(code: Column, role: Column, planned: Column, value: Column, shares: Column) -> Column:
    """F19 for merged transactions: logarithmic size by value, else by shares; officers and directors weigh more, planned sales a tenth."""
    money, n = F.abs(F.coalesce(value, F.lit(0.0))), F.abs(F.coalesce(shares, F.lit(0.0)))
    size = F.when(money > 0, F.log1p(money / 100_000.0) / 3.5).when(n > 0, F.log1p(n / 1_000.0) / 3.5).otherwise(0.15)
    size = F.greatest(F.lit(0.15), F.least(F.lit(1.50), size))
    who = F.lower(F.coalesce(role, F.lit("")))
    return F.when(F.upper(code) == "P", size * F.when(who.isin("ceo", "cfo"), 1.25).when(who == "director", 1.10).otherwise(1.0)).when(F.upper(code) == "S", -size * F.when(planned, 0.10).otherwise(1.0)).otherwise(0.0)


def resolved_securities(holdings: DataFrame, master: DataFrame) -> DataFrame:
    """Symbols of (cusip, cik) rows from a security master: by cusip, else by cik; null where neither is there."""
    by = lambda k: master.filter(F.col(k).isNotNull()).groupBy(k).agg(F.min("symbol").alias(f"_{k}"))
    return holdings.join(by("cusip"), "cusip", "left").join(by("cik"), "cik", "left").withColumn("symbol", F.coalesce("_cusip", "_cik")).drop("_cusip", "_cik")


def universe_snapshot(filings: DataFrame, events: DataFrame, as_of: Column) -> DataFrame:
    """Q27: filings accepted by ``as_of`` and not superseded, by form family, with the context of their symbols' events known by then."""
    from .joins import superseded

    known = superseded(filings, as_of).withColumn("family", form_family(F.col("form_type")))
    n = known.groupBy("symbol").agg(F.count("*").alias("filings"), *[F.sum((F.col("family") == f).cast("long")).alias(f) for f in ("insider", "notice", "institution", "ownership", "current")])
    return n.join(context_score(events.filter(F.col("accepted_at") <= as_of)).drop("categories"), "symbol", "left")
