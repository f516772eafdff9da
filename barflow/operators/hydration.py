"""Landing a provider's bars: split events, their reconciliation with a base, and hydration behind gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bars as ob
from . import quality as q

OHLCV = ["open", "high", "low", "close", "volume"]


def split_events(payload: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """Split rows as a provider sends them (symbol, split_date, old_shares, new_shares, split) to events: symbol, split_date, factor, effective_at.

    Share counts go before a text "new/old" or "new:old". Rows without a date or a positive, finite
    factor say nothing; equal events (a day, a factor to 12 places) are one. An event takes effect at
    midnight of its day at the exchange.
    """
    old, new = F.col("old_shares").cast("double"), F.col("new_shares").cast("double")
    text = F.when(F.rlike("split", F.lit("[/:]")), ob.split_ratio(F.col("split")))
    d = payload.select("symbol", F.to_date("split_date").alias("split_date"), F.coalesce(F.when((old > 0) & (new > 0), new / old), text).alias("factor"))
    d = d.filter("symbol IS NOT NULL AND split_date IS NOT NULL AND factor > 0 AND factor < double('infinity')")
    d = d.groupBy("symbol", "split_date", F.round("factor", 12).alias("_f")).agg(F.max("factor").alias("factor")).drop("_f")
    return d.withColumn("effective_at", F.to_utc_timestamp(F.col("split_date").cast("timestamp"), zone))


def reconcile_splits(fine: DataFrame, base: DataFrame, events: DataFrame, sessions: DataFrame, as_of: Column | None = None, median_bps: float = 50.0, p95_bps: float = 100.0, bad_fraction: float = 0.01, bad_bps: float = 100.0) -> tuple[DataFrame, DataFrame]:
    """Q05: whether fine bars agree with the hourly base as they are, or once adjusted by their split events.

    Gives the chosen bars (raw, or adjusted; none of a symbol that agrees neither way), and a row for
    each symbol of ``fine``: selection (RAW_ALREADY_COMPATIBLE, SPLIT_ADJUSTED or NONE), event_count
    and both overlap audits. A symbol without shared hours agrees with nothing.
    """
    adjusted = ob.split_adjust(fine, events)

    def audited(d: DataFrame, name: str) -> DataFrame:
        hours = ob.session_hourly(d, sessions, as_of=as_of).filter("complete")
        a = q.overlap_gate(ob.overlap_audit(base, hours, bad_bps), 5, median_bps, p95_bps, bad_fraction)
        return a.select("symbol", F.col("n").alias(f"{name}_rows"), F.col("median_bps").alias(f"{name}_median_bps"), F.col("p95_bps").alias(f"{name}_p95_bps"), F.col("bad_fraction").alias(f"{name}_bad_fraction"), F.col("passed").alias(f"{name}_compatible"))

    counts = events.groupBy("symbol").agg(F.count("*").alias("event_count"))
    d = fine.select("symbol").distinct()
    for other in (counts, audited(fine, "raw"), audited(adjusted.drop("split_factor"), "adjusted")):
        d = d.join(other, "symbol", "left")
    no = F.lit(False)
    d = d.withColumns({"event_count": F.coalesce("event_count", F.lit(0)), "raw_compatible": F.coalesce("raw_compatible", no), "adjusted_compatible": F.coalesce("adjusted_compatible", no)})
    d = d.withColumn("selection", F.when(F.col("raw_compatible"), "RAW_ALREADY_COMPATIBLE").when((F.col("event_count") > 0) & F.col("adjusted_compatible"), "SPLIT_ADJUSTED").otherwise("NONE"))
    raw = fine.withColumn("split_factor", F.lit(1.0)).join(d.filter("selection = 'RAW_ALREADY_COMPATIBLE'").select("symbol"), "symbol", "left_semi")
    return raw.unionByName(adjusted.join(d.filter("selection = 'SPLIT_ADJUSTED'").select("symbol"), "symbol", "left_semi")), d


def merged_download(stored: DataFrame, chunk: DataFrame, most_bad: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Q06: a downloaded chunk cleaned and merged over what is stored: merged bars, bad rows for quarantine, counts."""
    good, bad, audit = q.split_bad(chunk, most_bad)
    return ob.last_wins(stored, good), bad, audit


def buckets(sessions: DataFrame, cutoff: Column) -> DataFrame:
    """Hours (session_date, ts) that start at a session's open, one hour after the other, before its close and not after ``cutoff``."""
    step = F.expr("INTERVAL 1 HOUR")
    d = sessions.select("session_date", F.explode(F.sequence("market_open", F.col("market_close") - F.expr("INTERVAL 1 SECOND"), step)).alias("ts"))
    return d.filter(F.col("ts") <= cutoff)


def hydrated(symbols: DataFrame, stored: DataFrame, raw: DataFrame, events: DataFrame, sessions: DataFrame, as_of: str, least_rows: int, least_coverage: float = 0.9, stale_days: int = 14, most_gap: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """Q07: hourly bars of the symbols whose stored bars do not suffice, and a row of the outcome for each symbol.

    Stored bars suffice with ``least_rows`` rows, the last at most ``stale_days`` before ``as_of``. Of the
    others, raw bars are adjusted by splits and kept where they start an hour of a session and are
    complete; nothing is filled in. A symbol lands if enough rows, enough of the expected hours
    (between its first and last bar, up to ``as_of``) and no greater opening gap than ``most_gap`` are
    there; else ``reason`` names the first test that fails and none of its bars land.
    """
    cutoff = F.to_timestamp(F.lit(f"{as_of} 23:59:59"))
    have = q.usable(stored, least_rows, as_of, stale_days).select("symbol", F.col("rows").alias("_have"), F.col("usable").alias("_usable"))
    todo = symbols.select("symbol").distinct().join(have, "symbol", "left").withColumn("_usable", F.coalesce("_usable", F.lit(False)))
    wanted = todo.filter("NOT _usable").select("symbol")
    mine = ob.split_adjust(q.identical_once(raw.join(wanted, "symbol", "left_semi")), events.select("symbol", "effective_at", "factor"))
    span = mine.groupBy("symbol").agg(F.to_date(F.min("ts")).alias("_a"), F.to_date(F.least(F.max("ts"), cutoff)).alias("_z")).filter("_a <= _z")
    days = span.select("symbol", F.explode(F.sequence("_a", "_z", F.expr("INTERVAL 1 DAY"))).alias("session_date"))
    expected = days.join(buckets(sessions, cutoff), "session_date").select("symbol", "ts")
    whole = F.lit(True)
    for c in OHLCV:
        whole = whole & q.finite(c)
    hours = mine.join(expected, ["symbol", "ts"]).filter(whole)
    audit = expected.groupBy("symbol").agg(F.count("*").alias("_expected")).join(hours.groupBy("symbol").agg(F.count("*").alias("_rows"), F.count_distinct("ts").alias("_times"), F.min("ts").alias("first"), F.max("ts").alias("last")), "symbol", "left")
    counts = events.groupBy("symbol").agg(F.count("*").alias("_splits"))
    d = todo
    for other in (audit, q.open_gap(hours), counts):
        d = d.join(other, "symbol", "left")
    rows, share = F.coalesce("_rows", F.lit(0)), F.coalesce(F.col("_rows") / F.col("_expected"), F.lit(0.0))
    failed = (F.when(F.col("_expected").isNull(), "NO_ROWS").when(rows < least_rows, "INSUFFICIENT_ROWS").when(share < least_coverage, "INSUFFICIENT_COVERAGE").when(F.col("_times") < rows, "DUPLICATE_TIMESTAMPS").when(F.coalesce("max_open_gap", F.lit(0.0)) > most_gap, "EXTREME_OPEN_GAP"))
    ok = F.col("_usable")
    d = d.select("symbol", F.when(ok, "EXISTING_USABLE").when(failed.isNull(), "HYDRATED").otherwise("REJECTED").alias("status"), F.when(ok, F.col("_have")).otherwise(rows).cast("long").alias("rows"),
                 F.when(ok, 0).otherwise(F.coalesce("_splits", F.lit(0))).cast("long").alias("split_count"), F.when(ok, 1.0).otherwise(share).alias("coverage"), F.when(~ok, failed).alias("reason"))
    return hours.join(d.filter("status = 'HYDRATED'").select("symbol"), "symbol", "left_semi"), d
