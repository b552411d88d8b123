"""Fill rates: exactly one outcome for each book, notional and side at each tick of a fixed grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_join
from tidemark.operators.book import BOOK, eligibility

#: Why a book can't be tried, in the order in which it is judged, and every outcome of a sample.
REASONS = ["missing", "disconnected", "uninitialized", "discontinuous", "too_old", "incomplete", "crossed"]
OUTCOMES = ["filled", "insufficient", *REASONS]


def grid(start: int, end: int, interval: int, spark) -> DataFrame:
    """(tick): start, start + interval, .. up to end."""
    return spark.range(0, max(0, (end - start) // interval + 1)).select((F.lit(start) + F.col("id") * interval).cast("long").alias("tick"))


def last_by_tick(quotes: DataFrame, start: int, interval: int) -> DataFrame:
    """The last quote of each book between two ticks of a grid, the only one that the later tick can see."""
    tick = F.expr(f"(ns - {start} + {interval - 1}) div {interval}").alias("_tick")  # in whole numbers; none is before the start
    others = [c for c in quotes.columns if c not in BOOK]
    last = quotes.groupBy(*BOOK, tick).agg(F.max_by(F.struct(*others), F.struct("ns", "event_id")).alias("_last"))
    return last.select(*BOOK, *[F.col("_last")[c].alias(c) for c in others])


def samples(quotes: DataFrame, roster: DataFrame, ticks: DataFrame, notionals: DataFrame, max_age: int, block: int) -> DataFrame:
    """(tick, pair, venue, notional, side, outcome) of the whole roster: a book that was never seen or
    can't be used has its reason as the outcome.

    quotes: (pair, venue, ns, event_id, initialized, connected, bid, ask, bid_size, ask_size), what each row leaves of
    its book. The roster, ticks and notionals are small and span the result.
    """
    books = ticks.crossJoin(roster)
    state = asof_join(books, quotes, BOOK, "tick", "ns", ["event_id"], ["ns", "initialized", "connected", "bid", "ask", "bid_size", "ask_size"], block)
    why = eligibility(F.col("ns"), F.col("connected"), F.col("initialized"), F.col("initialized"), F.col("tick") - F.col("ns"), F.col("bid"), F.col("ask"), max_age)
    sides = F.explode(F.array(F.struct(F.lit("buy").alias("side"), (F.col("ask") * F.col("ask_size")).alias("depth")), F.struct(F.lit("sell").alias("side"), (F.col("bid") * F.col("bid_size")).alias("depth"))))
    rows = state.withColumn("why", why).select("tick", *BOOK, "why", sides.alias("s")).crossJoin(F.broadcast(notionals))
    outcome = F.coalesce("why", F.when(F.col("s.depth") >= F.col("notional"), "filled").otherwise("insufficient"))
    return rows.select("tick", *BOOK, "notional", F.col("s.side").alias("side"), outcome.alias("outcome"))


def buckets(samples_: DataFrame, width: int) -> DataFrame:
    """Counts of each outcome by bucket of time and row key."""
    bucket = (F.floor(F.col("tick") / width).cast("long") * width).alias("bucket_ns")
    return samples_.groupBy(bucket, *BOOK, "notional", "side").agg(F.count("*").alias("samples"), *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])


def window(buckets_: DataFrame, start: int, end: int) -> DataFrame:
    """Sums over the buckets of [start, end) with the fill rate in 1e-6 of what could be tried, null if
    nothing could, and the share of samples that could."""
    total = buckets_.where((F.col("bucket_ns") >= start) & (F.col("bucket_ns") < end)).groupBy(*BOOK, "notional", "side").agg(*[F.sum(c).alias(c) for c in ["samples", *OUTCOMES]])
    tried = F.col("filled") + F.col("insufficient")
    return total.withColumn("fill_rate", F.floor(F.try_divide(F.col("filled") * 1_000_000, tried)).cast("long")).withColumn("eligible_share", F.floor(tried * 1_000_000 / F.col("samples")).cast("long"))


def fingerprint(*settings: Column) -> Column:
    """SHA-256 of settings' texts, joined by |."""
    return F.sha2(F.concat_ws("|", *[s.cast("string") for s in settings]).cast("binary"), 256)


def session_id(started_ns: Column, print_: Column) -> Column:
    """<start>-<first 16 digits of the fingerprint>."""
    return F.concat_ws("-", started_ns.cast("string"), F.substring(print_, 1, 16))


def upserted(buckets_: DataFrame, keys: list[str]) -> DataFrame:
    """Buckets that came in several parts, summed by their keys; parts of one key are added, not replaced."""
    counts = [c for c in buckets_.columns if c not in keys]
    return buckets_.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])


def by_config(buckets_: DataFrame, sessions: DataFrame, start: int, end: int, interval: int) -> DataFrame:
    """Counts of the buckets of [start, end) by the configuration of their session and row key, with the share of
    the span (1e-6) that the samples of a row key cover. Sessions are few and broadcast by size only."""
    own = buckets_.where((F.col("bucket_ns") >= start) & (F.col("bucket_ns") < end)).join(sessions.select("session", "config"), "session")
    total = own.groupBy("config", *BOOK, "notional", "side").agg(*[F.sum(c).alias(c) for c in ["samples", *OUTCOMES]])
    tried = F.col("filled") + F.col("insufficient")
    rate = F.floor(F.try_divide(F.col("filled") * 1_000_000, tried)).cast("long")
    return total.withColumn("fill_rate", rate).withColumn("coverage", F.floor(F.col("samples") * (interval // 10**9 * 1_000_000) / ((end - start) // 10**9)).cast("long"))
