"""Episodes: maximal runs of a route above the threshold, with open, peak and close.

Runs are built in two steps, so that no task holds a route's whole history: inside each block of time the
rows of one state in a row become a segment with its measures, and a window over a route's few segments
merges those that go on across blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROUTE = ["pair", "route", "buy", "sell"]
_MEASURES = ["ask", "bid", "size", "spread", "buy_age", "sell_age", "skew"]


def segments(rows: DataFrame) -> DataFrame:
    """(route, block, part, state, first, peak, last_ns): runs of equal state inside each block. Rows that go on with a
    state other than above may be left out: only its first row counts."""
    inside = Window.partitionBy(*ROUTE, "block").orderBy("ns", "event_id")
    marked = rows.withColumn("new", F.when(F.col("state").eqNullSafe(F.lag("state").over(inside)), 0).otherwise(1))
    parts = marked.withColumn("part", F.sum("new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    row = F.struct("ns", "event_id", *_MEASURES)
    # The first of equal peaks wins.
    height = F.struct("spread", -F.col("ns"), -F.col("event_id"))
    return parts.groupBy(*ROUTE, "block", "part").agg(
        F.first("state").alias("state"), F.min(row).alias("first"), F.max_by(row, height).alias("peak"), F.max("skew").alias("max_skew"), F.max("ns").alias("last_ns"), F.count("*").alias("evaluations")
    )


def episodes(rows: DataFrame) -> DataFrame:
    """One row for each episode of route rows; end_ns and close_reason are null while it is open.

    A run ends at the first row of another state: spread_closed with that row's spread if both legs are
    there, book_ineligible without a spread if one is not.
    """
    order = Window.partitionBy(*ROUTE).orderBy("block", "part")
    runs = segments(rows).withColumn("new", F.when(F.col("state").eqNullSafe(F.lag("state").over(order)), 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy(*ROUTE, "run").agg(
        F.first("state").alias("state"),
        F.min("first").alias("first"),
        F.max_by("peak", F.struct("peak.spread", -F.col("peak.ns"), -F.col("peak.event_id"))).alias("peak"),
        F.max("max_skew").alias("max_skew"),
        F.sum("evaluations").alias("evaluations"),
    )
    by_run = Window.partitionBy(*ROUTE).orderBy("run")
    closed = merged.withColumn("next", F.lead(F.struct("state", F.col("first.ns").alias("ns"), F.col("first.spread").alias("spread"))).over(by_run)).where("state = 'above'")
    lasts = F.col("next")
    return closed.select(
        (F.col("first.event_id") * 8 + F.col("route")).alias("id"),
        "pair",
        F.substring_index("pair", "-", -1).alias("quote"),
        "buy",
        "sell",
        F.col("first.ns").alias("start_ns"),
        lasts["ns"].alias("end_ns"),
        F.when(lasts["state"] == "below", "spread_closed").when(lasts["state"] == "absent", "book_ineligible").alias("close_reason"),
        F.col("first.ask").alias("buy_price"),
        F.col("first.bid").alias("sell_price"),
        F.col("first.size").alias("max_size"),
        F.col("first.spread").alias("open_spread"),
        F.col("peak.ns").alias("peak_ns"),
        F.col("peak.event_id").alias("peak_id"),
        F.col("peak.spread").alias("peak_spread"),
        F.col("peak.size").alias("peak_size"),
        (F.col("peak.size") * (F.col("peak.bid") - F.col("peak.ask"))).alias("peak_profit"),
        F.when(lasts["state"] == "below", lasts["spread"]).alias("close_spread"),
        F.col("first.buy_age").alias("buy_age"),
        F.col("first.sell_age").alias("sell_age"),
        F.col("first.skew").alias("skew"),
        "max_skew",
        "evaluations",
    )


def shut_down(found: DataFrame, end_ns: int) -> DataFrame:
    """Open episodes closed at the end of the input."""
    is_open = F.col("close_reason").isNull()
    return found.withColumn("end_ns", F.when(is_open, F.lit(end_ns)).otherwise(F.col("end_ns"))).withColumn("close_reason", F.coalesce("close_reason", F.lit("shutdown")))


def orphaned(found: DataFrame) -> DataFrame:
    """Open episodes of a run that broke off: they stay without an end."""
    return found.withColumn("close_reason", F.coalesce("close_reason", F.lit("orphaned")))


def upsert_fold(changes: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """One row for each key of a stream of (key, values, end_ns, version): a closed row wins over an open
    one and the first closed row over later ones."""
    rank = F.struct(F.col("end_ns").isNotNull(), F.when(F.col("end_ns").isNotNull(), -F.col("version")).otherwise(F.col("version")))
    return changes.groupBy(*key).agg(F.max_by(F.struct(*values), rank).alias("_won")).select(*key, *[F.col("_won")[v].alias(v) for v in values])
