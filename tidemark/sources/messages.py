"""Venue messages as JSON text: three shapes, decoded to one, and written for tests and replays.

v0 and v2 send diffs with a range of ids and rows of [price, size]; v1 sends envelopes of sided updates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = "array<struct<price:decimal(20,8),size:decimal(20,8)>>"
# `U` and `u` differ only in case, which names of columns do not tell apart: `U` is read on its own.
DIFF = "s string, u long, b array<array<string>>, a array<array<string>>, lastUpdateId long, symbol string, bids array<array<string>>, asks array<array<string>>"
ENVELOPE = "sequence_num long, events array<struct<type:string,product_id:string,updates:array<struct<side:string,price_level:string,new_quantity:string>>>>"


def level_rows(rows: Column) -> Column:
    """[price, size, ...] rows as levels."""
    return F.transform(rows, lambda x: F.struct(x[0].cast("decimal(20,8)").alias("price"), x[1].cast("decimal(20,8)").alias("size")))


def level_updates(updates: Column, side: str) -> Column:
    """The levels of one side among sided updates."""
    own = F.filter(updates, lambda u: u["side"] == side)
    return F.transform(own, lambda u: F.struct(u["price_level"].cast("decimal(20,8)").alias("price"), u["new_quantity"].cast("decimal(20,8)").alias("size")))


def decode(raw: DataFrame) -> DataFrame:
    """raw: (event_id, venue, raw) as (event_id, venue, symbol, kind, first_id, last_id, bids, asks), with raw's other
    columns between. Each message is decoded where it lies: nothing is shuffled, and each text is read once.

    Text of another shape gives null ids and levels and the kind `invalid`.
    """
    envelope = F.col("venue") == "v1"
    rows = raw.where("venue is not null").withColumns({"_m": F.when(~envelope, F.from_json("raw", DIFF)), "_e": F.when(envelope, F.from_json("raw", ENVELOPE)), "_first": F.when(~envelope, F.get_json_object("raw", "$.U").cast("long"))})
    # Events of one product in an envelope are one update, in the envelope's order.
    products = F.array_distinct(F.transform("_e.events", lambda x: x["product_id"]))
    kept = [c for c in raw.columns if c not in ("event_id", "venue", "raw")]
    rows = rows.select("event_id", "venue", *kept, "_m", "_e", "_first", F.explode_outer(F.when(envelope, products).otherwise(F.array(F.coalesce("_m.s", "_m.symbol")))).alias("symbol"))
    own = F.filter("_e.events", lambda x: x["product_id"].eqNullSafe(F.col("symbol")))
    rows = rows.withColumn("_own", F.when(F.size("_e.events") > 0, own))
    shot = F.when(envelope, F.exists("_own", lambda x: F.coalesce(x["type"] == "snapshot", F.lit(False)))).otherwise(F.col("_m.lastUpdateId").isNotNull())
    last = F.when(envelope, F.col("_e.sequence_num")).otherwise(F.coalesce("_m.u", "_m.lastUpdateId"))
    rows = rows.withColumn("_updates", F.flatten(F.transform("_own", lambda x: x["updates"])))
    side = lambda sided, plain: F.when(envelope, level_updates(F.col("_updates"), sided)).otherwise(level_rows(plain))
    return rows.select(
        "event_id",
        "venue",
        *kept,
        "symbol",
        F.when(last.isNull(), "invalid").when(shot, "snapshot").otherwise("delta").alias("kind"),
        F.when(envelope, last).otherwise(F.coalesce("_first", "_m.lastUpdateId")).alias("first_id"),
        last.alias("last_id"),
        side("bid", F.coalesce("_m.b", "_m.bids")).alias("bids"),
        side("offer", F.coalesce("_m.a", "_m.asks")).alias("asks"),
    )


def encode(quotes: DataFrame) -> DataFrame:
    """Quotes as messages (event_id, venue, raw) with two levels on each side."""
    rows = lambda p, s, d: F.array(F.array(F.col(p).cast("string"), F.col(s).cast("string")), F.array((F.col(p) + d).cast("string"), F.lit("0")))
    diff = F.to_json(F.struct(F.col("pair").alias("s"), F.col("event_id").alias("U"), (F.col("event_id") + 2).alias("u"), rows("bid", "bid_size", -1).alias("b"), rows("ask", "ask_size", 1).alias("a")))
    one = lambda side, p, s: F.struct(F.lit(side).alias("side"), p.cast("string").alias("price_level"), s.cast("string").alias("new_quantity"))
    event = lambda *u: F.struct(F.lit("update").alias("type"), F.col("pair").alias("product_id"), F.array(*u).alias("updates"))
    zero = F.lit(0)
    parts = F.array(event(one("bid", F.col("bid"), F.col("bid_size")), one("offer", F.col("ask"), F.col("ask_size"))), event(one("bid", F.col("bid") - 1, zero), one("offer", F.col("ask") + 1, zero)))
    envelope = F.to_json(F.struct(F.col("event_id").alias("sequence_num"), parts.alias("events")))
    return quotes.select("event_id", "venue", F.when(F.col("venue") == "v1", envelope).otherwise(diff).alias("raw"))
