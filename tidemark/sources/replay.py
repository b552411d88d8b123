"""From a capture to market events: messages of three shapes, snapshot responses, acknowledgements and connection
rows become one event table, which acceptance, routes and episodes read as they read a live feed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources import messages

#: An acknowledgement of one book's subscription being dropped: its updates are over until the next snapshot.
ACK = r"^resync:([^:]+):unsubscribe:([0-9]+)$"


def _levels(price: str, size: str) -> Column:
    row = F.array(F.col(price).cast("string"), F.col(size).cast("string"))
    return F.when(F.col(price).isNotNull(), F.array(row)).otherwise(F.expr("cast(array() as array<array<string>>)"))


def frames(feed: DataFrame, pairs: tuple[str, ...]) -> DataFrame:
    """A feed (event_id, pair, venue, ns, kind, bid, ask, bid_size, ask_size, seq) as the frames of its capture. v0
    gives snapshots as responses to requests, v1 and v2 as messages; a link's rows are one connection frame."""
    snapshot, sided = F.col("kind") == "snapshot", lambda side, p, s: F.when(F.col(p).isNotNull(), F.struct(F.lit(side).alias("side"), F.col(p).cast("string").alias("price_level"), F.col(s).cast("string").alias("new_quantity")))
    bids, asks, at = _levels("bid", "bid_size"), _levels("ask", "ask_size"), F.col("event_id").alias("E")
    diff = F.struct(F.col("pair").alias("s"), F.col("seq").alias("U"), F.col("seq").alias("u"), at, bids.alias("b"), asks.alias("a"))
    whole = F.struct(F.col("pair").alias("symbol"), F.col("seq").alias("lastUpdateId"), at, bids.alias("bids"), asks.alias("asks"))
    updates = F.array_compact(F.array(sided("bid", "bid", "bid_size"), sided("offer", "ask", "ask_size")))
    event = F.struct(F.when(snapshot, "snapshot").otherwise("update").alias("type"), F.col("pair").alias("product_id"), updates.alias("updates"))
    envelope = F.struct(F.col("seq").alias("sequence_num"), at, F.array(event).alias("events"))
    ack = F.struct(F.concat_ws(":", F.lit("resync"), "pair", F.lit("unsubscribe"), "event_id").alias("id"), F.lit(200).alias("status"))
    text = F.when(F.col("kind") == "reset", F.to_json(ack)).when(F.col("venue") == "v1", F.to_json(envelope)).when(snapshot, F.to_json(whole)).otherwise(F.to_json(diff))
    link, answer = F.col("kind").isin("down", "up"), snapshot & (F.col("venue") == "v0")
    rows = feed.where(~link | (F.col("pair") == pairs[0]))
    return rows.select(
        F.col("venue").alias("exchange"),
        F.when(link, "connection").when(answer, "snapshot").otherwise("ws").alias("kind"),
        F.col("ns").alias("wall_ns"),
        F.col("ns").alias("mono_ns"),
        F.when(~link & ~answer, text).alias("raw"),
        F.when(answer, text).alias("payload"),
        F.when(link, F.col("kind") == "up").alias("connected"),
        F.when(link, F.col("event_id")).alias("connection_generation"),
        F.when(answer, F.struct(F.lit("resync").alias("purpose"), "pair", F.lit(1).cast("long").alias("connection_generation"))).alias("snapshot_provenance"),
        F.lit(None).cast("string").alias("reason"),
    )


def events(frames_: DataFrame, pairs: tuple[str, ...]) -> DataFrame:
    """Frames of a capture as (event_id, pair, venue, ns, kind, bid, ask, bid_size, ask_size, seq), as frames were made
    of; messages of another shape give none."""
    link = F.col("kind") == "connection"
    said = frames_.where("kind is not null").select(
        F.col("exchange").alias("venue"), F.col("mono_ns").alias("ns"), link.alias("link"), F.when(F.col("connected"), "up").otherwise("down").alias("turn"), F.col("connection_generation").alias("turn_id"), F.when(~link, F.coalesce("raw", "payload")).alias("raw")
    )
    said = said.withColumns({"name": F.get_json_object("raw", "$.id"), "status": F.get_json_object("raw", "$.status"), "number": F.get_json_object("raw", "$.E").cast("long")})
    row = lambda what, event_id, pair=F.lit(None), raw=F.lit(None): F.struct(what.alias("what"), event_id.alias("event_id"), pair.cast("string").alias("pair"), raw.cast("string").alias("raw"))
    # A connection is every pair's.
    links = F.array(*[row(F.col("turn"), F.col("turn_id"), F.lit(p)) for p in pairs])
    ack = F.when(F.col("name").rlike(ACK) & (F.col("status") == "200"), row(F.lit("reset"), F.regexp_extract("name", ACK, 2).cast("long"), F.regexp_extract("name", ACK, 1)))
    told = F.when(F.col("number").isNotNull(), row(F.lit("told"), F.col("number"), raw=F.col("raw")))
    # One pass over the frames; of links and acknowledgements there is nothing more to decode.
    rows = said.select("venue", "ns", F.explode(F.when(F.col("link"), links).otherwise(F.array_compact(F.array(ack, told)))).alias("r")).select("venue", "ns", "r.*")
    own = F.col("what") == "told"
    decoded = messages.decode(rows).where(~own | (F.col("kind") != "invalid"))
    first = lambda side, field: F.get(F.col(side), F.lit(0))[field].cast("long")
    return decoded.select(
        "event_id",
        F.when(own, F.col("symbol")).otherwise(F.col("pair")).alias("pair"),
        "venue",
        "ns",
        F.when(own, F.col("kind")).otherwise(F.col("what")).alias("kind"),
        first("bids", "price").alias("bid"),
        first("asks", "price").alias("ask"),
        first("bids", "size").alias("bid_size"),
        first("asks", "size").alias("ask_size"),
        F.col("last_id").alias("seq"),
    )
