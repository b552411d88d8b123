"""Derived market tables over the driver's tables: quotes and book levels of venues by pair.

Prices and sizes are integers (ticks and lots) and times are nanoseconds, so every result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import table

NS_MINUTE = 60 * 10**9
NS_HOUR = 60 * NS_MINUTE
NS_DAY = 24 * NS_HOUR
VENUES = ("v0", "v1", "v2")
#: Taker fees in 1e-8 of the notional, by venue; a venue without a fee isn't priced.
FEES = {"v0": 200_000, "v1": 150_000, "v2": 100_000}
NOTIONALS = (10_000, 40_000, 150_000)


def ns_of(ts: Column) -> Column:
    """Nanoseconds since the epoch; the session's time zone is UTC."""
    return F.unix_micros(ts.cast("timestamp")) * 1000


def pair_name(number: Column) -> Column:
    return F.concat(F.lit("P"), number.cast("string"), F.when(number % 3 == 0, F.lit("-EUR")).otherwise(F.lit("-USD")))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, pair, venue, ns, kind, bid, ask, bid_size, ask_size): top-of-book events in the order of
    (ns, event_id); kind is snapshot, delta or reset."""
    return quotes_of(table(spark, sf_dir, "events"))


def quotes_of(events: DataFrame) -> DataFrame:
    """The same of a table or stream of events."""
    number = F.floor(F.col("user_id") / 3).cast("long") % 9
    off = F.round(F.col("value") * 100).cast("long") % 200
    kind = F.when(F.col("event_type") == "error", "reset").when(F.col("event_type") == "signup", "snapshot").otherwise("delta")
    return events.select(
        "event_id",
        pair_name(number).alias("pair"),
        F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string")).alias("venue"),
        ns_of(F.col("ts")).alias("ns"),
        kind.alias("kind"),
        (F.lit(9995) + off).alias("bid"),
        (F.lit(10005) + off).alias("ask"),
        (1 + F.col("event_id") % 7).alias("bid_size"),
        (1 + F.col("event_id") % 5).alias("ask_size"),
    )


#: The pairs of the derived quotes.
PAIRS = tuple(f"P{k}-{'EUR' if k % 3 == 0 else 'USD'}" for k in range(9))


def feed_of(events: DataFrame) -> DataFrame:
    """Quotes as a venue sends them, with what goes wrong, of a table or stream of events: every 59th lacks its bid,
    every 53rd is crossed, every 37th repeats a number and every 41st skips one (`off`). Every 401st takes its venue's
    link down and every 43rd brings it back, each as a row for every pair, one nanosecond later."""
    n = F.col("event_id")
    rough = quotes_of(events).withColumns(
        {
            "off": F.when(n % 37 == 0, -1).when(n % 41 == 0, 1).otherwise(0).cast("long"),
            "ask": F.when(n % 53 == 0, F.col("bid") - 1).otherwise(F.col("ask")),
            "bid": F.when(n % 59 == 0, F.lit(None)).otherwise(F.col("bid")),
        }
    )
    kind = F.when(n % 401 == 0, "down").when(n % 43 == 0, "up")
    nothing = [F.lit(None).cast("long").alias(c) for c in ("bid", "ask", "bid_size", "ask_size", "off")]
    own = F.struct("pair", "ns", "kind", "bid", "ask", "bid_size", "ask_size", "off")
    link = [F.struct(F.lit(p).alias("pair"), (F.col("ns") + 1).alias("ns"), kind.alias("kind"), *nothing) for p in PAIRS]
    rows = F.when(kind.isNotNull(), F.array(own, *link)).otherwise(F.array(own))
    return rough.select("event_id", "venue", F.explode(rows).alias("r")).select("event_id", "r.pair", "venue", *[f"r.{c}" for c in ("ns", "kind", "bid", "ask", "bid_size", "ask_size", "off")])


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair, venue, side, price, size, ns, seq): level updates in the order of (ns, seq); size 0 deletes."""
    return levels_of(table(spark, sf_dir, "lineitem"))


def levels_of(lineitem: DataFrame) -> DataFrame:
    """The same of a table or stream of line items."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long") % 200
    venue = F.col("l_suppkey") % 3
    side = F.when(F.col("l_linestatus") == "O", "bid").otherwise("ask")
    return lineitem.select(
        pair_name(F.col("l_partkey") % 9).alias("pair"),
        F.concat(F.lit("v"), venue.cast("string")).alias("venue"),
        side.alias("side"),
        F.when(side == "bid", 10_000 + 10 * venue - cents).otherwise(10_001 + 10 * venue + cents).alias("price"),
        F.when(F.col("l_returnflag") == "R", 0).otherwise(F.col("l_quantity").cast("long")).alias("size"),
        ns_of(F.col("l_shipdate")).alias("ns"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
    )


def fees(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(FEES.items()), "venue string, fee long")


def notionals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n,) for n in NOTIONALS], "notional long")
