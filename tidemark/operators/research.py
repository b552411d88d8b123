"""Research over episodes: survival of fees, age and skew bands, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper edges of the bands in milliseconds, each included; what lies beyond is the open band.
BAND_EDGES_MS = (60_000, 600_000, 3_600_000, 10_800_000)


def ledgers(episodes: DataFrame, notionals: DataFrame, fees: DataFrame) -> DataFrame:
    """Episodes by notional: priced if the peak's depth covers it, and what the fees leave of the spread.
    Routes of a venue without a fee are left out."""
    fee = lambda leg: F.broadcast(fees.select(F.col("venue").alias(leg), F.col("fee").alias(f"{leg}_fee")))
    rows = episodes.join(fee("buy"), "buy").join(fee("sell"), "sell").crossJoin(F.broadcast(notionals))
    priced = F.col("peak_size") * F.col("buy_price") >= F.col("notional")
    return rows.withColumn("priced", priced).withColumn("net", F.when(priced, F.col("peak_spread") - F.col("buy_fee") - F.col("sell_fee")))


def survival(rows: DataFrame) -> DataFrame:
    """By notional and quote: observations, priced, insufficient, survivors and their profit."""
    survives = F.coalesce(F.col("net") > 0, F.lit(False))
    profit = F.when(survives, F.floor(F.col("notional") * F.col("net") / 100_000_000).cast("long")).otherwise(0)
    return rows.groupBy("notional", "quote").agg(
        F.count("*").alias("observations"), F.count_if(F.col("priced")).alias("priced"), F.count_if(~F.col("priced")).alias("insufficient"), F.count_if(survives).alias("survivors"), F.sum(profit).alias("net_profit")
    )


def fee_scenario(episodes: DataFrame, scenarios: DataFrame) -> DataFrame:
    """For each scenario (scenario, venue, fee): survivors and profit by quote, and episodes whose venue it
    doesn't know."""
    base = episodes.select("id", "quote", "buy", "sell", "peak_spread", (F.col("buy_price") * F.col("peak_size")).alias("notional"))
    names = F.broadcast(scenarios.select("scenario").distinct())
    fee = lambda leg: F.broadcast(scenarios.select("scenario", F.col("venue").alias(leg), F.col("fee").alias(f"{leg}_fee")))
    rows = base.crossJoin(names).join(fee("buy"), ["scenario", "buy"], "left").join(fee("sell"), ["scenario", "sell"], "left")
    net = F.col("peak_spread") - F.col("buy_fee") - F.col("sell_fee")
    rows = rows.withColumn("net", net)
    good = F.coalesce(F.col("net") > 0, F.lit(False))
    return rows.groupBy("scenario", "quote").agg(
        F.count("*").alias("episodes"),
        F.count_if(F.col("net").isNull()).alias("unpriced"),
        F.count_if(good).alias("survivors"),
        F.sum(F.when(good, F.floor(F.col("notional") * F.col("net") / 100_000_000).cast("long")).otherwise(0)).alias("net_profit"),
    )


def band(value_ms: Column) -> Column:
    """Index of the band, from 0; -1 for an unknown value."""
    out = F.lit(len(BAND_EDGES_MS))
    for k, edge in reversed(list(enumerate(BAND_EDGES_MS))):
        out = F.when(value_ms <= edge, F.lit(k)).otherwise(out)
    return F.when(value_ms.isNull(), F.lit(-1)).otherwise(out)


def dimensions(rows: DataFrame) -> DataFrame:
    """Rows by dimension: the older leg's age, unknown if either is, and the skew; with their band."""
    oldest = F.when(F.col("buy_age").isNotNull() & F.col("sell_age").isNotNull(), F.greatest("buy_age", "sell_age"))
    both = F.explode(F.array(F.struct(F.lit("age").alias("dimension"), oldest.alias("value")), F.struct(F.lit("skew").alias("dimension"), F.col("skew").alias("value"))))
    out = rows.withColumn("d", both)
    return out.select(*rows.columns, "d.dimension", band(F.floor(F.col("d.value") / 1_000_000)).alias("band"))


def band_table(evaluations: DataFrame, episodes: DataFrame, spark) -> DataFrame:
    """Every band of each dimension, empty ones too; the unknown band only if it has rows."""
    every = spark.createDataFrame([(d, k) for d in ("age", "skew") for k in range(len(BAND_EDGES_MS) + 1)], "dimension string, band int")
    seen = dimensions(evaluations).groupBy("dimension", "band").agg(F.count("*").alias("evaluations"))
    opened = dimensions(episodes).groupBy("dimension", "band").agg(
        F.count("*").alias("opened"), F.count_if(F.col("close_reason") == "book_ineligible").alias("ineligible"), F.max(F.col("end_ns") - F.col("start_ns")).alias("longest")
    )
    keys = every.unionByName(seen.where("band = -1").select("dimension", "band")).distinct()
    rows = keys.join(seen, ["dimension", "band"], "left").join(opened, ["dimension", "band"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    rate = F.floor(F.try_divide(F.coalesce("opened", F.lit(0)) * 1_000_000, F.col("evaluations"))).cast("long")
    return rows.select("dimension", "band", zero("evaluations"), zero("opened"), zero("ineligible"), rate.alias("open_rate"), "longest")


def gate_sensitivity(rows: DataFrame, cutoffs: DataFrame, by: tuple[str, ...] = (), **more: Column) -> DataFrame:
    """For each cutoff of the older leg's age: episodes that a gate there keeps or rejects, and survivors.

    rows: (buy_age, sell_age, net, peak_profit, quote); cutoffs: (cutoff), few. `by` are columns to group by as well, and
    `more` are further aggregates of a group.
    """
    oldest = F.when(F.col("buy_age").isNotNull() & F.col("sell_age").isNotNull(), F.greatest("buy_age", "sell_age"))
    out = rows.withColumn("oldest", oldest).crossJoin(F.broadcast(cutoffs))
    kept = F.coalesce(F.col("oldest") <= F.col("cutoff"), F.lit(False))
    return out.groupBy(*by, "cutoff", "quote").agg(
        F.count_if(kept).alias("retained"),
        F.count_if(F.col("oldest") > F.col("cutoff")).alias("rejected"),
        F.count_if(F.col("oldest").isNull()).alias("unknown"),
        F.count_if(kept & (F.col("net") > 0)).alias("survivors"),
        F.sum(F.when(kept, F.col("peak_profit")).otherwise(0)).alias("profit"),
        *[c.alias(n) for n, c in more.items()],
    )
