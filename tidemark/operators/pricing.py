"""Depth pricing: what a quote amount or a base quantity costs down a side's levels, and routes priced so.

A walk is a window of running sums over each side's levels; a level counts with what is still wanted. The
last division comes once at the end. Values of fills are in 1e-6 of a lot or a tick.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICRO = 1_000_000


def _from_best(side: Column, price: Column) -> Column:
    return F.when(side == "bid", -price).otherwise(price)


def _cumulated(levels: DataFrame, keys: list[str], amount: Column) -> DataFrame:
    """Levels with what the better ones and they themselves add up to; empty levels are passed over."""
    w = Window.partitionBy(*keys).orderBy(_from_best(F.col("side"), F.col("price")))
    own = levels.where("size > 0").withColumn("amount", amount)
    total = F.coalesce(F.sum("amount").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.withColumn("before", total)


def walk_quote(levels: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """(keys, notional, filled, levels_used, quote, base): spending `notional` down each side.

    wanted: (notional), few rows. A level that meets the rest exactly is the last one used. base is in
    1e-6 lots, rounded down for each level.
    """
    rows = _cumulated(levels, keys, F.col("price") * F.col("size")).crossJoin(F.broadcast(wanted))
    take = F.greatest(F.lit(0), F.least(F.col("amount"), F.col("notional") - F.col("before")))
    return (
        rows.withColumn("take", take)
        .groupBy(*keys, "notional")
        .agg(
            (F.sum("take") >= F.first("notional")).alias("filled"),
            F.sum((F.col("take") > 0).cast("long")).alias("levels_used"),
            F.sum("take").alias("quote"),
            F.sum(F.floor(F.col("take") * MICRO / F.col("price")).cast("long")).alias("base"),
        )
    )


def walk_base(levels: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """(keys, wanted's columns, filled, quote): trading `base` (1e-6 lots) down each side. wanted: (keys
    but the side, base, ...). quote is in 1e-6 ticks."""
    on = [k for k in keys if k != "side"]
    rows = _cumulated(levels, keys, F.col("size") * MICRO).join(wanted, on)
    take = F.greatest(F.lit(0), F.least(F.col("amount"), F.col("base") - F.col("before")))
    extra = [c for c in wanted.columns if c not in on]
    return rows.withColumn("take", take).groupBy(*keys, *extra).agg((F.sum("take") >= F.first("base")).alias("filled"), F.sum(F.col("take") * F.col("price")).alias("quote"))


def spread_of(cost: Column, proceeds: Column) -> Column:
    """Proceeds over cost in 1e-8, rounded down."""
    return F.floor((proceeds - cost) * 1e8 / cost).cast("long")


def matched_routes(levels: DataFrame, wanted: DataFrame, fees: DataFrame) -> DataFrame:
    """One row for each pair, directed route and notional: the notional is spent on the buy venue's asks
    and exactly that base sold on the sell venue's bids, before and after fees.

    A buy that falls short leaves the sell unpriced; routes of a venue without a fee are left out.
    """
    asks = walk_quote(levels.where("side = 'ask'"), ["pair", "venue"], wanted)
    bought = asks.select("pair", F.col("venue").alias("buy"), "notional", F.col("filled").alias("buy_filled"), F.col("quote").alias("cost"), "base")
    sells = levels.where("side = 'bid'").select("pair", F.col("venue").alias("sell")).distinct()
    wanted_base = bought.join(sells, "pair").where("buy <> sell")
    bids = levels.where("side = 'bid'").withColumnRenamed("venue", "sell")
    sold = walk_base(bids, ["pair", "sell", "side"], wanted_base).withColumn("sell_filled", F.when(F.col("buy_filled"), F.col("filled")))
    fee = lambda leg: F.broadcast(fees.select(F.col("venue").alias(leg), F.col("fee").alias(f"{leg}_fee")))
    priced = sold.join(fee("buy"), "buy").join(fee("sell"), "sell")
    both = F.col("buy_filled") & F.col("sell_filled")
    cost, proceeds = F.col("cost") * MICRO, F.col("quote")
    gross = F.when(both, spread_of(cost, proceeds))
    net = F.when(both, spread_of(cost + F.floor(cost * F.col("buy_fee") / 100_000_000), proceeds - F.floor(proceeds * F.col("sell_fee") / 100_000_000)))
    return priced.select("pair", "buy", "sell", "notional", "buy_filled", "sell_filled", F.when(F.col("buy_filled"), F.col("base")).alias("base"), gross.alias("gross"), net.alias("net"))
