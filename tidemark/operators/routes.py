"""Directed routes between venues of a pair: aligned tops, leg ages, spreads and their states."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import latest_by_series

#: 1e-8 units of a spread.
UNIT = 100_000_000


def spread(bid: Column, ask: Column) -> Column:
    """(bid - ask) / ask in 1e-8, rounded down."""
    return F.floor((bid - ask) * UNIT / ask).cast("long")


def aligned(trusted: DataFrame, venues: tuple[str, ...], block: int) -> DataFrame:
    """Each event of a pair with every venue's latest top, trusted or not (`at_<venue>`)."""
    state = F.struct("ns", "trusted", "bid", "ask", "bid_size", "ask_size")
    # An expiry row is a time to look at the books again and changes none of them.
    is_heard = F.col("kind") != "expiry" if "kind" in trusted.columns else F.lit(True)
    heard = trusted.withColumn("_heard", F.when(is_heard, F.col("venue")))
    return latest_by_series(heard, ["pair"], "_heard", venues, state, ["ns", "event_id"], "ns", block).drop("_heard")


def _leg(top: Column, ns: Column, max_age: int) -> Column:
    """Whether a venue's top can be used at a time."""
    return F.coalesce(top["trusted"] & (ns - top["ns"] <= max_age), F.lit(False))


def _above(bid: Column, ask: Column, threshold: int) -> Column:
    return (bid > ask) & ((bid - ask) * UNIT >= threshold * ask)


def marked(aligned_: DataFrame, venues: tuple[str, ...], max_age: int, threshold: int) -> DataFrame:
    """(pair, ns, event_id, block, at_<venue>) of aligned rows with two sets of routes, as bits by their number: `moved`,
    whose state, worth or spread isn't that of the row before in the block (of a block's first row all), and `turned`,
    whose state isn't or is above. Most rows change few routes, so steps that need only changes make no row of others."""
    inside = Window.partitionBy("pair", "block").orderBy("ns", "event_id")
    names, ns = [], F.col("ns")
    rows = aligned_.select("pair", "ns", "event_id", "block", *[f"at_{v}" for v in venues], *[_leg(F.col(f"at_{v}"), ns, max_age).alias(f"_f_{v}") for v in venues])
    now = {}
    for k, (b, s) in enumerate(permutations(venues, 2)):
        x, y = F.col(f"at_{b}"), F.col(f"at_{s}")
        state = F.when(_above(y["bid"], x["ask"], threshold), 2).otherwise(1)
        now[f"_n{k}"] = F.when(F.col(f"_f_{b}") & F.col(f"_f_{s}"), F.struct(state.alias("state"), x["ask"].alias("ask"), y["bid"].alias("bid"), F.least(x["ask_size"], y["bid_size"]).alias("size")))
        names.append(f"_n{k}")
    rows = rows.withColumns(now).withColumn("_first", F.row_number().over(inside) == 1).withColumns({f"_w{n}": F.lag(n).over(inside) for n in names})
    state = lambda c: F.coalesce(F.col(c)["state"], F.lit(0))
    bits = lambda tests: sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0))
    moved = bits([F.col("_first") | ~F.col(n).eqNullSafe(F.col(f"_w{n}")) for n in names])
    turned = bits([F.col("_first") | (state(n) == 2) | (state(n) != state(f"_w{n}")) for n in names])
    return rows.select("pair", "ns", "event_id", "block", *[f"at_{v}" for v in venues], moved.alias("moved"), turned.alias("turned"))


def route_rows(aligned_: DataFrame, venues: tuple[str, ...], max_age: int, threshold: int, only: str | None = None) -> DataFrame:
    """One row for each event and directed route: ages of both legs, their skew, and the route's state.

    absent: a leg is missing, untrusted or too old; above: the sell venue's bid is over the buy venue's
    ask by `threshold` (1e-8) or more, compared exactly; below: otherwise. `only`: moved or turned, for the routes of
    that set of `marked` rows.
    """
    if only:
        aligned_ = aligned_.where(F.col(only) != 0)
    routes = []
    for k, (b, s) in enumerate(permutations(venues, 2)):
        routes.append(F.struct(F.lit(k).alias("route"), F.lit(b).alias("buy"), F.lit(s).alias("sell"), F.col(f"at_{b}").alias("x"), F.col(f"at_{s}").alias("y")))
    keep = [] if only is None else [F.col(only).alias("_only")]
    rows = aligned_.select("pair", "ns", "event_id", "block", *keep, F.explode(F.array(*routes)).alias("r")).select("pair", "ns", "event_id", "block", *["_only" for _ in keep], "r.*")
    rows = rows if only is None else rows.where(F.expr("shiftright(_only, route) & 1 = 1")).drop("_only")
    fresh = lambda leg: _leg(F.col(leg), F.col("ns"), max_age)
    rows = rows.withColumn("both", fresh("x") & fresh("y")).withColumn("ask", F.col("x.ask")).withColumn("bid", F.col("y.bid"))
    above = _above(F.col("bid"), F.col("ask"), threshold)
    buy_age, sell_age = F.greatest(F.lit(0), F.col("ns") - F.col("x.ns")), F.greatest(F.lit(0), F.col("ns") - F.col("y.ns"))
    # greatest() passes over nulls, so an age without its leg is set to null here.
    buy_age, sell_age = F.when(F.col("x").isNotNull(), buy_age), F.when(F.col("y").isNotNull(), sell_age)
    return rows.select(
        "pair",
        "route",
        "buy",
        "sell",
        "ns",
        "event_id",
        "block",
        F.when(~F.col("both"), "absent").when(above, "above").otherwise("below").alias("state"),
        "ask",
        "bid",
        F.least("x.ask_size", "y.bid_size").alias("size"),
        F.when(F.col("both"), spread(F.col("bid"), F.col("ask"))).alias("spread"),
        buy_age.alias("buy_age"),
        sell_age.alias("sell_age"),
        F.abs(buy_age - sell_age).alias("skew"),
    )
