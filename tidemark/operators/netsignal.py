"""Net signals of routes and the intervals in which they pay, with hysteresis and delay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import block_of, preceding, running
from tidemark.session import settled

ROUTE = ["pair", "buy", "sell", "notional"]
ORDER = ["ns", "event_id"]
#: Nanoseconds in one block.
BLOCK = 7 * 86_400 * 10**9


def signals(route_rows: DataFrame, notionals: DataFrame, fees: DataFrame) -> DataFrame:
    """(route, notional, ns, event_id, state, net): what a notional nets at each evaluation; only changes of
    (state, net) are kept. Routes of a venue without a fee are left out."""
    fee = lambda leg: F.broadcast(fees.select(F.col("venue").alias(leg), F.col("fee").alias(f"{leg}_fee")))
    # Each row against the one before it, whichever block that is in; notionals come after, as all have the same rows.
    priced = F.when(F.col("state") != "absent", F.struct((F.col("size") * F.col("ask")).alias("worth"), "spread"))
    rows = route_rows.join(fee("buy"), "buy").join(fee("sell"), "sell").select("pair", "buy", "sell", *ORDER, "block", "buy_fee", "sell_fee", F.struct((F.col("state") == "absent").alias("absent"), priced.alias("p")).alias("now"))
    rows = preceding(rows, ["pair", "buy", "sell"], ORDER, F.col("now"), "was")
    # What a notional makes of a row depends on little, and a row that is like the one before it changes for none.
    rows = rows.where(~F.col("now").eqNullSafe(F.col("was"))).crossJoin(F.broadcast(notionals))

    def seen(c: str):
        state = F.when(F.col(f"{c}.absent"), "ineligible").when(F.col(f"{c}.p.worth") < F.col("notional"), "insufficient_depth").otherwise("priced")
        net = F.when(state == "priced", F.col(f"{c}.p.spread") - F.col("buy_fee") - F.col("sell_fee"))
        return F.struct(state.alias("state"), net.alias("net"))

    changed = F.col("was").isNull() | ~seen("now").eqNullSafe(seen("was"))
    return rows.where(changed).select(*ROUTE, *ORDER, seen("now")["state"].alias("state"), seen("now")["net"].alias("net"))


def intervals(signals_: DataFrame, variants: DataFrame, block: int = BLOCK) -> DataFrame:
    """Intervals by variant (variant, threshold, hysteresis, delay): open once net > threshold, closed once
    net <= threshold - hysteresis or the route can't be priced, dropped if over before the delay.

    The state between is the last decisive one. Rows are dealt out once, by route, variant and block: each block
    gives its last decision and its first row, a window over blocks carries these, and inside a block the rows
    of one state in a row become a segment. Only segments are put together over a whole route.
    """
    rows = settled(signals_, "signals").crossJoin(F.broadcast(variants))
    keys = ["variant", *ROUTE]
    up = F.col("net") > F.col("threshold")
    down = (F.col("state") != "priced") | (F.col("net") <= F.col("threshold") - F.col("hysteresis"))
    rows = rows.withColumn("flag", F.when(F.coalesce(up, F.lit(False)), 1).when(down, 0)).withColumn("block", block_of(F.col("ns"), block))
    place = F.struct(*ORDER)
    ends = rows.groupBy(*keys, "block").agg(F.max_by("flag", F.when(F.col("flag").isNotNull(), place)).alias("last"), F.min_by(F.struct("ns", "state"), place).alias("first"))
    over = Window.partitionBy(*keys).orderBy("block")
    carried = ends.select(*keys, "block", F.coalesce(F.last("last", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("opening"), F.lead("first").over(over).alias("after"))
    inside = Window.partitionBy(*keys, "block").orderBy(*ORDER)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(carried, [*keys, "block"]).withColumn("on", F.coalesce(F.last("flag", ignorenulls=True).over(so_far), "opening"))
    rows = rows.withColumn("was", F.coalesce(F.lag("on").over(inside), "opening")).withColumn("next", F.coalesce(F.lead(F.struct("ns", "state")).over(inside), "after"))
    rows = rows.withColumn("part", F.sum(F.when(F.col("on") != F.col("was"), 1).otherwise(0)).over(so_far)).where("on = 1")
    # A segment that begins with a row before which it was off opens an interval; others go on with one.
    segments = rows.groupBy(*keys, "block", "part").agg(
        F.min_by(F.col("was") == 0, place).alias("opens"), F.min("ns").alias("open_ns"), F.max("net").alias("peak_net"), F.max(F.struct(*ORDER, "net", "next")).alias("last"), F.first("delay").alias("delay")
    )
    runs = segments.withColumn("run", F.sum(F.col("opens").cast("int")).over(Window.partitionBy(*keys).orderBy("block", "part").rowsBetween(Window.unboundedPreceding, 0)))
    # The row that closes a run tells why.
    own = runs.groupBy(*keys, "run").agg(F.min("open_ns").alias("open_ns"), F.max("peak_net").alias("peak_net"), F.max("last").alias("last"), F.first("delay").alias("delay"))
    own = own.select(*keys, "open_ns", "peak_net", F.col("last.net").alias("last_net"), F.col("last.next.ns").alias("close_ns"), F.col("last.next.state").alias("why"), "delay")
    reason = F.when(F.col("why").isNull(), "end_of_capture").when(F.col("why") == "priced", "spread_closed").when(F.col("why") == "ineligible", "invalidated").otherwise("insufficient_depth")
    out = own.where("close_ns is null or close_ns > open_ns + delay")
    return out.select(*keys, (F.col("open_ns") + F.col("delay")).alias("open_ns"), "close_ns", "peak_net", "last_net", reason.alias("close_reason"))


def overlap(intervals_: DataFrame, episodes: DataFrame, width: int, end_ns: int) -> DataFrame:
    """Each interval with whether an episode of its route covers its start, and how much of it episodes
    cover (1e-6). How long episodes have covered a route by some time follows from the starts and ends until then, so
    no interval meets episodes one by one: running sums go by blocks of `width`, and the rows of one time are one."""
    route = ["pair", "buy", "sell"]
    a = intervals_.withColumn("stop", F.coalesce("close_ns", F.lit(end_ns))).where("stop > open_ns")
    b = episodes.select(*route, F.col("start_ns").alias("b0"), F.coalesce("end_ns", F.lit(end_ns)).alias("b1")).where("b1 > b0")
    # Intervals of one span ask the same, whatever their variant and notional.
    asked = a.select(*route, F.explode(F.array("open_ns", "stop")).alias("ns"), F.lit(0).alias("d"))
    edges = b.select(*route, F.explode(F.array(F.struct(F.col("b0").alias("ns"), F.lit(1).alias("d")), F.struct(F.col("b1").alias("ns"), F.lit(-1).alias("d")))).alias("e")).select(*route, "e.ns", "e.d")
    times = asked.unionByName(edges).groupBy(*route, "ns").agg(F.sum("d").alias("d")).withColumn("block", block_of(F.col("ns"), width))
    # Sums of times are beyond 64 bits until starts and ends cancel out.
    at = running(settled(times, "times"), route, ["ns"], {"live": ("sum", F.col("d"), True), "sum": ("sum", (F.col("d") * F.col("ns")).cast("decimal(28,0)"), True)})
    at = settled(at.select(*route, "ns", F.col("live"), (F.col("live").cast("decimal(10,0)") * F.col("ns").cast("decimal(20,0)") - F.col("sum")).cast("long").alias("by")), "covered")
    opened = at.select(*route, F.col("ns").alias("open_ns"), (F.col("live") > 0).alias("start_covered"), F.col("by").alias("by_open"))
    stopped = at.select(*route, F.col("ns").alias("stop"), F.col("by").alias("by_stop"))
    out = a.join(opened, [*route, "open_ns"]).join(stopped, [*route, "stop"])
    out = out.groupBy("variant", *route, "notional", "open_ns", "stop").agg(F.first("start_covered").alias("start_covered"), F.sum(F.col("by_stop") - F.col("by_open")).alias("covered"))
    return out.select("variant", *route, "notional", "open_ns", "start_covered", F.floor(F.col("covered") * 1e6 / (F.col("stop") - F.col("open_ns"))).cast("long").alias("coverage"))
