"""The latest state of each series at each event of a group, dealt out by group and block of time.

A plain window over the group would put a group's whole history into one task. Here every block of time
is a task of its own: the last state of each series in each block is aggregated first, a window over the
few blocks of a group carries these states forward, and the window over events only runs inside a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_of(time: Column, size: int) -> Column:
    return F.floor(time / size).cast("long")


def latest_by_series(events: DataFrame, group: list[str], series: str, names: tuple[str, ...], state: Column, order: list[str], time: str, block: int) -> DataFrame:
    """The events with a column `at_<name>` for each series: its state at the last event of its own that
    isn't after this one in `order`, else null. A state must never be null itself."""
    rows = events.withColumn("block", block_of(F.col(time), block)).withColumn("_state", state)
    own = lambda name: F.when(F.col(series) == name, F.col("_state"))
    place = F.struct(*order)
    ends = rows.groupBy(*group, "block").agg(*[F.max_by(own(n), F.when(F.col(series) == n, place)).alias(f"end_{n}") for n in names])
    before = Window.partitionBy(*group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    opening = ends.select(*group, "block", *[F.last(f"end_{n}", ignorenulls=True).over(before).alias(f"open_{n}") for n in names])
    inside = Window.partitionBy(*group, "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # The window comes before the join, so that what is sorted is narrow and sorted once.
    seen = rows.select(*events.columns, "block", *[F.last(own(n), ignorenulls=True).over(inside).alias(f"in_{n}") for n in names])
    joined = seen.join(opening, [*group, "block"])
    return joined.select(*events.columns, "block", *[F.coalesce(f"in_{n}", f"open_{n}").alias(f"at_{n}") for n in names])


def running(rows: DataFrame, group: list[str], order: list[str], values: dict[str, tuple[str, Column, bool]]) -> DataFrame:
    """rows with running aggregates over a group in order, block by block. rows have a column `block` that
    grows with the order. values: name to (sum, max or last, value, whether the row itself counts); last is the
    last value that isn't null. rows are read twice, so settle them first if they are dear."""
    held = rows.select("*", *[v.alias(f"_v_{name}") for name, (_, v, _) in values.items()])

    def whole(kind: str, name: str) -> Column:
        v = F.col(f"_v_{name}")
        return F.sum(v) if kind == "sum" else F.max(v) if kind == "max" else F.max_by(v, F.when(v.isNotNull(), F.struct(*order)))

    over = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    ends = held.groupBy(*group, "block").agg(*[whole(kind, name).alias(f"_o_{name}") for name, (kind, *_) in values.items()])
    before = Window.partitionBy(*group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    opening = ends.select(*group, "block", *[over[kind](f"_o_{name}").over(before).alias(f"_o_{name}") for name, (kind, *_) in values.items()])
    so_far = lambda own: Window.partitionBy(*group, "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    seen = held.select(*rows.columns, *[over[kind](f"_v_{name}").over(so_far(own)).alias(f"_h_{name}") for name, (kind, _, own) in values.items()])
    joined = seen.join(opening, [*group, "block"])
    out = []
    for name, (kind, *_) in values.items():
        here, earlier = F.col(f"_h_{name}"), F.col(f"_o_{name}")
        # greatest() passes over nulls; a sum of nothing is null as well.
        if kind == "sum":
            value = F.when(here.isNotNull() | earlier.isNotNull(), F.coalesce(here, F.lit(0)) + F.coalesce(earlier, F.lit(0)))
        else:
            value = F.greatest(here, earlier) if kind == "max" else F.coalesce(here, earlier)
        out.append(value.alias(name))
    return joined.select(*rows.columns, *out)


def following(rows: DataFrame, group: list[str], order: list[str], value: Column, name: str, grows: bool = False) -> DataFrame:
    """rows with `name`: the value at the next row of the group, null at its last one. rows have a column
    `block` that grows with the order, and the value is never null. A value that `grows` with the order is a block's
    least at its first row, which is hashed where a value by a place is sorted."""
    held = rows.withColumn("_v", value)
    firsts = held.groupBy(*group, "block").agg((F.min("_v") if grows else F.min_by("_v", F.struct(*order))).alias("_f"))
    after = Window.partitionBy(*group).orderBy("block")
    closing = firsts.select(*group, "block", F.lead("_f").over(after).alias("_n"))
    inside = Window.partitionBy(*group, "block").orderBy(*order)
    seen = held.select(*rows.columns, F.lead("_v").over(inside).alias("_h"))
    return seen.join(closing, [*group, "block"]).select(*rows.columns, F.coalesce("_h", "_n").alias(name))


def preceding(rows: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """rows with `name`: the value at the row before of the group, null at its first one; like `following`."""
    held = rows.withColumn("_v", value)
    lasts = held.groupBy(*group, "block").agg(F.max_by("_v", F.struct(*order)).alias("_l"))
    before = Window.partitionBy(*group).orderBy("block")
    opening = lasts.select(*group, "block", F.lag("_l").over(before).alias("_p"))
    inside = Window.partitionBy(*group, "block").orderBy(*order)
    seen = held.select(*rows.columns, F.lag("_v").over(inside).alias("_h"))
    return seen.join(opening, [*group, "block"]).select(*rows.columns, F.coalesce("_h", "_p").alias(name))


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, right_order: list[str], values: list[str], block: int, tolerance: int | None = None) -> DataFrame:
    """left with `values` of the last right row of equal keys at or before it in time, null without one or
    beyond the tolerance. Both sides are dealt out by keys and block of time."""
    extra = [c for c in left.columns if c not in keys]
    a = left.select(*keys, F.col(left_time).alias("t_"), F.lit(1).alias("side_"), F.struct(*extra).alias("left_"), F.lit(None).cast("string").alias("s_"), *[F.lit(0).cast("long").alias(f"o{i}_") for i in range(len(right_order))])
    b = right.select(*keys, F.col(right_time).alias("t_"), F.lit(0).alias("side_"), F.struct(F.col(right_time).alias("t"), *values).alias("right_"), F.lit("r").alias("s_"), *[F.col(c).cast("long").alias(f"o{i}_") for i, c in enumerate(right_order)])
    both = a.unionByName(b, allowMissingColumns=True)
    order = ["t_", "side_", *[f"o{i}_" for i in range(len(right_order))]]
    found = latest_by_series(both, keys, "s_", ("r",), F.col("right_"), order, "t_", block).where("side_ = 1")
    near = F.lit(True) if tolerance is None else F.col("t_") - F.col("at_r")["t"] <= tolerance
    return found.select(*keys, *[F.col("left_")[c].alias(c) for c in extra], *[F.when(near, F.col("at_r")[v]).alias(v) for v in values])
