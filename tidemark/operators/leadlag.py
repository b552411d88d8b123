"""Lead and lag between venues: tick series, returns, and the Hayashi-Yoshida contrast over a grid of lags.

Overlaps of return intervals are found by an equi-join on bins of time: an interval is listed in each bin
it reaches into, and a pair counts in the bin in which its overlap begins, so no pair counts twice and no
task holds a series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.asof import block_of, preceding

#: Nanoseconds in one block of a series: a week.
BLOCK = 7 * 86_400 * 10**9

#: Surrogates of each sign without which the p-value couldn't come down to NULL_ALPHA.
LEAST_SURROGATES = 10
NULL_ALPHA = 0.05


def ticks(quotes: DataFrame, width: int) -> DataFrame:
    """(pair, venue, bin, ns, mid2): twice the mid price at the last valid quote of each bin."""
    good = quotes.where("trusted and bid > 0 and ask > 0 and ns > 0")
    last = F.max(F.struct("ns", "event_id", (F.col("bid") + F.col("ask")).alias("mid2"))).alias("t")
    return good.groupBy("pair", "venue", F.floor(F.col("ns") / width).cast("long").alias("bin")).agg(last).select("pair", "venue", "bin", "t.ns", "t.mid2")


def returns(ticks_: DataFrame) -> DataFrame:
    """(pair, venue, start_ns, end_ns, value): log returns between consecutive ticks."""
    blocked = ticks_.withColumn("block", block_of(F.col("ns"), BLOCK))
    rows = preceding(blocked, ["pair", "venue"], ["ns"], F.struct("mid2", "ns"), "was")
    rows = rows.withColumn("p0", F.col("was.mid2")).withColumn("start_ns", F.col("was.ns"))
    rows = rows.where("p0 > 0 and mid2 > 0 and start_ns < ns")
    return rows.select("pair", "venue", "start_ns", F.col("ns").alias("end_ns"), F.ln(F.col("mid2") / F.col("p0")).alias("value"))


def contrast(left: DataFrame, right: DataFrame, lags: DataFrame, keys: list[str], width: int) -> DataFrame:
    """(keys, lag, overlaps, contrast, rho) for each lag by which the right series is moved back.

    left, right: (keys, start_ns, end_ns, value). rho is null without overlaps or variance.
    """
    bins = lambda: F.explode(F.sequence(F.floor(F.col("start_ns") / width), F.floor((F.col("end_ns") - 1) / width)))
    moved = right.crossJoin(F.broadcast(lags)).select(*keys, "lag", (F.col("start_ns") - F.col("lag")).alias("start_ns"), (F.col("end_ns") - F.col("lag")).alias("end_ns"), "value")
    a = left.select(*keys, F.col("start_ns").alias("a0"), F.col("end_ns").alias("a1"), F.col("value").alias("av"), bins().alias("bin"))
    b = moved.select(*keys, "lag", F.col("start_ns").alias("b0"), F.col("end_ns").alias("b1"), F.col("value").alias("bv"), bins().alias("bin"))
    begins = F.greatest("a0", "b0")
    pairs = a.join(b, [*keys, "bin"]).where((F.least("a1", "b1") > begins) & (F.floor(begins / width) == F.col("bin")))
    sums = pairs.groupBy(*keys, "lag").agg(F.count("*").alias("overlaps"), F.sum(F.col("av") * F.col("bv")).alias("c"))
    squares = lambda rows, name: rows.groupBy(*keys).agg(F.sum(F.col("value") * F.col("value")).alias(name))
    every = left.select(*keys).distinct().crossJoin(F.broadcast(lags))
    rows = every.join(sums, [*keys, "lag"], "left").join(squares(left, "va"), keys).join(squares(right, "vb"), keys)
    rho = F.when((F.col("overlaps") > 0) & (F.col("va") > 0) & (F.col("vb") > 0), F.col("c") / F.sqrt(F.col("va") * F.col("vb")))
    return rows.select(*keys, "lag", F.coalesce("overlaps", F.lit(0)).alias("overlaps"), F.coalesce("c", F.lit(0.0)).alias("contrast"), rho.alias("rho"))


def best_lag(points: DataFrame, keys: list[str], least_overlaps: int, step: int, max_lag: int) -> DataFrame:
    """(keys, status, lag, rho): the lag of the greatest |rho|; ties go to the smallest |lag|, then the
    smaller one. A maximum at the grid's edge, tied at other lags or on too few overlaps identifies none."""
    good = points.where((F.col("overlaps") >= least_overlaps) & F.col("rho").isNotNull()).withColumn("height", F.round(F.abs("rho"), 10))
    top = good.groupBy(*keys).agg(F.max("height").alias("height"))
    tied = good.join(top, [*keys, "height"]).groupBy(*keys).agg(F.count("*").alias("ties"), F.min(F.struct(F.abs("lag").alias("away"), "lag", "rho")).alias("best"))
    rows = points.select(*keys).distinct().join(tied, keys, "left")
    status = (
        F.when(F.col("best").isNull(), "insufficient_data")
        .when(F.col("ties") > 1, "tied_maximum")
        .when(F.col("best.away") >= max_lag - max_lag % step, "maximum_at_grid_edge")
        .otherwise("ok")
    )
    return rows.select(*keys, status.alias("status"), F.col("best.lag").alias("lag"), F.round("best.rho", 6).alias("rho"))


def part_of(time: Column, start: Column, end: Column, parts: int) -> Column:
    """Index of the equal part of [start, end] a time falls into; the last one includes its end."""
    return F.least(F.lit(parts - 1), F.floor((time - start) * parts / (end - start + 1)).cast("int"))


def shifted(returns_: DataFrame, shifts: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """Series moved around the circle of their bounds by each shift; intervals that straddle its end go."""
    rows = returns_.join(bounds, keys).crossJoin(F.broadcast(shifts))
    span = F.col("hi") - F.col("lo")
    at = lambda c: F.pmod(F.col(c) - F.col("lo") + F.col("shift"), span) + F.col("lo")
    out = rows.select(*keys, "shift", at("start_ns").alias("start_ns"), (at("start_ns") + F.col("end_ns") - F.col("start_ns")).alias("end_ns"), "value", "hi")
    return out.where("end_ns <= hi").drop("hi")


def surrogate_shifts(base: int, surrogates: int) -> list[int]:
    """Shifts of both signs, base * (1 + 5k) for k from 1, all far outside a grid of lags up to `base`."""
    if surrogates < LEAST_SURROGATES:
        raise ValueError(f"at least {LEAST_SURROGATES} surrogates of each sign, or no p-value comes down to {NULL_ALPHA}")
    return [sign * base * (1 + 5 * k) for k in range(1, surrogates + 1) for sign in (1, -1)]


def surrogate_null(left: DataFrame, right: DataFrame, lags: DataFrame, shifts: DataFrame, keys: list[str], least_overlaps: int, step: int, max_lag: int, width: int) -> DataFrame:
    """(keys, status, lag, rho, surrogates, p95, exceedance, p_value): best_lag with the last step of its ladder.

    Where a lag was identified, the right series is moved around the span of both series by each shift, and the
    greatest |rho| over the grid is taken again, by the same least number of overlaps. `surrogates` counts the
    shifts that gave a value; p95 is the ceil(0.95 n)-th of these, exceedance their share that reaches the
    |rho| found, and p_value (times + 1) / (n + 1). Above NULL_ALPHA the status is null_not_rejected.
    """
    points = contrast(left, right, lags, keys, width)
    best = best_lag(points, keys, least_overlaps, step, max_lag)
    height = F.round(F.max(F.abs("rho")), 10)
    enough = (F.col("overlaps") >= least_overlaps) & F.col("rho").isNotNull()
    found = points.where(enough).groupBy(*keys).agg(height.alias("found"))
    asked = best.where("status = 'ok'").select(*keys)
    ends = lambda rows: rows.select(*keys, "start_ns", "end_ns")
    bounds = ends(left).unionByName(ends(right)).groupBy(*keys).agg(F.min("start_ns").alias("lo"), F.max("end_ns").alias("hi"))
    moved = shifted(right.join(asked, keys, "left_semi"), shifts, bounds, keys)
    again = left.join(asked, keys, "left_semi").crossJoin(F.broadcast(shifts))
    tops = contrast(again, moved, lags, [*keys, "shift"], width).where(enough).groupBy(*keys, "shift").agg(height.alias("top"))
    times, n = F.count_if(F.col("top") >= F.col("found")), F.count("*")
    null = tops.join(found, keys).groupBy(*keys).agg(n.alias("surrogates"), times.alias("times"), F.sort_array(F.collect_list("top")).alias("tops"))
    null = null.select(
        *keys,
        "surrogates",
        F.element_at("tops", F.ceil(F.lit(0.95) * F.col("surrogates")).cast("int")).alias("p95"),
        (F.col("times") / F.col("surrogates")).alias("exceedance"),
        ((F.col("times") + 1) / (F.col("surrogates") + 1)).alias("p_value"),
    )
    status = F.when((F.col("status") == "ok") & (F.col("p_value") > NULL_ALPHA), "null_not_rejected").otherwise(F.col("status"))
    return best.join(null, keys, "left").select(*keys, status.alias("status"), "lag", "rho", F.coalesce("surrogates", F.lit(0)).alias("surrogates"), "p95", "exceedance", "p_value")
