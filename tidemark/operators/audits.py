"""Audits of streams and books: id chains, level differences, runs of states, matches and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import block_of, preceding, running
from tidemark.session import settled

BOOK = ["pair", "venue"]
#: Units of the first column of an order in one block; a day of nanoseconds.
BLOCK = 86_400 * 10**9


def _blocked(rows: DataFrame, order: list[str]) -> DataFrame:
    return rows.withColumn("block", block_of(F.col(order[0]), BLOCK))


def chain_classes(updates: DataFrame, keys: list[str], order: list[str], first: str, last: str) -> DataFrame:
    """Updates with their place in the chain of ids: first, already_covered, contiguous, overlapping, gap.
    What came before reaches to the greatest last id so far."""
    rows = running(_blocked(updates, order), keys, order, {"reach": ("max", F.col(last), False)}).drop("block")
    f, u, p = F.col(first), F.col(last), F.col("reach")
    kind = F.when(p.isNull(), "first").when(u <= p, "already_covered").when(f == p + 1, "contiguous").when(f > p + 1, "gap").otherwise("overlapping")
    return rows.withColumn("chain_class", kind)


def envelope_classes(messages: DataFrame, keys: list[str], order: list[str], seq: str) -> DataFrame:
    """Messages as first, duplicate, next or gap by the greatest sequence number before them."""
    rows = running(_blocked(messages, order), keys, order, {"reach": ("max", F.col(seq), False)}).drop("block")
    kind = F.when(F.col("reach").isNull(), "first").when(F.col(seq) <= F.col("reach"), "duplicate").when(F.col(seq) == F.col("reach") + 1, "next").otherwise("gap")
    return rows.withColumn("envelope_class", kind).drop("reach")


def level_differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Levels (keys, price, size) of both sides held against each other in the price range they share:
    outcome is same, size_differs, left_only or right_only."""
    span = lambda rows, side: rows.groupBy(*keys).agg(F.min("price").alias(f"{side}_lo"), F.max("price").alias(f"{side}_hi"))
    shared = span(left, "a").join(span(right, "b"), keys).select(*keys, F.greatest("a_lo", "b_lo").alias("lo"), F.least("a_hi", "b_hi").alias("hi"))
    a, b = left.select(*keys, "price", F.col("size").alias("left_size")), right.select(*keys, "price", F.col("size").alias("right_size"))
    both = a.join(b, [*keys, "price"], "full_outer").join(shared, keys).where("price between lo and hi")
    outcome = F.when(F.col("right_size").isNull(), "left_only").when(F.col("left_size").isNull(), "right_only").when(F.col("left_size") != F.col("right_size"), "size_differs").otherwise("same")
    return both.select(*keys, "price", "left_size", "right_size", outcome.alias("outcome"))


def nearest(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, price) with the distance to the nearest price of others, found by one ordered pass over
    both; null if others has none."""
    both = rows.select(*keys, "price", F.lit(1).alias("own")).unionByName(others.select(*keys, "price", F.lit(0).alias("own")))
    w = Window.partitionBy(*keys).orderBy("price", "own")
    other = F.when(F.col("own") == 0, F.col("price"))
    below = F.last(other, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    above = F.first(other, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return both.withColumn("distance", F.least(F.col("price") - below, above - F.col("price"))).where("own = 1").drop("own")


def _numbered(rows: DataFrame, keys: list[str], order: list[str], state: Column) -> DataFrame:
    """rows with `state`, `run` (its number among the key's runs of equal state) and `block`."""
    marked = _blocked(rows, order).withColumn("state", state)
    # As a struct the state before tells a null state from none.
    changed = settled(preceding(marked, keys, order, F.struct("state"), "_was"), "states")
    new = F.when(F.struct("state").eqNullSafe(F.col("_was")), 0).otherwise(1)
    return running(changed, keys, order, {"run": ("sum", new, True)}).drop("_was")


def runs(rows: DataFrame, keys: list[str], order: list[str], state: Column) -> DataFrame:
    """(keys, state, start_ns, end_ns, rows): runs of equal state; end_ns is the start of the next run. Only the
    runs of a key, not its rows, are put in order together."""
    out = _numbered(rows, keys, order, state).groupBy(*keys, "run").agg(F.first("state").alias("state"), F.min("ns").alias("start_ns"), F.count("*").alias("rows"))
    return out.select(*keys, "state", "start_ns", F.lead("start_ns").over(Window.partitionBy(*keys).orderBy("run")).alias("end_ns"), "rows")


def streak_triggers(rows: DataFrame, keys: list[str], order: list[str], mismatch: Column, signature: Column, length: int) -> DataFrame:
    """Rows at which a streak of mismatches of one signature reaches `length`; a match or another signature
    begins anew."""
    numbered = _numbered(rows, keys, order, F.when(mismatch, signature)).withColumnRenamed("state", "sign")
    placed = running(numbered, [*keys, "run"], order, {"streak": ("sum", F.lit(1), True)})
    return placed.where(F.col("sign").isNotNull() & (F.col("streak") == length)).drop("run", "streak", "block")


def recoveries(rows: DataFrame, keys: list[str], order: list[str], good: str) -> DataFrame:
    """(keys, lost_ns, recovered_ns, duration): from the first row that isn't good to the next good one."""
    spans = runs(rows, keys, order, F.col(good))
    return spans.where("not state and end_ns is not null").select(*keys, F.col("start_ns").alias("lost_ns"), F.col("end_ns").alias("recovered_ns"), (F.col("end_ns") - F.col("start_ns")).alias("duration"))


def rate_exceeded(rows: DataFrame, keys: list[str], time: str, span: int, most: int) -> DataFrame:
    """Rows with the number of rows in the `span` that ends with them, where it is over `most`."""
    w = Window.partitionBy(*keys).orderBy(time).rangeBetween(-(span - 1), 0)
    return rows.withColumn("recent", F.count("*").over(w)).where(F.col("recent") > most)


def within(rows: DataFrame, others: DataFrame, keys: list[str], time: str, other_time: str, span: int, how: str) -> DataFrame:
    """rows that have (left_semi) or lack (left_anti) one of others of equal keys at most `span` away in
    time. Both sides are dealt out by bins of the span, so this is an equi-join."""
    near = others.select(*keys, F.col(other_time).alias("o_ns"), F.explode(F.array(*[F.floor(F.col(other_time) / span) + d for d in (-1, 0, 1)])).alias("bin"))
    own = rows.withColumn("bin", F.floor(F.col(time) / span))
    on = [own[k] == near[k] for k in [*keys, "bin"]]
    return own.join(near, [*on, F.abs(own[time] - near["o_ns"]) <= span], how).drop("bin")


def first_unused(requests: DataFrame, responses: DataFrame, keys: list[str], block: int = 86_400 * 10**9) -> DataFrame:
    """(keys, rank, request_ns, response_ns): each request (keys, ns, event_id), in order, with the first response of
    equal keys at or after it that no earlier request has taken, null without one.

    No fold is needed: requests wait in line, so a response is taken by the longest waiting one, and goes unused if
    none waits. Of all responses so far as many are unused as the greatest lead that they ever had over requests.
    """
    both = requests.select(*keys, "ns", F.lit(0).alias("side"), "event_id").unionByName(responses.select(*keys, "ns", F.lit(1).alias("side"), "event_id"))
    order = ["ns", "side", "event_id"]
    rows = running(settled(both.withColumn("block", block_of(F.col("ns"), block)), "line"), keys, order, {"asked": ("sum", 1 - F.col("side"), True), "given": ("sum", F.col("side"), True)})
    lead = F.col("given") - F.col("asked")
    rows = running(settled(rows, "leads"), keys, order, {"most": ("max", lead, True), "before": ("max", lead, False)})
    rows = rows.withColumn("unused", F.greatest("most", F.lit(0))).withColumn("taken", (F.col("side") == 1) & (F.col("unused") == F.greatest("before", F.lit(0))))
    a = rows.where("side = 0").select(*keys, F.col("asked").alias("rank"), F.col("ns").alias("request_ns"))
    b = rows.where("taken").select(*keys, (F.col("given") - F.col("unused")).alias("rank"), F.col("ns").alias("response_ns"))
    return a.join(b, [*keys, "rank"], "left")


def digest(rows: DataFrame, group: str, block: Column, line: Column, order: list[str]) -> DataFrame:
    """(group, digest): SHA-256 over the digests of the blocks of time in order, each over its rows' lines in
    order; a block is what one task gathers."""
    own = rows.select(group, block.alias("block"), F.struct(*order, line.alias("line")).alias("x"))
    blocks = own.groupBy(group, "block").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    blocks = blocks.select(group, "block", F.sha2(F.array_join(F.transform("xs", lambda x: x["line"]), "\n").cast("binary"), 256).alias("h"))
    return blocks.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("block", "h"))).alias("hs")).select(group, F.sha2(F.array_join(F.transform("hs", lambda x: x["h"]), "\n").cast("binary"), 256).alias("digest"))
