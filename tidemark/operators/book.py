"""Order books: acceptance of sequenced updates, live levels, tops, depth and eligibility.

Acceptance needs no fold. A chain starts at each snapshot, reset, disconnection or connection; within it the
running maximum of the sequence numbers before an update tells whether the update is late, next or past a
gap, and the first gap ends the chain's trust. All of these run by blocks of time, so a book's whole history
is in no task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import block_of, following, running
from tidemark.session import settled

BOOK = ["pair", "venue"]
ORDER = ["ns", "event_id"]
#: Nanoseconds in one block: a day.
BLOCK = 86_400 * 10**9


def with_expiries(trusted: DataFrame, max_age: int, block: int = BLOCK) -> DataFrame:
    """Quotes and their `lapses`, which are written once, as they are few and all quotes are put in order to find them.
    The quotes are read several times, so settle them first."""
    return trusted.unionByName(settled(lapses(trusted, max_age, block), "lapses"))


def lapses(trusted: DataFrame, max_age: int, block: int = BLOCK) -> DataFrame:
    """Wherever a book hears nothing for longer than `max_age`, a row of kind expiry just after: at its last receipt +
    max_age + 1. None comes after the input's last row; expiry rows change no book."""
    blocked = trusted.select(*trusted.columns, block_of(F.col("ns"), block).alias("block"))
    at = F.col("ns") + max_age + 1
    end = F.broadcast(trusted.agg(F.max("ns").alias("_end")))
    lapsed = following(blocked, BOOK, ORDER, F.col("ns"), "_next", grows=True).crossJoin(end).where((F.col("_next").isNull() | (F.col("_next") > at)) & (at <= F.col("_end")))
    expiry = [at.alias(c) if c == "ns" else F.lit("expiry").alias(c) if c == "kind" else F.col(c) for c in trusted.columns]
    return lapsed.select(*expiry)


#: Kinds that are events of a venue's link and not of a book.
LINKS = ["down", "up"]


def _link() -> Column:
    return F.when(F.col("kind").isin(LINKS), F.col("kind"))


def sequenced(quotes: DataFrame, block: int = BLOCK, links: bool = False) -> DataFrame:
    """Quotes with a local sequence number: their number among the book's updates, moved by `off`. With `links` also
    `link`, the last kind of a link's row so far, which `apply_reasons` then needs no pass of its own for, and `block`."""
    blocked = quotes.withColumn("block", block_of(F.col("ns"), block))
    own = ~F.col("kind").isin(LINKS)
    numbered = running(blocked, BOOK, ORDER, {"n": ("sum", F.when(own, F.lit(1)), True)} | ({"link": ("last", _link(), True)} if links else {}))
    return numbered.select(*[c for c in quotes.columns if c != "off"], F.when(own, F.col("n").cast("long") + F.col("off")).alias("seq"), *(["link", "block"] if links else []))


def _chains(rows: DataFrame) -> DataFrame:
    """rows with chain, at_mark (what the chain began with) and top (the greatest sequence number before, with its chain).

    One pass: inside a block chains are numbered from its start, and a block's number of chains, its last mark and
    its greatest (chain, seq) are carried over blocks together. A chain's number comes first, so the greatest of
    all rows before is of this chain or of none. What a block knows of itself is written once, in the tasks that have
    the rows in order already; what blocks open with is then joined to it without any order.
    """
    inside = Window.partitionBy(*BOOK, "block").orderBy(*ORDER)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("local", F.coalesce(F.count("mark").over(so_far), F.lit(0))).withColumn("last_mark", F.last("mark", ignorenulls=True).over(so_far))
    own = own.withColumn("place", F.when(~F.col("cut") & F.col("seq").isNotNull(), F.struct("local", "seq")))
    own = settled(own.withColumn("top", F.max("place").over(inside.rowsBetween(Window.unboundedPreceding, -1))), "chains")
    ends = own.groupBy(*BOOK, "block").agg(F.max("local").alias("n"), F.max_by("mark", F.when(F.col("mark").isNotNull(), F.struct(*ORDER))).alias("m"), F.max("place").alias("p"))
    over = Window.partitionBy(*BOOK).orderBy("block")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("n_before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("m_before", F.last("m", ignorenulls=True).over(before))
    ends = ends.withColumn("p", F.when(F.col("p").isNotNull(), F.struct((F.col("n_before") + F.col("p.local")).alias("chain"), F.col("p.seq").alias("seq"))))
    opening = ends.select(*BOOK, "block", "n_before", "m_before", F.max("p").over(before).alias("p_before"))
    joined = own.join(opening, [*BOOK, "block"]).withColumn("chain", F.col("n_before") + F.col("local"))
    here = F.when(F.col("top").isNotNull(), F.struct((F.col("n_before") + F.col("top.local")).alias("chain"), F.col("top.seq").alias("seq")))
    return joined.select(*rows.columns, "chain", F.coalesce("last_mark", "m_before").alias("at_mark"), F.greatest(here, F.col("p_before")).alias("top"))


def apply_reasons(events: DataFrame, block: int = BLOCK, links: bool = False) -> DataFrame:
    """events: (pair, venue, ns, event_id, kind, seq, bid, ask) with chain, reason and accepted.

    Kinds: snapshot, delta, reset, invalidate (the book is given up until the next snapshot), and with `links` down
    and up for a venue's link, which are no updates and have the reasons link_down and link_up. Reasons: ok,
    disconnected, adapter_reset, invalidated, snapshot_incomplete, snapshot_crossed, book_stale, out_of_order,
    sequence_gap, crossed_book, and book_incomplete for an update that leaves a side empty, which is applied and
    may be healed by the next. A crossed update or a gap ends the chain; what follows is stale until the next
    snapshot. While the link is down nothing is applied, not even a snapshot.
    """
    carried = links and "link" in events.columns
    names = [c for c in events.columns if not (carried and c in ("link", "block"))]
    # `sequenced` has dealt its rows out by its blocks, which are taken as they are.
    rows = (events if carried and "block" in events.columns else events.withColumn("block", block_of(F.col("ns"), block))).withColumn("cut", F.lit(False))
    if links:
        rows = rows if carried else running(rows, BOOK, ORDER, {"link": ("last", _link(), True)})
        rows = rows.withColumn("cut", F.coalesce((F.col("link") == "down") & (F.col("kind") != "down"), F.lit(False))).drop("link")
    crossed = F.coalesce(F.col("bid") >= F.col("ask"), F.lit(False))
    empty = F.col("bid").isNull() | F.col("ask").isNull()
    rows = _chains(rows.withColumn("mark", F.when((F.col("kind") != "delta") & ~F.col("cut"), F.struct("kind", (crossed | empty).alias("bad")))))
    rows = rows.select(*names, "block", "cut", "chain", "at_mark", F.when(F.col("top.chain") == F.col("chain"), F.col("top.seq")).alias("top_seq"))
    gap = (F.col("kind") == "delta") & (F.col("seq") > F.col("top_seq") + 1)
    fresh = (F.col("kind") == "delta") & (F.col("seq") == F.col("top_seq") + 1)
    rows = running(rows, BOOK, ORDER, {"ended": ("max", F.when(~F.col("cut") & (gap | (fresh & crossed)), F.col("chain")), False)})
    dead = F.coalesce(F.col("ended") == F.col("chain"), F.lit(False))
    lost = F.col("at_mark").isNull() | (F.col("at_mark.kind") != "snapshot") | F.col("at_mark.bad") | dead
    reason = (
        F.when(F.col("kind").isin(LINKS), F.concat(F.lit("link_"), F.col("kind")))
        .when(F.col("cut"), "disconnected")
        .when(F.col("kind") == "reset", "adapter_reset")
        .when(F.col("kind") == "invalidate", "invalidated")
        .when((F.col("kind") == "snapshot") & empty, "snapshot_incomplete")
        .when((F.col("kind") == "snapshot") & crossed, "snapshot_crossed")
        .when(F.col("kind") == "snapshot", "ok")
        .when(lost, "book_stale")
        .when(F.col("seq") <= F.col("top_seq"), "out_of_order")
        .when(gap, "sequence_gap")
        .when(crossed, "crossed_book")
        .when(empty, "book_incomplete")
        .otherwise("ok")
    )
    return rows.select(*names, "chain", reason.alias("reason")).withColumn("accepted", F.col("reason").isin("ok", "adapter_reset"))


def tops_over_time(applied: DataFrame) -> DataFrame:
    """What each row of `apply_reasons` leaves of its book: trusted (a usable top), initialized (perhaps with a side
    empty) and connected. Late updates and those that come while the link is down leave it as it was and are left
    out."""
    rows = applied.where(~F.col("reason").isin("out_of_order", "disconnected"))
    reason = F.col("reason")
    return rows.select(
        *[c for c in applied.columns if c not in ("seq", "chain", "reason", "accepted")],
        (reason == "ok").alias("trusted"),
        reason.isin("ok", "book_incomplete").alias("initialized"),
        (reason != "link_down").alias("connected"),
    )


def verify(events: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Snapshots held against the accepted book of exactly their sequence: verified, mismatch or skipped.

    events: (pair, venue, seq, bid, ask, accepted); snapshots: (pair, venue, seq, bid, ask).
    """
    own = events.where("accepted and kind <> 'reset'").select(*BOOK, "seq", F.col("bid").alias("own_bid"), F.col("ask").alias("own_ask"))
    own = own.groupBy(*BOOK, "seq").agg(F.max(F.struct("own_bid", "own_ask")).alias("own"))
    joined = snapshots.join(own, [*BOOK, "seq"], "left")
    outcome = F.when(F.col("own").isNull(), "verification_skipped").when((F.col("own.own_bid") == F.col("bid")) & (F.col("own.own_ask") == F.col("ask")), "verified").otherwise("mismatch")
    return joined.select(*BOOK, "seq", outcome.alias("outcome"))


def live_levels(updates: DataFrame) -> DataFrame:
    """(pair, venue, side, price, size) of the levels left after all updates: the last one of each price
    counts, and size 0 or less deletes. One aggregation, with partial sums before the shuffle."""
    last = updates.groupBy(*BOOK, "side", "price").agg(F.max_by("size", F.struct("ns", "seq")).alias("size"))
    return last.where("size > 0")


def ranked(levels: DataFrame) -> DataFrame:
    """Levels with their rank from the best price of their side."""
    best_first = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    return levels.withColumn("rank", F.row_number().over(Window.partitionBy(*BOOK, "side").orderBy(best_first)))


def top_n(levels: DataFrame, n: int) -> DataFrame:
    """The best n levels of each side; none if n isn't positive."""
    return ranked(levels).where(F.col("rank") <= n)


def tops(levels: DataFrame) -> DataFrame:
    """(pair, venue, bid, bid_size, ask, ask_size): the best prices, null where a side is empty."""
    bid, ask = F.col("side") == "bid", F.col("side") == "ask"
    return levels.groupBy(*BOOK).agg(
        F.max(F.when(bid, F.col("price"))).alias("bid"),
        F.max_by(F.when(bid, F.col("size")), F.when(bid, F.col("price"))).alias("bid_size"),
        F.min(F.when(ask, F.col("price"))).alias("ask"),
        F.min_by(F.when(ask, F.col("size")), F.when(ask, F.col("price"))).alias("ask_size"),
    )


def eligibility(seen: Column, connected: Column, initialized: Column, continuous: Column, age: Column, bid: Column, ask: Column, max_age: int) -> Column:
    """The first reason, in fixed order, that keeps a book from use; null for an eligible one. A book that is given
    up is neither initialized nor continuous; discontinuous is for a source that knows of a break in what it holds."""
    return (
        F.when(seen.isNull(), "missing")
        .when(~connected, "disconnected")
        .when(~initialized, "uninitialized")
        .when(~continuous, "discontinuous")
        .when(age.isNull() | (age > max_age), "too_old")
        .when(bid.isNull() | ask.isNull(), "incomplete")
        .when(bid >= ask, "crossed")
    )


def roster(*books: DataFrame) -> DataFrame:
    """All books that are tracked or were seen, once."""
    out = books[0].select(*BOOK)
    for one in books[1:]:
        out = out.unionByName(one.select(*BOOK))
    return out.distinct()
