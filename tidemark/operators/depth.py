"""Depth as of any instant: walks down the levels that are live then, for routes, fill-rate samples and ledgers.

A level holds from its mention to the next mention of its price, so each pair's updates are dealt out by blocks of
about as many rows, and a block opens with the levels whose time began before it and hasn't ended. Inside a block
the sizes of all levels at a few hundred instants are one array, best price first, and its running sums along the
levels are the walks of all these instants at once, a window of levels at a time and further ones only while some
walk isn't filled. No join makes a row for each instant and level, and a task holds one block.

Updates are (pair, venue, side, price, size, ns, seq): those of one venue and time are one message, in which later
ones win. At equal times messages are in the order of their venues, so an instant is (ns, rank): it sees the
messages of earlier times and, at its own, of venues up to its rank.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import block_of, following
from tidemark.operators.pricing import MICRO
from tidemark.session import settled

LEVEL = ["pair", "venue", "side", "price"]
#: Nanoseconds that are never parted into two blocks: a day. Rows of a block.
DAY = 86_400 * 10**9
ROWS = 50_000
#: Instants that are worked on at once, and levels of the first window of a walk.
CHUNK, WINDOW = 256, 64


def intervals(updates: DataFrame, block: int = 30 * DAY) -> DataFrame:
    """(pair, venue, side, price, size, ns, to_ns): each state of a level from its message to the next that mentions
    it, null if none does; a deleted level's size is 0."""
    said = updates.groupBy(*LEVEL, "ns").agg(F.max_by("size", "seq").alias("size"))
    rows = settled(said.withColumn("size", F.greatest("size", F.lit(0))), "levels").withColumn("block", block_of(F.col("ns"), block))
    return following(rows, LEVEL, ["ns"], F.col("ns"), "to_ns", grows=True).drop("block")


def parts(places: DataFrame, rows: int = ROWS) -> DataFrame:
    """(pair, day, part): days of (pair, ns) rows, in order, to parts of about `rows` rows."""
    days = places.groupBy("pair", block_of(F.col("ns"), DAY).alias("day")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("pair").orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    return days.select("pair", "day", F.floor(F.coalesce(before, F.lit(0)) / rows).cast("long").alias("part"))


def dealt(updates: DataFrame, instants: DataFrame, rank: Column, rows: int = ROWS) -> DataFrame:
    """All that a part's task needs, by (pair, part): levels that are live when it begins (kind open), when each venue
    was last heard before (heard), its updates (update) and its instants (at). In place of updates their
    `intervals` may be given, settled, as they are the same for all instants."""
    states = updates if "to_ns" in updates.columns else settled(intervals(updates), "states")
    places = states.select("pair", "ns").unionByName(instants.select("pair", "ns"))
    index = settled(parts(places, rows), "parts")
    day = lambda df, ns: df.withColumn("day", block_of(F.col(ns), DAY))
    own = day(states, "ns").join(index, ["pair", "day"]).drop("day")
    ends = day(own.where("size > 0 and to_ns is not null"), "to_ns").join(index.withColumnRenamed("part", "last"), ["pair", "day"]).drop("day")
    # A level without an end lasts to the pair's last part.
    last = index.groupBy("pair").agg(F.max("part").alias("last"))
    ends = ends.unionByName(own.where("size > 0 and to_ns is null").join(last, "pair"))
    opened = ends.where("last > part").select("pair", F.explode(F.sequence(F.col("part") + 1, F.col("last"))).alias("part"), "venue", "side", "price", "size", "ns")
    heard = own.groupBy("pair", "venue", "part").agg(F.max("ns").alias("ns"))
    after = Window.partitionBy("pair", "venue").orderBy("part")
    heard = heard.join(last, "pair").withColumn("next", F.coalesce(F.lead("part").over(after), F.col("last")))
    heard = heard.where("next > part").select("pair", F.explode(F.sequence(F.col("part") + 1, F.col("next"))).alias("part"), "venue", F.lit(None).cast("string").alias("side"), F.lit(None).cast("long").alias("price"), F.lit(None).cast("long").alias("size"), "ns")
    at = day(instants, "ns").join(index, ["pair", "day"])
    wide = lambda df, kind: df.select("pair", "part", F.lit(kind).alias("kind"), "venue", "side", F.col("price").cast("long").alias("price"), F.col("size").cast("long").alias("size"), "ns", rank.alias("rank"))
    blank = at.select("pair", "part", F.lit("at").alias("kind"), "venue", F.lit(None).cast("string").alias("side"), F.lit(None).cast("long").alias("price"), F.lit(None).cast("long").alias("size"), "ns", "rank")
    return wide(opened, "open").unionByName(wide(heard, "heard")).unionByName(wide(own, "update")).unionByName(blank)


class Side:
    """The sizes of one side's levels at every instant of a chunk, best price first."""

    def __init__(self, rows: pd.DataFrame, bid: bool):
        prices = np.unique(rows["price"].to_numpy(np.int64))
        self.price = prices[::-1] if bid else prices
        self.now = np.zeros(len(prices), np.int64)
        level = np.searchsorted(prices, rows["price"].to_numpy(np.int64))
        level = len(prices) - 1 - level if bid else level
        size, seen = rows["size"].to_numpy(np.int64), rows["seen"].to_numpy(np.int64)
        opened = (rows["kind"] == "open").to_numpy()
        self.now[level[opened]] = size[opened]
        # The last update of a level before an instant is the one that it sees.
        order = np.lexsort((rows["rank"].to_numpy(), rows["ns"].to_numpy(), level, seen))
        order = order[~opened[order]]
        last = np.append((seen[order][1:] != seen[order][:-1]) | (level[order][1:] != level[order][:-1]), True) if len(order) else np.zeros(0, bool)
        order = order[last]
        self.seen, self.level, self.size = seen[order], level[order], size[order]

    def sizes(self, a: int, b: int) -> np.ndarray:
        """Sizes at instants a .. b - 1 (rows) by level; chunks are taken in order."""
        lo, hi = np.searchsorted(self.seen, [a, b])
        when, level, size = self.seen[lo:hi] - a, self.level[lo:hi], self.size[lo:hi]
        mark = np.zeros((b - a, len(self.price)), np.int64)
        mark[when, level] = np.arange(1, len(when) + 1)
        np.maximum.accumulate(mark, axis=0, out=mark)
        out = np.where(mark > 0, np.concatenate([[0], size])[mark], self.now)
        self.now = out[-1].copy()
        return out

    def best(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(price, size) of the best level; size 0 where the side is empty."""
        if not len(self.price):
            return np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        first = (sizes > 0).argmax(1)
        return self.price[first], sizes[np.arange(len(sizes)), first]


def _windows(width: int) -> Iterator[slice]:
    a, step = 0, WINDOW
    while a < width:
        yield slice(a, min(width, a + step))
        a, step = a + step, 2 * step


def spend(sizes: np.ndarray, price: np.ndarray, notional: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(filled, quote spent, base in 1e-6 lots) of a quote amount at each instant; rounded down for each level."""
    left, base = np.full(len(sizes), notional), np.zeros(len(sizes), np.int64)
    for w in _windows(sizes.shape[1]):
        amount = sizes[:, w] * price[w]
        take = np.clip(left[:, None] - (np.cumsum(amount, 1) - amount), 0, amount)
        base += (take * MICRO // price[w]).sum(1)
        left = left - take.sum(1)
        if not left.any():
            break
    return left == 0, notional - left, base


def sell(sizes: np.ndarray, price: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(filled, quote in 1e-6 ticks) of a base amount, its own at each instant."""
    left, quote = base.copy(), np.zeros(len(sizes), np.int64)
    for w in _windows(sizes.shape[1]):
        amount = sizes[:, w] * MICRO
        take = np.clip(left[:, None] - (np.cumsum(amount, 1) - amount), 0, amount)
        quote += (take * price[w]).sum(1)
        left = left - take.sum(1)
        if not left.any():
            break
    return left == 0, quote


class Books:
    """One part: its instants in order, and what each venue's book is at each of them."""

    def __init__(self, rows: pd.DataFrame, venues: tuple[str, ...], max_age: int):
        ns, rank = rows["ns"].to_numpy(np.int64), rows["rank"].to_numpy(np.int64)
        order = np.lexsort((rank, ns))
        new = np.append(True, (ns[order][1:] != ns[order][:-1]) | (rank[order][1:] != rank[order][:-1]))
        place = np.empty(len(rows), np.int64)
        place[order] = np.cumsum(new)
        is_at = (rows["kind"] == "at").to_numpy()
        at = np.flatnonzero(is_at)[np.argsort(place[is_at], kind="stable")]
        self.ns, self.rank, self.venue = ns[at], rank[at], rows["venue"].to_numpy()[at]
        held = rows[~is_at].assign(seen=np.searchsorted(place[at], place[~is_at], side="left"))
        self.max_age, self.venues = max_age, venues
        self.sides, self.heard = {}, {}
        for v in venues:
            own = held[held["venue"] == v]
            levels = own[own["side"].notna()]
            self.sides[v] = {s: Side(levels[levels["side"] == s], s == "bid") for s in ("bid", "ask")}
            said = np.full(len(at) + 1, -1, np.int64)
            np.maximum.at(said, np.where(own["kind"].isin(["open", "heard"]), 0, own["seen"]), own["ns"].to_numpy(np.int64))
            self.heard[v] = np.maximum.accumulate(said)[: len(at)]

    def chunks(self) -> Iterator[tuple[int, int, dict]]:
        """(a, b, books) of the instants a .. b - 1; a book is (sizes by side, best by side, age, reason)."""
        for a in range(0, len(self.ns), CHUNK):
            b = min(a + CHUNK, len(self.ns))
            books = {}
            for v in self.venues:
                sizes = {s: side.sizes(a, b) for s, side in self.sides[v].items()}
                best = {s: self.sides[v][s].best(m) for s, m in sizes.items()}
                heard = self.heard[v][a:b]
                age = self.ns[a:b] - heard
                empty = (best["bid"][1] == 0) | (best["ask"][1] == 0)
                reason = np.select([heard < 0, age > self.max_age, empty, best["bid"][0] >= best["ask"][0]], ["missing", "too_old", "incomplete", "crossed"], "")
                books[v] = (sizes, best, age, reason)
            yield a, b, books


def _grouped(rows: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    return rows.groupBy("pair", "part").applyInPandas(run, schema)


TOPS = "pair string, venue string, ns long, event_id long, kind string, trusted boolean, bid long, ask long, bid_size long, ask_size long"
_TOPS = [f.split()[0] for f in TOPS.split(", ")]


def tops(rows: DataFrame, venues: tuple[str, ...], max_age: int) -> DataFrame:
    """Each message's book (instants of `messages`) as TOPS rows: trusted if both sides are there and don't cross."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found, out = Books(pdf, venues, max_age), []
        for a, b, books in found.chunks():
            for v, (_, best, _, reason) in books.items():
                at = found.venue[a:b] == v
                row = {"pair": pdf["pair"].iloc[0], "venue": v, "ns": found.ns[a:b][at], "event_id": found.rank[a:b][at], "kind": "delta", "trusted": reason[at] == ""}
                row |= {"bid": best["bid"][0][at], "ask": best["ask"][0][at], "bid_size": best["bid"][1][at], "ask_size": best["ask"][1][at]}
                out.append(pd.DataFrame(row))
        return pd.concat(out)[_TOPS] if out else pd.DataFrame(columns=_TOPS)

    return _grouped(rows, run, TOPS)


PRICES = "pair string, buy string, sell string, notional long, ns long, event_id long, state string, top_spread long, gross long, net long, base long, buy_age long, sell_age long"
_PRICES = [f.split()[0] for f in PRICES.split(", ")]


def spreads(cost: np.ndarray, proceeds: np.ndarray, buy_fee: int, sell_fee: int) -> tuple[np.ndarray, np.ndarray]:
    """(gross, net) of matched fills in 1e-8, rounded down; cost and proceeds in 1e-6 ticks."""
    paid, got = cost + cost * buy_fee // 100_000_000, proceeds - proceeds * sell_fee // 100_000_000
    one = lambda c, p: np.floor((p - c) * 1e8 / np.maximum(c, 1)).astype(np.int64)
    return one(cost, proceeds), one(paid, got)


def routes(rows: DataFrame, venues: tuple[str, ...], notionals: tuple[int, ...], fees: dict[str, int], max_age: int) -> DataFrame:
    """PRICES rows of every instant, directed route and notional: the notional is spent on the buy venue's asks and
    exactly that base sold on the sell venue's bids. An instant with a venue is for the routes of this venue only.
    state: priced, insufficient_depth, or ineligible:<reason> of the buy leg, else of the sell leg. Routes of a venue
    without a fee are left out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found, out = Books(pdf, venues, max_age), []
        for a, b, books in found.chunks():
            bought = {(v, n): spend(books[v][0]["ask"], found.sides[v]["ask"].price, n) for v in venues if v in fees for n in notionals}
            for buy, sell_ in permutations([v for v in venues if v in fees], 2):
                at = pd.isna(found.venue[a:b]) | (found.venue[a:b] == buy) | (found.venue[a:b] == sell_)
                (_, x, x_age, x_why), (y_sizes, y, y_age, y_why) = books[buy], books[sell_]
                why = np.where(x_why != "", x_why, y_why)
                good = why == ""
                top = np.floor((y["bid"][0] - x["ask"][0]) * 1e8 / np.maximum(x["ask"][0], 1)).astype(np.int64)
                for n in notionals:
                    filled, cost, base = bought[buy, n]
                    sold, proceeds = sell(y_sizes["bid"], found.sides[sell_]["bid"].price, base)
                    gross, net = spreads(cost * MICRO, proceeds, fees[buy], fees[sell_])
                    priced = good & filled & sold
                    state = np.where(~good, np.char.add("ineligible:", why), np.where(priced, "priced", "insufficient_depth"))
                    row = {"pair": pdf["pair"].iloc[0], "buy": buy, "sell": sell_, "notional": n, "ns": found.ns[a:b], "event_id": found.rank[a:b], "state": state}
                    masked = {"top_spread": (top, good), "gross": (gross, priced), "net": (net, priced), "base": (base, priced), "buy_age": (x_age, good), "sell_age": (y_age, good)}
                    row |= {k: pd.arrays.IntegerArray(np.asarray(v, np.int64), ~ok) for k, (v, ok) in masked.items()}
                    out.append(pd.DataFrame(row)[at])
        return pd.concat(out)[_PRICES] if out else pd.DataFrame(columns=_PRICES)

    return _grouped(rows, run, PRICES)


SAMPLES = "tick long, pair string, venue string, notional long, side string, outcome string, at_cap boolean"
_SAMPLES = [f.split()[0] for f in SAMPLES.split(", ")]


def samples(rows: DataFrame, venues: tuple[str, ...], notionals: tuple[int, ...], max_age: int, cap: int) -> DataFrame:
    """SAMPLES rows of every instant, venue, notional and side: filled, insufficient or why the book can't be tried.
    at_cap: the walked side holds `cap` levels or more, so a shortfall may be the cap's."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found, out = Books(pdf, venues, max_age), []
        for a, b, books in found.chunks():
            for v, (sizes, _, _, why) in books.items():
                for side, name in (("ask", "buy"), ("bid", "sell")):
                    held = (sizes[side] > 0).sum(1)
                    for n in notionals:
                        filled, _, _ = spend(sizes[side], found.sides[v][side].price, n)
                        outcome = np.where(why != "", why, np.where(filled, "filled", "insufficient"))
                        out.append(pd.DataFrame({"tick": found.ns[a:b], "pair": pdf["pair"].iloc[0], "venue": v, "notional": n, "side": name, "outcome": outcome, "at_cap": (outcome == "insufficient") & (held >= cap)}))
        return pd.concat(out)[_SAMPLES] if out else pd.DataFrame(columns=_SAMPLES)

    return _grouped(rows, run, SAMPLES)


def messages(states: DataFrame, rank: Column) -> DataFrame:
    """The instants right after each message, of updates or their `intervals`."""
    return states.select("pair", "venue", "ns").distinct().withColumn("rank", rank)
