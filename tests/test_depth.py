"""Depth as of every instant, and recovery, against plain folds."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import depth, recovery
from tidemark.operators.asof import block_of
from tidemark.operators.pricing import MICRO

VENUES, FEES = ("v0", "v1", "v2"), {"v0": 60_000, "v1": 50_000}
NOTIONALS = (300, 2_000, 9_000)
MAX_AGE = 3 * depth.DAY
SCHEMA = "pair string, venue string, side string, price long, size long, ns long, seq long"


def rank():
    return F.substring("venue", 2, 1).cast("long")


def updates(seed, n=400):
    """Updates of two pairs, one of them with most rows; prices near one another, so walks cross levels and books cross."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        side = rng.choice(["bid", "ask"])
        price = rng.randint(90, 101) if side == "bid" else rng.randint(100, 112)
        rows.append((rng.choice("AAAB"), f"v{rng.choice([0, 0, 1, 2])}", side, price, rng.choice([0, 1, 2, 5, 9]), rng.randint(0, 300) * depth.DAY // 5, i))
    return rows


def fold(rows):
    """Books of each pair right after each message, by a plain fold: (pair, ns, venue, {venue: ({side: {price: size}}, last)})."""
    out = []
    for pair in "AB":
        books = {v: ({"bid": {}, "ask": {}}, None) for v in VENUES}
        keys = sorted({(ns, v) for p, v, *_, ns, _ in rows if p == pair})
        for ns, venue in keys:
            sides = {s: dict(x) for s, x in books[venue][0].items()}
            for p, v, side, price, size, t, _ in sorted((r for r in rows), key=lambda r: r[6]):
                if (p, v, t) == (pair, venue, ns):
                    sides[side].pop(price, None)
                    if size > 0:
                        sides[side][price] = size
            books = books | {venue: (sides, ns)}
            out.append((pair, ns, venue, books))
    return out


def why(book, ns):
    sides, last = book
    if last is None:
        return "missing"
    if ns - last > MAX_AGE:
        return "too_old"
    if not sides["bid"] or not sides["ask"]:
        return "incomplete"
    return "crossed" if max(sides["bid"]) >= min(sides["ask"]) else None


def priced(pair, ns, venue, books):
    for buy in FEES:
        for sell in FEES:
            if buy == sell or venue not in (None, buy, sell):
                continue
            reason = why(books[buy], ns) or why(books[sell], ns)
            for n in NOTIONALS:
                left, base = n, 0
                for price, size in sorted(books[buy][0]["ask"].items()):
                    take = min(left, price * size)
                    left, base = left - take, base + take * MICRO // price
                want, proceeds = base, 0
                for price, size in sorted(books[sell][0]["bid"].items(), reverse=True):
                    take = min(want, size * MICRO)
                    want, proceeds = want - take, proceeds + take * price
                row = [pair, buy, sell, n, ns, int(venue[1]) if venue else 99]
                if reason:
                    yield (*row, f"ineligible:{reason}", None, None, None)
                elif left or want:
                    yield (*row, "insufficient_depth", None, None, None)
                else:
                    cost = n * MICRO
                    paid, got = cost + cost * FEES[buy] // 10**8, proceeds - proceeds * FEES[sell] // 10**8
                    yield (*row, "priced", (proceeds - cost) * 10**8 // cost, (got - paid) * 10**8 // paid, base)


@pytest.mark.parametrize(("rows_a_part", "window"), [(10**6, 64), (40, 2)])
def test_routes_at_every_message_equal_a_fold(spark, monkeypatch, rows_a_part, window):
    monkeypatch.setattr(depth, "WINDOW", window)
    monkeypatch.setattr(depth, "CHUNK", 7)
    rows = updates(1)
    df = spark.createDataFrame(rows, SCHEMA)
    dealt = depth.dealt(df, depth.messages(df, rank()), rank(), rows_a_part)
    got = depth.routes(dealt, VENUES, NOTIONALS, FEES, MAX_AGE).select("pair", "buy", "sell", "notional", "ns", "event_id", "state", "gross", "net", "base")
    want = [r for at in fold(rows) for r in priced(*at)]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert {r[6].split(":")[-1] for r in want} >= {"priced", "insufficient_depth", "crossed", "too_old", "incomplete", "missing"}
    if rows_a_part < 100:
        assert dealt.select("pair", "part").distinct().count() > 8
        assert "NestedLoop" not in dealt._jdf.queryExecution().toString() and "Cartesian" not in dealt._jdf.queryExecution().toString()


def test_ticks_see_everything_up_to_them_and_each_sample_has_one_outcome(spark):
    rows = updates(2)
    df = spark.createDataFrame(rows, SCHEMA)
    ticks = spark.createDataFrame([(p, None, t * depth.DAY, 99) for p in "ABC" for t in range(0, 64, 3)], "pair string, venue string, ns long, rank long")
    got = depth.samples(depth.dealt(df, ticks, rank(), 50), (*VENUES, "v9"), NOTIONALS, MAX_AGE, 4).collect()
    books = {}
    for pair, ns, _, state in fold(rows):
        books.setdefault(pair, []).append((ns, state))
    assert len(got) == 3 * 22 * 4 * 3 * 2
    for r in got:
        state = next((b for ns, b in reversed(books.get(r.pair, [])) if ns <= r.tick), None)
        book = (state or {}).get(r.venue, ({"bid": {}, "ask": {}}, None))
        side = book[0]["ask" if r.side == "buy" else "bid"]
        reason = why(book, r.tick)
        worth = sum(p * s for p, s in side.items())
        assert r.outcome == (reason or ("filled" if worth >= r.notional else "insufficient")), r
        assert r.at_cap == (r.outcome == "insufficient" and len(side) >= 4)


def test_depth_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    rows = depth.dealt(none, depth.messages(none, rank()), rank())
    assert depth.routes(rows, VENUES, NOTIONALS, FEES, MAX_AGE).count() == 0 and depth.tops(rows, VENUES, MAX_AGE).count() == 0


@pytest.mark.parametrize("block", [1, 5, 1000])
def test_recovery_equals_a_fold(spark, block):
    rng, rows, want = random.Random(block), [], []
    for book in range(12):
        state = ("waiting", 1, 0)
        for i in range(rng.choice([1, 2, 77])):
            frame = rng.choices(recovery.FRAMES, [8, 4, 3, 3, 2, 1, 0.5])[0]
            rows.append((f"P{book}", "v", i, i, frame))
            state, outcome = recovery.step(state, frame)
            want.append((f"P{book}", i, outcome, f"{state[0]}:{state[1]}" if state[0] == "waiting" else state[0], state[2]))
    df = spark.createDataFrame(rows, "pair string, venue string, ns long, event_id long, frame string").withColumn("block", block_of(F.col("ns"), block))
    got = recovery.replay(df).select("pair", "event_id", "outcome", "state", "resyncs")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert {r[2] for r in want} >= {"applied", "buffered", "skipped", "resync", "retry", "reconnect", "aligned", "unasked"}


def test_three_attempts_then_a_reconnect_that_waits_for_the_link(spark):
    frames = ["gap", "failed", "stale", "failed", "snapshot", "update", "up", "snapshot", "update"]
    df = spark.createDataFrame([("P", "v", i, i, f) for i, f in enumerate(frames)], "pair string, venue string, ns long, event_id long, frame string").withColumn("block", F.col("ns"))
    got = [r.outcome for r in recovery.replay(df).orderBy("event_id").collect()]
    assert got == ["buffered", "retry", "retry", "reconnect", "skipped", "skipped", "connected", "aligned", "applied"]
