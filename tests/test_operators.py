"""Operators against plain folds written from their meaning, and cases that the tables don't hold."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import symbols
from tidemark.operators import asof, audits, book, comparisons, episodes, fillrates, history, leadlag, netsignal, pricing, routes, stats
from tidemark.sources import capture, messages

EVENTS = "pair string, venue string, ns long, event_id long, kind string, seq long, bid long, ask long"


def fold(events):
    """Reasons of one book's events, by the rules, one after another."""
    trusted, cur, out = False, None, []
    for kind, seq, bid, ask in events:
        if kind == "reset":
            trusted = False
            out.append("adapter_reset")
        elif kind == "snapshot":
            trusted = None not in (bid, ask) and bid < ask
            cur = seq
            out.append("ok" if trusted else "snapshot_incomplete" if None in (bid, ask) else "snapshot_crossed")
        elif not trusted:
            out.append("book_stale")
        elif seq <= cur:
            out.append("out_of_order")
        elif seq != cur + 1:
            trusted = False
            out.append("sequence_gap")
        elif None not in (bid, ask) and bid >= ask:
            trusted = False
            out.append("crossed_book")
        elif None in (bid, ask):  # applied, and may be healed
            cur = seq
            out.append("book_incomplete")
        else:
            cur = seq
            out.append("ok")
    return out


@pytest.mark.parametrize("block", [4, 10**6])
def test_acceptance_equals_the_fold(spark, block):
    rng, rows, want = random.Random(5), [], {}
    for b in range(40):
        own, seq = [], 0
        for i in range(60):
            kind = rng.choices(["snapshot", "reset", "delta"], [1, 1, 8])[0]
            seq += rng.choices([0, 1, 2], [1, 12, 1])[0]
            bid = rng.randint(95, 105)
            own.append((kind, seq, bid, rng.choices([bid + 1, bid, None], [15, 1, 1])[0]))
        rows += [(f"P{b}", "v", i, i, *e) for i, e in enumerate(own)]
        want |= {(f"P{b}", i): r for i, r in enumerate(fold(own))}
    got = book.apply_reasons(spark.createDataFrame(rows, EVENTS), block=block).collect()
    assert {(r.pair, r.event_id): r.reason for r in got} == want
    assert {r.reason for r in got} >= {"ok", "book_stale", "out_of_order", "sequence_gap", "crossed_book", "snapshot_crossed", "adapter_reset", "book_incomplete", "snapshot_incomplete"}


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_asof_join_equals_a_scan(spark, block):
    rng = random.Random(block)
    left = [(rng.choice("ab"), rng.randint(0, 60), i) for i in range(60)]
    right = [(rng.choice("ab"), rng.randint(0, 60), i, i * 10) for i in range(40)]
    got = asof.asof_join(spark.createDataFrame(left, "k string, t long, id int"), spark.createDataFrame(right, "k string, u long, o int, v int"), ["k"], "t", "u", ["o"], ["v"], block, 9).collect()

    def scan(k, t):
        found = max(((u, o, v) for rk, u, o, v in right if rk == k and u <= t), default=None)
        return found[2] if found and t - found[0] <= 9 else None

    assert {r.id: r.v for r in got} == {i: scan(k, t) for k, t, i in left}


def route(spark, rows, block=10):
    """rows: (ns, state, spread) of one route."""
    data = [("P-USD", 0, "x", "y", ns, ns, ns // block, state, 100, 101, 5, spread, 1, 2, 1) for ns, state, spread in rows]
    return spark.createDataFrame(data, "pair string, route int, buy string, sell string, ns long, event_id long, block long, state string, ask long, bid long, size long, spread long, buy_age long, sell_age long, skew long")


def test_episode_goes_on_across_blocks_and_keeps_its_first_peak(spark):
    rows = [(1, "below", -5), (8, "above", 10), (12, "above", 30), (25, "above", 30), (31, "below", 2), (33, "above", 7), (47, "absent", None), (55, "above", 9)]
    got = episodes.episodes(route(spark, rows)).orderBy("start_ns").collect()
    assert [(r.start_ns, r.end_ns, r.close_reason, r.peak_ns, r.peak_spread, r.close_spread) for r in got] == [(8, 31, "spread_closed", 12, 30, 2), (33, 47, "book_ineligible", 33, 7, None), (55, None, None, 55, 9, None)]
    closed = episodes.shut_down(episodes.episodes(route(spark, rows)), 60).orderBy("start_ns").collect()
    assert (closed[-1].end_ns, closed[-1].close_reason) == (60, "shutdown")


def test_empty_tables_give_empty_results(spark):
    none = route(spark, [])
    assert episodes.episodes(none).count() == 0
    assert book.apply_reasons(spark.createDataFrame([], EVENTS)).count() == 0


def levels(spark, *rows):
    return spark.createDataFrame(rows, "pair string, venue string, side string, price long, size long")


def test_walks(spark):
    side = levels(spark, ("p", "v", "ask", 100, 1), ("p", "v", "ask", 102, 2), ("p", "v", "ask", 101, 0))
    wanted = spark.createDataFrame([(50,), (100,), (200,), (500,)], "notional long")
    got = {r.notional: (r.filled, r.levels_used, r.quote, r.base) for r in pricing.walk_quote(side, ["pair", "venue", "side"], wanted).collect()}
    # A level that meets the rest exactly is the last one used.
    assert got == {50: (True, 1, 50, 500_000), 100: (True, 1, 100, 1_000_000), 200: (True, 2, 200, 1_980_392), 500: (False, 2, 304, 3_000_000)}
    base = pricing.walk_base(side, ["pair", "venue", "side"], spark.createDataFrame([("p", "v", 1_500_000), ("p", "v", 9_000_000)], "pair string, venue string, base long")).collect()
    assert {r.base: (r.filled, r.quote) for r in base} == {1_500_000: (True, 151_000_000), 9_000_000: (False, 304_000_000)}


def test_matched_route_prices_and_fee_gate(spark):
    rows = levels(spark, ("p", "a", "ask", 100, 1), ("p", "a", "ask", 102, 2), ("p", "b", "bid", 103, 1), ("p", "b", "bid", 101, 2), ("p", "c", "bid", 500, 9))
    fees = spark.createDataFrame([("a", 400_000), ("b", 600_000)], "venue string, fee long")
    got = pricing.matched_routes(rows, spark.createDataFrame([(200,), (1000,)], "notional long"), fees).collect()
    by = {r.notional: r for r in got}
    assert {(r.buy, r.sell) for r in got} == {("a", "b")}  # c has no fee
    assert by[200].gross == (103_000_000 + 980_392 * 101 - 200_000_000) * 10**8 // 200_000_000
    assert by[200].net < by[200].gross
    assert (by[1000].buy_filled, by[1000].sell_filled, by[1000].gross) == (False, None, None)


def test_eligibility_order(spark):
    rows = [(None, True, True, True, 1, 1, 2), (1, False, True, True, 1, 1, 2), (1, True, False, True, 1, 1, 2), (1, True, True, False, 1, 1, 2), (1, True, True, True, 99, 1, 2), (1, True, True, True, 1, None, 2), (1, True, True, True, 1, 2, 2), (1, True, True, True, 1, 1, 2)]
    df = spark.createDataFrame(rows, "seen int, up boolean, begun boolean, whole boolean, age int, bid int, ask int")
    got = [r[0] for r in df.select(book.eligibility(F.col("seen"), F.col("up"), F.col("begun"), F.col("whole"), F.col("age"), F.col("bid"), F.col("ask"), 10)).collect()]
    assert got == ["missing", "disconnected", "uninitialized", "discontinuous", "too_old", "incomplete", "crossed", None]


def test_samples_count_each_outcome_once(spark):
    rows = [("a", 5, True, True, 10, 11), ("c", 1, True, True, 12, 11), ("i", 1, True, True, None, 11), ("u", 1, False, True, 10, 11), ("d", 1, False, False, None, None)]
    quotes = spark.createDataFrame([("p", v, t, 1, b, c, x, y, 3, 1) for v, t, b, c, x, y in rows], "pair string, venue string, ns long, event_id long, initialized boolean, connected boolean, bid long, ask long, bid_size long, ask_size long")
    roster = spark.createDataFrame([("p", v) for v in "aciudz"], "pair string, venue string")
    ticks, amounts = fillrates.grid(0, 20, 5, spark), spark.createDataFrame([(20,)], "notional long")
    found = fillrates.buckets(fillrates.samples(quotes, roster, ticks, amounts, 5, 7), 100).collect()
    got = {(r.venue, r.side): (r.samples, r.filled, r.insufficient, r.missing, r.too_old) for r in found if r.venue in "az"}
    assert got == {("a", "buy"): (5, 0, 2, 1, 2), ("a", "sell"): (5, 2, 0, 1, 2), ("z", "buy"): (5, 0, 0, 5, 0), ("z", "sell"): (5, 0, 0, 5, 0)}
    assert all(sum(r[o] for o in fillrates.OUTCOMES) == r.samples == 5 for r in found)
    assert {r.venue: (r.crossed, r.incomplete, r.uninitialized, r.disconnected) for r in found if r.venue in "ciud"} == {"c": (1, 0, 0, 0), "i": (0, 1, 0, 0), "u": (0, 0, 4, 0), "d": (0, 0, 0, 4)}


@pytest.mark.parametrize("ceil", [False, True])
def test_percentiles_equal_sorting(spark, ceil):
    import math

    rng = random.Random(3)
    values = [rng.randint(0, 30) for _ in range(57)]
    got = stats.percentiles(spark.createDataFrame([("k", v) for v in values], "k string, v int"), ["k"], "v", {"p50": 0.5, "p90": 0.9, "all": 1.0}, ceil).first()
    own = sorted(values)
    pick = (lambda f: own[math.ceil(f * 57) - 1]) if ceil else (lambda f: own[min(56, math.floor(f * 57))])
    assert (got.n, got.p50, got.p90, got["all"]) == (57, pick(0.5), pick(0.9), pick(1.0))


def test_pages_traverse_everything_once(spark):
    rows = [(i, i % 7, None if i % 5 == 0 else "x", i % 5 or None) for i in range(43)]
    df = spark.createDataFrame(rows, "id long, start_ns long, close_reason string, end_ns long")
    asked, seen, token = history.search(closed=True), [], None
    while True:
        page, token = history.page(df, asked, 10, token)
        seen += [(r.start_ns, r.id) for r in page.collect()]
        if token is None:
            break
    assert seen == sorted(((s, i) for i, s, c, _ in rows if c), reverse=True)
    assert history.Place.of(history.Place(1, 2, 3).token(asked), asked) == (1, 2, 3)
    for bad in (history.Place(1, 2, 3).token(history.search()), "", "!!", "a" * 600, "ab" * 32):
        with pytest.raises(ValueError):
            history.Place.of(bad, asked)
    with pytest.raises(ValueError):
        history.search(since=5, until=5)
    assert history.search(pair="P", since=1).mark == history.Search(("start_ns", ">=", 1), ("pair", "=", "P")).mark


def test_a_page_does_not_see_what_comes_later(spark):
    rows = [(i, i, None, None) for i in range(20)]
    schema = "id long, start_ns long, close_reason string, end_ns long"
    asked = history.search(closed=False)
    _, token = history.page(spark.createDataFrame(rows, schema), asked, 5)
    later = spark.createDataFrame([*rows, (99, 3, None, None)], schema)
    assert [r.id for r in history.page(later, asked, 30, token)[0].collect()] == list(range(14, -1, -1))


def signal(spark, rows):
    data = [("p", "a", "b", 1, t, t, state, net) for t, state, net in rows]
    return spark.createDataFrame(data, "pair string, buy string, sell string, notional long, ns long, event_id long, state string, net long")


def test_intervals(spark):
    """Times, nets and settings with known outcomes, nets in hundredths."""
    cases = [
        ([(1, 50), (2, 120), (3, 80), (4, -10)], (0, 0, 0), [(1, 4, 120, 80, "spread_closed")]),
        ([(1, 10), (2, 30), (3, 10), (4, 40), (5, -100)], (10, 0, 0), [(2, 3, 30, 30, "spread_closed"), (4, 5, 40, 40, "spread_closed")]),
        ([(1, 50), (2, 5), (3, -20)], (0, 10, 0), [(1, 3, 50, 5, "spread_closed")]),
        ([(1, 40), (2, "insufficient_depth")], (0, 0, 0), [(1, 2, 40, 40, "insufficient_depth")]),
        ([(1, 40), (2, "ineligible")], (0, 0, 0), [(1, 2, 40, 40, "invalidated")]),
        ([(10, 30), (20, 40)], (0, 0, 0), [(10, None, 40, 40, "end_of_capture")]),
        ([(0, 50), (5, -100)], (0, 0, 10), []),
    ]
    for rows, setting, want in cases:
        own = [(t, "priced" if isinstance(x, int) else x, x if isinstance(x, int) else None) for t, x in rows]
        got = netsignal.intervals(signal(spark, own), spark.createDataFrame([("v", *setting)], "variant string, threshold long, hysteresis long, delay long")).orderBy("open_ns").collect()
        assert [(r.open_ns, r.close_ns, r.peak_net, r.last_net, r.close_reason) for r in got] == want


def test_contrast_finds_the_planted_lag_and_equals_brute_force(spark):
    rng, price, step = random.Random(11), [0.0], 10
    for _ in range(6000):
        price.append(price[-1] + rng.gauss(0, 0.001))
    series = {}
    for side, lag in (("l", 0), ("r", 200)):
        at = sorted({rng.randrange(300, 59_000) for _ in range(700)})
        series[side] = [(t, price[(t - lag) // step]) for t in at]
    rets = {s: [("k", a, b, y - x) for (a, x), (b, y) in zip(v, v[1:], strict=False)] for s, v in series.items()}
    schema = "k string, start_ns long, end_ns long, value double"
    left, right = (spark.createDataFrame(rets[s], schema) for s in "lr")
    lags = [100 * k for k in range(-5, 6)]
    points = leadlag.contrast(left, right, spark.createDataFrame([(x,) for x in lags], "lag long"), ["k"], 400)
    got = {r.lag: r for r in points.collect()}
    for lag in (-300, 0, 200):
        pairs = [(a, b) for _, a0, a1, a in rets["l"] for _, b0, b1, b in rets["r"] if min(a1, b1 - lag) > max(a0, b0 - lag)]
        assert got[lag].overlaps == len(pairs)
        assert got[lag].contrast == pytest.approx(sum(a * b for a, b in pairs))
    best = leadlag.best_lag(points, ["k"], 30, 100, 500).first()
    assert (best.status, best.lag) == ("ok", 200)


def test_symbols(spark):
    df = spark.createDataFrame([("btcusdt",), ("ETHUSD",), ("USDT",), ("xyz",), ("a-b-USD",)], "s string")
    got = df.select(symbols.split_suffix(F.col("s")), symbols.base_of(F.col("s")), symbols.quote_of(F.col("s"))).collect()
    assert [r[0] for r in got] == ["BTC-USDT", "ETH-USD", "USDT", "XYZ", "A-B--USD"]
    assert (got[4][1], got[4][2]) == ("a-b", "USD")


def test_messages_of_three_venues(spark):
    rows = [
        (1, "v0", json.dumps({"s": "BTCUSDT", "U": 5, "u": 7, "b": [["100.5", "0"]], "a": [["101", "2"], ["102", "3"]]})),
        (2, "v0", json.dumps({"symbol": "BTCUSDT", "lastUpdateId": 9, "bids": [["1", "2"]], "asks": []})),
        (3, "v1", json.dumps({"sequence_num": 4, "events": [{"type": "snapshot", "product_id": "P", "updates": [{"side": "bid", "price_level": "1", "new_quantity": "2"}, {"side": "offer", "price_level": "3", "new_quantity": "4"}]}]})),
        (4, "v2", "no json"),
    ]
    got = {r.event_id: r for r in messages.decode(spark.createDataFrame(rows, "event_id int, venue string, raw string")).collect()}
    assert (got[1].kind, got[1].first_id, got[1].last_id, str(got[1].bids[0].price), len(got[1].asks)) == ("delta", 5, 7, "100.50000000", 2)
    assert (got[2].kind, got[2].last_id) == ("snapshot", 9)
    assert (got[3].kind, got[3].symbol, str(got[3].asks[0].size)) == ("snapshot", "P", "4.00000000")
    assert got[4].kind == "invalid"


def capture_lines(footer=None, version=2):
    out = [{"type": "header", "format": "book-capture", "version": version, "exchanges": {"v0": ["P"]}, "started_wall_ns": 1}]
    out += [{"exchange": "v0", "kind": "connection", "wall_ns": 1, "mono_ns": 1, "connected": True, "connection_generation": 1}, {"exchange": "v0", "kind": "ws", "wall_ns": 2, "mono_ns": 2, "raw": "{}"}, {"exchange": "v0", "kind": "ws", "wall_ns": 3, "mono_ns": 3}]
    return out + ([footer] if footer else [])


@pytest.mark.parametrize(
    ("footer", "verdict"),
    [
        (None, "missing_footer"),
        ({"type": "footer", "frame_count": 3, "clean": True, "frame_counts": {"attempted": 3, "accepted": 3, "flushed": 3}}, "lossless"),
        ({"type": "footer", "frame_count": 3, "clean": True, "frame_counts": {"attempted": 4, "accepted": 3, "flushed": 3, "dropped": {"ws": {"queue_full": 1}}}}, "declared_frame_loss"),
        ({"type": "footer", "frame_count": 2, "clean": True, "frame_counts": {"attempted": 3, "accepted": 3, "flushed": 3}}, "count_mismatch"),
        ({"type": "footer", "frame_count": 3, "clean": False, "frame_counts": {"attempted": 3, "accepted": 3, "flushed": 3}}, "writer_failure"),
    ],
)
def test_capture_integrity(spark, tmp_path, footer, verdict):
    lines = spark.createDataFrame([(json.dumps(x),) for x in capture_lines(footer)], "line string").coalesce(1)
    capture.write(lines, str(tmp_path / "c"), gzip=True)
    records = capture.read(spark, str(tmp_path / "c"))
    got = capture.integrity(records).first()
    assert (got.verdict, got.frames) == (verdict, 3)
    wrong = [r.wrong for r in capture.frames(records).orderBy("mono_ns", "priority").collect()]
    assert wrong == [None, None, "missing_raw"]


def test_audit_helpers(spark):
    rows = spark.createDataFrame([("k", t, t, s) for t, s in enumerate("aabbba")], "k string, ns long, event_id long, s string")
    got = audits.runs(rows, ["k"], ["ns"], F.col("s")).orderBy("start_ns").collect()
    assert [(r.state, r.start_ns, r.end_ns, r["rows"]) for r in got] == [("a", 0, 2, 2), ("b", 2, 5, 3), ("a", 5, None, 1)]
    near = audits.within(rows.where("s = 'b'"), rows.where("s = 'a'").select("k", F.col("ns").alias("n2")), ["k"], "ns", "n2", 1, "left_semi").collect()
    assert sorted(r.ns for r in near) == [2, 4]


def test_leg_ages_are_null_without_their_leg(spark):
    quotes = spark.createDataFrame([("p", "v0", 10, 1, True, 100, 101, 1, 1), ("p", "v1", 12, 2, True, 103, 104, 1, 1)], "pair string, venue string, ns long, event_id long, trusted boolean, bid long, ask long, bid_size long, ask_size long")
    rows = routes.route_rows(routes.aligned(quotes, ("v0", "v1"), 5), ("v0", "v1"), 100, 100_000).orderBy("ns", "route").collect()
    assert [(r.state, r.buy_age, r.sell_age, r.skew) for r in rows] == [("absent", 0, None, None), ("absent", None, 0, None), ("above", 2, 0, 2), ("below", 0, 2, 2)]


@pytest.mark.parametrize("block", [3, 1000])
def test_each_request_gets_the_first_unused_response_at_or_after_it(spark, block):
    rng = random.Random(block)
    asked = [(rng.choice("ab"), rng.randint(0, 30), i) for i in range(40)]
    given = [(rng.choice("ab"), rng.randint(0, 30), i) for i in range(40)]
    want = []
    for k in "ab":
        used: set[tuple] = set()
        for rank, (ns, _) in enumerate(sorted((t, i) for x, t, i in asked if x == k)):
            free = sorted((t, i) for x, t, i in given if x == k and t >= ns and (t, i) not in used)
            used |= set(free[:1])
            want.append((k, rank + 1, ns, free[0][0] if free else None))
    frame = lambda rows: spark.createDataFrame(rows, "k string, ns long, event_id long")
    got = audits.first_unused(frame(asked), frame(given), ["k"], block)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and any(r[3] is None for r in want)


@pytest.mark.parametrize("block", [2, 1000])
def test_streaks_of_equal_sets(spark, block):
    """Sets that stay, change, shrink, come back, are empty for a while, and are listed in another order."""
    weeks = {"P": ["ab", "ba", "ab", "a", "a", "ab", "", "ab", "ab"], "Q": ["c", "d", "d", "d"]}
    rows = [(k, w, x) for k, sets in weeks.items() for w, s in enumerate(sets) for x in s + s[:1]]
    signs = comparisons.signatures(spark.createDataFrame(rows, "k string, week long, x string"), ["k", "week"], ["x"])
    got = sorted((r.k, r.week, r.n, r.streak) for r in comparisons.set_streaks(signs, ["k"], "week", block).collect())
    want = [("P", 0, 2, 1), ("P", 1, 2, 2), ("P", 2, 2, 3), ("P", 3, 1, 1), ("P", 4, 1, 2), ("P", 5, 2, 1), ("P", 7, 2, 1), ("P", 8, 2, 2), ("Q", 0, 1, 1), ("Q", 1, 1, 1), ("Q", 2, 1, 2), ("Q", 3, 1, 3)]
    assert got == want
