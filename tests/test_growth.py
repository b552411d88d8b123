"""Steps whose work must grow with their input and no faster."""

import time
import tracemalloc

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark import session
from tidemark.llm import lm_scoring
from tidemark.operators import book, comparisons, depth, fillrates, leadlag, netsignal, research, routes, sequencing
from tidemark.operators import episodes as batch
from tidemark.plans import common, research_queries, sequencing_queries
from tidemark.sources import store
from tidemark.streaming import books, episodes


def test_route_of_many_changes_takes_linear_time():
    n = 300_000
    code = np.where(np.arange(n) % 2 == 0, episodes.ABOVE, episodes.BELOW)
    began = time.perf_counter()
    closed, held = episodes._route("P", 0, "v0", "v1", np.arange(n), np.arange(n), code, np.arange(n) % 7, None)
    assert len(closed) == n // 2 and held["open"] is None
    assert closed[1] == (16, "P", "v0", "v1", 2, 3, "spread_closed", 2, 2, 2, 3)
    assert time.perf_counter() - began < 20  # it took minutes when each change searched all of them


def _updates(n):
    return pd.DataFrame({"pair": "P", "venue": "v0", "ns": np.arange(n), "event_id": np.arange(n), "kind": np.where(np.arange(n) % 2 == 0, "snapshot", "delta"), "bid": 9.0, "ask": 10.0, "off": 0.0})


def test_chains_are_taken_at_once():
    began = time.perf_counter()
    found, seq, chains, held = books.accept(_updates(400_000), books.EMPTY)
    assert set(found) == {"ok"} and chains[-1] == 200_000 and held[:3] == (400_000, 200_000, "snapshot")
    assert time.perf_counter() - began < 5  # over 20 s when each chain had its own arrays


def test_rows_of_a_key_go_back_in_slices():
    class State:
        exists = False

        def update(self, held):
            self.held = held

    rows = _updates(200_000)
    out = list(books._accept(("P", "v0"), iter([rows.iloc[100_000:], rows.iloc[:100_000]]), State()))
    assert max(map(len, out)) <= books.SLICE and pd.concat(out)["event_id"].tolist() == list(range(200_000))


def test_a_keys_rows_take_little_memory():
    n = 200_000
    chunks = [_updates(n // 20) for _ in range(20)]
    tracemalloc.start()
    books.accept(books.gathered(iter(chunks)), books.EMPTY)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 * n


_ALIGN = """WITH hd AS (SELECT sn.id, snap, u.ns, u.event_id, first_id, last_id FROM sn JOIN up u ON u.pair = sn.pair AND u.venue = sn.venue AND u.ns BETWEEN asked_ns AND got_ns
), lf AS (SELECT *, max(last_id) OVER (PARTITION BY id ORDER BY ns, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM hd WHERE last_id > snap
), kp AS (SELECT id, count(*) AS pending, bool_or(reach IS NULL AND first_id > snap + 1) AS late, bool_or(reach IS NOT NULL AND first_id > reach + 1) AS out FROM lf GROUP BY id
), dr AS (SELECT id, count(*) AS dropped FROM hd WHERE last_id <= snap GROUP BY id)
SELECT id, coalesce(pending, 0) AS pending, coalesce(dropped, 0) AS dropped, CASE WHEN pending IS NULL THEN 'empty' WHEN late THEN 'retry' WHEN out THEN 'gap' ELSE 'aligned' END AS status
FROM sn LEFT JOIN kp USING (id) LEFT JOIN dr USING (id)"""


def test_snapshots_align_with_any_ids(spark):
    rng = np.random.default_rng(3)
    n, m = 3000, 900
    first = rng.integers(0, 60, n) + np.arange(n) // 60
    up = pd.DataFrame({"pair": rng.choice(["P", "Q"], n), "venue": "v0", "ns": rng.integers(-200, 1200, n), "event_id": np.arange(n), "first_id": first, "last_id": first + rng.integers(-2, 4, n)})
    asked = rng.integers(-250, 1300, m)
    sn = pd.DataFrame({"pair": rng.choice(["P", "Q", "R"], m), "venue": "v0", "id": np.arange(m), "snap": rng.integers(0, 110, m), "asked_ns": asked, "got_ns": asked + rng.integers(0, 41, m)})
    got = sequencing.aligned(spark.createDataFrame(sn), spark.createDataFrame(up), 40).select("id", "pending", "dropped", "status").collect()
    con = duckdb.connect()
    con.register("sn", sn)
    con.register("up", up)
    want = con.execute(_ALIGN).fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and {r[3] for r in want} == {"empty", "retry", "gap", "aligned"}


def test_alignment_pairs_no_snapshot_with_its_updates(spark):
    # 3,000 snapshots over the same 20,000 updates would be 60 million rows.
    up = spark.range(20_000).selectExpr("'P' AS pair", "'v0' AS venue", "id AS ns", "id AS event_id", "3 * id AS first_id", "3 * id + 2 AS last_id")
    sn = spark.range(3_000).selectExpr("'P' AS pair", "'v0' AS venue", "id", "3 * id + 5 AS snap", "id AS asked_ns", "id + 17000 AS got_ns")
    began = time.perf_counter()
    out = sequencing.aligned(sn, up, 20_000).groupBy("status").count().collect()
    assert [tuple(r) for r in out] == [("aligned", 3_000)]
    assert time.perf_counter() - began < 20


def test_each_training_group_has_a_file_of_its_own(spark):
    docs = spark.range(3_000).selectExpr("id AS doc_id", "concat_ws(' ', 'w' || id % 7, 'x' || id % 11, 'y' || id, 'z') AS text")
    taught = lm_scoring.texts(docs)
    classes = lm_scoring.classes_of(taught.mapInArrow(lm_scoring._count, "h long, e int, c long").groupBy("h").agg(F.min("e").alias("e"), F.sum("c").alias("c")))
    groups = lm_scoring.groups_of(taught, classes, 500)
    held = groups.groupBy(F.input_file_name()).count().collect()
    assert len(held) == 30 and {r["count"] for r in held} == {1}


def test_overlap_meets_no_episode_one_by_one(spark):
    rng = np.random.default_rng(4)
    n, m, end = 1500, 400, 2**60 + 3000
    route = lambda k: {"pair": rng.choice(["P", "Q"], k), "buy": "v0", "sell": rng.choice(["v1", "v2"], k)}
    a0, b0 = 2**60 + rng.integers(0, 2900, n), 2**60 + rng.integers(0, 2900, m)
    iv = pd.DataFrame(route(n) | {"variant": rng.choice(["x", "y"], n), "notional": 5, "open_ns": a0, "close_ns": a0 + rng.integers(-5, 400, n)}).drop_duplicates(["pair", "sell", "variant", "open_ns", "close_ns"])
    ep = pd.DataFrame(route(m) | {"start_ns": b0, "end_ns": b0 + rng.integers(-5, 90, m)})
    iv["close_ns"], ep["end_ns"] = iv["close_ns"].astype("Int64").mask(iv.index % 50 == 0), ep["end_ns"].astype("Int64").mask(ep.index % 60 == 0)
    schema = "pair string, buy string, sell string, "
    rows = lambda df: [tuple(None if pd.isna(x) else x for x in r) for r in df.astype(object).itertuples(index=False)]
    left, right = spark.createDataFrame(rows(iv), schema + "variant string, notional long, open_ns long, close_ns long"), spark.createDataFrame(rows(ep), schema + "start_ns long, end_ns long")
    found = netsignal.overlap(left, right, 500, end)
    con = duckdb.connect()
    con.register("iv", iv)
    con.register("ep", ep)
    want = con.execute(f"""WITH a AS (SELECT *, coalesce(close_ns, {end}) AS stop FROM iv WHERE coalesce(close_ns, {end}) > open_ns), b AS (SELECT pair, sell, start_ns AS b0, coalesce(end_ns, {end}) AS b1 FROM ep WHERE coalesce(end_ns, {end}) > start_ns)
    SELECT variant, a.pair, buy, a.sell, notional, open_ns, coalesce(bool_or(b0 <= open_ns AND open_ns < b1), false), CAST(floor(sum(CASE WHEN b0 IS NULL THEN 0 ELSE greatest(0, least(stop, b1) - greatest(open_ns, b0)) END)::DOUBLE * 1e6 / (stop - open_ns)) AS BIGINT)
    FROM a LEFT JOIN b ON b.pair = a.pair AND b.sell = a.sell AND b0 < stop AND b1 > open_ns GROUP BY variant, a.pair, buy, a.sell, notional, open_ns, stop""").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 1000
    assert "Generate explode(sequence" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_signals_are_compared_before_notionals_multiply_them(spark):
    schema = "pair string, route int, buy string, sell string, ns long, event_id long, block long, state string, ask long, bid long, size long, spread long"
    rows = [("P", 0, "a", "b", t, t, t // 3, s, 10, 12, z, p) for t, (s, z, p) in enumerate([("absent", None, None), ("below", 1, 5), ("below", 2, 5), ("below", 2, 5), ("above", 9, 7), ("absent", 9, None), ("absent", 8, None)])]
    fees, notionals = spark.createDataFrame([("a", 1), ("b", 1)], "venue string, fee long"), spark.createDataFrame([(15,), (50,)], "notional long")
    found = netsignal.signals(spark.createDataFrame(rows, schema), notionals, fees)
    assert sorted((r.notional, r.ns, r.state, r.net) for r in found.collect()) == [(15, 0, "ineligible", None), (15, 1, "insufficient_depth", None), (15, 2, "priced", 3), (15, 4, "priced", 5), (15, 5, "ineligible", None), (50, 0, "ineligible", None), (50, 1, "insufficient_depth", None), (50, 4, "priced", 5), (50, 5, "ineligible", None)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "hashpartitioning" in x and "notional" in x]


TOPS = "pair string, venue string, ns long, event_id long, kind string, trusted boolean, bid long, ask long, bid_size long, ask_size long"


def _tops(spark, n=4000):
    """Tops of two pairs over some blocks of 50, with equal times, untrusted rows and gaps."""
    rng = np.random.default_rng(5)
    bid = 10_000 + rng.integers(0, 40, n) * 5
    rows = zip(rng.choice(["P", "Q"], n).tolist(), rng.choice(["v0", "v1", "v2"], n).tolist(), np.sort(rng.integers(0, 3000, n)).tolist(), range(n), ["delta"] * n, (rng.random(n) < 0.7).tolist(), bid.tolist(), (bid + 10).tolist(), rng.integers(1, 4, n).tolist(), rng.integers(1, 4, n).tolist(), strict=True)
    return spark.createDataFrame(list(rows), TOPS)


def test_only_rows_that_change_a_route_become_its_rows(spark):
    venues = ("v0", "v1", "v2")
    aligned = routes.aligned(book.with_expiries(_tops(spark), 20, 50), venues, 50)
    marked = routes.marked(aligned, venues, 20, 100_000)
    every, moved, turned = (routes.route_rows(marked, venues, 20, 100_000, only) for only in (None, "moved", "turned"))
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, routes.route_rows(aligned, venues, 20, 100_000).collect()))
    total = every.count()
    assert 0 < turned.count() < total / 2 and 0 < moved.count() < total / 1.2
    found = sorted(map(tuple, batch.episodes(turned).fillna(-1).collect()))
    assert found == sorted(map(tuple, batch.episodes(every).fillna(-1).collect())) and len(found) > 100
    fees, notionals = spark.createDataFrame([(v, 100) for v in venues], "venue string, fee long"), spark.createDataFrame([(15_000,), (25_000,)], "notional long")
    signals = lambda rows: sorted(map(tuple, netsignal.signals(rows, notionals, fees).fillna(-1).collect()))
    assert signals(moved) == signals(every)


def test_states_are_sorted_once_and_without_what_blocks_open_with(spark):
    # A window after the join with openings sorts rows that hold every venue's opening.
    plan = routes.aligned(_tops(spark, 50), ("v0", "v1"), 50)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Window")


def test_a_flush_makes_its_changes_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def seen(rows):
        for row in rows:
            made.add(len(row))
            yield row

    columns = [c.split() for c in store.EPISODES.split(", ")]
    one = spark.range(40).selectExpr(*[f"cast({'id * 86400000000000' if c == 'start_ns' else 'id'} AS {t}) AS {c}" for c, t in columns])
    kept = store.EpisodeStore(spark, str(tmp_path / "store"))
    kept.flush(one.mapInPandas(seen, store.EPISODES))
    assert kept.episodes().count() == 40 and made.value == 40


def test_actions_after_the_last_target_go_no_further(spark, monkeypatch):
    actions = spark.range(5000).selectExpr("concat('P', id % 2) AS pair", "'bid' AS side", "id % 7 AS price", "id % 5 AS size", "id AS update_id")
    targets = spark.createDataFrame([("a", "P0", 40), ("b", "P1", 100)], "id string, pair string, at_id long")
    put = []
    monkeypatch.setattr(comparisons, "settled", lambda df, name: put.append(df) or df)
    found = sorted(map(tuple, comparisons.book_at(actions, targets, 16).collect()))
    want = {}
    for u in range(5000):
        for k, pair, at in (("a", 0, 40), ("b", 1, 100)):
            if u % 2 == pair and u <= at:
                want[k, u % 7] = (k, f"P{pair}", "bid", u % 7, u % 5, u)
    assert found == sorted(want.values()) and put[0].count() == 101


def test_samples_need_one_quote_a_tick(spark):
    start, step = 2**60 - 5, 50  # beyond what a double tells apart
    tops = _tops(spark).selectExpr("pair", "venue", f"{start} + ns AS ns", "event_id", "trusted AS initialized", "event_id % 9 <> 0 AS connected", "bid", "ask", "bid_size", "ask_size")
    last = fillrates.last_by_tick(tops, start, step)
    roster, ticks, notionals = tops.select("pair", "venue").distinct(), fillrates.grid(start, start + 3000, step, spark), spark.createDataFrame([(15_000,)], "notional long")
    samples = lambda quotes: sorted(map(tuple, fillrates.samples(quotes, roster, ticks, notionals, 200, 500).collect()))
    assert samples(last) == samples(tops) and last.count() <= 6 * 61 < tops.count() / 8


def test_links_are_carried_with_the_numbers(spark, monkeypatch):
    feed = _tops(spark).selectExpr("pair", "venue", "ns", "event_id", "CASE WHEN event_id % 41 = 0 THEN 'down' WHEN event_id % 13 = 0 THEN 'up' WHEN event_id % 5 = 0 THEN 'snapshot' ELSE 'delta' END AS kind", "bid", "ask", "bid_size", "ask_size", "cast(0 AS long) AS off")
    passes, own = [], book.running
    monkeypatch.setattr(book, "running", lambda *args: passes.append(args) or own(*args))
    apart = book.apply_reasons(book.sequenced(feed, 50), 50, links=True)
    assert len(passes) == 3
    at_once = book.apply_reasons(book.sequenced(feed, 50, links=True), 50, links=True)
    assert len(passes) == 5 and apart.columns == at_once.columns
    assert apart.exceptAll(at_once).count() == 0 and at_once.count() == 4000 and at_once.where("reason = 'disconnected'").count() > 100


def test_level_states_are_made_once_for_all_instants(spark, monkeypatch):
    updates = spark.range(600).selectExpr("'P' AS pair", "concat('v', id % 3) AS venue", "'bid' AS side", "id % 11 AS price", "id % 4 AS size", "id div 3 * 86400000000000 AS ns", "id AS seq")
    rank = F.substring("venue", 2, 1).cast("long")
    states = depth.intervals(updates)
    want = depth.dealt(updates, depth.messages(updates, rank), rank, 100)
    monkeypatch.setattr(depth, "intervals", None)
    got = depth.dealt(states, depth.messages(states, rank), rank, 100)
    assert want.exceptAll(got).count() == 0 and got.count() == want.count() > 1200


def test_acceptance_writes_rows_once(spark, monkeypatch):
    # Numbers, links and what a block knows of its chains come of one deal of the rows; it took three, and two tables.
    feed = _tops(spark).selectExpr("pair", "venue", "ns", "event_id", "CASE WHEN event_id % 41 = 0 THEN 'down' WHEN event_id % 13 = 0 THEN 'up' WHEN event_id % 5 = 0 THEN 'snapshot' ELSE 'delta' END AS kind", "bid", "ask", "bid_size", "ask_size", "cast(0 AS long) AS off")
    put, own = [], book.settled
    monkeypatch.setattr(book, "settled", lambda df, name: put.append(df) or own(df, name))
    assert book.apply_reasons(book.sequenced(feed, 50, links=True), 50, links=True).count() == 4000
    dealt = [x for x in put[0]._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x and "block#" in x]
    # The rows, each block's ends, and what blocks open with.
    assert len(put) == 1 and len(dealt) == 3


def test_lapses_are_found_once(spark):
    rows = book.with_expiries(_tops(spark), 20, 50)
    assert "Window" not in rows._jdf.queryExecution().optimizedPlan().toString() and rows.where("kind = 'expiry'").count() > 10


def test_gates_read_episodes_once(spark):
    rows = spark.range(50).selectExpr("id AS buy_age", "id % 7 AS sell_age", "id % 3 - 1 AS net", "id AS peak_profit", "'Q' AS quote", "id % 2 AS notional")
    found = research.gate_sensitivity(rows, spark.range(10, 30, 10).withColumnRenamed("id", "cutoff"), ("notional",), winners=F.count_if(F.col("net") > 0), all_profit=F.sum("peak_profit"))
    got = {(r.notional, r.cutoff): (r.retained, r.rejected, r.unknown, r.survivors, r.profit, r.winners, r.all_profit) for r in found.collect()}
    net = lambda i: i % 3 - 1
    want = {(n, c): (len(k := [i for i in own if i <= c]), len(own) - len(k), 0, sum(net(i) > 0 for i in k), sum(k), sum(net(i) > 0 for i in own), sum(own)) for n in (0, 1) for own in [range(n, 50, 2)] for c in (10, 20)}
    assert {k: v for k, v in got.items()} == want


def test_lapses_and_ticks_are_made_once_for_all_queries(spark, monkeypatch):
    sf, made = "/root/testdata/sf0.001", []
    for module, name in ((book, "lapses"), (leadlag, "ticks")):
        own = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *args, own=own, name=name: made.append(name) or own(*args))
    monkeypatch.setattr(session, "_derived", {})
    for query in (sequencing_queries.replay_transitions, research_queries.return_intervals, research_queries.tick_series, common.route_table, sequencing_queries.replay_transitions):
        query(spark, sf)
    assert sorted(made) == ["lapses", "ticks"]
