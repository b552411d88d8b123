"""Queries behind views and reports: gated depth, client baselines, sessions, and the research run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import asof, audits, book, episodes, routes
from tidemark.plans import audit_queries, common, market_queries, research_queries, sequencing_queries
from tidemark.session import settled, shared_path
from tidemark.sources import capture, datasets, market, replay

Q, T, E = common.QUOTES, common.TRUSTED, common.EPISODES
DAY, HOUR = market.NS_DAY, market.NS_HOUR


def depth_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best five levels of each side of the books that can be used at the last instant."""
    good = market_queries.eligibility_ladder(spark, sf_dir).where("status = 'eligible'")
    return book.top_n(common.live_levels(spark, sf_dir).join(good, book.BOOK, "left_semi"), 5)


_LADDER = market_queries.LADDER_SQL.split(" ", 1)[1]
DEPTH_SQL = f"""WITH g AS (WITH {_LADDER}), {common.LEVELS}, k AS (SELECT *, row_number() OVER (PARTITION BY pair, venue, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END) AS rank FROM live)
SELECT pair, venue, side, price, size, rank FROM k WHERE rank <= 5 AND (pair, venue) IN (SELECT (pair, venue) FROM g WHERE status = 'eligible')"""


def pair_spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best prices of each pair over the venues that can be used, and the spread between them in ticks."""
    good = market_queries.eligibility_ladder(spark, sf_dir).where("status = 'eligible'")
    now = market_queries._last_tops(spark, sf_dir).join(good, book.BOOK, "left_semi")
    best = now.groupBy("pair").agg(F.max("top.bid").alias("best_bid"), F.min("top.ask").alias("best_ask"), F.count("*").alias("venues"))
    return best.withColumn("spread", F.col("best_ask") - F.col("best_bid"))


SPREADS_SQL = f"""WITH g AS (WITH {_LADDER}), {T}, l AS (SELECT pair, venue, max({{'ns': ns, 'id': event_id, 'bid': bid, 'ask': ask}}) AS t FROM tr GROUP BY ALL)
SELECT pair, max(t.bid) AS best_bid, min(t.ask) AS best_ask, count(*) AS venues, min(t.ask) - max(t.bid) AS spread FROM l WHERE (pair, venue) IN (SELECT (pair, venue) FROM g WHERE status = 'eligible') GROUP BY pair"""


def episode_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends by the monotonic clock, which may have gone back: start + max(0, close - open)."""
    rows = common.episode_store(spark, sf_dir).episodes().where("end_ns is not null")
    opened, closed = F.col("start_ns") + F.col("id") % 5, F.col("end_ns") - (F.col("id") % 7) * HOUR
    return rows.select("id", "start_ns", (F.col("start_ns") + F.greatest(F.lit(0), closed - opened)).alias("end_ns"))


CLOCKS_SQL = f"WITH {E} SELECT id, start_ns, start_ns + greatest(0, end_ns - (id % 7) * {HOUR} - (start_ns + id % 5)) AS end_ns FROM ep WHERE end_ns IS NOT NULL"


def delayed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The net that is in force when a delayed interval opens."""
    opened = research_queries._intervals(spark, sf_dir).where("variant = 'delayed'").select("pair", "buy", "sell", "notional", "open_ns")
    nets = research_queries._signals(spark, sf_dir).select("pair", "buy", "sell", "notional", F.col("ns").alias("net_ns"), "event_id", "state", "net")
    return asof.asof_join(opened, nets, ["pair", "buy", "sell", "notional"], "open_ns", "net_ns", ["event_id"], ["state", "net"], DAY).withColumnRenamed("open_ns", "at_ns")


DELAYED_SQL = f"""WITH {research_queries.INTERVALS}, o AS (SELECT pair, buy, sell, notional, open_ns FROM iv WHERE variant = 'delayed'),
x AS (SELECT o.*, (SELECT arg_max({{'s': state, 'n': net}}, (ns, event_id)) FROM sg WHERE sg.pair = o.pair AND sg.buy = o.buy AND sg.sell = o.sell AND sg.notional = o.notional AND sg.ns <= o.open_ns) AS v FROM o)
SELECT pair, buy, sell, notional, open_ns AS at_ns, v.s AS state, v.n AS net FROM x"""


def episode_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each episode with the ages that were recorded for its route at its opening, joined by its key."""
    found = common.episode_store(spark, sf_dir).episodes().select("id", "pair", "buy", "sell", F.col("start_ns").alias("ns"), F.floor(F.col("id") / 8).cast("long").alias("event_id"))
    # A route is above where an episode opens.
    ages = common.route_table(spark, sf_dir, "turned").where("state = 'above'").select("pair", "buy", "sell", "ns", "event_id", "buy_age", "sell_age", "skew")
    return found.join(ages, ["pair", "buy", "sell", "ns", "event_id"], "left").select("id", "buy_age", "sell_age", "skew")


AGES_SQL = f"WITH {E} SELECT id, buy_age, sell_age, skew FROM ep"


def client_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a client that joins halfway through gets: each book's newest state, then only later events."""
    rows = market.quotes(spark, sf_dir)
    half = F.broadcast(rows.agg(F.floor((F.min("ns") + F.max("ns")) / 2).cast("long").alias("joined")))
    both = rows.crossJoin(half)
    base = both.where("ns <= joined").groupBy("pair", "venue").agg(F.max(F.struct("ns", "event_id")).alias("x")).select(F.lit("baseline").alias("what"), "pair", "venue", "x.event_id")
    return base.unionByName(both.where("ns > joined").select(F.lit("update").alias("what"), "pair", "venue", "event_id"))


BASELINE_SQL = f"""WITH {Q}, h AS (SELECT (min(ns)::HUGEINT + max(ns)) // 2 AS j FROM q) SELECT 'baseline' AS what, pair, venue, arg_max(event_id, (ns, event_id)) AS event_id FROM q, h WHERE ns <= j GROUP BY pair, venue
UNION ALL SELECT 'update', pair, venue, event_id FROM q, h WHERE ns > j"""


def activity_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each book: events with less than eight hours between them."""
    rows = market.quotes(spark, sf_dir).withColumn("block", F.floor(F.col("ns") / DAY).cast("long"))
    far = asof.preceding(rows, book.BOOK, ["ns", "event_id"], F.col("ns"), "was")
    new = F.when(F.col("ns") - F.col("was") < 8 * HOUR, 0).otherwise(1)
    numbered = asof.running(far, book.BOOK, ["ns", "event_id"], {"session": ("sum", new, True)})
    return numbered.groupBy(*book.BOOK, "session").agg(F.min("ns").alias("start_ns"), F.max("ns").alias("end_ns"), F.count("*").alias("events"))


ACTIVITY_SQL = f"""WITH {Q}, s AS (SELECT *, sum(new) OVER (PARTITION BY pair, venue ORDER BY ns, event_id) AS session FROM (SELECT *, CASE WHEN ns - lag(ns) OVER (PARTITION BY pair, venue ORDER BY ns, event_id) < {8 * HOUR} THEN 0 ELSE 1 END AS new FROM q))
SELECT pair, venue, session::BIGINT AS session, min(ns) AS start_ns, max(ns) AS end_ns, count(*) AS events FROM s GROUP BY ALL"""


def snapshot_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with the first unused response at or after them of equal book, purpose and connection generation."""
    rows = market.quotes(spark, sf_dir).withColumn("block", F.floor(F.col("ns") / DAY).cast("long"))
    gens = asof.running(rows, book.BOOK, ["ns", "event_id"], {"generation": ("sum", (F.col("kind") == "reset").cast("int"), True)})
    gens = gens.where("kind <> 'reset'").withColumn("purpose", F.when(F.col("event_id") % 2 == 0, "audit").otherwise("resync"))
    return audits.first_unused(gens.where("event_id % 5 = 0"), gens.where("kind = 'snapshot'"), [*book.BOOK, "purpose", "generation"])


REQUESTS_SQL = f"""WITH RECURSIVE {Q}, g AS (SELECT *, (sum(CASE WHEN kind = 'reset' THEN 1 ELSE 0 END) OVER (PARTITION BY pair, venue ORDER BY ns, event_id))::BIGINT AS generation, CASE WHEN event_id % 2 = 0 THEN 'audit' ELSE 'resync' END AS purpose FROM q
), a0 AS (SELECT * FROM g WHERE kind <> 'reset' AND event_id % 5 = 0), b0 AS (SELECT * FROM g WHERE kind = 'snapshot'), {audit_queries.line_sql(["pair", "venue", "purpose", "generation"], "a0", "b0")}"""


def rebuild_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why books have to be rebuilt: by cause, by pair and cause, by venue and cause."""
    rows = sequencing_queries.book_terminators(spark, sf_dir).where("reason in ('sequence_gap', 'adapter_reset', 'crossed_book', 'snapshot_crossed', 'snapshot_incomplete', 'invalidated')")
    return rows.groupingSets([["reason"], ["pair", "reason"], ["venue", "reason"]], "pair", "venue", "reason").agg(F.count("*").alias("n"))


_TERMINATORS = sequencing_queries.TERMINATORS_SQL.rsplit("\nSELECT ", 1)[0]
CAUSES_SQL = f"""{_TERMINATORS} SELECT pair, venue, reason, count(*) AS n FROM rs WHERE kind NOT IN ('down', 'up') AND reason IN ('sequence_gap', 'adapter_reset', 'crossed_book', 'snapshot_crossed', 'snapshot_incomplete', 'invalidated')
GROUP BY GROUPING SETS ((reason), (pair, reason), (venue, reason))"""


def replay_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed recorded as a capture of three venues, read back, decoded, and taken through acceptance, routes and
    episodes: how many episodes each pair has, and a digest of all of them in order."""
    path = shared_path(spark, "replayed")
    capture.record(replay.frames(common.feed(spark, sf_dir), market.PAIRS), path, list(market.VENUES), 0, gzip=True)
    records = capture.read(spark, path)
    events = settled(replay.events(capture.frames(records).where("wrong is null"), market.PAIRS), "events")
    tops = settled(book.tops_over_time(book.apply_reasons(events, links=True)), "tops")
    aligned = routes.aligned(book.with_expiries(tops, common.MAX_AGE, common.BLOCK), market.VENUES, common.BLOCK)
    turns = routes.route_rows(routes.marked(aligned, market.VENUES, common.MAX_AGE, common.THRESHOLD), market.VENUES, common.MAX_AGE, common.THRESHOLD, "turned")
    found = settled(episodes.episodes(turns), "replayed-episodes")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    line = F.concat_ws("|", *map(text, _REPLAYED))
    marks = audits.digest(found, "pair", F.floor(F.col("start_ns") / DAY).cast("long"), line, ["start_ns", "id"])
    return found.groupBy("pair").agg(F.count("*").alias("episodes")).join(marks, "pair")


_REPLAYED = ["id", "buy", "sell", "start_ns", "end_ns", "close_reason", "buy_price", "sell_price", "max_size", "open_spread", "peak_ns", "peak_spread", "peak_size", "peak_profit", "close_spread"]
REPLAY_SQL = f"""WITH {E}, l AS (SELECT pair, start_ns, id, concat_ws('|', {", ".join(f"coalesce({c}::VARCHAR, '-')" for c in _REPLAYED)}) AS line FROM ep
), b AS (SELECT pair, start_ns // {DAY} AS block, count(*) AS n, sha256(string_agg(line, chr(10) ORDER BY start_ns, id)) AS h FROM l GROUP BY ALL)
SELECT pair, sum(n)::BIGINT AS episodes, sha256(string_agg(h, chr(10) ORDER BY block)) AS digest FROM b GROUP BY pair"""


def research_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The datasets of a research run written as JSON lines, and how many rows each has when it is read back."""
    made = {
        "episodes": common.episode_store(spark, sf_dir).episodes(),
        "leg_ages": market_queries.route_leg_ages(spark, sf_dir),
        "net_signal": research_queries.net_signal(spark, sf_dir),
        "returns": research_queries.return_intervals(spark, sf_dir),
        "ticks": research_queries.tick_series(spark, sf_dir),
        "transitions": sequencing_queries.replay_transitions(spark, sf_dir),
    }
    path, out = shared_path(spark, "research"), None
    for name, rows in made.items():
        datasets.write_lines(rows, f"{path}/{name}")
        one = datasets.count_lines(spark.read.text(f"{path}/{name}"), name)
        out = one if out is None else out.unionByName(one)
    return out


_TRANSITIONS = sequencing_queries.TRANSITIONS_SQL
RUN_SQL = f"""SELECT 'episodes' AS dataset, (SELECT count(*) FROM (WITH {E} SELECT 1 FROM ep)) AS rows UNION ALL SELECT 'leg_ages', (SELECT count(*) FROM ({market_queries.AGES_SQL}))
UNION ALL SELECT 'net_signal', (SELECT count(*) FROM ({research_queries.SIGNAL_SQL})) UNION ALL SELECT 'returns', (SELECT count(*) FROM ({research_queries.RETURNS_SQL}))
UNION ALL SELECT 'ticks', (SELECT count(*) FROM ({research_queries.TICKS_SQL})) UNION ALL SELECT 'transitions', (SELECT count(*) FROM ({_TRANSITIONS}))"""

QUERIES = {
    "replay_capture": (replay_capture, REPLAY_SQL),
    "depth_eligible": (depth_eligible, DEPTH_SQL),
    "pair_spreads": (pair_spreads, SPREADS_SQL),
    "episode_clocks": (episode_clocks, CLOCKS_SQL),
    "delayed_values": (delayed_values, DELAYED_SQL),
    "episode_ages": (episode_ages, AGES_SQL),
    "client_baseline": (client_baseline, BASELINE_SQL),
    "activity_sessions": (activity_sessions, ACTIVITY_SQL),
    "snapshot_requests": (snapshot_requests, REQUESTS_SQL),
    "rebuild_causes": (rebuild_causes, CAUSES_SQL),
    "research_run": (research_run, RUN_SQL),
}
