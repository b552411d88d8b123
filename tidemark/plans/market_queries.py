"""Queries over books, routes and episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import book, episodes
from tidemark.plans import common
from tidemark.session import settled
from tidemark.sources import market


def book_apply_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.applied(spark, sf_dir).where(~F.col("kind").isin(book.LINKS))
    return rows.select("event_id", "pair", "venue", "seq", "chain", "reason", "accepted")


REASONS_SQL = f"WITH {common.APPLIED} SELECT event_id, pair, venue, seq, chain, reason, reason IN ('ok', 'adapter_reset') AS accepted FROM ap WHERE kind NOT IN ('down', 'up')"


def acceptance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates by reason: for each pair and reason, for each reason, and in all."""
    return common.applied(spark, sf_dir).groupingSets([["pair", "reason"], ["reason"], []], "pair", "reason").agg(F.count("*").alias("n"))


ACCEPTANCE_SQL = f"WITH {common.APPLIED} SELECT pair, reason, count(*) AS n FROM ap GROUP BY GROUPING SETS ((pair, reason), (reason), ())"


def book_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth quote comes back as a snapshot of its sequence, with a wrong ask at every thirtieth."""
    events = settled(common.applied(spark, sf_dir), "applied")
    again = events.where("event_id % 10 = 0 and kind in ('snapshot', 'delta')").select("pair", "venue", "seq", "bid", (F.col("ask") + F.when(F.col("event_id") % 30 == 0, 1).otherwise(0)).alias("ask"))
    found = book.verify(events, again)
    return found.groupBy("pair", "venue", "outcome").agg(F.count("*").alias("n"))


VERIFY_SQL = f"""WITH {common.APPLIED}, own AS (
  SELECT pair, venue, seq, max({{'b': bid, 'a': ask}}) AS o FROM ap WHERE reason = 'ok' GROUP BY ALL
), again AS (SELECT pair, venue, seq, bid, ask + CASE WHEN event_id % 30 = 0 THEN 1 ELSE 0 END AS ask FROM ap WHERE event_id % 10 = 0 AND kind IN ('snapshot', 'delta'))
SELECT pair, venue, CASE WHEN o IS NULL THEN 'verification_skipped' WHEN o.b = bid AND o.a = ask THEN 'verified' ELSE 'mismatch' END AS outcome, count(*) AS n
FROM again LEFT JOIN own USING (pair, venue, seq) GROUP BY ALL"""


def top_of_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.tops(common.live_levels(spark, sf_dir))


TOP_SQL = f"""WITH {common.LEVELS} SELECT pair, venue, max(price) FILTER (side = 'bid') AS bid, arg_max(size, price) FILTER (side = 'bid') AS bid_size,
  min(price) FILTER (side = 'ask') AS ask, arg_min(size, price) FILTER (side = 'ask') AS ask_size FROM live GROUP BY pair, venue"""


def depth_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.top_n(common.live_levels(spark, sf_dir), 10)


DEPTH_SQL = f"""WITH {common.LEVELS} SELECT pair, venue, side, price, size, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY pair, venue, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END) AS rank FROM live) WHERE rank <= 10"""


def _last_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each book's last event, and the time of the last one of all."""
    rows = common.trusted_quotes(spark, sf_dir)
    last = rows.groupBy(*book.BOOK).agg(F.max(F.struct("ns", "event_id", "trusted", "initialized", "connected", "bid", "ask")).alias("top"))
    return last.crossJoin(F.broadcast(rows.agg(F.max("ns").alias("now"))))


def eligibility_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each book of the roster can't be used at the last instant; v9 was never seen."""
    tracked = spark.createDataFrame([(f"P{k}-EUR" if k % 3 == 0 else f"P{k}-USD", "v9") for k in (0, 1)], "pair string, venue string")
    now = _last_tops(spark, sf_dir)
    books = book.roster(tracked, now).join(now, book.BOOK, "left")
    state = F.col("top.initialized")
    reason = book.eligibility(F.col("top"), F.col("top.connected"), state, state, F.col("now") - F.col("top.ns"), F.col("top.bid"), F.col("top.ask"), common.MAX_AGE)
    return books.select(*book.BOOK, F.coalesce(reason, F.lit("eligible")).alias("status"))


LADDER_SQL = f"""WITH {common.TRUSTED}, l AS (SELECT pair, venue, arg_max({{'ns': ns, 'initialized': initialized, 'connected': connected, 'bid': bid, 'ask': ask}}, (ns, event_id)) AS t FROM tr GROUP BY ALL),
r AS (SELECT pair, venue FROM l UNION SELECT * FROM (VALUES ('P0-EUR', 'v9'), ('P1-USD', 'v9')))
SELECT pair, venue, CASE WHEN t IS NULL THEN 'missing' WHEN NOT t.connected THEN 'disconnected' WHEN NOT t.initialized THEN 'uninitialized'
  WHEN (SELECT max(ns) FROM tr) - t.ns > {common.MAX_AGE} THEN 'too_old' WHEN t.bid IS NULL OR t.ask IS NULL THEN 'incomplete' WHEN t.bid >= t.ask THEN 'crossed' ELSE 'eligible' END AS status
FROM r LEFT JOIN l USING (pair, venue)"""


def pair_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best prices over the trusted venues of each pair that has two or more, and the oldest age."""
    now = _last_tops(spark, sf_dir).where("top.trusted")
    return now.groupBy("pair").agg(F.max("top.bid").alias("best_bid"), F.min("top.ask").alias("best_ask"), F.count("*").alias("venues"), F.max(F.col("now") - F.col("top.ns")).alias("oldest_ns")).where("venues >= 2")


SUMMARY_SQL = f"""WITH {common.TRUSTED}, l AS (SELECT pair, venue, arg_max({{'ns': ns, 'trusted': trusted, 'bid': bid, 'ask': ask}}, (ns, event_id)) AS t FROM tr GROUP BY ALL)
SELECT pair, max(t.bid) AS best_bid, min(t.ask) AS best_ask, count(*) AS venues, max((SELECT max(ns) FROM tr) - t.ns) AS oldest_ns FROM l WHERE t.trusted GROUP BY pair HAVING count(*) >= 2"""


def route_spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.route_table(spark, sf_dir).where("state <> 'absent'")
    return rows.select("pair", "buy", "sell", "ns", "event_id", "state", "ask", "bid", "size", "spread", (F.col("size") * (F.col("bid") - F.col("ask"))).alias("profit"))


SPREADS_SQL = f"WITH {common.ROUTES} SELECT pair, buy, sell, ns, event_id, state, ask, bid, size, spread, size * (bid - ask) AS profit FROM rt WHERE state <> 'absent'"


def route_leg_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ages in milliseconds, rounded down; the skew is that of the rounded ages."""
    rows = common.route_table(spark, sf_dir).where("state <> 'absent'")
    ms = lambda c: F.floor(F.col(c) / 1_000_000).cast("long")
    return rows.select("pair", "buy", "sell", "event_id", ms("buy_age").alias("buy_ms"), ms("sell_age").alias("sell_ms"), F.abs(ms("buy_age") - ms("sell_age")).alias("skew_ms"))


AGES_SQL = f"""WITH {common.ROUTES} SELECT pair, buy, sell, event_id, buy_age // 1000000 AS buy_ms, sell_age // 1000000 AS sell_ms, abs(buy_age // 1000000 - sell_age // 1000000) AS skew_ms FROM rt WHERE state <> 'absent'"""


def episodes_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.episode_table(spark, sf_dir)


EPISODES_SQL = f"WITH {common.EPISODES} SELECT * FROM ep"


def episodes_shutdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes still open are closed at the last event."""
    end = market.quotes(spark, sf_dir).agg(F.max("ns")).first()[0] or 0
    return episodes.shut_down(common.episode_table(spark, sf_dir), end).select("id", "pair", "buy", "sell", "start_ns", "end_ns", "close_reason")


SHUTDOWN_SQL = f"WITH {common.EPISODES} SELECT id, pair, buy, sell, start_ns, coalesce(end_ns, (SELECT max(ns) FROM q)) AS end_ns, coalesce(close_reason, 'shutdown') AS close_reason FROM ep"


def orphan_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = episodes.orphaned(common.episode_table(spark, sf_dir))
    return found.groupBy("pair", "close_reason").agg(F.count("*").alias("n"), F.count("end_ns").alias("ended"))


ORPHAN_SQL = f"WITH {common.EPISODES} SELECT pair, coalesce(close_reason, 'orphaned') AS close_reason, count(*) AS n, count(end_ns) AS ended FROM ep GROUP BY ALL"


def episode_upsert_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open and close rows of each episode, written in any order, folded to one row by natural key."""
    found = common.episode_table(spark, sf_dir)
    key = ["start_ns", "pair", "buy", "sell"]
    opened = found.select(*key, F.lit(None).cast("long").alias("end_ns"), F.lit(None).cast("string").alias("close_reason"), F.col("open_spread").alias("top_spread"), F.lit(1).alias("version"))
    closed = found.where("end_ns is not null").select(*key, "end_ns", "close_reason", F.col("peak_spread").alias("top_spread"), F.lit(2).alias("version"))
    late = closed.where("pair = 'P1-USD'").withColumn("close_reason", F.lit("late")).withColumn("version", F.lit(3))
    return episodes.upsert_fold(opened.unionByName(closed).unionByName(late), key, ["end_ns", "close_reason", "top_spread"])


UPSERT_SQL = f"WITH {common.EPISODES} SELECT start_ns, pair, buy, sell, end_ns, close_reason, CASE WHEN end_ns IS NULL THEN open_spread ELSE peak_spread END AS top_spread FROM ep"


def best_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each pair and hour the route of the widest spread; ties go to the smaller size, then the first."""
    rows = common.route_table(spark, sf_dir).where("state <> 'absent'").withColumn("hour", F.floor(F.col("ns") / market.NS_HOUR).cast("long"))
    place = F.struct("spread", -F.col("size"), -F.col("ns"), -F.col("event_id"), -F.col("route"))
    best = rows.groupBy("pair", "hour").agg(F.max_by(F.struct("buy", "sell", "spread", "size"), place).alias("best"))
    return best.select("pair", "hour", "best.*")


BEST_SQL = f"""WITH {common.ROUTES} SELECT pair, hour, b.buy AS buy, b.sell AS sell, b.spread AS spread, b.size AS size FROM (
  SELECT pair, ns // 3600000000000 AS hour, arg_max({{'buy': buy, 'sell': sell, 'spread': spread, 'size': size}}, (spread, -size, -ns, -event_id, -route)) AS b FROM rt WHERE state <> 'absent' GROUP BY ALL)"""

QUERIES = {
    "book_apply_reasons": (book_apply_reasons, REASONS_SQL),
    "acceptance_counts": (acceptance_counts, ACCEPTANCE_SQL),
    "book_verify": (book_verify, VERIFY_SQL),
    "top_of_book": (top_of_book, TOP_SQL),
    "depth_top_n": (depth_top_n, DEPTH_SQL),
    "eligibility_ladder": (eligibility_ladder, LADDER_SQL),
    "pair_summary": (pair_summary, SUMMARY_SQL),
    "route_spreads": (route_spreads, SPREADS_SQL),
    "route_leg_ages": (route_leg_ages, AGES_SQL),
    "episodes": (episodes_, EPISODES_SQL),
    "episodes_shutdown": (episodes_shutdown, SHUTDOWN_SQL),
    "orphan_mark": (orphan_mark, ORPHAN_SQL),
    "episode_upsert_fold": (episode_upsert_fold, UPSERT_SQL),
    "best_route": (best_route, BEST_SQL),
}
