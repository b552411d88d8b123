"""Queries over depth as of every instant: net signals and their intervals, ledgers of episodes, and fill rates, all
by walks down the levels that are live at each message or tick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import depth, episodes, fillrates, netsignal, routes
from tidemark.operators.asof import block_of, preceding
from tidemark.plans import common, research_queries
from tidemark.session import derived, settled, table
from tidemark.sources import market

DAY = market.NS_DAY
MAX_AGE = 20 * DAY
#: Amounts that take from one to some twenty levels.
NOTIONALS = (200_000, 1_000_000, 4_000_000)
TICK = 28 * DAY
#: Levels to which a venue's subscription is cut; a shortfall of a side that holds as many may be the cap's.
CAP = 40
#: Taker fees in 1e-8, low enough for some depth to pay.
_PRICED = {"v0": 60_000, "v1": 50_000, "v2": 40_000}


def _rank() -> Column:
    """Order of messages of one time: their venues'."""
    return F.substring("venue", 2, 1).cast("long")


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of all levels, made once for messages, episodes' moments and ticks."""
    return derived(table(spark, sf_dir, "lineitem"), "level-states", lambda: depth.intervals(market.levels(spark, sf_dir)))


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of the routes of each message's venue, right after it."""

    def make() -> DataFrame:
        states = _states(spark, sf_dir)
        rows = depth.dealt(states, depth.messages(states, _rank()), _rank())
        return depth.routes(rows, market.VENUES, NOTIONALS, _PRICED, MAX_AGE)

    return derived(table(spark, sf_dir, "lineitem"), "depth-routes", make)


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of `_routes` at which a route's state, gross or net changes."""
    rows = _routes(spark, sf_dir).withColumn("block", block_of(F.col("ns"), netsignal.BLOCK))
    now = F.struct("state", "gross", "net")
    rows = preceding(rows, netsignal.ROUTE, netsignal.ORDER, now, "was")
    return rows.where(F.col("was").isNull() | ~now.eqNullSafe(F.col("was"))).drop("block", "was")


def net_signal_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir)


#: Levels with the time of their next mention, and the messages.
STATES = (
    common.LEVELS
    + """, le AS (SELECT pair, venue, side, price, ns, greatest(arg_max(size, seq), 0) AS size FROM lv GROUP BY ALL
), vi AS (SELECT *, lead(ns) OVER (PARTITION BY pair, venue, side, price ORDER BY ns) AS to_ns FROM le
), ms AS (SELECT DISTINCT pair, venue, ns, CAST(substr(venue, 2, 1) AS BIGINT) AS rank FROM lv)"""
)


def _walks(instants: str, age: int = MAX_AGE) -> str:
    """CTEs of the books at `instants` (pair, ns, rank): bk (every venue's state), cw (live levels with what lies before
    them), and wa (asks by notional)."""
    seen = "({x} < i.ns OR ({x} = i.ns AND CAST(substr(v.venue, 2, 1) AS BIGINT) <= i.rank))"
    notionals = ", ".join(f"({n})" for n in NOTIONALS)
    return f""", nl(notional) AS (VALUES {notionals}), ix AS (SELECT DISTINCT pair, ns, rank FROM {instants}
), ll AS (
  SELECT i.pair, i.ns, i.rank, v.venue, v.side, v.price, v.size FROM ix i JOIN vi v ON v.pair = i.pair AND v.size > 0 AND v.ns <= i.ns WHERE {seen.format(x="v.ns")} AND NOT coalesce({seen.format(x="v.to_ns")}, false)
), cw AS (
  SELECT *, coalesce(sum(price * size) OVER w, 0)::BIGINT AS before, coalesce(sum(size) OVER w, 0)::BIGINT AS before_size FROM ll
  WINDOW w AS (PARTITION BY pair, ns, rank, venue, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), tp AS (SELECT pair, ns, rank, venue, max(price) FILTER (side = 'bid') AS bid, min(price) FILTER (side = 'ask') AS ask, arg_max(size, price) FILTER (side = 'bid') AS bid_size, arg_min(size, price) FILTER (side = 'ask') AS ask_size,
    count(*) FILTER (side = 'bid') AS bids, count(*) FILTER (side = 'ask') AS asks FROM ll GROUP BY ALL
), hd AS (SELECT i.pair, i.ns, i.rank, v.venue, max(v.ns) AS heard FROM ix i JOIN (SELECT DISTINCT pair, venue, ns FROM lv) v ON v.pair = i.pair AND v.ns <= i.ns WHERE {seen.format(x="v.ns")} GROUP BY ALL
), bk AS (
  SELECT i.pair, i.ns, i.rank, n.venue, bid, ask, bid_size, ask_size, bids, asks, i.ns - heard AS age,
    CASE WHEN heard IS NULL THEN 'missing' WHEN i.ns - heard > {age} THEN 'too_old' WHEN bid IS NULL OR ask IS NULL THEN 'incomplete' WHEN bid >= ask THEN 'crossed' END AS why
  FROM ix i CROSS JOIN (SELECT unnest({list(market.VENUES)}) AS venue) n LEFT JOIN hd ON hd.pair = i.pair AND hd.ns = i.ns AND hd.rank = i.rank AND hd.venue = n.venue
  LEFT JOIN tp ON tp.pair = i.pair AND tp.ns = i.ns AND tp.rank = i.rank AND tp.venue = n.venue
), tk AS (SELECT *, least(price * size, notional - before)::BIGINT AS take FROM cw, nl WHERE before < notional
), wq AS (SELECT pair, ns, rank, venue, side, notional, sum(take)::BIGINT AS cost, sum(take * 1000000 // price)::BIGINT AS base FROM tk GROUP BY ALL)"""


def _priced(instants: str) -> str:
    """CTE pr: PRICES rows of `instants` (pair, ns, rank, venue), for all routes where the venue is null."""
    fees = ", ".join(f"('{v}', {f})" for v, f in sorted(_PRICED.items()))
    return f"""{_walks(instants)}, fe(venue, fee) AS (VALUES {fees}
), rr AS (SELECT i.pair, i.ns, i.rank, b.venue AS buy, s.venue AS sell, b.fee AS bf, s.fee AS sf, notional FROM {instants} i, fe b, fe s, nl WHERE b.venue <> s.venue AND (i.venue IS NULL OR i.venue IN (b.venue, s.venue))
), sd AS (
  SELECT r.pair, r.ns, r.rank, r.buy, r.sell, r.notional, w.cost * 1000000 AS cost, w.base, w.cost = r.notional AS bought,
    coalesce(sum(greatest(0, least(c.size * 1000000, w.base - c.before_size * 1000000))), 0) >= w.base AS sold,
    coalesce(sum(greatest(0, least(c.size * 1000000, w.base - c.before_size * 1000000)) * c.price), 0)::BIGINT AS proceeds
  FROM rr r JOIN wq w ON w.pair = r.pair AND w.ns = r.ns AND w.rank = r.rank AND w.venue = r.buy AND w.side = 'ask' AND w.notional = r.notional
  LEFT JOIN cw c ON c.pair = r.pair AND c.ns = r.ns AND c.rank = r.rank AND c.venue = r.sell AND c.side = 'bid' AND c.before_size * 1000000 < w.base GROUP BY r.pair, r.ns, r.rank, r.buy, r.sell, r.notional, w.cost, w.base
), pz AS (
  SELECT r.*, x.age AS buy_age, y.age AS sell_age, x.ask, y.bid, coalesce(x.why, y.why) AS why, cost, base, proceeds, coalesce(bought AND sold, false) AS filled,
    cost + cost * bf // 100000000 AS paid, proceeds - proceeds * sf // 100000000 AS got
  FROM rr r JOIN bk x ON x.pair = r.pair AND x.ns = r.ns AND x.rank = r.rank AND x.venue = buy JOIN bk y ON y.pair = r.pair AND y.ns = r.ns AND y.rank = r.rank AND y.venue = sell
  LEFT JOIN sd ON sd.pair = r.pair AND sd.ns = r.ns AND sd.rank = r.rank AND sd.buy = r.buy AND sd.sell = r.sell AND sd.notional = r.notional
), pr AS (
  SELECT pair, buy, sell, notional, ns, rank AS event_id, CASE WHEN why IS NOT NULL THEN 'ineligible:' || why WHEN filled THEN 'priced' ELSE 'insufficient_depth' END AS state,
    CASE WHEN why IS NULL THEN CAST(floor((bid - ask) * 1e8 / ask) AS BIGINT) END AS top_spread,
    CASE WHEN why IS NULL AND filled THEN CAST(floor((proceeds - cost) * 1e8 / cost) AS BIGINT) END AS gross, CASE WHEN why IS NULL AND filled THEN CAST(floor((got - paid) * 1e8 / paid) AS BIGINT) END AS net,
    CASE WHEN why IS NULL AND filled THEN base END AS base, CASE WHEN why IS NULL THEN buy_age END AS buy_age, CASE WHEN why IS NULL THEN sell_age END AS sell_age
  FROM pz
)"""


SIGNALS = (
    f"""{STATES}{_priced("ms")}, sg AS (
  SELECT * EXCLUDE (s0, g0, n0) FROM (SELECT *, lag(state) OVER w AS s0, lag(gross) OVER w AS g0, lag(net) OVER w AS n0 FROM pr WINDOW w AS (PARTITION BY pair, buy, sell, notional ORDER BY ns, event_id))
  WHERE s0 IS NULL OR s0 <> state OR g0 IS DISTINCT FROM gross OR n0 IS DISTINCT FROM net
)"""
)
SIGNAL_SQL = f"WITH {SIGNALS} SELECT * FROM sg"

VARIANTS = [("plain", 0, 0, 0), ("hysteresis", 50_000, 50_000, 0), ("delayed", 0, 0, 3 * DAY)]


def net_intervals_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals in which a matched fill pays, by notional and variant."""
    rows = _signals(spark, sf_dir).select(*netsignal.ROUTE, *netsignal.ORDER, F.when(F.col("state").startswith("ineligible"), "ineligible").otherwise(F.col("state")).alias("state"), "net")
    return netsignal.intervals(rows, spark.createDataFrame(VARIANTS, "variant string, threshold long, hysteresis long, delay long"), block=360 * DAY)


_INTERVALS = research_queries.INTERVALS.split(", va(variant", 1)[1].split(")", 1)[1].split(", fl AS (", 1)[1]
INTERVALS_SQL = f"""WITH {SIGNALS}, va(variant, threshold, hysteresis, delay) AS (VALUES {", ".join(str(v) for v in VARIANTS)}), fl AS (
{_INTERVALS.replace("FROM sg, va", "FROM (SELECT * REPLACE (CASE WHEN state LIKE 'ineligible%' THEN 'ineligible' ELSE state END AS state) FROM sg), va")} SELECT * FROM iv"""


def _tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = _states(spark, sf_dir)
    return depth.tops(depth.dealt(states, depth.messages(states, _rank()), _rank()), market.VENUES, MAX_AGE)


def _episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of the level books' routes."""
    rows = routes.aligned(settled(_tops(spark, sf_dir), "depth-tops"), market.VENUES, 360 * DAY)
    return episodes.episodes(routes.route_rows(routes.marked(rows, market.VENUES, MAX_AGE, common.THRESHOLD), market.VENUES, MAX_AGE, common.THRESHOLD, "turned"))


def episode_ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each notional would have fetched at an episode's opening and at its peak: top-of-book spread, gross after
    depth, net after fees, and what depth and fees take."""
    found = _episodes(spark, sf_dir).where(F.col("buy").isin(list(_PRICED)) & F.col("sell").isin(list(_PRICED)))
    moments = F.array(*[F.struct(F.lit(m).alias("moment"), ns.alias("ns"), at.alias("rank")) for m, ns, at in (("open", F.col("start_ns"), F.floor(F.col("id") / 8).cast("long")), ("peak", F.col("peak_ns"), F.col("peak_id")))])
    asked = settled(found.select("id", "pair", "buy", "sell", F.explode(moments).alias("m")).select("id", "pair", "buy", "sell", "m.moment", "m.ns", "m.rank"), "moments")
    instants = asked.select("pair", "ns", "rank").distinct().withColumn("venue", F.lit(None).cast("string"))
    rows = depth.routes(depth.dealt(_states(spark, sf_dir), instants, _rank()), market.VENUES, NOTIONALS, _PRICED, MAX_AGE)
    priced = asked.join(rows.withColumnRenamed("event_id", "rank"), ["pair", "buy", "sell", "ns", "rank"])
    short = F.col("gross").isNull()
    return priced.select("id", "pair", "buy", "sell", "moment", "ns", "notional", "top_spread", "gross", (F.col("gross") - F.col("top_spread")).alias("depth_impact"), (F.col("net") - F.col("gross")).alias("fee_impact"), "net", short.alias("insufficient_depth"))


#: Episodes over the level books: the CTEs of common.EPISODES over other tops.
_CHAIN = common.EPISODES.split("), al AS (", 1)[1].replace(str(common.MAX_AGE), str(MAX_AGE))
LEDGERS_SQL = f"""WITH {STATES}{_walks("ms")}, te AS (
  SELECT m.rank AS event_id, m.pair, m.venue, m.ns, 'delta' AS kind, coalesce(bid, 0) AS bid, coalesce(ask, 0) AS ask, coalesce(bid_size, 0) AS bid_size, coalesce(ask_size, 0) AS ask_size, why IS NULL AS trusted
  FROM ms m JOIN bk USING (pair, ns, rank, venue)
), al AS ({_CHAIN}, mo AS (
  SELECT id, pair, buy, sell, 'open' AS moment, start_ns AS ns, id // 8 AS rank, NULL::VARCHAR AS venue FROM ep WHERE buy IN (SELECT unnest({sorted(_PRICED)})) AND sell IN (SELECT unnest({sorted(_PRICED)}))
  UNION ALL SELECT id, pair, buy, sell, 'peak', peak_ns, peak_id, NULL FROM ep WHERE buy IN (SELECT unnest({sorted(_PRICED)})) AND sell IN (SELECT unnest({sorted(_PRICED)}))
), ask AS (SELECT DISTINCT pair, ns, rank, venue FROM mo), pq AS (WITH {STATES}{_priced("ask")} SELECT * FROM pr)
SELECT id, pair, buy, sell, moment, ns, notional, top_spread, gross, gross - top_spread AS depth_impact, net - gross AS fee_impact, net, gross IS NULL AS insufficient_depth
FROM mo JOIN (SELECT * RENAME (event_id AS rank) FROM pq) USING (pair, buy, sell, ns, rank)"""


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks over the span of the level updates, for every pair that has one."""
    updates = market.levels(spark, sf_dir)
    start, end = updates.agg(F.min("ns"), F.max("ns")).first()
    ticks = fillrates.grid(0 if start is None else start // DAY * DAY, -1 if end is None else end, TICK, spark)
    pairs = spark.createDataFrame([(p,) for p in market.PAIRS], "pair string")
    return ticks.crossJoin(F.broadcast(pairs)).select("pair", F.lit(None).cast("string").alias("venue"), F.col("tick").alias("ns"), F.lit(99).cast("long").alias("rank"))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = depth.dealt(_states(spark, sf_dir), _grid(spark, sf_dir), _rank())
    return depth.samples(rows, (*market.VENUES, "v9"), NOTIONALS, MAX_AGE, CAP)


def fill_rate_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of walks by book, notional and side over all ticks; each sample has exactly one."""
    n = [F.count_if(F.col("outcome") == o).alias(o) for o in fillrates.OUTCOMES]
    return _samples(spark, sf_dir).groupBy("pair", "venue", "notional", "side").agg(F.count("*").alias("samples"), *n, F.count_if("at_cap").alias("insufficient_at_cap"))


_N = ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in fillrates.OUTCOMES)
FILL_SQL = f"""WITH {STATES}, gr AS (SELECT unnest({list(market.PAIRS)}) AS pair, t.ns, 99::BIGINT AS rank FROM (SELECT unnest(range((SELECT min(ns) // {DAY} * {DAY} FROM lv), (SELECT max(ns) + 1 FROM lv), {TICK})) AS ns) t
){_walks("gr").replace(str(list(market.VENUES)), str([*market.VENUES, "v9"]))}, so AS (
  SELECT b.pair, b.venue, b.ns, n.notional, d.name AS side, CASE WHEN why IS NOT NULL THEN why WHEN w.cost = n.notional THEN 'filled' ELSE 'insufficient' END AS outcome, CASE d.side WHEN 'bid' THEN bids ELSE asks END AS held
  FROM bk b CROSS JOIN nl n CROSS JOIN (VALUES ('ask', 'buy'), ('bid', 'sell')) d(side, name) LEFT JOIN wq w ON w.pair = b.pair AND w.ns = b.ns AND w.rank = b.rank AND w.venue = b.venue AND w.side = d.side AND w.notional = n.notional)
SELECT pair, venue, notional, side, count(*) AS samples, {_N}, count(*) FILTER (outcome = 'insufficient' AND held >= {CAP}) AS insufficient_at_cap FROM so GROUP BY ALL"""

QUERIES = {
    "net_signal_depth": (net_signal_depth, SIGNAL_SQL),
    "net_intervals_depth": (net_intervals_depth, INTERVALS_SQL),
    "episode_ledgers": (episode_ledgers, LEDGERS_SQL),
    "fill_rate_depth": (fill_rate_depth, FILL_SQL),
}
