"""Queries over depth walks, priced routes and fill rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import book, fillrates, pricing
from tidemark.plans import common
from tidemark.session import derived, table
from tidemark.sources import market

_NOTIONALS = ", ".join(f"({n})" for n in market.NOTIONALS)
_FEES = ", ".join(f"('{v}', {f})" for v, f in sorted(market.FEES.items()))
SIDE = ["pair", "venue", "side"]

WALK = (
    common.LEVELS
    + f""", nl(notional) AS (VALUES {_NOTIONALS}), fe(venue, fee) AS (VALUES {_FEES}), cu AS (
  SELECT *, coalesce(sum(price * size) OVER w, 0) AS before, coalesce(sum(size) OVER w, 0) AS before_size FROM live
  WINDOW w AS (PARTITION BY pair, venue, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), tk AS (SELECT *, greatest(0, least(price * size, notional - before))::BIGINT AS take FROM cu, nl
), wq AS (
  SELECT pair, venue, side, notional, sum(take) >= notional AS filled, count(*) FILTER (take > 0) AS levels_used, sum(take)::BIGINT AS quote,
    sum(CAST(floor(take * 1000000 / price) AS BIGINT))::BIGINT AS base FROM tk GROUP BY pair, venue, side, notional
)"""
)


def depth_walk_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.walk_quote(common.live_levels(spark, sf_dir), SIDE, market.notionals(spark))


WALK_QUOTE_SQL = f"WITH {WALK} SELECT * FROM wq"


def depth_walk_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What 5, 50 and 500 lots cost on each side."""
    levels = common.live_levels(spark, sf_dir)
    lots = spark.createDataFrame([(n * pricing.MICRO,) for n in (5, 50, 500)], "base long")
    wanted = levels.select("pair", "venue").distinct().crossJoin(F.broadcast(lots))
    return pricing.walk_base(levels, SIDE, wanted)


WALK_BASE_SQL = f"""WITH {WALK}, w(base) AS (VALUES (5000000), (50000000), (500000000)),
t AS (SELECT *, greatest(0, least(size * 1000000, base - before_size * 1000000))::BIGINT AS take FROM cu, w)
SELECT pair, venue, side, base::BIGINT AS base, sum(take) >= base AS filled, sum(take * price)::BIGINT AS quote FROM t GROUP BY pair, venue, side, base"""

MATCHED = (
    WALK
    + """, bo AS (SELECT pair, venue AS buy, notional, filled AS buy_filled, quote AS cost, base FROM wq WHERE side = 'ask'
), so AS (
  SELECT pair, buy, notional, buy_filled, cost, base, venue AS sell, sum(greatest(0, least(size * 1000000, base - before_size * 1000000))) >= base AS enough,
    sum(greatest(0, least(size * 1000000, base - before_size * 1000000)) * price)::BIGINT AS proceeds
  FROM bo JOIN cu USING (pair) WHERE side = 'bid' AND venue <> buy GROUP BY pair, buy, notional, buy_filled, cost, base, venue
), mr AS (
  SELECT pair, buy, sell, notional, buy_filled, CASE WHEN buy_filled THEN enough END AS sell_filled, CASE WHEN buy_filled THEN base END AS base,
    CASE WHEN buy_filled AND enough THEN CAST(floor((proceeds - cost * 1000000) * 1e8 / (cost * 1000000)) AS BIGINT) END AS gross,
    CASE WHEN buy_filled AND enough THEN CAST(floor((proceeds - CAST(floor(proceeds * s.fee / 100000000) AS BIGINT) - (cost * 1000000 + CAST(floor(cost * 1000000 * b.fee / 100000000) AS BIGINT))) * 1e8
      / (cost * 1000000 + CAST(floor(cost * 1000000 * b.fee / 100000000) AS BIGINT))) AS BIGINT) END AS net
  FROM so JOIN fe b ON b.venue = buy JOIN fe s ON s.venue = sell
)"""
)


def matched_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.matched_routes(common.live_levels(spark, sf_dir), market.notionals(spark), market.fees(spark))


MATCHED_SQL = f"WITH {MATCHED} SELECT pair, buy, sell, notional, buy_filled, sell_filled, base, gross, net FROM mr"


def pricing_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-of-book spread, gross and net spread, and what depth and fees take from it, by route and notional."""
    levels = common.live_levels(spark, sf_dir)
    tops = book.tops(levels)
    ask = tops.select("pair", F.col("venue").alias("buy"), "ask")
    bid = tops.select("pair", F.col("venue").alias("sell"), "bid")
    rows = matched_route(spark, sf_dir).join(ask, ["pair", "buy"], "left").join(bid, ["pair", "sell"], "left")
    top = F.floor((F.col("bid") - F.col("ask")) * 1e8 / F.col("ask")).cast("long")
    return rows.select("pair", "buy", "sell", "notional", top.alias("top_spread"), "gross", (F.col("gross") - top).alias("depth_impact"), (F.col("net") - F.col("gross")).alias("fee_impact"), "net", F.col("gross").isNull().alias("insufficient_depth"))


LEDGER_SQL = f"""WITH {MATCHED}, tp AS (SELECT pair, venue, max(price) FILTER (side = 'bid') AS bid, min(price) FILTER (side = 'ask') AS ask FROM live GROUP BY ALL)
SELECT pair, buy, sell, notional, top_spread, gross, gross - top_spread AS depth_impact, net - gross AS fee_impact, net, gross IS NULL AS insufficient_depth FROM (
  SELECT mr.*, CAST(floor((s.bid - b.ask) * 1e8 / b.ask) AS BIGINT) AS top_spread FROM mr LEFT JOIN tp b ON b.pair = mr.pair AND b.venue = buy LEFT JOIN tp s ON s.pair = mr.pair AND s.venue = sell)"""


def best_venue_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The route of the best net, then gross spread for each pair and notional; the first wins ties."""
    rows = matched_route(spark, sf_dir).where("net is not null")
    best = rows.groupBy("pair", "notional").agg(F.max(F.struct("net", "gross")).alias("top"))
    ties = rows.join(best, ["pair", "notional"]).where("net = top.net and gross = top.gross")
    return ties.groupBy("pair", "notional").agg(F.min(F.struct("buy", "sell", "gross", "net")).alias("b")).select("pair", "notional", "b.*")


BEST_SQL = f"""WITH {MATCHED} SELECT pair, notional, buy, sell, gross, net FROM (
  SELECT *, row_number() OVER (PARTITION BY pair, notional ORDER BY net DESC, gross DESC, buy, sell) AS r FROM mr WHERE net IS NOT NULL) WHERE r = 1"""

TICK = 6 * market.NS_HOUR


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of all ticks, made once of the books; their number is that of ticks and books."""
    return derived(table(spark, sf_dir, "events"), "samples", lambda: _made(spark, sf_dir))


def _made(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = common.trusted_quotes(spark, sf_dir)
    start, end = quotes.agg(F.min("ns"), F.max("ns")).first()
    start = 0 if start is None else start // market.NS_HOUR * market.NS_HOUR
    ticks = fillrates.grid(start, end or 0, TICK, spark)
    roster = book.roster(quotes.select("pair", "venue").distinct(), spark.createDataFrame([("P0-EUR", "v9")], "pair string, venue string"))
    quotes = fillrates.last_by_tick(quotes.select("pair", "venue", "ns", "event_id", "initialized", "connected", "bid", "ask", "bid_size", "ask_size"), start, TICK)
    return fillrates.samples(quotes, roster, ticks, market.notionals(spark), common.MAX_AGE, common.BLOCK)


SAMPLES = (
    common.TRUSTED
    + f""", nl(notional) AS (VALUES {_NOTIONALS}), tick AS (
  SELECT unnest(range((min(ns) // {market.NS_HOUR}) * {market.NS_HOUR}, max(ns) + 1, {TICK})) AS tick FROM tr
), ro AS (SELECT DISTINCT pair, venue FROM tr UNION SELECT 'P0-EUR', 'v9'
), stt AS (
  SELECT r.pair, r.venue, tick, (SELECT arg_max({{'ns': ns, 'initialized': initialized, 'connected': connected, 'bid': bid, 'ask': ask, 'bid_size': bid_size, 'ask_size': ask_size}}, (ns, event_id)) FROM tr WHERE tr.pair = r.pair AND tr.venue = r.venue AND tr.ns <= tick) AS t
  FROM ro r, tick
), sm AS (
  SELECT tick, pair, venue, notional, side, CASE WHEN t IS NULL THEN 'missing' WHEN NOT t.connected THEN 'disconnected' WHEN NOT t.initialized THEN 'uninitialized' WHEN tick - t.ns > {common.MAX_AGE} THEN 'too_old' WHEN t.bid IS NULL OR t.ask IS NULL THEN 'incomplete' WHEN t.bid >= t.ask THEN 'crossed'
    WHEN CASE WHEN side = 'buy' THEN t.ask * t.ask_size ELSE t.bid * t.bid_size END >= notional THEN 'filled' ELSE 'insufficient' END AS outcome
  FROM stt, nl, (VALUES ('buy'), ('sell')) sd(side)
)"""
)


def fill_rate_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(spark, sf_dir)


SAMPLES_SQL = f"WITH {SAMPLES} SELECT * FROM sm"


def fill_rate_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fillrates.buckets(_samples(spark, sf_dir), market.NS_DAY)


_OUT = ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in fillrates.OUTCOMES)
BUCKETS_SQL = f"WITH {SAMPLES} SELECT tick // {market.NS_DAY} * {market.NS_DAY} AS bucket_ns, pair, venue, notional, side, count(*) AS samples, {_OUT} FROM sm GROUP BY ALL"


def fill_rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten days from 2024-01-10."""
    start = 1_704_844_800 * 10**9
    return fillrates.window(fillrates.buckets(_samples(spark, sf_dir), market.NS_DAY), start, start + 10 * market.NS_DAY)


WINDOW_SQL = f"""WITH {SAMPLES}, w AS (SELECT pair, venue, notional, side, count(*) AS samples, {_OUT} FROM sm
  WHERE tick >= 1704844800000000000 AND tick < 1704844800000000000 + 10 * {market.NS_DAY} GROUP BY pair, venue, notional, side)
SELECT *, CASE WHEN filled + insufficient > 0 THEN filled * 1000000 // (filled + insufficient) END AS fill_rate, (filled + insufficient) * 1000000 // samples AS eligible_share FROM w"""

QUERIES = {
    "depth_walk_quote": (depth_walk_quote, WALK_QUOTE_SQL),
    "depth_walk_base": (depth_walk_base, WALK_BASE_SQL),
    "matched_route": (matched_route, MATCHED_SQL),
    "pricing_ledger": (pricing_ledger, LEDGER_SQL),
    "best_venue_route": (best_venue_route, BEST_SQL),
    "fill_rate_samples": (fill_rate_samples, SAMPLES_SQL),
    "fill_rate_buckets": (fill_rate_buckets, BUCKETS_SQL),
    "fill_rate_window": (fill_rate_window, WINDOW_SQL),
}
