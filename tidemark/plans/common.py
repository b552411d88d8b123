"""SQL pieces that the DuckDB twins of several queries share, and the settings of the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import book, episodes, routes
from tidemark.session import derived, table
from tidemark.sources import market, store

MAX_AGE = 6 * market.NS_HOUR
THRESHOLD = 100_000  # 1e-8, 0.1 %
BLOCK = market.NS_DAY

QUOTES = """
q AS (
  SELECT event_id, 'P' || (user_id // 3) % 9 || CASE WHEN (user_id // 3) % 9 % 3 = 0 THEN '-EUR' ELSE '-USD' END AS pair,
    'v' || user_id % 3 AS venue, epoch_us(ts) * 1000 AS ns,
    CASE event_type WHEN 'error' THEN 'reset' WHEN 'signup' THEN 'snapshot' ELSE 'delta' END AS kind,
    9995 + c % 200 AS bid, 10005 + c % 200 AS ask, 1 + event_id % 7 AS bid_size, 1 + event_id % 5 AS ask_size
  FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS c FROM events)
)"""

#: What venues send, with what goes wrong, and why each update was accepted or not.
APPLIED = (
    QUOTES
    + f""", sq AS (
  SELECT event_id, pair, venue, ns, kind, CASE WHEN event_id % 59 = 0 THEN NULL ELSE bid END AS bid, CASE WHEN event_id % 53 = 0 THEN bid - 1 ELSE ask END AS ask, bid_size, ask_size,
    n + CASE WHEN event_id % 37 = 0 THEN -1 WHEN event_id % 41 = 0 THEN 1 ELSE 0 END AS seq
  FROM (SELECT *, row_number() OVER (PARTITION BY pair, venue ORDER BY ns, event_id) AS n FROM q)
), sent AS (
  SELECT * FROM sq
  UNION ALL SELECT event_id, p, venue, ns + 1, CASE WHEN event_id % 401 = 0 THEN 'down' ELSE 'up' END, NULL, NULL, NULL, NULL, NULL FROM sq, (SELECT unnest({list(market.PAIRS)}) AS p) WHERE event_id % 401 = 0 OR event_id % 43 = 0
), lk AS (SELECT *, kind <> 'down' AND coalesce(last_value(CASE WHEN kind IN ('down', 'up') THEN kind END IGNORE NULLS) OVER (PARTITION BY pair, venue ORDER BY ns, event_id) = 'down', false) AS cut FROM sent
), mk AS (SELECT *, kind <> 'delta' AND NOT cut AS mark, coalesce(bid >= ask, false) AS crossed, bid IS NULL OR ask IS NULL AS hollow FROM lk
), ch AS (SELECT *, sum(mark::INT) OVER w AS chain, last_value(CASE WHEN mark THEN {{'k': kind, 'bad': crossed OR hollow}} END IGNORE NULLS) OVER w AS head FROM mk WINDOW w AS (PARTITION BY pair, venue ORDER BY ns, event_id)
), tp AS (SELECT *, max(CASE WHEN NOT cut THEN seq END) OVER (PARTITION BY pair, venue, chain ORDER BY ns, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM ch
), dd AS (SELECT *, coalesce(bool_or(NOT cut AND kind = 'delta' AND (seq > top + 1 OR (seq = top + 1 AND crossed))) OVER (PARTITION BY pair, venue, chain ORDER BY ns, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS dead FROM tp
), ap AS (
  SELECT event_id, pair, venue, ns, kind, bid, ask, bid_size, ask_size, seq, chain::BIGINT AS chain, CASE WHEN kind IN ('down', 'up') THEN 'link_' || kind WHEN cut THEN 'disconnected' WHEN kind = 'reset' THEN 'adapter_reset'
    WHEN kind = 'snapshot' AND hollow THEN 'snapshot_incomplete' WHEN kind = 'snapshot' AND crossed THEN 'snapshot_crossed' WHEN kind = 'snapshot' THEN 'ok'
    WHEN head IS NULL OR head.k <> 'snapshot' OR head.bad OR dead THEN 'book_stale' WHEN seq <= top THEN 'out_of_order' WHEN seq > top + 1 THEN 'sequence_gap' WHEN crossed THEN 'crossed_book'
    WHEN hollow THEN 'book_incomplete' ELSE 'ok' END AS reason FROM dd
)"""
)

#: Books after each update that changed them.
TRUSTED = (
    APPLIED
    + """, tr AS (
  SELECT event_id, pair, venue, ns, kind, bid, ask, bid_size, ask_size, reason = 'ok' AS trusted, reason IN ('ok', 'book_incomplete') AS initialized, reason <> 'link_down' AS connected
  FROM ap WHERE reason NOT IN ('out_of_order', 'disconnected')
)"""
)

#: Quotes and a row just after each book's lapse.
EXPIRIES = (
    TRUSTED
    + f""", hs AS (
  SELECT *, lead(ns) OVER (PARTITION BY pair, venue ORDER BY ns, event_id) AS nx, max(ns) OVER () AS last_ns FROM tr
), te AS (
  SELECT * FROM tr
  UNION ALL SELECT event_id, pair, venue, ns + {MAX_AGE + 1}, 'expiry', bid, ask, bid_size, ask_size, trusted, initialized, connected FROM hs WHERE (nx IS NULL OR nx > ns + {MAX_AGE + 1}) AND ns + {MAX_AGE + 1} <= last_ns
)"""
)

ROUTES = (
    EXPIRIES
    + f""", al AS (
  SELECT pair, ns, event_id, {", ".join(f"last_value(CASE WHEN venue = '{v}' AND kind <> 'expiry' THEN {{'ns': ns, 'trusted': trusted, 'bid': bid, 'ask': ask, 'bid_size': bid_size, 'ask_size': ask_size}} END IGNORE NULLS) OVER w AS at_{v}" for v in market.VENUES)}
  FROM te WINDOW w AS (PARTITION BY pair ORDER BY ns, event_id)
), legs AS (
  {" UNION ALL ".join(f"SELECT pair, {k} AS route, '{b}' AS buy, '{s}' AS sell, ns, event_id, at_{b} AS x, at_{s} AS y FROM al" for k, (b, s) in enumerate((b, s) for b in market.VENUES for s in market.VENUES if b != s))}
), rt AS (
  SELECT *, CASE WHEN NOT fresh THEN 'absent' WHEN bid > ask AND (bid - ask) * 100000000 >= {THRESHOLD} * ask THEN 'above' ELSE 'below' END AS state,
    CASE WHEN fresh THEN CAST(floor((bid - ask) * 100000000 / ask) AS BIGINT) END AS spread, abs(buy_age - sell_age) AS skew
  FROM (
    SELECT pair, route, buy, sell, ns, event_id, x.ask AS ask, y.bid AS bid, least(x.ask_size, y.bid_size) AS size,
      coalesce(x.trusted AND y.trusted AND ns - x.ns <= {MAX_AGE} AND ns - y.ns <= {MAX_AGE}, false) AS fresh,
      CASE WHEN x IS NOT NULL THEN greatest(0, ns - x.ns) END AS buy_age, CASE WHEN y IS NOT NULL THEN greatest(0, ns - y.ns) END AS sell_age
    FROM legs)
)"""
)

EPISODES = (
    ROUTES
    + """, runs AS (
  SELECT *, sum(new) OVER (PARTITION BY pair, route ORDER BY ns, event_id) AS run FROM (
    SELECT *, CASE WHEN state = lag(state) OVER (PARTITION BY pair, route ORDER BY ns, event_id) THEN 0 ELSE 1 END AS new FROM rt)
), islands AS (
  SELECT pair, route, buy, sell, run, any_value(state) AS state,
    arg_min({'ns': ns, 'id': event_id, 'ask': ask, 'bid': bid, 'size': size, 'spread': spread, 'buy_age': buy_age, 'sell_age': sell_age, 'skew': skew}, (ns, event_id)) AS f,
    arg_max({'ns': ns, 'id': event_id, 'ask': ask, 'bid': bid, 'size': size, 'spread': spread}, (spread, -ns, -event_id)) AS p, max(skew) AS max_skew, count(*) AS evaluations
  FROM runs GROUP BY ALL
), nx AS (
  SELECT *, lead({'state': state, 'ns': f.ns, 'spread': f.spread}) OVER (PARTITION BY pair, route ORDER BY run) AS n FROM islands
), ep AS (
  SELECT f.id * 8 + route AS id, pair, string_split(pair, '-')[-1] AS quote, buy, sell, f.ns AS start_ns, n.ns AS end_ns,
    CASE n.state WHEN 'below' THEN 'spread_closed' WHEN 'absent' THEN 'book_ineligible' END AS close_reason,
    f.ask AS buy_price, f.bid AS sell_price, f.size AS max_size, f.spread AS open_spread, p.ns AS peak_ns, p.id AS peak_id, p.spread AS peak_spread, p.size AS peak_size,
    p.size * (p.bid - p.ask) AS peak_profit, CASE WHEN n.state = 'below' THEN n.spread END AS close_spread,
    f.buy_age AS buy_age, f.sell_age AS sell_age, f.skew AS skew, max_skew, evaluations
  FROM nx WHERE state = 'above'
)"""
)

LEVELS = """
lv AS (
  SELECT 'P' || l_partkey % 9 || CASE WHEN l_partkey % 9 % 3 = 0 THEN '-EUR' ELSE '-USD' END AS pair, 'v' || l_suppkey % 3 AS venue,
    CASE WHEN l_linestatus = 'O' THEN 'bid' ELSE 'ask' END AS side,
    CASE WHEN l_linestatus = 'O' THEN 10000 + 10 * (l_suppkey % 3) - c ELSE 10001 + 10 * (l_suppkey % 3) + c END AS price,
    CASE WHEN l_returnflag = 'R' THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS size,
    epoch_us(l_shipdate) * 1000 AS ns, l_orderkey * 8 + l_linenumber AS seq
  FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) % 200 AS c FROM lineitem)
), live AS (
  SELECT * FROM (SELECT pair, venue, side, price, arg_max(size, (ns, seq)) AS size FROM lv GROUP BY ALL) WHERE size > 0
)"""


def trusted_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books after each update that changed them: what was accepted, and what gave a book up."""
    events = table(spark, sf_dir, "events")
    return derived(events, "books", lambda: book.tops_over_time(applied(spark, sf_dir)))


def lapsing_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`trusted_quotes` and a row just after each book's lapse; lapses are found once for all queries."""
    quotes = trusted_quotes(spark, sf_dir)
    return quotes.unionByName(derived(table(spark, sf_dir, "events"), "lapses", lambda: book.lapses(quotes, MAX_AGE, BLOCK)))


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What venues send, numbered by book."""
    return book.sequenced(market.feed_of(table(spark, sf_dir, "events")))


def applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.apply_reasons(book.sequenced(market.feed_of(table(spark, sf_dir, "events")), links=True), links=True)


def route_table(spark: SparkSession, sf_dir: str, only: str | None = None) -> DataFrame:
    """Every route at every change of a pair's books, or `only` those that `routes.marked` says. One row a change is
    stored, and its routes are made of it as they are read."""

    def make() -> DataFrame:
        rows = routes.aligned(lapsing_quotes(spark, sf_dir), market.VENUES, BLOCK)
        return routes.marked(rows, market.VENUES, MAX_AGE, THRESHOLD)

    return routes.route_rows(derived(table(spark, sf_dir, "events"), "aligned", make), market.VENUES, MAX_AGE, THRESHOLD, only)


def episode_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.episodes(route_table(spark, sf_dir, "turned"))


def live_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.live_levels(market.levels(spark, sf_dir))


def episode_store(spark: SparkSession, sf_dir: str) -> store.EpisodeStore:
    """All episodes of the events as a store by day, with its rollup; made at the first use."""
    return store.store_of(spark, table(spark, sf_dir, "events"), lambda: episode_table(spark, sf_dir))
