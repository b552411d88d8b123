"""Queries over audits of streams, books and captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import symbols
from tidemark.operators import asof, audits, stats
from tidemark.plans import common
from tidemark.session import table
from tidemark.sources import market, messages

Q, T, E = common.QUOTES, common.TRUSTED, common.EPISODES
ORDER = ["ns", "event_id"]


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes with the range of native ids that each covers, with overlaps and gaps."""
    n = F.row_number().over(Window.partitionBy(*audits.BOOK).orderBy(*ORDER)).cast("long")
    rows = market.quotes(spark, sf_dir).withColumn("n", n)
    off = F.when(F.col("event_id") % 11 == 0, -4).when(F.col("event_id") % 13 == 0, 3).otherwise(0)
    return rows.withColumn("first_id", 3 * F.col("n") + off).withColumn("last_id", 3 * F.col("n") + F.when(F.col("event_id") % 17 == 0, -1).otherwise(2))


IDS = (
    Q
    + """, idn AS (SELECT *, row_number() OVER (PARTITION BY pair, venue ORDER BY ns, event_id) AS n FROM q
), ids AS (SELECT *, 3 * n + CASE WHEN event_id % 11 = 0 THEN -4 WHEN event_id % 13 = 0 THEN 3 ELSE 0 END AS first_id, 3 * n + CASE WHEN event_id % 17 = 0 THEN -1 ELSE 2 END AS last_id FROM idn
), cc AS (
  SELECT *, CASE WHEN p IS NULL THEN 'first' WHEN last_id <= p THEN 'already_covered' WHEN first_id = p + 1 THEN 'contiguous' WHEN first_id > p + 1 THEN 'gap' ELSE 'overlapping' END AS chain_class
  FROM (SELECT *, max(last_id) OVER (PARTITION BY pair, venue ORDER BY ns, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM ids)
)"""
)


def chain_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audits.chain_classes(_ids(spark, sf_dir), audits.BOOK, ORDER, "first_id", "last_id")
    return rows.select("event_id", "pair", "venue", "first_id", "last_id", "chain_class")


CHAIN_SQL = f"WITH {IDS} SELECT event_id, pair, venue, first_id, last_id, chain_class FROM cc"


def drift_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audits.chain_classes(_ids(spark, sf_dir), audits.BOOK, ORDER, "first_id", "last_id")
    return rows.groupingSets([["chain_class"], ["pair", "chain_class"], ["venue", "chain_class"]], "pair", "venue", "chain_class").agg(F.count("*").alias("n"))


DRIFT_SQL = f"WITH {IDS} SELECT pair, venue, chain_class, count(*) AS n FROM cc GROUP BY GROUPING SETS ((chain_class), (pair, chain_class), (venue, chain_class))"


def snapshot_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the update after each snapshot takes up its id: aligned, stale, retry or waiting."""
    w = Window.partitionBy(*audits.BOOK).orderBy(*ORDER)
    rows = _ids(spark, sf_dir).withColumn("nf", F.lead("first_id").over(w)).withColumn("nl", F.lead("last_id").over(w)).where("kind = 'snapshot'")
    snap = 3 * F.col("n") + 1
    status = F.when(F.col("nf").isNull(), "waiting").when(F.col("nl") <= snap, "stale").when(F.col("nf") > snap + 1, "retry").otherwise("aligned")
    return rows.select("event_id", "pair", "venue", status.alias("status"))


ALIGN_SQL = f"""WITH {IDS} SELECT event_id, pair, venue, CASE WHEN nf IS NULL THEN 'waiting' WHEN nl <= 3 * n + 1 THEN 'stale' WHEN nf > 3 * n + 2 THEN 'retry' ELSE 'aligned' END AS status
FROM (SELECT *, lead(first_id) OVER w AS nf, lead(last_id) OVER w AS nl FROM ids WINDOW w AS (PARTITION BY pair, venue ORDER BY ns, event_id)) WHERE kind = 'snapshot'"""


def envelope_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelope numbers of each venue's connection, by day, with duplicates and gaps."""
    day = F.floor(F.col("ns") / market.NS_DAY).cast("long").alias("day")
    rows = market.quotes(spark, sf_dir).select("*", day)
    n = F.row_number().over(Window.partitionBy("venue", "day").orderBy(*ORDER)).cast("long")
    seq = n + F.when(F.col("event_id") % 29 == 0, -1).when(F.col("event_id") % 31 == 0, 2).otherwise(0)
    found = audits.envelope_classes(rows.withColumn("envelope", seq), ["venue", "day"], ORDER, "envelope")
    return found.groupBy("venue", "day", "envelope_class").agg(F.count("*").alias("n"))


ENVELOPE_SQL = f"""WITH {Q}, e AS (SELECT *, row_number() OVER (PARTITION BY venue, day ORDER BY ns, event_id) + CASE WHEN event_id % 29 = 0 THEN -1 WHEN event_id % 31 = 0 THEN 2 ELSE 0 END AS s FROM (SELECT *, ns // {market.NS_DAY} AS day FROM q)),
p AS (SELECT *, max(s) OVER (PARTITION BY venue, day ORDER BY ns, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM e)
SELECT venue, day, CASE WHEN r IS NULL THEN 'first' WHEN s <= r THEN 'duplicate' WHEN s = r + 1 THEN 'next' ELSE 'gap' END AS envelope_class, count(*) AS n FROM p GROUP BY ALL"""


def _venues(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    levels = common.live_levels(spark, sf_dir)
    return levels.where("venue = 'v0'").drop("venue"), levels.where("venue = 'v1'").drop("venue")


def reconcile_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of v0 and v1 in the price range that they share."""
    return audits.level_differences(*_venues(spark, sf_dir), ["pair", "side"])


DIFFERENCE = (
    common.LEVELS
    + """, a AS (SELECT * FROM live WHERE venue = 'v0'), b AS (SELECT * FROM live WHERE venue = 'v1'
), sh AS (SELECT pair, side, greatest(x.lo, y.lo) AS lo, least(x.hi, y.hi) AS hi FROM (SELECT pair, side, min(price) AS lo, max(price) AS hi FROM a GROUP BY ALL) x JOIN (SELECT pair, side, min(price) AS lo, max(price) AS hi FROM b GROUP BY ALL) y USING (pair, side)
), df AS (
  SELECT pair, side, price, a.size AS left_size, b.size AS right_size, CASE WHEN b.size IS NULL THEN 'left_only' WHEN a.size IS NULL THEN 'right_only' WHEN a.size <> b.size THEN 'size_differs' ELSE 'same' END AS outcome
  FROM a FULL JOIN b USING (pair, side, price) JOIN sh USING (pair, side) WHERE price BETWEEN lo AND hi
)"""
)
DIFFERENCE_SQL = f"WITH {DIFFERENCE} SELECT * FROM df"


def reconcile_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By pair and side: levels of each outcome, sizes in the shared range, and what the evidence is."""
    rows = reconcile_difference(spark, sf_dir)
    n = lambda o: F.count_if(F.col("outcome") == o)
    out = rows.groupBy("pair", "side").agg(n("same").alias("same"), n("size_differs").alias("size_differs"), (n("left_only") + n("right_only")).alias("one_sided"), F.coalesce(F.sum("left_size"), F.lit(0)).alias("left_total"), F.coalesce(F.sum("right_size"), F.lit(0)).alias("right_total"))
    kind = F.when((F.col("one_sided") > 0) & (F.col("size_differs") > 0), "price_and_size").when(F.col("one_sided") > 0, "price").when(F.col("size_differs") > 0, "size").otherwise("none")
    return out.withColumn("evidence", kind)


EVIDENCE_SQL = f"""WITH {DIFFERENCE}, s AS (SELECT pair, side, count(*) FILTER (outcome = 'same') AS same, count(*) FILTER (outcome = 'size_differs') AS size_differs, count(*) FILTER (outcome IN ('left_only', 'right_only')) AS one_sided,
  coalesce(sum(left_size), 0)::BIGINT AS left_total, coalesce(sum(right_size), 0)::BIGINT AS right_total FROM df GROUP BY pair, side)
SELECT *, CASE WHEN one_sided > 0 AND size_differs > 0 THEN 'price_and_size' WHEN one_sided > 0 THEN 'price' WHEN size_differs > 0 THEN 'size' ELSE 'none' END AS evidence FROM s"""


def nearest_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each level of v0 is from the nearest one of v1."""
    return audits.nearest(*_venues(spark, sf_dir), ["pair", "side"])


NEAREST_SQL = f"WITH {common.LEVELS} SELECT pair, side, price, (SELECT min(abs(b.price - a.price)) FROM live b WHERE b.venue = 'v1' AND b.pair = a.pair AND b.side = a.side) AS distance FROM live a WHERE venue = 'v0'"


def reconcile_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes at which a book's ask has been over 10,050 three times on end with the same size."""
    rows = market.quotes(spark, sf_dir).where("kind <> 'reset'")
    found = audits.streak_triggers(rows, audits.BOOK, ORDER, F.col("ask") > 10_050, F.col("ask_size") % 2, 3)
    return found.select("event_id", "pair", "venue", "sign")


STREAKS_SQL = f"""WITH {Q}, s AS (SELECT *, CASE WHEN ask > 10050 THEN ask_size % 2 END AS sign FROM q WHERE kind <> 'reset'),
r AS (SELECT *, sum(CASE WHEN sign IS NOT DISTINCT FROM p AND k > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY pair, venue ORDER BY ns, event_id) AS run FROM (SELECT *, lag(sign) OVER w AS p, row_number() OVER w AS k FROM s WINDOW w AS (PARTITION BY pair, venue ORDER BY ns, event_id)))
SELECT event_id, pair, venue, sign FROM (SELECT *, row_number() OVER (PARTITION BY pair, venue, run ORDER BY ns, event_id) AS i FROM r) WHERE sign IS NOT NULL AND i = 3"""


def outage_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audits.runs(common.trusted_quotes(spark, sf_dir), audits.BOOK, ORDER, F.col("trusted"))
    return rows.where("not state").select("pair", "venue", "start_ns", "end_ns", "rows")


RUNS = (
    T
    + """, rr AS (SELECT *, sum(CASE WHEN trusted = p THEN 0 ELSE 1 END) OVER (PARTITION BY pair, venue ORDER BY ns, event_id) AS run FROM (SELECT *, lag(trusted) OVER (PARTITION BY pair, venue ORDER BY ns, event_id) AS p FROM tr)
), rs AS (SELECT *, lead(start_ns) OVER (PARTITION BY pair, venue ORDER BY run) AS end_ns FROM (SELECT pair, venue, run, any_value(trusted) AS good, min(ns) AS start_ns, count(*) AS rows FROM rr GROUP BY ALL))"""
)
OUTAGES_SQL = f"WITH {RUNS} SELECT pair, venue, start_ns, end_ns, rows FROM rs WHERE NOT good"


def recovery_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of how long books stay out of use, by pair."""
    rows = audits.recoveries(common.trusted_quotes(spark, sf_dir), audits.BOOK, ORDER, "trusted")
    return stats.percentiles(rows, ["pair"], "duration", {"p50": 0.5, "p95": 0.95})


RECOVERY_SQL = f"""WITH {RUNS}, l AS (SELECT pair, list(end_ns - start_ns ORDER BY end_ns - start_ns) AS v FROM rs WHERE NOT good AND end_ns IS NOT NULL GROUP BY pair)
SELECT pair, len(v) AS n, v[1 + least(len(v) - 1, CAST(floor(len(v) * 0.5) AS BIGINT))] AS p50, v[1 + least(len(v) - 1, CAST(floor(len(v) * 0.95) AS BIGINT))] AS p95, v[-1] AS longest FROM l"""


def latency_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between a book's events by kind, with percentiles at rank ceil(f n)."""
    gap = F.col("ns") - F.lag("ns").over(Window.partitionBy(*audits.BOOK).orderBy(*ORDER))
    rows = market.quotes(spark, sf_dir).withColumn("gap", gap)
    ranks = stats.percentiles(rows, ["kind"], "gap", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, ceil=True)
    return ranks.join(rows.groupBy("kind").agg(F.floor(F.avg("gap") / 1000).cast("long").alias("mean_us")), "kind")


LATENCY_SQL = f"""WITH {Q}, g AS (SELECT kind, ns - lag(ns) OVER (PARTITION BY pair, venue ORDER BY ns, event_id) AS gap FROM q),
l AS (SELECT kind, list(gap ORDER BY gap) FILTER (gap IS NOT NULL) AS v, avg(gap) AS m FROM g GROUP BY kind)
SELECT kind, len(v) AS n, {", ".join(f"v[CAST(ceil(len(v) * {f}) AS BIGINT)] AS {n}" for n, f in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)))}, v[-1] AS longest, CAST(floor(m / 1000) AS BIGINT) AS mean_us FROM l"""


def unmatched_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events sent but not processed, and processed but not sent, by book."""
    rows = market.quotes(spark, sf_dir).select("event_id", "pair", "venue")
    sent, done = rows.where("event_id % 7 <> 0"), rows.where("event_id % 11 <> 0")
    lost = sent.join(done, ["event_id", "pair", "venue"], "left_anti").select("pair", "venue", F.lit("missing").alias("what"))
    extra = done.join(sent, ["event_id", "pair", "venue"], "left_anti").select("pair", "venue", F.lit("unmatched").alias("what"))
    return lost.unionByName(extra).groupBy("pair", "venue", "what").agg(F.count("*").alias("n"))


UNMATCHED_SQL = f"WITH {Q} SELECT pair, venue, CASE WHEN event_id % 11 = 0 THEN 'missing' ELSE 'unmatched' END AS what, count(*) AS n FROM q WHERE (event_id % 7 = 0) <> (event_id % 11 = 0) GROUP BY ALL"


def phantom_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each episode with its buy venue's last snapshot at or before the start, at most four hours earlier,
    and whether that snapshot showed the price."""
    found = common.episode_store(spark, sf_dir).episodes().select("id", "pair", "buy", "start_ns", "buy_price")
    shots = market.quotes(spark, sf_dir).where("kind = 'snapshot'").select("pair", F.col("venue").alias("buy"), "ns", "event_id", F.col("ask").alias("shot_ask"), F.col("event_id").alias("shot_id"))
    rows = asof.asof_join(found, shots, ["pair", "buy"], "start_ns", "ns", ["event_id"], ["shot_ask", "shot_id"], common.BLOCK, 4 * market.NS_HOUR)
    verdict = F.when(F.col("shot_id").isNull(), "unaligned").when(F.col("shot_ask") == F.col("buy_price"), "confirmed").otherwise("phantom")
    return rows.select("id", "shot_id", verdict.alias("verdict"))


PHANTOM_SQL = f"""WITH {E}, s AS (SELECT pair, venue AS buy, ns, event_id, ask FROM q WHERE kind = 'snapshot'),
j AS (SELECT id, buy_price, (SELECT arg_max({{'i': s.event_id, 'a': s.ask, 'n': s.ns}}, (s.ns, s.event_id)) FROM s WHERE s.pair = ep.pair AND s.buy = ep.buy AND s.ns <= ep.start_ns) AS x, start_ns FROM ep),
k AS (SELECT id, buy_price, CASE WHEN start_ns - x.n <= {4 * market.NS_HOUR} THEN x END AS x FROM j)
SELECT id, x.i AS shot_id, CASE WHEN x IS NULL THEN 'unaligned' WHEN x.a = buy_price THEN 'confirmed' ELSE 'phantom' END AS verdict FROM k"""


def trade_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales without a quote of the same pair on another book of v0 within ten minutes, and with one."""
    rows = market.quotes(spark, sf_dir).where("kind = 'delta'")
    trades, quotes = rows.where("venue <> 'v0'").select("event_id", "pair", "venue", "ns"), rows.where("venue = 'v0'").select("pair", "ns")
    span = 600 * 10**9
    yes = audits.within(trades, quotes, ["pair"], "ns", "ns", span, "left_semi").withColumn("supported", F.lit(True))
    no = audits.within(trades, quotes, ["pair"], "ns", "ns", span, "left_anti").withColumn("supported", F.lit(False))
    return yes.unionByName(no).select("event_id", "supported")


SUPPORT_SQL = f"""WITH {Q} SELECT event_id, EXISTS (SELECT 1 FROM q b WHERE b.kind = 'delta' AND b.venue = 'v0' AND b.pair = a.pair AND abs(b.ns - a.ns) <= 600000000000) AS supported FROM q a WHERE kind = 'delta' AND venue <> 'v0'"""


def snapshot_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reset of a book with the first unused snapshot at or after it."""
    rows = market.quotes(spark, sf_dir)
    return audits.first_unused(rows.where("kind = 'reset'"), rows.where("kind = 'snapshot'"), audits.BOOK)


def line_sql(keys: list[str], requests: str, responses: str) -> str:
    """CTEs of requests and responses (keys, ns, event_id) that wait in line, worked through one after another, and the
    final query."""
    k = ", ".join(keys)
    same = lambda x, y: " AND ".join(f"{x}.{c} = {y}.{c}" for c in keys)
    return f"""e AS (SELECT {k}, ns, 0 AS side, event_id FROM {requests} UNION ALL SELECT {k}, ns, 1, event_id FROM {responses}
), o AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY ns, side, event_id) AS i FROM e
), f AS (
  SELECT {k}, 0::BIGINT AS i, 0::BIGINT AS ns, -1 AS side, 0::BIGINT AS asked, 0::BIGINT AS used, false AS takes FROM (SELECT DISTINCT {k} FROM o)
  UNION ALL SELECT {", ".join(f"o.{c}" for c in keys)}, o.i, o.ns, o.side, asked + 1 - o.side, used + CASE WHEN o.side = 1 AND asked > used THEN 1 ELSE 0 END, o.side = 1 AND asked > used FROM f JOIN o ON {same("o", "f")} AND o.i = f.i + 1)
SELECT {", ".join(f"a.{c}" for c in keys)}, a.asked AS rank, a.ns AS request_ns, b.ns AS response_ns FROM f a LEFT JOIN f b ON b.takes AND {same("b", "a")} AND b.used = a.asked WHERE a.side = 0"""


MATCH_SQL = f"""WITH RECURSIVE {Q}, a0 AS (SELECT * FROM q WHERE kind = 'reset'), b0 AS (SELECT * FROM q WHERE kind = 'snapshot'), {line_sql(["pair", "venue"], "a0", "b0")}"""


def resync_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resets of a book beyond three within twelve hours."""
    rows = market.quotes(spark, sf_dir).where("kind = 'reset'").select("event_id", "pair", "venue", "ns")
    return audits.rate_exceeded(rows, audits.BOOK, "ns", 12 * market.NS_HOUR, 3).drop("ns")


RATE_SQL = f"""WITH {Q} SELECT * FROM (SELECT event_id, pair, venue, count(*) OVER (PARTITION BY pair, venue ORDER BY ns RANGE BETWEEN {12 * market.NS_HOUR - 1} PRECEDING AND CURRENT ROW) AS recent FROM q WHERE kind = 'reset') WHERE recent > 3"""


def coalesced_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each book's newest state by hour, left out where it shows what the last one showed."""
    rows = common.trusted_quotes(spark, sf_dir).withColumn("hour", F.floor(F.col("ns") / market.NS_HOUR).cast("long"))
    newest = rows.groupBy(*audits.BOOK, "hour").agg(F.max(F.struct(*ORDER, "trusted", "bid", "ask")).alias("x")).select(*audits.BOOK, "hour", "x.trusted", "x.bid", "x.ask")
    shown = F.struct("trusted", F.when(F.col("trusted"), F.col("bid")), F.when(F.col("trusted"), F.col("ask")))
    before = F.lag(shown).over(Window.partitionBy(*audits.BOOK).orderBy("hour"))
    return newest.withColumn("same", F.coalesce(shown.eqNullSafe(before), F.lit(False))).where("not same").drop("same")


DISPLAY_SQL = f"""WITH {T}, n AS (SELECT pair, venue, hour, x.trusted AS trusted, x.bid AS bid, x.ask AS ask FROM (SELECT pair, venue, ns // {market.NS_HOUR} AS hour, max({{'ns': ns, 'id': event_id, 'trusted': trusted, 'bid': bid, 'ask': ask}}) AS x FROM tr GROUP BY ALL)),
p AS (SELECT *, lag(trusted) OVER w AS t0, lag(bid) OVER w AS b0, lag(ask) OVER w AS a0 FROM n WINDOW w AS (PARTITION BY pair, venue ORDER BY hour))
SELECT pair, venue, hour, trusted, bid, ask FROM p WHERE NOT coalesce(t0 = trusted AND (NOT trusted OR (b0 = bid AND a0 = ask)), false)"""


def stream_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of each venue's messages, in order, by day."""
    rows = market.quotes(spark, sf_dir).withColumn("day", F.floor(F.col("ns") / market.NS_DAY).cast("long"))
    return rows.select("event_id", "venue", "day", F.row_number().over(Window.partitionBy("venue", "day").orderBy(*ORDER)).cast("long").alias("stream_sequence"))


STREAM_SQL = f"WITH {Q} SELECT event_id, venue, ns // {market.NS_DAY} AS day, row_number() OVER (PARTITION BY venue, ns // {market.NS_DAY} ORDER BY ns, event_id) AS stream_sequence FROM q"


def replay_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws("|", "venue", "kind", "ns", "bid", "ask", "event_id")
    return audits.digest(market.quotes(spark, sf_dir), "pair", F.floor(F.col("ns") / market.NS_DAY).cast("long"), line, ORDER)


DIGEST_SQL = f"""WITH {Q}, b AS (SELECT pair, ns // {market.NS_DAY} AS block, sha256(string_agg(concat_ws('|', venue, kind, ns, bid, ask, event_id), chr(10) ORDER BY ns, event_id)) AS h FROM q GROUP BY ALL)
SELECT pair, sha256(string_agg(h, chr(10) ORDER BY block)) AS digest FROM b GROUP BY pair"""


def venue_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each venue's health by its books at the last instant, and the worst of all."""
    rows = common.trusted_quotes(spark, sf_dir)
    last = rows.groupBy(*audits.BOOK).agg(F.max(F.struct(*ORDER, "trusted")).alias("x")).crossJoin(F.broadcast(rows.agg(F.max("ns").alias("now"))))
    rank: Column = F.when(~F.col("x.trusted"), 2).when(F.col("now") - F.col("x.ns") > common.MAX_AGE, 1).otherwise(0)
    by_venue = last.groupBy("venue").agg(F.sum((rank == 2).cast("int")).alias("down"), F.max(rank).alias("worst"), F.count("*").alias("books"))
    health = F.when(F.col("down") == F.col("books"), "down").when(F.col("worst") == 2, "degraded").when(F.col("worst") == 1, "stale").otherwise("ok")
    return by_venue.select("venue", "books", "down", health.alias("health"))


HEALTH_SQL = f"""WITH {T}, l AS (SELECT pair, venue, max({{'ns': ns, 'id': event_id, 'trusted': trusted}}) AS x FROM tr GROUP BY ALL),
r AS (SELECT venue, CASE WHEN NOT x.trusted THEN 2 WHEN (SELECT max(ns) FROM tr) - x.ns > {common.MAX_AGE} THEN 1 ELSE 0 END AS k FROM l)
SELECT venue, count(*) AS books, count(*) FILTER (k = 2) AS down, CASE WHEN count(*) FILTER (k = 2) = count(*) THEN 'down' WHEN max(k) = 2 THEN 'degraded' WHEN max(k) = 1 THEN 'stale' ELSE 'ok' END AS health FROM r GROUP BY venue"""


def symbol_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols made of customers' segments and quote assets, as pairs with their parts."""
    tail = F.element_at(F.array(*map(F.lit, ["usdt", "USDC", "busd", "usd", "eur", ""])), (F.col("c_custkey") % 6 + 1).cast("int"))
    head = F.when(F.col("c_custkey") % 10 == 0, "").otherwise(F.lower(F.substring("c_mktsegment", 1, 3)))
    pair = symbols.split_suffix(F.concat(head, tail))
    return table(spark, sf_dir, "customer").select("c_custkey", pair.alias("pair"), symbols.base_of(pair).alias("base"), symbols.quote_of(pair).alias("quote"))


SYMBOL_SQL = """WITH s AS (SELECT c_custkey, upper(CASE WHEN c_custkey % 10 = 0 THEN '' ELSE substr(c_mktsegment, 1, 3) END || ['usdt', 'USDC', 'busd', 'usd', 'eur', ''][c_custkey % 6 + 1]) AS u FROM customer),
p AS (SELECT c_custkey, CASE WHEN u LIKE '_%USDT' THEN left(u, -4) || '-USDT' WHEN u LIKE '_%USDC' THEN left(u, -4) || '-USDC' WHEN u LIKE '_%BUSD' THEN left(u, -4) || '-BUSD' WHEN u LIKE '_%USD' THEN left(u, -3) || '-USD' ELSE u END AS pair FROM s)
SELECT c_custkey, pair, regexp_extract(pair, '^(.*)-[^-]*$', 1) AS base, string_split(pair, '-')[-1] AS quote FROM p"""


def frame_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes written as the three venues' messages and decoded again."""
    rows = market.quotes(spark, sf_dir)
    return messages.decode(messages.encode(rows)).select("event_id", "venue", "symbol", "first_id", "last_id", F.col("bids")[0]["price"].cast("string").alias("bid"), F.col("asks")[0]["size"].cast("string").alias("ask_size"), F.size("bids").alias("n_bids"))


PARSE_SQL = f"""WITH {Q} SELECT event_id, venue, pair AS symbol, event_id AS first_id, event_id + CASE WHEN venue = 'v1' THEN 0 ELSE 2 END AS last_id, printf('%.8f', bid::DOUBLE) AS bid, printf('%.8f', ask_size::DOUBLE) AS ask_size, 2::INTEGER AS n_bids FROM q"""

QUERIES = {
    "chain_audit": (chain_audit, CHAIN_SQL),
    "drift_counts": (drift_counts, DRIFT_SQL),
    "snapshot_alignment": (snapshot_alignment, ALIGN_SQL),
    "envelope_audit": (envelope_audit, ENVELOPE_SQL),
    "reconcile_difference": (reconcile_difference, DIFFERENCE_SQL),
    "reconcile_evidence": (reconcile_evidence, EVIDENCE_SQL),
    "nearest_levels": (nearest_levels, NEAREST_SQL),
    "reconcile_streaks": (reconcile_streaks, STREAKS_SQL),
    "outage_windows": (outage_windows, OUTAGES_SQL),
    "recovery_durations": (recovery_durations, RECOVERY_SQL),
    "latency_distribution": (latency_distribution, LATENCY_SQL),
    "unmatched_events": (unmatched_events, UNMATCHED_SQL),
    "phantom_episodes": (phantom_episodes, PHANTOM_SQL),
    "trade_support": (trade_support, SUPPORT_SQL),
    "snapshot_match": (snapshot_match, MATCH_SQL),
    "resync_rate": (resync_rate, RATE_SQL),
    "coalesced_display": (coalesced_display, DISPLAY_SQL),
    "stream_sequence": (stream_sequence, STREAM_SQL),
    "replay_digest": (replay_digest, DIGEST_SQL),
    "venue_health": (venue_health, HEALTH_SQL),
    "symbol_normalize": (symbol_normalize, SYMBOL_SQL),
    "frame_parse": (frame_parse, PARSE_SQL),
}
