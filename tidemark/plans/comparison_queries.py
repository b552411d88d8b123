"""Queries that hold books against snapshots, and rules against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import asof, book, comparisons
from tidemark.plans import common
from tidemark.session import settled, table
from tidemark.sources import market

Q, T = common.QUOTES, common.TRUSTED
DAY, HOUR = market.NS_DAY, market.NS_HOUR
#: Update ids at which snapshots are taken, and how many rows a snapshot leaves out.
AT_IDS = (20_000, 100_000, 200_000)
#: Update ids of one bin in which levels and snapshots meet.
ID_WIDTH = 20_000


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level updates of every book, `pair` being its pair and venue."""
    return market.levels(spark, sf_dir).select(F.concat_ws("/", "pair", "venue").alias("pair"), "side", "price", "size", F.col("seq").alias("update_id"), "ns")


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.createDataFrame([(k, x) for k, x in enumerate(AT_IDS)], "k int, at_id long")
    pairs = _actions(spark, sf_dir).select("pair").distinct()
    return pairs.crossJoin(F.broadcast(ids)).select(F.concat_ws("@", "pair", F.col("at_id").cast("string")).alias("id"), "pair", "at_id")


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(what a REST snapshot shows, which missed every 19th action; the stream's books at the same ids)."""
    actions, targets = _actions(spark, sf_dir), _targets(spark, sf_dir)
    rest = comparisons.book_at(actions.where("update_id % 19 <> 0"), targets, ID_WIDTH).where("size > 0")
    return rest, comparisons.book_at(actions, targets, ID_WIDTH)


ACTIONS = (
    common.LEVELS
    + f""", ac AS (SELECT pair || '/' || venue AS pair, side, price, size, seq AS update_id, ns FROM lv
), tg AS (SELECT pair || '@' || at_id AS id, pair, at_id FROM (SELECT DISTINCT pair FROM ac), (VALUES {", ".join(f"({x})" for x in AT_IDS)}) t(at_id)
), bk AS (SELECT id, pair, side, price, arg_max(size, (update_id, size <= 0)) AS size FROM ac JOIN tg USING (pair) WHERE update_id <= at_id GROUP BY ALL
), rt AS (SELECT id, pair, side, price, arg_max(size, (update_id, size <= 0)) AS size FROM ac JOIN tg USING (pair) WHERE update_id <= at_id AND update_id % 19 <> 0 GROUP BY ALL
), td AS (SELECT DISTINCT pair, price FROM ac WHERE size = 7
), cp AS (SELECT coalesce(r.id, b.id) AS id, coalesce(r.pair, b.pair) AS pair, coalesce(r.side, b.side) AS side, coalesce(r.price, b.price) AS price, r.size AS rs, b.size AS bs
  FROM (SELECT * FROM rt WHERE size > 0) r FULL JOIN bk b ON b.id = r.id AND b.side = r.side AND b.price = r.price WHERE r.size IS NOT NULL OR b.size > 0
), oc AS (SELECT *, CASE WHEN rs IS NULL THEN 'stream_only' WHEN bs IS NULL OR bs <= 0 THEN 'rest_only' WHEN rs = bs THEN 'exact_match' ELSE 'size_differs' END AS outcome FROM cp
), sc AS (SELECT id, pair, side, price, outcome, CASE WHEN outcome = 'rest_only' THEN CASE WHEN bs IS NULL THEN 'never' ELSE 'deleted' END END AS last_action,
    CASE WHEN outcome = 'rest_only' THEN (pair, price) IN (SELECT (pair, price) FROM td) END AS traded FROM oc)"""
)


def _audit(spark: SparkSession, sf_dir: str, rest: DataFrame, stream: DataFrame) -> DataFrame:
    traded = _actions(spark, sf_dir).where("size = 7").select("pair", "price")
    return comparisons.snapshot_comparison(rest, stream, traded)


def snapshot_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots against the stream's books at their very ids, level by level; lots of 7 count as trades."""
    return _audit(spark, sf_dir, *_snapshots(spark, sf_dir))


AUDIT_SQL = f"WITH {ACTIONS} SELECT * FROM sc"


def snapshot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparisons by outcome and pair, and what a snapshot alone has by its last action and trades."""
    rows = snapshot_audit(spark, sf_dir)
    return rows.groupingSets([["pair", "outcome"], ["outcome"], ["last_action", "traded"]], "pair", "outcome", "last_action", "traded").agg(F.count("*").alias("n"))


COUNTS_SQL = f"WITH {ACTIONS} SELECT pair, outcome, last_action, traded, count(*) AS n FROM sc GROUP BY GROUPING SETS ((pair, outcome), (outcome), (last_action, traded))"


def discrepancy_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discrepancies by kind and by how deep in the snapshot's side they stand."""
    rest, stream = _snapshots(spark, sf_dir)
    rest = settled(rest, "rest")  # ranked, and compared
    deep = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    ranks = rest.withColumn("rank", F.row_number().over(Window.partitionBy("id", "side").orderBy(deep)) - 1).select("id", "side", "price", "rank")
    rows = _audit(spark, sf_dir, rest, stream).where("outcome in ('rest_only', 'size_differs')").join(ranks, ["id", "side", "price"])
    return rows.groupBy("outcome", comparisons.rank_bucket(F.col("rank")).alias("ranks")).agg(F.count("*").alias("n"))


RANKS_SQL = f"""WITH {ACTIONS}, rk AS (SELECT id, side, price, row_number() OVER (PARTITION BY id, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END) - 1 AS r FROM rt WHERE size > 0)
SELECT outcome, CASE WHEN r = 0 THEN 'best' WHEN r <= 4 THEN '1-4' WHEN r <= 19 THEN '5-19' ELSE 'deeper' END AS ranks, count(*) AS n FROM sc JOIN rk USING (id, side, price) WHERE outcome IN ('rest_only', 'size_differs') GROUP BY ALL"""


def drift_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books that missed every 23rd action, against fresh ones; a price not mentioned for two years is stale."""
    actions = _actions(spark, sf_dir)
    key = ["pair", "side", "price"]
    levels = lambda rows: rows.groupBy(*key).agg(F.max_by("size", "update_id").alias("size")).where("size > 0")
    mentions = actions.groupBy(*key).agg(F.max("ns").alias("seen_ns"))
    now = F.broadcast(actions.agg(F.max("ns").alias("now")))
    rows = comparisons.drift_classes(levels(actions.where("update_id % 23 <> 0")), levels(actions), mentions.crossJoin(now), F.col("now"), 730 * DAY)
    return rows.groupingSets([["pair", "drift"], ["drift"]], "pair", "drift").agg(F.count("*").alias("n"))


DRIFT_SQL = f"""WITH {ACTIONS}, f AS (SELECT * FROM (SELECT pair, side, price, arg_max(size, update_id) AS size, max(ns) AS seen FROM ac GROUP BY ALL)), o AS (SELECT * FROM (SELECT pair, side, price, arg_max(size, update_id) AS size FROM ac WHERE update_id % 23 <> 0 GROUP BY ALL) WHERE size > 0
), d AS (SELECT f.pair, CASE WHEN o.size IS NULL AND f.size > 0 THEN 'missing_' WHEN f.size <= 0 THEN 'ghost_' WHEN o.size = f.size THEN 'agree' ELSE 'size_differs' END AS k, CASE WHEN (SELECT max(ns) FROM ac) - seen > {730 * DAY} THEN 'stale' ELSE 'unannounced' END AS a
  FROM f LEFT JOIN o USING (pair, side, price) WHERE f.size > 0 OR o.size IS NOT NULL
), e AS (SELECT pair, CASE WHEN k LIKE '%\\_' ESCAPE '\\' THEN k || a ELSE k END AS drift FROM d)
SELECT pair, drift, count(*) AS n FROM e GROUP BY GROUPING SETS ((pair, drift), (drift))"""


def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive weeks in which a book's price got no lot of less than 20, as disagreements that last."""
    rows = _actions(spark, sf_dir).select("pair", "side", "price", F.floor(F.col("ns") / (7 * DAY)).cast("long").alias("week"), "size").groupBy("pair", "side", "price", "week").agg(F.min("size").alias("least")).where("least >= 20")
    return comparisons.run_lengths(rows, ["pair", "side", "price"], "week")


_RUNS = f"""{ACTIONS}, wk AS (SELECT pair, side, price, week FROM (SELECT pair, side, price, ns // {7 * DAY} AS week, min(size) AS least FROM ac GROUP BY ALL) WHERE least >= 20
), rl AS (SELECT pair, side, price, min(week) AS first, count(*) AS length FROM (SELECT *, week - row_number() OVER (PARTITION BY pair, side, price ORDER BY week) AS g FROM wk) GROUP BY pair, side, price, g)"""
RUNS_SQL = f"WITH {_RUNS} SELECT * FROM rl"


def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By pair: runs, those that healed after one comparison, the median, runs over two, and the longest."""
    return run_lengths(spark, sf_dir).groupBy("pair").agg(F.count("*").alias("runs"), F.count_if(F.col("length") == 1).alias("healed"), F.percentile("length", 0.5).alias("median"), F.count_if(F.col("length") > 2).alias("over_2"), F.max("length").alias("longest"))


RUN_STATS_SQL = f"WITH {_RUNS} SELECT pair, count(*) AS runs, count(*) FILTER (length = 1) AS healed, median(length)::DOUBLE AS median, count(*) FILTER (length > 2) AS over_2, max(length) AS longest FROM rl GROUP BY pair"


def reconcile_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response an hour after each snapshot's request, against the book before the request and at the
    response: the difference of sizes in per cent that both brackets bear out, at 50 % and of one sign."""
    rows = market.quotes(spark, sf_dir).where("kind <> 'reset'")
    asked = rows.where("kind = 'snapshot'").select("event_id", "pair", "venue", "ns", F.col("bid_size").alias("rest"), (F.col("ns") - 1).alias("before_ns"), (F.col("ns") + HOUR).alias("after_ns"))
    books = rows.where("kind = 'delta'").select("pair", "venue", F.col("ns").alias("book_ns"), F.col("event_id").alias("book_id"), "bid_size")
    # Two as-of joins: strictly before the request, and at or before the response.
    first = asof.asof_join(asked, books, ["pair", "venue"], "before_ns", "book_ns", ["book_id"], ["bid_size"], DAY).withColumnRenamed("bid_size", "before_size")
    both = asof.asof_join(first, books, ["pair", "venue"], "after_ns", "book_ns", ["book_id"], ["bid_size"], DAY).withColumnRenamed("bid_size", "after_size")
    per_cent = lambda c: F.floor((F.col("rest") - F.col(c)) * 100 / F.col(c)).cast("long")
    found = comparisons.corroborated(per_cent("before_size"), per_cent("after_size"), 50)
    return both.select("event_id", "before_size", "after_size", found.alias("difference"), F.coalesce(F.signum(per_cent("before_size")) == F.signum(per_cent("after_size")), F.lit(False)).alias("same_sign"))


BRACKETS_SQL = f"""WITH {Q}, b AS (SELECT * FROM q WHERE kind = 'delta'), a AS (
  SELECT s.event_id, s.bid_size AS rest, (SELECT arg_max(bid_size, (ns, event_id)) FROM b WHERE b.pair = s.pair AND b.venue = s.venue AND b.ns < s.ns) AS x, (SELECT arg_max(bid_size, (ns, event_id)) FROM b WHERE b.pair = s.pair AND b.venue = s.venue AND b.ns <= s.ns + {HOUR}) AS y
  FROM q s WHERE kind = 'snapshot'
), d AS (SELECT *, CAST(floor((rest - x) * 100 / x) AS BIGINT) AS p, CAST(floor((rest - y) * 100 / y) AS BIGINT) AS r FROM a)
SELECT event_id, x AS before_size, y AS after_size, CASE WHEN sign(p) = sign(r) AND abs(p) >= 50 AND abs(r) >= 50 THEN CASE WHEN abs(p) <= abs(r) THEN p ELSE r END END AS difference, coalesce(sign(p) = sign(r), false) AS same_sign FROM d"""


def _triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disagreements of a book: asks over 10,100, once for each instant."""
    return market.quotes(spark, sf_dir).where("kind = 'delta' and ask > 10100").groupBy("pair", "venue", "ns").agg(F.min("event_id").alias("event_id"))


def reconcile_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which disagreements ask for a resync when there is none within a day of the last."""
    return comparisons.with_cooldown(_triggers(spark, sf_dir), book.BOOK, "ns", DAY).select("event_id", "pair", "venue", "fired")


_COOL = f"""{Q}, tg AS (SELECT pair, venue, ns, min(event_id) AS event_id, row_number() OVER (PARTITION BY pair, venue ORDER BY ns) AS n FROM q WHERE kind = 'delta' AND ask > 10100 GROUP BY pair, venue, ns
), fl AS (SELECT pair, venue, ns, event_id, n, true AS fired, ns AS last FROM tg WHERE n = 1
  UNION ALL SELECT t.pair, t.venue, t.ns, t.event_id, t.n, t.ns - f.last >= {DAY}, CASE WHEN t.ns - f.last >= {DAY} THEN t.ns ELSE f.last END FROM fl f JOIN tg t ON t.pair = f.pair AND t.venue = f.venue AND t.n = f.n + 1)"""
COOLDOWN_SQL = f"WITH RECURSIVE {_COOL} SELECT event_id, pair, venue, fired FROM fl"


def reconcile_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resyncs that each rule would have asked for: every disagreement, those past the cooldown, and those that
    also repeat within six hours; with the recoveries (a snapshot within two days) of each."""
    fired = comparisons.with_cooldown(_triggers(spark, sf_dir), book.BOOK, "ns", DAY)
    again = asof.asof_join(fired, _triggers(spark, sf_dir).select("pair", "venue", (F.col("ns") + 1).alias("seen_ns"), F.col("ns").alias("earlier"), F.col("event_id").alias("seen_id")), book.BOOK, "ns", "seen_ns", ["seen_id"], ["earlier"], DAY, 6 * HOUR)
    shots = market.quotes(spark, sf_dir).where("kind = 'snapshot'").select("pair", "venue", F.col("ns").alias("shot_ns"), F.floor(F.col("ns") / (2 * DAY)).alias("bin"))
    rows = again.withColumn("bin", F.explode(F.array(F.floor(F.col("ns") / (2 * DAY)), F.floor(F.col("ns") / (2 * DAY)) + 1)))
    near = rows.join(shots, [*book.BOOK, "bin"]).where((F.col("shot_ns") > F.col("ns")) & (F.col("shot_ns") <= F.col("ns") + 2 * DAY)).select("event_id").distinct().withColumn("recovered", F.lit(True))
    met = again.join(near, "event_id", "left").withColumn("recovered", F.coalesce("recovered", F.lit(False)))
    rules = F.filter(F.array(F.lit("every"), F.when(F.col("fired"), "cooldown"), F.when(F.col("fired") & F.col("earlier").isNotNull(), "repeated")), lambda r: r.isNotNull())
    return met.select(F.explode(rules).alias("rule"), "pair", "recovered").groupBy("rule", "pair").agg(F.count("*").alias("resyncs"), F.count_if("recovered").alias("recovered"))


RULES_SQL = f"""WITH RECURSIVE {_COOL}, m AS (SELECT f.*, EXISTS (SELECT 1 FROM tg t WHERE t.pair = f.pair AND t.venue = f.venue AND t.ns < f.ns AND f.ns - (t.ns + 1) <= {6 * HOUR}) AS again,
  EXISTS (SELECT 1 FROM q s WHERE s.kind = 'snapshot' AND s.pair = f.pair AND s.venue = f.venue AND s.ns > f.ns AND s.ns <= f.ns + {2 * DAY}) AS rec FROM fl f)
SELECT rule, pair, count(*) AS resyncs, count(*) FILTER (rec) AS recovered FROM (SELECT 'every' AS rule, * FROM m UNION ALL SELECT 'cooldown', * FROM m WHERE fired UNION ALL SELECT 'repeated', * FROM m WHERE fired AND again) GROUP BY rule, pair"""


def expected_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books that the roster of all pairs and venues expects and the first day's events don't show."""
    rows = market.quotes(spark, sf_dir)
    first = rows.agg(F.min("ns").alias("start"))
    seen = rows.crossJoin(F.broadcast(first)).where(F.col("ns") < F.col("start") + DAY).select("pair", "venue")
    every = rows.select("pair").distinct().crossJoin(F.broadcast(rows.select("venue").distinct()))
    return every.join(seen, book.BOOK, "left_anti")


EXPECTED_SQL = f"WITH {Q} SELECT p.pair, v.venue FROM (SELECT DISTINCT pair FROM q) p, (SELECT DISTINCT venue FROM q) v EXCEPT SELECT pair, venue FROM q WHERE ns < (SELECT min(ns) FROM q) + {DAY}"


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a live feed: numbers by venue with holes and repeats, and types that aren't known."""
    kind = F.when(F.col("event_id") % 71 == 0, "gossip").when(F.col("kind") == "snapshot", "snapshot").otherwise("update")
    rows = market.quotes(spark, sf_dir).withColumn("type", kind).withColumn("block", F.floor(F.col("ns") / DAY).cast("long"))
    numbered = asof.running(rows, ["venue"], ["ns", "event_id"], {"n": ("sum", F.lit(1), True)})
    return numbered.select("event_id", "venue", "ns", "type", "block", (F.col("n") + F.when(F.col("event_id") % 73 == 0, 2).otherwise(0)).alias("seq"))


LIVE = f"""{Q}, lf AS (SELECT event_id, venue, ns, CASE WHEN event_id % 71 = 0 THEN 'gossip' WHEN kind = 'snapshot' THEN 'snapshot' ELSE 'update' END AS type,
  row_number() OVER (PARTITION BY venue ORDER BY ns, event_id) + CASE WHEN event_id % 73 = 0 THEN 2 ELSE 0 END AS seq FROM q
), lv2 AS (SELECT *, lag(seq) OVER w AS p, row_number() OVER w AS k FROM lf WINDOW w AS (PARTITION BY venue ORDER BY ns, event_id)
), lc AS (SELECT *, CASE WHEN type = 'gossip' THEN 'unknown_type' WHEN k = 1 AND type <> 'snapshot' THEN 'not_a_snapshot_first' WHEN seq <= 0 THEN 'bad_sequence' WHEN seq <> p + 1 THEN 'gap' ELSE 'ok' END AS verdict FROM lv2)"""


def live_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each live frame's verdict: its type, the first one's, its number, and whether it follows the last."""
    rows = _live(spark, sf_dir)
    # The number before is the next frame's; by blocks, a frame's follower is found from the other end.
    back = rows.withColumn("block", -F.col("block")).withColumn("_ns", -F.col("ns")).withColumn("_id", -F.col("event_id"))
    found = asof.following(back, ["venue"], ["_ns", "_id"], F.col("seq"), "before")
    verdict = F.when(F.col("type") == "gossip", "unknown_type").when(F.col("before").isNull() & (F.col("type") != "snapshot"), "not_a_snapshot_first").when(F.col("seq") <= 0, "bad_sequence").when(F.col("seq") != F.col("before") + 1, "gap").otherwise("ok")
    return found.select("event_id", "venue", "type", "seq", verdict.alias("verdict"))


LIVE_SQL = f"WITH {LIVE} SELECT event_id, venue, type, seq, verdict FROM lc"


def live_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a consumer saw: frames by type and verdict, with the last number."""
    return live_frames(spark, sf_dir).groupBy("venue", "type", "verdict").agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"))


LIVE_SUMMARY_SQL = f"WITH {LIVE} SELECT venue, type, verdict, count(*) AS n, max(seq) AS last_seq FROM lc GROUP BY ALL"


def adapter_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each venue's last message's age at the end, its counts by kind, whether host and venue were up, and the
    worst health of all venues beside it."""
    rows = common.trusted_quotes(spark, sf_dir)
    end = F.broadcast(rows.agg(F.max("ns").alias("now")))
    n = lambda k: F.count_if(F.col("kind") == k).alias(f"{k}s")
    by = rows.groupBy("venue").agg(F.max("ns").alias("last"), n("snapshot"), n("delta"), n("reset"), F.max_by("trusted", F.struct("ns", "event_id")).alias("up")).crossJoin(end)
    online = F.col("resets") % 2 == 0
    host = F.when(F.col("up") & online, "connected").when(F.col("up"), "host_offline").when(online, "backend_down").otherwise("both_down")
    rank = F.when(~F.col("up"), 3).when(F.col("now") - F.col("last") > HOUR, 2).when(F.col("resets") > 0, 1).otherwise(0)
    ranked = by.withColumn("rank", rank)
    name = lambda r: F.element_at(F.array(*map(F.lit, ["ok", "degraded", "stale", "down"])), r + 1)
    worst = F.broadcast(ranked.agg(F.max("rank").alias("top")))
    return ranked.crossJoin(worst).select("venue", (F.col("now") - F.col("last")).alias("age"), "snapshots", "deltas", "resets", host.alias("connectivity"), name(F.col("rank")).alias("health"), name(F.col("top")).alias("worst"))


STATUS_SQL = f"""WITH {T}, b AS (SELECT venue, max(ns) AS last, count(*) FILTER (kind = 'snapshot') AS snapshots, count(*) FILTER (kind = 'delta') AS deltas, count(*) FILTER (kind = 'reset') AS resets, arg_max(trusted, (ns, event_id)) AS up, (SELECT max(ns) FROM tr) AS now FROM tr GROUP BY venue
), r AS (SELECT *, CASE WHEN NOT up THEN 3 WHEN now - last > {HOUR} THEN 2 WHEN resets > 0 THEN 1 ELSE 0 END AS k FROM b)
SELECT venue, now - last AS age, snapshots, deltas, resets, CASE WHEN up AND resets % 2 = 0 THEN 'connected' WHEN up THEN 'host_offline' WHEN resets % 2 = 0 THEN 'backend_down' ELSE 'both_down' END AS connectivity,
  ['ok', 'degraded', 'stale', 'down'][k + 1] AS health, ['ok', 'degraded', 'stale', 'down'][max(k) OVER () + 1] AS worst FROM r"""


def metric_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters written as metrics' text lines and read back by label, with the first and last of each day."""
    rows = market.quotes(spark, sf_dir)
    day = F.floor(F.col("ns") / DAY).cast("long")
    line = F.concat(F.lit('events_total{venue="'), F.col("venue"), F.lit('",kind="'), F.col("kind"), F.lit('"} '), F.col("event_id").cast("string"))
    text = rows.select(day.alias("day"), F.when(F.col("event_id") % 29 == 0, F.concat(F.lit("# HELP "), line)).otherwise(line).alias("line"))
    got = lambda k: F.regexp_extract("line", r'^events_total\{venue="([^"]*)",kind="([^"]*)"\} ([0-9]+)\z', k)
    read = text.select("day", got(1).alias("venue"), got(2).alias("kind"), got(3).alias("value")).where("value <> ''").withColumn("value", F.col("value").cast("long"))
    return read.groupBy("venue", "kind", "day").agg(F.count("*").alias("lines"), (F.max("value") - F.min("value")).alias("change"))


METRICS_SQL = f"WITH {Q} SELECT venue, kind, ns // {DAY} AS day, count(*) AS lines, max(event_id) - min(event_id) AS change FROM q WHERE event_id % 29 <> 0 GROUP BY ALL"


def time_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations such as 90s, 10m or 1h, and times that must have a zone, in nanoseconds; null if they are bad."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey")
    number, unit = F.col("n_nationkey"), F.element_at(F.array(*map(F.lit, ["s", "m", "h", "d", "ms"])), (F.col("n_nationkey") % 5 + 1).cast("int"))
    text = F.concat(number.cast("string"), unit)
    amount, of = F.regexp_extract(text, r"^([0-9]+)([smh])\z", 1), F.regexp_extract(text, r"^([0-9]+)([smh])\z", 2)
    seconds = F.when(of == "s", 1).when(of == "m", 60).when(of == "h", 3600)
    iso = F.concat(F.lit("2024-01-"), F.lpad((number % 28 + 1).cast("string"), 2, "0"), F.lit("T10:00:00"), F.when(number % 3 == 0, "+02:00").when(number % 3 == 1, "Z").otherwise(""))
    zoned = F.when(iso.rlike(r"(Z|[+-][0-9]{2}:[0-9]{2})\z"), F.unix_micros(F.to_timestamp(iso)) * 1000)
    return rows.select("n_nationkey", text.alias("text"), (F.when(amount != "", amount.cast("long")) * seconds * 10**9).alias("duration_ns"), zoned.alias("zoned_ns"), (F.unix_micros(F.to_timestamp(iso)) * 1000).alias("utc_ns"))


LITERALS_SQL = """WITH n AS (SELECT n_nationkey, n_nationkey || ['s', 'm', 'h', 'd', 'ms'][n_nationkey % 5 + 1] AS text, epoch_us(make_timestamp(2024, 1, (n_nationkey % 28 + 1)::BIGINT, 10, 0, 0)) * 1000 - CASE WHEN n_nationkey % 3 = 0 THEN 7200000000000 ELSE 0 END AS t FROM nation)
SELECT n_nationkey, text, CASE n_nationkey % 5 WHEN 0 THEN n_nationkey::BIGINT * 1000000000 WHEN 1 THEN n_nationkey::BIGINT * 60000000000 WHEN 2 THEN n_nationkey::BIGINT * 3600000000000 END AS duration_ns, CASE WHEN n_nationkey % 3 < 2 THEN t END AS zoned_ns, t AS utc_ns FROM n"""

def reconcile_set_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly comparisons of each book whose wrong levels are the same set as the weeks before: a side and hundred of
    prices is wrong in a week where its sizes add up to a multiple of three."""
    week = F.floor(F.col("ns") / (7 * DAY)).cast("long")
    rows = market.levels(spark, sf_dir).groupBy("pair", "venue", week.alias("week"), "side", F.floor(F.col("price") / 100).cast("long").alias("hundred")).agg(F.sum("size").alias("total"))
    signs = comparisons.signatures(rows.where("total % 3 = 0"), ["pair", "venue", "week"], ["side", "hundred"])
    return comparisons.set_streaks(signs, ["pair", "venue"], "week", 26).drop("sign")


SET_STREAKS_SQL = f"""WITH {common.LEVELS}, t AS (SELECT pair, venue, ns // {7 * DAY} AS week, side, price // 100 AS hundred FROM lv GROUP BY ALL HAVING sum(size) % 3 = 0
), s AS (SELECT pair, venue, week, count(*) AS n, list(side || hundred ORDER BY side, hundred) AS own FROM t GROUP BY ALL
), f AS (SELECT *, CASE WHEN own = lag(own) OVER w AND week = lag(week) OVER w + 1 THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY pair, venue ORDER BY week)
), r AS (SELECT *, sum(new) OVER (PARTITION BY pair, venue ORDER BY week) AS run FROM f)
SELECT pair, venue, week, n, row_number() OVER (PARTITION BY pair, venue, run ORDER BY week) AS streak FROM r"""

QUERIES = {
    "reconcile_set_streaks": (reconcile_set_streaks, SET_STREAKS_SQL),
    "snapshot_audit": (snapshot_audit, AUDIT_SQL),
    "snapshot_counts": (snapshot_counts, COUNTS_SQL),
    "discrepancy_ranks": (discrepancy_ranks, RANKS_SQL),
    "drift_classes": (drift_classes, DRIFT_SQL),
    "run_lengths": (run_lengths, RUNS_SQL),
    "run_stats": (run_stats, RUN_STATS_SQL),
    "reconcile_brackets": (reconcile_brackets, BRACKETS_SQL),
    "reconcile_cooldown": (reconcile_cooldown, COOLDOWN_SQL),
    "reconcile_rules": (reconcile_rules, RULES_SQL),
    "expected_books": (expected_books, EXPECTED_SQL),
    "live_frames": (live_frames, LIVE_SQL),
    "live_summary": (live_summary, LIVE_SUMMARY_SQL),
    "adapter_status": (adapter_status, STATUS_SQL),
    "metric_counts": (metric_counts, METRICS_SQL),
    "time_literals": (time_literals, LITERALS_SQL),
}
