"""Queries over stored episodes: statistics, history pages, export, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import history, stats
from tidemark.plans import common, market_queries
from tidemark.sources import market

E = common.EPISODES
WINDOWS = {"1h": market.NS_HOUR, "4h": 4 * market.NS_HOUR, "24h": market.NS_DAY, "72h": 3 * market.NS_DAY, "1w": 7 * market.NS_DAY}


def minute_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.episode_store(spark, sf_dir).rollup()


def _rollup_sql(rows: str, width: int) -> str:
    return f"SELECT start_ns // {width} * {width} AS bucket_ns, pair, quote, count(*) AS n, max(peak_spread) AS max_spread, sum(peak_spread)::BIGINT AS sum_spread, sum(peak_profit)::BIGINT AS sum_profit FROM {rows} GROUP BY ALL"


ROLLUP_SQL = f"WITH {E} {_rollup_sql('ep', market.NS_MINUTE)}"


def window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.by_window(common.episode_store(spark, sf_dir).episodes(), WINDOWS)


WINDOWS_SQL = f"""WITH {E} SELECT label, quote, count(*) AS n, max(peak_spread) AS max_spread, sum(peak_profit)::BIGINT AS profit
FROM ep, (VALUES {", ".join(f"('{k}', {v})" for k, v in WINDOWS.items())}) w(label, span) WHERE start_ns >= (SELECT max(start_ns) FROM ep) - span GROUP BY ALL"""


def rollup_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals from 2024-01-12 00:30:30 on: the part of the first minute from the episodes, whole minutes
    from the rollup."""
    store = common.episode_store(spark, sf_dir)
    start = 1_705_019_430 * 10**9
    whole = (start + market.NS_MINUTE - 1) // market.NS_MINUTE * market.NS_MINUTE
    first, rest = stats.rollup(store.episodes(start, whole), market.NS_MINUTE), store.rollup(whole)
    return first.unionByName(rest).groupBy("quote").agg(F.sum("n").alias("n"), F.max("max_spread").alias("max_spread"), F.sum("sum_profit").alias("profit"))


ROLLUP_WINDOW_SQL = f"WITH {E} SELECT quote, count(*) AS n, max(peak_spread) AS max_spread, sum(peak_profit)::BIGINT AS profit FROM ep WHERE start_ns >= 1705019430000000000 GROUP BY quote"


def extended_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = common.episode_store(spark, sf_dir).episodes()
    by_pair = found.groupBy("pair").agg(F.count("*").alias("n"), F.max("peak_spread").alias("max_spread"), F.sum("peak_spread").alias("total"))
    all_ = by_pair.agg(F.sum("n").alias("n"), F.max("max_spread").alias("max_spread"), F.floor(F.sum("total") / F.sum("n")).cast("long").alias("mean_spread"))
    best = stats.most_common(by_pair, "pair", latest=False).select(F.col("pair").alias("top_pair"), F.col("n").alias("top_n"))
    return all_.crossJoin(best)


EXTENDED_SQL = f"""WITH {E}, bp AS (SELECT pair, count(*) AS n FROM ep GROUP BY pair ORDER BY n DESC, pair LIMIT 1)
SELECT count(*) AS n, max(peak_spread) AS max_spread, CAST(floor(sum(peak_spread) / count(*)) AS BIGINT) AS mean_spread, (SELECT pair FROM bp) AS top_pair, (SELECT n FROM bp) AS top_n FROM ep"""


def peak_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = common.episode_store(spark, sf_dir).episodes().groupBy(stats.floor_to(F.col("start_ns"), market.NS_MINUTE).alias("bucket_ns")).agg(F.count("*").alias("n"))
    return stats.most_common(counts, "bucket_ns", latest=True)


PEAK_SQL = f"WITH {E} SELECT start_ns // {market.NS_MINUTE} * {market.NS_MINUTE} AS bucket_ns, count(*) AS n FROM ep GROUP BY ALL ORDER BY n DESC, bucket_ns DESC LIMIT 1"


SINCE = 1_705_019_430 * 10**9


def system_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statistics of the window from 2024-01-12 00:30:30 on in one row: what the first, partial minute has comes from its
    episodes, whole minutes from the rollup, and lifetimes from the window's episodes."""
    held = common.episode_store(spark, sf_dir)
    whole = (SINCE + market.NS_MINUTE - 1) // market.NS_MINUTE * market.NS_MINUTE
    by_minute = stats.rollup(held.episodes(SINCE, whole), market.NS_MINUTE).unionByName(held.rollup(whole))
    lives = held.episodes(SINCE).where("end_ns is not null").select((F.col("end_ns") - F.col("start_ns")).alias("life"))
    return stats.window_summary(by_minute, lives)


_OF = f"(SELECT * FROM ep WHERE start_ns >= {SINCE})"
STATS_SQL = f"""WITH {E}, w AS {_OF}, p AS (SELECT quote, sum(peak_profit) AS p FROM w GROUP BY quote), l AS (SELECT list(end_ns - start_ns ORDER BY end_ns - start_ns) AS v FROM w WHERE end_ns IS NOT NULL
), t AS (SELECT pair, count(*) AS n FROM w GROUP BY pair ORDER BY n DESC, pair LIMIT 1), m AS (SELECT start_ns // {market.NS_MINUTE} * {market.NS_MINUTE} AS b, count(*) AS n FROM w GROUP BY b ORDER BY n DESC, b DESC LIMIT 1)
SELECT count(*) AS n, max(peak_spread) AS max_spread, CAST(floor(sum(peak_spread) / count(*)) AS BIGINT) AS mean_spread, (SELECT string_agg(quote || '=' || p, ';' ORDER BY quote || '=' || p) FROM p) AS profit,
  (SELECT pair FROM t) AS top_pair, (SELECT n FROM t) AS top_n, (SELECT b FROM m) AS peak_minute_ns, (SELECT n FROM m) AS peak_n, (SELECT coalesce(len(v), 0) FROM l) AS closed,
  (SELECT v[1 + least(len(v) - 1, CAST(floor(len(v) * 0.5) AS BIGINT))] FROM l) AS life_p50, (SELECT v[1 + least(len(v) - 1, CAST(floor(len(v) * 0.9) AS BIGINT))] FROM l) AS life_p90, (SELECT v[-1] FROM l) AS life_max FROM w"""


def system_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of the system in one row: open episodes, those of the last 24 hours with their widest spread, and how many
    books can be used; ready if every venue has such a book."""
    held = common.episode_store(spark, sf_dir)
    found = held.episodes()
    last = found.agg(F.max("start_ns").alias("now"))
    day = found.crossJoin(F.broadcast(last)).agg(F.count_if(F.col("end_ns").isNull() & F.col("close_reason").isNull()).alias("open"), F.count_if(F.col("start_ns") >= F.col("now") - market.NS_DAY).alias("last_day"), F.max(F.when(F.col("start_ns") >= F.col("now") - market.NS_DAY, F.col("peak_spread"))).alias("widest"))
    books = market_queries.eligibility_ladder(spark, sf_dir).where(F.col("venue").isin(list(market.VENUES)))
    good = F.col("status") == "eligible"
    usable = books.agg(F.count_if(good).alias("usable_books"), F.count("*").alias("books"), F.count_distinct(F.when(good, F.col("venue"))).alias("v"))
    return day.crossJoin(usable).select("open", "last_day", "widest", "usable_books", "books", (F.col("v") == len(market.VENUES)).alias("ready"))


OVERVIEW_SQL = f"""WITH {E}, n AS (SELECT max(start_ns) AS now FROM ep), b AS (SELECT * FROM ({market_queries.LADDER_SQL}) WHERE venue IN (SELECT unnest({list(market.VENUES)})))
SELECT count(*) FILTER (end_ns IS NULL AND close_reason IS NULL) AS open, count(*) FILTER (start_ns >= now - {market.NS_DAY}) AS last_day, max(peak_spread) FILTER (start_ns >= now - {market.NS_DAY}) AS widest,
  (SELECT count(*) FROM b WHERE status = 'eligible') AS usable_books, (SELECT count(*) FROM b) AS books, (SELECT count(DISTINCT venue) FROM b WHERE status = 'eligible') = {len(market.VENUES)} AS ready FROM ep, n"""


def timeseries(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = stats.floor_to(F.col("start_ns"), 6 * market.NS_HOUR).alias("bucket_ns")
    return common.episode_store(spark, sf_dir).episodes().groupBy(bucket).agg(F.count("*").alias("n"), F.max("peak_spread").alias("max_spread"))


SERIES_SQL = f"WITH {E} SELECT start_ns // {6 * market.NS_HOUR} * {6 * market.NS_HOUR} AS bucket_ns, count(*) AS n, max(peak_spread) AS max_spread FROM ep GROUP BY ALL"


def lifetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.episode_store(spark, sf_dir).episodes().where("end_ns is not null").withColumn("life", F.col("end_ns") - F.col("start_ns"))
    return stats.percentiles(rows, ["pair"], "life", {"p50": 0.5, "p90": 0.9})


LIVES_SQL = f"""WITH {E}, l AS (SELECT pair, list(end_ns - start_ns ORDER BY end_ns - start_ns) AS v FROM ep WHERE end_ns IS NOT NULL GROUP BY pair)
SELECT pair, len(v) AS n, v[1 + least(len(v) - 1, CAST(floor(len(v) * 0.5) AS BIGINT))] AS p50, v[1 + least(len(v) - 1, CAST(floor(len(v) * 0.9) AS BIGINT))] AS p90, v[-1] AS longest FROM l"""


def open_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.episode_store(spark, sf_dir).episodes().agg(F.count_if(F.col("end_ns").isNull() & F.col("close_reason").isNull()).alias("open"), F.count("*").alias("n"), F.count_distinct("pair").alias("pairs"))


OPEN_SQL = f"WITH {E} SELECT count(*) FILTER (end_ns IS NULL) AS open, count(*) AS n, count(DISTINCT pair) AS pairs FROM ep"

_COLUMNS = ["id", "pair", "buy", "sell", "start_ns", "end_ns", "close_reason", "peak_spread"]


def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.episode_store(spark, sf_dir).episodes().orderBy(F.desc("start_ns"), F.desc("id")).limit(50).select(*_COLUMNS)


RECENT_SQL = f"WITH {E} SELECT {', '.join(_COLUMNS)} FROM ep ORDER BY start_ns DESC, id DESC LIMIT 50"
_ASKED = history.search(pair="P4-USD", closed=True, close_reason="spread_closed")
_WHERE = "pair = 'P4-USD' AND close_reason = 'spread_closed'"


def history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = common.episode_store(spark, sf_dir)
    return history.page(store.episodes(), _ASKED, 25, newest=store.newest())[0].select(*_COLUMNS)


PAGE_SQL = f"WITH {E} SELECT {', '.join(_COLUMNS)} FROM ep WHERE {_WHERE} ORDER BY start_ns DESC, id DESC LIMIT 25"


def history_second_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = common.episode_store(spark, sf_dir)
    found = store.episodes()
    _, token = history.page(found, _ASKED, 25, newest=store.newest())
    return (history.page(found, _ASKED, 25, token)[0] if token else found.limit(0)).select(*_COLUMNS)


SECOND_SQL = f"WITH {E} SELECT {', '.join(_COLUMNS)} FROM ep WHERE {_WHERE} ORDER BY start_ns DESC, id DESC LIMIT 25 OFFSET 25"


def export_ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.export_lines(common.episode_store(spark, sf_dir).episodes(), history.search(buy="v0", closed=True), ["id", "pair", "buy", "sell", "start_ns", "end_ns", "peak_spread", "close_spread"], 100_000)


EXPORT_SQL = f"""WITH {E}, x AS (SELECT * FROM ep WHERE buy = 'v0' AND close_reason IS NOT NULL ORDER BY start_ns DESC, id DESC LIMIT 100000)
SELECT 0 AS ord, to_json({{'type': 'episode', 'id': id, 'pair': pair, 'buy': buy, 'sell': sell, 'start_ns': start_ns, 'end_ns': end_ns, 'peak_spread': peak_spread, 'close_spread': close_spread}})::VARCHAR AS line FROM x
UNION ALL SELECT 1, to_json({{'type': 'end', 'count': count(*)}})::VARCHAR FROM x"""

_CUTOFF = 1_705_019_430 * 10**9


def prune_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred oldest episodes before the cutoff, which one bounded prune takes."""
    return history.prune_batch(common.episode_store(spark, sf_dir).episodes(until=_CUTOFF), _CUTOFF, 100).select(*_COLUMNS)


PRUNE_BATCH_SQL = f"WITH {E} SELECT {', '.join(_COLUMNS)} FROM ep WHERE start_ns < {_CUTOFF} ORDER BY start_ns, id LIMIT 100"


def unique_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts by the hour, moved on so that no route has two episodes of one start."""
    hour = stats.floor_to(F.col("start_ns"), market.NS_HOUR).alias("hour_ns")
    rows = common.episode_store(spark, sf_dir).episodes().select("id", "pair", "buy", "sell", hour)
    return history.unique_starts(rows, ["pair", "buy", "sell"], "hour_ns")


UNIQUE_SQL = f"""WITH RECURSIVE {E}, h AS (SELECT id, pair, buy, sell, start_ns // {market.NS_HOUR} * {market.NS_HOUR} AS hour_ns, row_number() OVER (PARTITION BY pair, buy, sell ORDER BY start_ns // {market.NS_HOUR}, id) AS n FROM ep
), u AS (SELECT id, pair, buy, sell, hour_ns, n, hour_ns AS unique_ns FROM h WHERE n = 1
  UNION ALL SELECT h.id, h.pair, h.buy, h.sell, h.hour_ns, h.n, greatest(h.hour_ns, u.unique_ns + 1) FROM u JOIN h ON h.pair = u.pair AND h.buy = u.buy AND h.sell = u.sell AND h.n = u.n + 1)
SELECT id, pair, buy, sell, hour_ns, unique_ns FROM u"""


def last_lifetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest episode of each pair with its lifetime; an open one comes before closed ones."""
    rows = common.episode_store(spark, sf_dir).episodes()
    rank = F.struct(F.col("end_ns").isNull(), "start_ns", "id")
    last = rows.groupBy("pair").agg(F.max_by(F.struct("id", "start_ns", "end_ns"), rank).alias("e"))
    return last.select("pair", "e.id", F.col("e.end_ns").isNull().alias("open"), (F.col("e.end_ns") - F.col("e.start_ns")).alias("lifetime"))


LAST_SQL = f"""WITH {E} SELECT pair, id, end_ns IS NULL AS open, end_ns - start_ns AS lifetime FROM (
  SELECT *, row_number() OVER (PARTITION BY pair ORDER BY end_ns IS NULL DESC, start_ns DESC, id DESC) AS r FROM ep) WHERE r = 1"""


def episode_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes by pair, by close reason and by route, with the profit of each quote asset."""
    rows = common.episode_store(spark, sf_dir).episodes().withColumn("close_reason", F.coalesce("close_reason", F.lit("open")))
    sets = [["quote", "pair"], ["quote", "close_reason"], ["quote", "pair", "buy", "sell"], ["quote"]]
    return rows.groupingSets(sets, "quote", "pair", "close_reason", "buy", "sell").agg(F.count("*").alias("n"), F.sum("peak_profit").alias("profit"))


COUNTS_SQL = f"""WITH {E}, c AS (SELECT *, coalesce(close_reason, 'open') AS cr FROM ep)
SELECT quote, pair, cr AS close_reason, buy, sell, count(*) AS n, sum(peak_profit)::BIGINT AS profit FROM c GROUP BY GROUPING SETS ((quote, pair), (quote, cr), (quote, pair, buy, sell), (quote))"""


def ages_at_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of the older leg's age, in quarters of an hour, at the opening of episodes only."""
    age = F.greatest("buy_age", "sell_age")
    bucket = F.floor(age / (market.NS_HOUR // 4)).cast("long").alias("quarter")
    return common.episode_store(spark, sf_dir).episodes().groupBy("pair", bucket).agg(F.count("*").alias("n"))


AGES_SQL = f"WITH {E} SELECT pair, greatest(buy_age, sell_age) // {market.NS_HOUR // 4} AS quarter, count(*) AS n FROM ep GROUP BY ALL"


def window_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes in the trailing windows of some labels; 1d is 24h and an unknown label one hour."""
    labels = {k: stats.window_ns(k) for k in ("1h", "4h", "1d", "72h", "1w", "fortnight", "")}
    return stats.by_window(common.episode_store(spark, sf_dir).episodes(), labels).groupBy("label").agg(F.sum("n").alias("n"))


LABELS_SQL = f"""WITH {E} SELECT label, count(*) AS n FROM ep, (VALUES ('1h', 1), ('4h', 4), ('1d', 24), ('72h', 72), ('1w', 168), ('fortnight', 1), ('', 1)) w(label, hours)
WHERE start_ns >= (SELECT max(start_ns) FROM ep) - hours * {market.NS_HOUR} GROUP BY label"""


def prune_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = common.episode_store(spark, sf_dir).episodes()
    kept, _ = history.prune(found, stats.rollup(found, market.NS_HOUR), _CUTOFF, market.NS_HOUR, lambda rows: stats.rollup(rows, market.NS_HOUR))
    return kept.select(*_COLUMNS)


PRUNE_SQL = f"WITH {E} SELECT {', '.join(_COLUMNS)} FROM ep WHERE start_ns >= {_CUTOFF}"


def prune_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = common.episode_store(spark, sf_dir).episodes()
    return history.prune(found, stats.rollup(found, market.NS_HOUR), _CUTOFF, market.NS_HOUR, lambda rows: stats.rollup(rows, market.NS_HOUR))[1]


PRUNE_ROLLUP_SQL = f"WITH {E}, kept AS (SELECT * FROM ep WHERE start_ns >= {_CUTOFF}) {_rollup_sql('kept', market.NS_HOUR)}"

QUERIES = {
    "system_stats": (system_stats, STATS_SQL),
    "system_overview": (system_overview, OVERVIEW_SQL),
    "minute_rollup": (minute_rollup, ROLLUP_SQL),
    "window_stats": (window_stats, WINDOWS_SQL),
    "rollup_window": (rollup_window, ROLLUP_WINDOW_SQL),
    "extended_stats": (extended_stats, EXTENDED_SQL),
    "peak_minute": (peak_minute, PEAK_SQL),
    "timeseries": (timeseries, SERIES_SQL),
    "lifetimes": (lifetimes, LIVES_SQL),
    "open_count": (open_count, OPEN_SQL),
    "recent": (recent, RECENT_SQL),
    "history_page": (history_page, PAGE_SQL),
    "history_second_page": (history_second_page, SECOND_SQL),
    "export_ndjson": (export_ndjson, EXPORT_SQL),
    "prune_survivors": (prune_survivors, PRUNE_SQL),
    "prune_rollup": (prune_rollup, PRUNE_ROLLUP_SQL),
    "prune_batch": (prune_batch, PRUNE_BATCH_SQL),
    "unique_starts": (unique_starts, UNIQUE_SQL),
    "last_lifetimes": (last_lifetimes, LAST_SQL),
    "episode_counts": (episode_counts, COUNTS_SQL),
    "ages_at_open": (ages_at_open, AGES_SQL),
    "window_labels": (window_labels, LABELS_SQL),
}
