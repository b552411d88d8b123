"""Queries that run as streams over the events table, all that is there at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans import common, market_queries
from tidemark.session import shared_path, table
from tidemark.sources import market, metrics
from tidemark.streaming import books, episodes, levels


#: Bytes of input that one micro-batch takes.
BATCH_BYTES = 256 << 20


def _source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", BATCH_BYTES).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _source(spark, sf_dir, "events")


def stream_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books.run_to_table(books.trusted(market.feed_of(_events(spark, sf_dir))), spark, "stream-books")


BOOKS_SQL = f"WITH {common.TRUSTED} SELECT event_id, pair, venue, ns, trusted FROM tr"


def stream_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book_apply_reasons as a keyed stream."""
    rows = books.reasons(market.feed_of(_events(spark, sf_dir))).where(~F.col("reason").isin("link_down", "link_up"))
    return books.run_to_table(rows.drop("ns"), spark, "stream-reasons")


def stream_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed episodes as a keyed stream; a lapse shows once its pair has a later event."""
    found = episodes.closed_episodes(market.feed_of(_events(spark, sf_dir)), market.VENUES, common.MAX_AGE, common.THRESHOLD)
    return books.run_to_table(found, spark, "stream-episodes")


EPISODES_SQL = f"""WITH {common.EPISODES} SELECT id, pair, buy, sell, start_ns, end_ns, close_reason, open_spread, peak_ns, peak_spread, close_spread FROM ep
WHERE close_reason IS NOT NULL AND end_ns <= (SELECT max(ns) FROM sent WHERE sent.pair = ep.pair)"""


LATE_MS = 3_600_000


def stream_lapses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed episodes as a stream with timers, as far as its watermark has come: an episode of a pair that hears nothing
    more closes at its lapse, without a later event of its pair."""
    found = episodes.timed_episodes(market.feed_of(_events(spark, sf_dir)), market.VENUES, common.MAX_AGE, common.THRESHOLD, f"{LATE_MS} milliseconds")
    end = market.feed_of(table(spark, sf_dir, "events")).agg((F.floor(F.max("ns") / 1_000_000).cast("long") - LATE_MS - 1).alias("ms"))
    rows = books.run_to_table(found, spark, "stream-lapses").crossJoin(F.broadcast(end))
    return rows.where(F.col("end_ns") <= F.col("ms") * 1_000_000).drop("ms")


LAPSES_SQL = f"""WITH {common.EPISODES} SELECT id, pair, buy, sell, start_ns, end_ns, close_reason, open_spread, peak_ns, peak_spread, close_spread FROM ep
WHERE close_reason IS NOT NULL AND end_ns <= (SELECT max(ns) // 1000000 - {LATE_MS} - 1 FROM sent) * 1000000"""


def stream_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best ten levels of each side of every book, by a stream that keeps levels in its state."""
    found = levels.top_n(market.levels_of(_source(spark, sf_dir, "lineitem")), 10)
    return levels.newest(books.run_to_table(found, spark, "stream-depth"))


def _metrics() -> metrics.Metrics:
    reasons = ["ok", "adapter_reset", "disconnected", "snapshot_incomplete", "snapshot_crossed", "book_stale", "out_of_order", "sequence_gap", "crossed_book", "book_incomplete"]
    return metrics.Metrics({"updates_total": {r: F.col("reason") == r for r in reasons}}, {"chain_length": (F.col("chain"), CHAIN_EDGES)})


CHAIN_EDGES = [5, 20, 80]


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of reasons and a histogram of chain numbers, of a batch run and a streaming run over the same feed."""
    out = None
    for run in ("batch", "stream"):
        registry = metrics.Registry()
        if run == "batch":
            rows = common.applied(spark, sf_dir).where(~F.col("kind").isin("down", "up"))
            metrics.batch(rows, _metrics(), registry, lambda df: df.write.format("noop").mode("overwrite").save())
        else:
            rows = books.reasons(market.feed_of(_events(spark, sf_dir))).where(~F.col("reason").isin("link_down", "link_up"))
            metrics.stream(rows, _metrics(), registry, "updates", lambda df: books.started(df, shared_path(spark, "run-metrics")))
        one = registry.rows(spark).select(F.lit(run).alias("run"), "metric", "label", "value")
        out = one if out is None else out.unionByName(one)
    return out


_OF = "SELECT reason, chain FROM ap WHERE kind NOT IN ('down', 'up')"
METRICS_SQL = f"""WITH {common.APPLIED}, o AS ({_OF}), m AS (
  SELECT 'updates_total' AS metric, label, count(o.reason) AS value FROM (SELECT unnest(['ok', 'adapter_reset', 'disconnected', 'snapshot_incomplete', 'snapshot_crossed', 'book_stale', 'out_of_order', 'sequence_gap', 'crossed_book', 'book_incomplete']) AS label) l LEFT JOIN o ON o.reason = l.label GROUP BY label
  UNION ALL SELECT 'chain_length_bucket', e::VARCHAR, count(*) FILTER (chain <= e) FROM o, (SELECT unnest({CHAIN_EDGES}) AS e) GROUP BY e
  UNION ALL SELECT 'chain_length_bucket', '+Inf', count(chain) FROM o UNION ALL SELECT 'chain_length_sum', '', sum(chain)::BIGINT FROM o)
SELECT run, m.* FROM m, (VALUES ('batch'), ('stream')) r(run)"""


def stream_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books.rollup_to_table(market.quotes_of(_events(spark, sf_dir)), spark, market.NS_HOUR, "stream-rollup")


ROLLUP_SQL = f"WITH {common.QUOTES} SELECT ns // {market.NS_HOUR} * {market.NS_HOUR} AS bucket_ns, kind, count(*) AS n FROM q GROUP BY ALL"


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has closed: those that end an hour or more before the last event."""
    return books.run_to_table(books.minute_counts(market.quotes_of(_events(spark, sf_dir))), spark, "stream-windows")


WINDOWS_SQL = f"""WITH {common.QUOTES} SELECT ns // {market.NS_HOUR} * 3600000000 AS start_us, pair, count(*) AS n FROM q
WHERE (ns // {market.NS_HOUR} + 1) * {market.NS_HOUR} <= (SELECT max(ns) // 1000000 * 1000000 FROM q) - {market.NS_HOUR} GROUP BY ALL"""

QUERIES = {
    "stream_books": (stream_books, BOOKS_SQL),
    "stream_reasons": (stream_reasons, market_queries.REASONS_SQL),
    "stream_episodes": (stream_episodes, EPISODES_SQL),
    "run_metrics": (run_metrics, METRICS_SQL),
    "stream_lapses": (stream_lapses, LAPSES_SQL),
    "stream_depth": (stream_depth, market_queries.DEPTH_SQL),
    "stream_rollup": (stream_rollup, ROLLUP_SQL),
    "stream_windows": (stream_windows, WINDOWS_SQL),
}
