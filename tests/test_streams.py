"""Keyed streams over several micro-batches give what they give over one."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import book, routes
from tidemark.operators import episodes as batch_episodes
from tidemark.plans import common
from tidemark.session import table
from tidemark.sources import market
from tidemark.streaming import books, episodes, levels

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pieces(spark, tmp_path_factory):
    """The events in seven files, one after another in time."""
    rows = table(spark, SF, "events")
    path = tmp_path_factory.mktemp("pieces")
    ordered = rows.orderBy("ts", "event_id").toPandas()
    size = -(-len(ordered) // 7)
    for k in range(7):
        ordered.iloc[k * size : (k + 1) * size].to_parquet(path / f"part-{k}.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
    return rows.schema, str(path)


def stream(spark, pieces, files):
    raw = spark.readStream.schema(pieces[0]).option("maxFilesPerTrigger", files).parquet(pieces[1])
    return market.feed_of(raw)


@pytest.mark.parametrize("kind", ["episodes", "trusted", "reasons"])
def test_batches_make_no_difference(spark, pieces, kind):
    def run(files):
        rows = stream(spark, pieces, files)
        if kind == "episodes":
            out = episodes.closed_episodes(rows, market.VENUES, common.MAX_AGE, common.THRESHOLD)
        elif kind == "trusted":
            out = books.trusted(rows)
        else:
            out = books.reasons(rows)
        return sorted(map(tuple, books.run_to_table(out, spark, "stream-test").collect()), key=repr)

    one, many = run(7), run(1)
    assert one == many and len(one) > 20


def test_timers_close_what_the_batch_closes(spark, pieces):
    feed = market.feed_of(table(spark, SF, "events"))
    rows = book.tops_over_time(book.apply_reasons(book.sequenced(feed), links=True))
    routed = routes.route_rows(routes.aligned(book.with_expiries(rows, common.MAX_AGE), market.VENUES, common.BLOCK), market.VENUES, common.MAX_AGE, common.THRESHOLD)
    names = [f.split()[0] for f in episodes.CLOSED.split(", ")]
    end = (feed.agg({"ns": "max"}).first()[0] // 10**6 - 3_600_001) * 10**6
    want = sorted(tuple(r) for r in batch_episodes.episodes(routed).where(f"close_reason is not null and end_ns <= {end}").select(*names).collect())
    for files in (7, 1):
        found = episodes.timed_episodes(stream(spark, pieces, files), market.VENUES, common.MAX_AGE, common.THRESHOLD)
        got = books.run_to_table(found, spark, "stream-test").where(f"end_ns <= {end}")
        assert sorted(map(tuple, got.collect())) == want and len(want) > 20


def test_a_quiet_pair_closes_at_its_lapse(spark, tmp_path):
    """Nothing of pair A comes after 2 s; pair B's rows move the watermark on, and A's episode closes at 2 s + max age + 1 ns."""
    s = 10**9
    row = lambda i, pair, venue, ns, bid, ask: (i, pair, venue, ns, "snapshot", bid, ask, 0)
    first = [row(1, "A", "v0", s, 100, 101), row(2, "A", "v1", 2 * s, 110, 111)]
    later = [row(10 + k, "B", "v0", 60 * k * s, 100, 101) for k in range(1, 4)]
    schema = "event_id long, pair string, venue string, ns long, kind string, bid long, ask long, off long"
    for k, rows in enumerate([first, later, [row(20, "B", "v0", 400 * s, 100, 101)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        feed = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        found = episodes.timed_episodes(feed, ("v0", "v1"), 30 * s, 100_000, "10 seconds")
        got = books.run_into(found, str(tmp_path / "out")).collect()
        assert len(got) == (k > 0)  # another run goes on from the state that the last one left
    assert [(r.pair, r.buy, r.sell, r.start_ns, r.end_ns, r.close_reason) for r in got] == [("A", "v0", "v1", 2 * s, 31 * s + 1, "book_ineligible")]


def test_depth_after_each_of_seven_batches(spark, tmp_path):
    rows = table(spark, SF, "lineitem")
    parts = rows.withColumn("k", F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(7)))
    for k in range(7):  # updates of any time in any batch
        parts.where(F.col("k") == k).drop("k").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        got = levels.newest(books.run_into(levels.top_n(market.levels_of(source), 5), str(tmp_path / "out")))
        want = book.top_n(book.live_levels(market.levels_of(spark.read.parquet(str(tmp_path / "in")))), 5)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_a_book_that_loses_its_last_level_is_empty(spark, tmp_path):
    schema = "pair string, venue string, side string, price long, size long, ns long, seq long"
    for size, ns, left in ((5, 10, 1), (0, 20, 0), (7, 15, 0)):  # the last one is older than the deletion
        spark.createDataFrame([("P", "v", "bid", 9, size, ns, ns)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        feed = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        assert levels.newest(books.run_into(levels.top_n(feed, 3), str(tmp_path / "out"))).count() == left
