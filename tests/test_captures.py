"""Recorded captures with footers from what was written, and metrics observed while a run goes on."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import stats
from tidemark.sources import capture, messages, metrics, replay
from tidemark.streaming import books

FRAMES = "exchange string, kind string, wall_ns long, mono_ns long, raw string, payload string, connected boolean, reason string"


def frames(spark, dropped=()):
    rows = [(e, k, i, i, "{}" if k == "ws" else None, "{}" if k == "snapshot" else None, True if k == "connection" else None, dict(dropped).get((e, i))) for e in "ab" for i, k in enumerate(["connection", "snapshot", "ws", "ws", "ws"])]
    return spark.createDataFrame(rows, FRAMES).repartition(3)


def verdicts(spark, path, **options):
    records = capture.read(spark, path).withColumn("file", F.regexp_extract("file", r"exchange=(\w+)", 1))
    return {r.file: (r.frames, r.verdict) for r in capture.integrity(records, **options).collect()}


@pytest.mark.parametrize("gzip", [True, False])
def test_a_recorded_capture_is_lossless(spark, tmp_path, gzip):
    capture.record(frames(spark), str(tmp_path / "c"), ["a", "b", "quiet"], 7, gzip)
    assert verdicts(spark, str(tmp_path / "c")) == {"a": (5, "lossless"), "b": (5, "lossless"), "quiet": (0, "lossless")}
    assert capture.frames(capture.read(spark, str(tmp_path / "c"))).where("wrong is not null").count() == 0


def test_footers_count_what_was_lost_by_kind_and_reason(spark, tmp_path):
    path = str(tmp_path / "c")
    capture.record(frames(spark, [(("a", 2), "queue_full"), (("a", 3), "queue_full"), (("a", 1), "writer_closed")]), path, ["a", "b"], 7)
    assert verdicts(spark, path) == {"a": (2, "declared_frame_loss"), "b": (5, "lossless")}
    assert verdicts(spark, path, allow_lossy=True)["a"] == (2, "lossy")
    footer = next(json.loads(r.line) for r in capture.read(spark, path).where("type = 'footer' and file like '%exchange=a%'").collect())["frame_counts"]
    assert (footer["attempted"], footer["accepted"], footer["dropped"]) == (5, 2, {"snapshot": {"writer_closed": 1}, "ws": {"queue_full": 2}})
    assert footer["accepted_by_kind"] == {"connection": 1, "snapshot": 0, "ws": 1} and footer["attempted_by_kind"]["ws"] == 3


def test_a_writer_that_dies_leaves_no_footer(spark, tmp_path):
    whole, torn = str(tmp_path / "whole"), str(tmp_path / "torn")
    capture.record(frames(spark), whole, ["a"], 7)
    spark.read.text(whole).where("value not like '%footer%'").select(F.col("value").alias("line")).coalesce(1).write.text(torn)
    assert [v for _, v in verdicts(spark, torn).values()] == ["missing_footer"]


def test_metrics_of_a_batch_and_of_a_stream_of_several_batches(spark, tmp_path):
    schema = "kind string, size long"
    for k in range(3):
        spark.createDataFrame([("x", 5 * k), ("y", 7), ("y", None)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    made = metrics.Metrics({"rows_total": {"x": F.col("kind") == "x", "y": F.col("kind") == "y", "z": F.col("kind") == "z"}}, {"size": (F.col("size"), [0, 5, 7])})
    want = {("rows_total", "x"): 3, ("rows_total", "y"): 6, ("rows_total", "z"): 0, ("size_bucket", "0"): 1, ("size_bucket", "5"): 2, ("size_bucket", "7"): 5, ("size_bucket", "+Inf"): 6, ("size_sum", ""): 36}
    one, many = metrics.Registry(), metrics.Registry()
    metrics.batch(spark.read.parquet(str(tmp_path / "in")), made, one, lambda df: df.count())
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    metrics.stream(feed, made, many, "sizes", lambda df: books.started(df, str(tmp_path / "out")))
    assert one.totals == many.totals == want
    assert sorted(map(tuple, many.rows(spark).collect())) == sorted((n, label, v) for (n, label), v in want.items())


def test_a_replayed_feed_is_the_feed(spark):
    rows = [(1, "P", "v0", 10, "snapshot", 9, 11, 1, 2, 1), (2, "P", "v1", 10, "snapshot", 9, 11, 1, 2, 1), (3, "Q", "v2", 11, "snapshot", 9, None, 1, None, 1), (4, "P", "v0", 12, "delta", None, 12, None, 3, 2), (5, "Q", "v2", 13, "delta", 8, 9, 4, 5, 3)]
    rows += [(6, "P", "v1", 14, "delta", 7, 8, 6, 5, 2), (7, "Q", "v2", 15, "reset", 1, 2, 3, 4, 9), (8, "P", "v1", 17, "down", *[None] * 5), (8, "Q", "v1", 17, "down", *[None] * 5)]
    schema = "event_id long, pair string, venue string, ns long, kind string, bid long, ask long, bid_size long, ask_size long, seq long"
    pairs = ("P", "Q")
    made = replay.frames(spark.createDataFrame(rows, schema), pairs)
    assert sorted(r.kind for r in made.collect()) == ["connection", *["snapshot"], *["ws"] * 6]
    got = sorted(map(tuple, replay.events(made, pairs).collect()), key=repr)
    want = [(*r[:5], *[None] * 5) if r[4] == "reset" else r for r in rows]
    assert got == sorted(want, key=repr)
    other = spark.createDataFrame([("v0", "ws", 1, t, None) for t in ("{}", "not json", '{"id": "resync:P:unsubscribe:4", "status": 400}', '{"id": 7, "status": 200}')], "exchange string, kind string, mono_ns long, raw string, payload string")
    assert replay.events(other.withColumn("connected", F.lit(True)).withColumn("connection_generation", F.lit(1).cast("long")), pairs).count() == 0


def test_a_window_without_episodes(spark):
    minutes = spark.createDataFrame([], "bucket_ns long, pair string, quote string, n long, max_spread long, sum_spread long, sum_profit long")
    (row,) = stats.window_summary(minutes, spark.createDataFrame([], "life long")).collect()
    assert (row.n, row.closed, row.profit) == (0, 0, "") and {row.max_spread, row.mean_spread, row.top_pair, row.peak_minute_ns, row.life_p50} == {None}


def test_messages_are_decoded_where_they_lie(spark):
    envelope = '{"sequence_num": 5, "E": 9, "events": [{"type": "update", "product_id": "P", "updates": [{"side": "bid", "price_level": "7", "new_quantity": "1"}]}, null, {"type": "snapshot", "product_id": "Q", "updates": []}, {"type": "update", "product_id": "P", "updates": [{"side": "offer", "price_level": "8", "new_quantity": "2"}]}]}'
    rows = [(9, "v1", 3, envelope), (9, "v1", 4, envelope), (1, "v1", 5, '{"sequence_num": 6, "events": []}'), (2, "v1", 6, '{"sequence_num": 7}'), (3, "v1", 7, "no"), (4, "v0", 8, '{"s": "P", "U": 3, "u": 4, "b": [["1", "2"]], "a": []}'), (5, "v2", 9, "{}"), (6, None, 9, "{}")]
    found = messages.decode(spark.createDataFrame(rows, "event_id long, venue string, ns long, raw string"))
    levels = lambda side: None if side is None else [tuple(map(int, x)) for x in side]
    got = [(r.event_id, r.ns, r.symbol, r.kind, r.first_id, r.last_id, levels(r.bids), levels(r.asks)) for r in found.collect()]
    twice = [(9, t, *r) for t in (3, 4) for r in (("P", "delta", 5, 5, [(7, 1)], [(8, 2)]), ("Q", "snapshot", 5, 5, [], []), (None, "delta", 5, 5, None, None))]
    want = [*twice, (1, 5, None, "delta", 6, 6, None, None), (2, 6, None, "delta", 7, 7, None, None), (3, 7, None, "invalid", None, None, None, None), (4, 8, "P", "delta", 3, 4, [(1, 2)], []), (5, 9, None, "invalid", None, None, None, None)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_a_capture_is_replayed_in_one_pass_without_a_shuffle(spark, tmp_path):
    path = str(tmp_path / "c")
    capture.record(frames(spark), path, ["a", "b"], 7)
    found = replay.events(capture.frames(capture.read(spark, path)).where("wrong is null"), ("P", "Q"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("FileScan text") == 1
    assert found.count() == 4


def test_files_of_a_capture_are_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(capture, "FILE_FRAMES", 2)
    path = str(tmp_path / "c")
    capture.record(frames(spark).coalesce(1), path, ["a", "b"], 7)
    assert max(r["count"] for r in capture.read(spark, path).where("type = 'frame'").groupBy("file").count().collect()) == 2
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
