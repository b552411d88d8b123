"""Queries over native sequencing and the replay of captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import audits, book, recovery, sequencing
from tidemark.operators.asof import asof_join, block_of, running
from tidemark.plans import common
from tidemark.plans.audit_queries import IDS, ORDER, _ids
from tidemark.sources import capture, market
from tidemark.session import settled, shared_path

Q = common.QUOTES
HOUR, DAY = market.NS_HOUR, market.NS_DAY


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(spark, sf_dir).where("kind <> 'reset'")


UPDATES = f"""{IDS}, up AS (SELECT * FROM ids WHERE kind <> 'reset')"""

APPLIED = (
    UPDATES
    + """, s1 AS (SELECT *, sum(CASE WHEN kind = 'snapshot' THEN 1 ELSE 0 END) OVER (PARTITION BY pair, venue ORDER BY ns, event_id) AS chain FROM up
), s2 AS (SELECT *, max(last_id) OVER (PARTITION BY pair, venue, chain ORDER BY ns, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s1
), s3 AS (SELECT *, kind = 'delta' AND chain > 0 AND first_id > reach + 1 AS gap FROM s2
), s4 AS (SELECT *, coalesce(bool_or(gap) OVER (PARTITION BY pair, venue, chain ORDER BY ns, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS gone FROM s3
), s5 AS (SELECT *, CASE WHEN kind = 'snapshot' THEN 'snapshot' WHEN chain = 0 OR gone THEN 'lost' WHEN last_id <= reach THEN 'covered' WHEN gap THEN 'gap' ELSE 'applied' END AS outcome FROM s4
), sa AS (SELECT *, CASE WHEN outcome IN ('snapshot', 'applied') THEN sum(CASE WHEN outcome = 'applied' THEN 1 ELSE 0 END) OVER (PARTITION BY pair, venue, chain ORDER BY ns, event_id) END AS local_seq,
    CASE WHEN outcome = 'gap' THEN 'resync:' || pair || ':unsubscribe:' || (sum(CASE WHEN outcome = 'gap' THEN 1 ELSE 0 END) OVER (PARTITION BY pair, venue ORDER BY ns, event_id))::BIGINT END AS request FROM s5
)"""
)


def sequencing_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each native update's outcome, its local sequence number, and the resync that a gap asks for."""
    return sequencing.applied(_updates(spark, sf_dir)).select("event_id", "pair", "venue", "outcome", "local_seq", "cause", "request")


APPLY_SQL = f"WITH {APPLIED} SELECT event_id, pair, venue, outcome, local_seq::BIGINT AS local_seq, CASE WHEN outcome = 'gap' THEN 'sequence_gap' END AS cause, request FROM sa"


def resync_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each resync request's id, and of some texts that are none."""
    asked = sequencing.applied(_updates(spark, sf_dir)).where("request is not null").select("event_id", "request")
    odd = spark.createDataFrame([(-1, "resync:P1-USD:restart:3"), (-2, "resync::subscribe:1"), (-3, "7"), (-4, "resync:P1-USD:subscribe:x")], "event_id long, request string")
    rows = asked.unionByName(odd).withColumn("r", sequencing.parse_resync(F.col("request")))
    return rows.select("event_id", "r.pair", "r.action", "r.number")


REQUESTS_SQL = f"""WITH {APPLIED} SELECT event_id, pair, 'unsubscribe' AS action, string_split(request, ':')[-1]::BIGINT AS number FROM sa WHERE request IS NOT NULL
UNION ALL SELECT unnest([-1, -2, -3, -4]), NULL, NULL, NULL"""


def sequencing_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots that are answered twelve hours after they were asked for, against what was buffered."""
    rows = settled(_updates(spark, sf_dir).select("pair", "venue", "ns", "event_id", "kind", "n", "first_id", "last_id"), "updates")
    asked = rows.where("kind = 'snapshot'").select("pair", "venue", F.col("event_id").alias("id"), (3 * F.col("n") + 5).alias("snap"), F.col("ns").alias("asked_ns"), (F.col("ns") + 12 * HOUR).alias("got_ns"))
    deltas = rows.where("kind = 'delta'").select("pair", "venue", "ns", "event_id", "first_id", "last_id")
    return sequencing.aligned(asked, deltas, 12 * HOUR).select("id", "pair", "venue", "pending", "dropped", "status")


ALIGN_SQL = f"""WITH {UPDATES}, sn AS (SELECT event_id AS id, pair, venue, 3 * n + 5 AS snap, ns AS asked, ns + {12 * HOUR} AS got FROM up WHERE kind = 'snapshot'
), hd AS (SELECT sn.id, snap, u.ns, u.event_id, first_id, last_id FROM sn JOIN up u ON u.pair = sn.pair AND u.venue = sn.venue AND u.kind = 'delta' AND u.ns BETWEEN asked AND got
), lf AS (SELECT *, max(last_id) OVER (PARTITION BY id ORDER BY ns, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM hd WHERE last_id > snap
), kp AS (SELECT id, count(*) AS pending, bool_or(reach IS NULL AND first_id > snap + 1) AS late, bool_or(reach IS NOT NULL AND first_id > reach + 1) AS out FROM lf GROUP BY id
), dr AS (SELECT id, count(*) AS dropped FROM hd WHERE last_id <= snap GROUP BY id)
SELECT id, pair, venue, coalesce(pending, 0) AS pending, coalesce(dropped, 0) AS dropped, CASE WHEN pending IS NULL THEN 'empty' WHEN late THEN 'retry' WHEN out THEN 'gap' ELSE 'aligned' END AS status
FROM sn LEFT JOIN kp USING (id) LEFT JOIN dr USING (id)"""


def sequencing_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six events of a venue's day in one envelope, over the products of USD only."""
    day = F.floor(F.col("ns") / DAY).cast("long")
    n = F.row_number().over(Window.partitionBy("venue", "day").orderBy(*ORDER)) - 1
    rows = market.quotes(spark, sf_dir).where("kind <> 'reset'").where(F.col("pair").endswith("-USD")).withColumn("day", day).withColumn("envelope", F.floor(n / 6).cast("long"))
    return sequencing.envelopes(rows, ["venue", "day", "envelope"], ORDER)


ENVELOPES_SQL = f"""WITH {Q}, n AS (SELECT *, ns // {DAY} AS day, (row_number() OVER (PARTITION BY venue, ns // {DAY} ORDER BY ns, event_id) - 1) // 6 AS envelope FROM q WHERE kind <> 'reset' AND pair LIKE '%-USD'
), r AS (SELECT *, row_number() OVER (PARTITION BY venue, day, envelope, pair ORDER BY ns, event_id) AS k, bool_or(kind = 'snapshot') OVER (PARTITION BY venue, day, envelope, pair) AS has FROM n
), p AS (SELECT venue, day, envelope, pair, count(*) AS n, bool_or(k = 1 AND kind = 'snapshot') OR NOT bool_or(has) AS good FROM r GROUP BY ALL)
SELECT venue, day, envelope, count(*) AS products, sum(n)::BIGINT AS events, bool_and(good) AS accepted FROM p GROUP BY ALL"""


def sequencing_resubscribe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps, acknowledged after an hour, that wait two days for a whole snapshot; over three in four days escalate."""
    rows = _updates(spark, sf_dir)
    gaps = sequencing.applied(rows).where("outcome = 'gap'").select("pair", "venue", "ns", "event_id")
    frames = rows.select("pair", "venue", "ns", "event_id", F.when(F.col("event_id") % 6 == 0, F.col("last_id")).otherwise(F.col("last_id") - 1).alias("first_id"), "last_id")
    return sequencing.resubscribed(gaps, frames, HOUR, 2 * DAY, 4 * DAY, 3).drop("recovered_ns")


RESUB_SQL = f"""WITH {APPLIED}, g AS (SELECT pair, venue, event_id, ns AS gap_ns, count(*) OVER (PARTITION BY pair, venue ORDER BY ns RANGE BETWEEN {4 * DAY - 1} PRECEDING AND CURRENT ROW) AS recent FROM sa WHERE outcome = 'gap')
SELECT pair, venue, event_id, gap_ns, CASE WHEN recent > 3 THEN 'escalated' WHEN EXISTS (SELECT 1 FROM up u WHERE u.pair = g.pair AND u.venue = g.venue AND u.event_id % 6 = 0 AND u.ns > gap_ns + {HOUR} AND u.ns <= gap_ns + {HOUR + 2 * DAY}) THEN 'recovered' ELSE 'deadline' END AS outcome FROM g"""


def sequencing_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial snapshots two ids ahead of every ninth update, held for at most a day."""
    rows = _updates(spark, sf_dir).where("kind = 'delta'")
    partial = rows.where("event_id % 9 = 0").select("pair", "venue", F.col("event_id").alias("id"), (F.col("last_id") + 2 + F.col("event_id") % 2).alias("at_id"), "ns")
    return sequencing.held_verifications(partial, rows.select("pair", "venue", "ns", "event_id", "first_id", "last_id"), DAY).select("id", "pair", "venue", "at_id", "status")


VERIFY_SQL = f"""WITH {UPDATES}, d AS (SELECT * FROM up WHERE kind = 'delta'), p AS (SELECT event_id AS id, pair, venue, last_id + 2 + event_id % 2 AS at_id, ns FROM d WHERE event_id % 9 = 0
), m AS (SELECT p.id, min({{'ns': d.ns, 'last': d.last_id}}) AS u FROM p JOIN d ON d.pair = p.pair AND d.venue = p.venue AND d.ns >= p.ns AND (p.at_id BETWEEN d.first_id AND d.last_id OR (d.last_id < d.first_id AND p.at_id = d.last_id)) GROUP BY p.id)
SELECT p.id, pair, venue, at_id, CASE WHEN u IS NULL OR u.ns - p.ns > {DAY} THEN 'stalled' WHEN u.last = at_id THEN 'verified' ELSE 'unaligned' END AS status FROM p LEFT JOIN m USING (id)"""


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capture's frames: resets are connection boundaries, snapshots and deltas what they are."""
    kind = F.when(F.col("kind") == "reset", "connection").when(F.col("kind") == "snapshot", "snapshot").otherwise("ws")
    return market.quotes(spark, sf_dir).select(F.col("venue").alias("exchange"), kind.alias("kind"), "pair", "ns", "event_id", (F.col("event_id") % 2 == 0).alias("connected"))


FRAMES = f"""{Q}, fr AS (SELECT venue AS exchange, CASE kind WHEN 'reset' THEN 'connection' WHEN 'snapshot' THEN 'snapshot' ELSE 'ws' END AS kind, pair, ns, event_id, event_id % 2 = 0 AS connected FROM q
), ep AS (SELECT *, sum(CASE WHEN kind = 'connection' THEN 1 ELSE 0 END) OVER w AS generation, coalesce(last_value(CASE WHEN kind = 'connection' THEN connected END IGNORE NULLS) OVER (PARTITION BY exchange ORDER BY ns, kind <> 'connection', event_id), true) AS is_up
  FROM fr WINDOW w AS (PARTITION BY exchange ORDER BY ns, event_id)
), oc AS (SELECT *, CASE WHEN kind = 'connection' THEN 'boundary' WHEN is_up THEN 'processed' WHEN kind = 'snapshot' THEN 'abandoned' ELSE 'skipped' END AS outcome FROM ep)"""


def replay_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a replay makes of each frame, by the exchange's connection at its time."""
    return sequencing.epochs(_frames(spark, sf_dir)).select("exchange", "event_id", "kind", "generation", "outcome")


REPLAY_SQL = f"WITH {FRAMES} SELECT exchange, event_id, kind, generation::BIGINT AS generation, outcome FROM oc"


def replay_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames by exchange, kind and outcome, with subtotals."""
    rows = sequencing.epochs(_frames(spark, sf_dir))
    return rows.groupingSets([["exchange", "kind", "outcome"], ["kind", "outcome"], ["outcome"]], "exchange", "kind", "outcome").agg(F.count("*").alias("n"))


REPLAY_COUNTS_SQL = f"WITH {FRAMES} SELECT exchange, kind, outcome, count(*) AS n FROM oc GROUP BY GROUPING SETS ((exchange, kind, outcome), (kind, outcome), (outcome))"


def replay_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots that arrive eight hours after their request: completed, or abandoned if the exchange was down
    at the request, is down at the response, or has another generation by then."""
    frames = _frames(spark, sf_dir)
    asked = sequencing.epochs(frames).where("kind = 'snapshot'")
    links = frames.where("kind = 'connection'")
    states = sequencing.epochs(links).join(links.select("event_id", "connected"), "event_id").select("exchange", F.col("ns").alias("link_ns"), F.col("event_id").alias("link_id"), F.col("generation").alias("later"), "connected")
    rows = asof_join(asked.select("exchange", "event_id", "generation", "outcome", (F.col("ns") + 8 * HOUR).alias("got_ns")), states, ["exchange"], "got_ns", "link_ns", ["link_id"], ["later", "connected"], DAY)
    status = F.when(F.col("outcome") == "abandoned", "down_at_request").when(~F.coalesce("connected", F.lit(True)), "down_at_response").when(F.coalesce("later", F.lit(0)) != F.col("generation"), "other_generation").otherwise("completed")
    return rows.select("exchange", "event_id", status.alias("status"))


SNAPSHOTS_SQL = f"""WITH {FRAMES}, lk AS (SELECT * FROM oc WHERE kind = 'connection'), rq AS (
  SELECT o.exchange, o.event_id, o.generation, o.outcome, (SELECT arg_max({{'c': connected, 'g': generation}}, (ns, event_id)) FROM lk WHERE lk.exchange = o.exchange AND lk.ns <= o.ns + {8 * HOUR}) AS l FROM oc o WHERE kind = 'snapshot')
SELECT exchange, event_id, CASE WHEN outcome = 'abandoned' THEN 'down_at_request' WHEN NOT coalesce(l.c, true) THEN 'down_at_response' WHEN coalesce(l.g, 0) <> generation THEN 'other_generation' ELSE 'completed' END AS status FROM rq"""


def replay_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that a disconnect's reason names, and the snapshots in flight that it cancels (asked for at most
    eight hours before, of the same exchange and pair)."""
    frames = _frames(spark, sf_dir)
    reason = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("snapshot for "), F.col("pair"), F.lit(" failed after 3 attempts"))).otherwise(F.lit("closed by peer"))
    down = frames.where("kind = 'connection' and not connected").select("exchange", "event_id", "ns", F.regexp_extract(reason, r"^snapshot for (\S+) failed", 1).alias("pair"))
    failed = down.where("pair <> ''").withColumn("bin", F.explode(F.array(F.floor(F.col("ns") / (8 * HOUR)), F.floor(F.col("ns") / (8 * HOUR)) - 1)))
    asked = frames.where("kind = 'snapshot'").select("exchange", "pair", F.col("ns").alias("asked_ns"), F.floor(F.col("ns") / (8 * HOUR)).alias("bin"))
    hits = failed.join(asked, ["exchange", "pair", "bin"]).where((F.col("asked_ns") < F.col("ns")) & (F.col("asked_ns") >= F.col("ns") - 8 * HOUR)).groupBy("event_id").agg(F.count("*").alias("cancelled"))
    return down.where("pair <> ''").join(hits, "event_id", "left").select("exchange", "event_id", "pair", F.coalesce("cancelled", F.lit(0)).cast("long").alias("cancelled"))


FAILURES_SQL = f"""WITH {FRAMES} SELECT exchange, event_id, pair, (SELECT count(*) FROM fr s WHERE s.kind = 'snapshot' AND s.exchange = d.exchange AND s.pair = d.pair AND s.ns < d.ns AND s.ns >= d.ns - {8 * HOUR}) AS cancelled
FROM fr d WHERE kind = 'connection' AND NOT connected AND event_id % 3 = 0"""


def replay_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wall time at each whole day of a replay, from the last processed frame's two clocks; the wall clock of
    frames is ahead of their own time by a second for each exchange's number, and drifts by their id."""
    frames = sequencing.epochs(_frames(spark, sf_dir)).where("outcome = 'processed'")
    drift = F.substring("exchange", 2, 1).cast("long") * 10**9 + F.col("event_id") % 1000
    anchors = frames.select("exchange", F.col("ns").alias("mono"), "event_id", (F.col("ns") + drift).alias("wall"))
    span = anchors.agg(F.min("mono").alias("lo"), F.max("mono").alias("hi"))
    days = span.where("lo is not null").select(F.explode(F.sequence(F.ceil(F.col("lo") / DAY), F.floor(F.col("hi") / DAY))).alias("day")).select((F.col("day") * DAY).cast("long").alias("tick"))
    ticks = days.crossJoin(F.broadcast(anchors.select("exchange").distinct()))
    rows = asof_join(ticks, anchors.withColumn("anchor", F.col("mono")), ["exchange"], "tick", "mono", ["event_id"], ["anchor", "wall"], DAY)
    return rows.select("exchange", "tick", (F.col("wall") + F.col("tick") - F.col("anchor")).alias("wall_ns"))


CLOCK_SQL = f"""WITH {FRAMES}, an AS (SELECT exchange, ns AS mono, event_id, ns + substr(exchange, 2, 1)::BIGINT * 1000000000 + event_id % 1000 AS wall FROM oc WHERE outcome = 'processed'
), tk AS (SELECT unnest(range(((min(mono) + {DAY - 1}) // {DAY})::BIGINT, (max(mono) // {DAY} + 1)::BIGINT)) * {DAY} AS tick FROM an), t AS (SELECT exchange, tick, (SELECT arg_max({{'m': mono, 'w': wall}}, (mono, event_id)) FROM an WHERE an.exchange = e.exchange AND mono <= tick) AS a FROM tk, (SELECT DISTINCT exchange FROM an) e)
SELECT exchange, tick, a.w + tick - a.m AS wall_ns FROM t"""


def replay_expiries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instants at which books lapse, none after the last frame."""
    rows = common.lapsing_quotes(spark, sf_dir)
    return rows.where("kind = 'expiry'").select("pair", "venue", "event_id", "ns")


EXPIRIES_SQL = f"WITH {common.EXPIRIES} SELECT pair, venue, event_id, ns FROM te WHERE kind = 'expiry'"


def replay_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each change of a book between trusted, untrusted and lapsed."""
    rows = common.lapsing_quotes(spark, sf_dir)
    state = F.when(~F.col("trusted"), "untrusted").when(F.col("kind") == "expiry", "lapsed").otherwise("trusted")
    runs = audits.runs(rows, book.BOOK, ["ns", "event_id"], state)
    return runs.select("pair", "venue", "state", "start_ns", "end_ns", "rows")


TRANSITIONS_SQL = f"""WITH {common.EXPIRIES}, s AS (SELECT *, CASE WHEN NOT trusted THEN 'untrusted' WHEN kind = 'expiry' THEN 'lapsed' ELSE 'trusted' END AS state FROM te
), n AS (SELECT *, CASE WHEN state = lag(state) OVER (PARTITION BY pair, venue ORDER BY ns, event_id) THEN 0 ELSE 1 END AS new FROM s
), r AS (SELECT *, sum(new) OVER (PARTITION BY pair, venue ORDER BY ns, event_id) AS run FROM n
), g AS (SELECT pair, venue, run, any_value(state) AS state, min(ns) AS start_ns, count(*) AS rows FROM r GROUP BY ALL)
SELECT pair, venue, state, start_ns, lead(start_ns) OVER (PARTITION BY pair, venue ORDER BY run) AS end_ns, rows FROM g"""


def book_terminators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates by reason where some quotes are crossed or lack a side, and venues go down and up: every 61st
    event takes its venue's books down, every 67th brings them back, every 97th gives its own book up."""
    off = F.when(F.col("event_id") % 37 == 0, -1).when(F.col("event_id") % 41 == 0, 1).otherwise(0)
    rows = book.sequenced(market.quotes(spark, sf_dir).withColumn("off", off))
    bid = F.when(F.col("event_id") % 23 == 0, F.col("ask") + 1).when(F.col("event_id") % 31 == 0, F.lit(None)).otherwise(F.col("bid"))
    rough = rows.withColumn("bid", bid).withColumn("kind", F.when(F.col("event_id") % 97 == 0, "invalidate").otherwise(F.col("kind")))
    links = rows.where("event_id % 61 = 0 or event_id % 67 = 0").select("venue", "ns", "event_id", F.when(F.col("event_id") % 61 == 0, "down").otherwise("up").alias("kind"))
    books = rows.select("pair", "venue").distinct()
    # A venue's link is an event of each of its books, right after the event that it comes from.
    spread = links.join(books, "venue").select("pair", "venue", "ns", (2 * F.col("event_id") + 1).alias("event_id"), "kind", F.lit(None).cast("long").alias("seq"), F.lit(None).cast("long").alias("bid"), F.lit(None).cast("long").alias("ask"))
    both = rough.select("pair", "venue", "ns", (2 * F.col("event_id")).alias("event_id"), "kind", "seq", "bid", "ask").unionByName(spread)
    return book.apply_reasons(both, links=True).where(~F.col("kind").isin(book.LINKS)).select((F.col("event_id") / 2).cast("long").alias("event_id"), "pair", "venue", "reason", "accepted")


TERMINATORS_SQL = f"""WITH {Q}, sq AS (SELECT *, CASE WHEN event_id % 37 = 0 THEN n - 1 WHEN event_id % 41 = 0 THEN n + 1 ELSE n END AS seq FROM (SELECT *, row_number() OVER (PARTITION BY pair, venue ORDER BY ns, event_id) AS n FROM q)
), ev AS (
  SELECT pair, venue, ns, 2 * event_id AS id, CASE WHEN event_id % 97 = 0 THEN 'invalidate' ELSE kind END AS kind, seq, CASE WHEN event_id % 23 = 0 THEN ask + 1 WHEN event_id % 31 = 0 THEN NULL ELSE bid END AS bid, ask FROM sq
  UNION ALL SELECT b.pair, l.venue, l.ns, 2 * l.event_id + 1, CASE WHEN l.event_id % 61 = 0 THEN 'down' ELSE 'up' END, NULL, NULL, NULL FROM sq l JOIN (SELECT DISTINCT pair, venue FROM sq) b ON b.venue = l.venue WHERE l.event_id % 61 = 0 OR l.event_id % 67 = 0
), lk AS (SELECT *, kind <> 'down' AND coalesce(last_value(CASE WHEN kind IN ('down', 'up') THEN kind END IGNORE NULLS) OVER (PARTITION BY pair, venue ORDER BY ns, id) = 'down', false) AS cut FROM ev
), mk AS (SELECT *, kind <> 'delta' AND NOT cut AS mark, coalesce(bid >= ask, false) AS crossed, bid IS NULL OR ask IS NULL AS hollow FROM lk
), ch AS (SELECT *, sum(mark::INT) OVER w AS chain, last_value(CASE WHEN mark THEN {{'k': kind, 'bad': crossed OR hollow}} END IGNORE NULLS) OVER w AS head FROM mk WINDOW w AS (PARTITION BY pair, venue ORDER BY ns, id)
), tp AS (SELECT *, max(CASE WHEN NOT cut THEN seq END) OVER (PARTITION BY pair, venue, chain ORDER BY ns, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM ch
), dd AS (SELECT *, coalesce(bool_or(NOT cut AND kind = 'delta' AND (seq > top + 1 OR (seq = top + 1 AND crossed))) OVER (PARTITION BY pair, venue, chain ORDER BY ns, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS dead FROM tp
), rs AS (SELECT *, CASE WHEN cut THEN 'disconnected' WHEN kind = 'reset' THEN 'adapter_reset' WHEN kind = 'invalidate' THEN 'invalidated' WHEN kind = 'snapshot' AND hollow THEN 'snapshot_incomplete' WHEN kind = 'snapshot' AND crossed THEN 'snapshot_crossed' WHEN kind = 'snapshot' THEN 'ok'
    WHEN head IS NULL OR head.k <> 'snapshot' OR head.bad OR dead THEN 'book_stale' WHEN seq <= top THEN 'out_of_order' WHEN seq > top + 1 THEN 'sequence_gap' WHEN crossed THEN 'crossed_book' WHEN hollow THEN 'book_incomplete' ELSE 'ok' END AS reason FROM dd)
SELECT id // 2 AS event_id, pair, venue, reason, reason IN ('ok', 'adapter_reset') AS accepted FROM rs WHERE kind NOT IN ('down', 'up')"""


def capture_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each venue's events written as a capture and read back: v0's file is whole, v1's footer declares a lost
    frame and counts one too many, v2 has no footer."""
    frames = _frames(spark, sf_dir)
    body = F.to_json(F.struct(F.lit("frame").alias("type"), "exchange", "kind", F.col("ns").alias("wall_ns"), F.col("ns").alias("mono_ns"), F.when(F.col("kind") == "ws", F.lit("{}")).alias("raw"), F.when(F.col("kind") == "snapshot", F.lit("{}")).alias("payload"), F.when(F.col("kind") == "connection", F.col("connected")).alias("connected")))
    count = frames.groupBy("exchange").agg(F.count("*").alias("n")).withColumn("accepted", F.col("n") + (F.col("exchange") == "v1").cast("int"))
    lost = F.when(F.col("exchange") == "v1", F.lit(1)).otherwise(F.lit(0))
    counts = F.struct((F.col("accepted") + lost).alias("attempted"), "accepted", F.col("n").alias("flushed"), F.create_map(F.lit("ws"), F.create_map(F.lit("queue_full"), lost)).alias("dropped"))
    footer = F.to_json(F.struct(F.lit("footer").alias("type"), F.col("accepted").alias("frame_count"), F.lit(True).alias("clean"), F.lit("complete").alias("status"), counts.alias("frame_counts")))
    header = F.to_json(F.struct(F.lit("header").alias("type"), F.lit("capture").alias("format"), F.lit(2).alias("version")))
    lines = frames.select("exchange", body.alias("line")).unionByName(count.select("exchange", header.alias("line"))).unionByName(count.where("exchange <> 'v2'").select("exchange", footer.alias("line")))
    path = shared_path(spark, "capture")
    lines.repartition("exchange").write.partitionBy("exchange").option("compression", "gzip").text(path)
    records = capture.read(spark, path)
    exchange = F.regexp_extract("file", r"exchange=(\w+)", 1)
    rows = capture.integrity(records.withColumn("file", exchange))
    return rows.select(F.col("file").alias("exchange"), "frames", "verdict")


INTEGRITY_SQL = f"WITH {Q} SELECT venue AS exchange, count(*) AS frames, CASE venue WHEN 'v0' THEN 'lossless' WHEN 'v1' THEN 'count_mismatch' ELSE 'missing_footer' END AS verdict FROM q GROUP BY venue"


def capture_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames in the order of a replay within each exchange, and what is wrong with bad ones: every 43rd lacks
    its payload or message, every 47th has a kind that there isn't."""
    rows = _frames(spark, sf_dir)
    kind = F.when(F.col("event_id") % 47 == 0, "tick").otherwise(F.col("kind"))
    some = F.when(F.col("event_id") % 43 != 0, F.lit("{}"))
    records = rows.select(F.lit("frame").alias("type"), "exchange", kind.alias("kind"), F.col("ns").alias("wall_ns"), F.col("ns").alias("mono_ns"), some.alias("raw"), some.alias("payload"), F.lit(None).cast("string").alias("error"), "connected", "event_id")
    found = capture.frames(records)
    place = F.row_number().over(Window.partitionBy("exchange").orderBy("mono_ns", "priority", "event_id"))
    return found.select("exchange", "event_id", "kind", "wrong", place.cast("long").alias("place"))


CAPTURE_FRAMES_SQL = f"""WITH {FRAMES}, k AS (SELECT exchange, event_id, ns, CASE WHEN event_id % 47 = 0 THEN 'tick' ELSE kind END AS kind FROM fr)
SELECT exchange, event_id, kind, CASE WHEN kind = 'tick' THEN 'unknown_kind' WHEN kind = 'ws' AND event_id % 43 = 0 THEN 'missing_raw' WHEN kind = 'snapshot' AND event_id % 43 = 0 THEN 'payload_or_error' END AS wrong,
  row_number() OVER (PARTITION BY exchange ORDER BY ns, CASE kind WHEN 'connection' THEN 0 WHEN 'snapshot' THEN 1 ELSE 2 END, event_id) AS place FROM k"""


def capture_frame_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames attempted, accepted and dropped by kind, and dropped ones by reason; every 53rd finds the queue
    full and every 59th the writer closed."""
    reason = F.when(F.col("event_id") % 53 == 0, "queue_full").when(F.col("event_id") % 59 == 0, "writer_closed")
    rows = _frames(spark, sf_dir).withColumn("reason", reason)
    return rows.groupBy("kind").agg(F.count("*").alias("attempted"), F.count_if(F.col("reason").isNull()).alias("accepted"), F.count_if(F.col("reason") == "queue_full").alias("queue_full"), F.count_if(F.col("reason") == "writer_closed").alias("writer_closed"))


FRAME_COUNTS_SQL = f"WITH {FRAMES} SELECT kind, count(*) AS attempted, count(*) FILTER (event_id % 53 <> 0 AND event_id % 59 <> 0) AS accepted, count(*) FILTER (event_id % 53 = 0) AS queue_full, count(*) FILTER (event_id % 53 <> 0 AND event_id % 59 = 0) AS writer_closed FROM fr GROUP BY kind"

def capture_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames recorded as captures whose footers come from what was written, and read back: v0 loses every 53rd frame to a
    full queue and every 59th to a closed writer; v1's snapshots come without provenance for every third."""
    n = F.col("event_id")
    rows = _frames(spark, sf_dir).withColumn("reason", F.when((F.col("exchange") == "v0") & (n % 53 == 0), "queue_full").when((F.col("exchange") == "v0") & (n % 59 == 0), "writer_closed"))
    told = F.when((F.col("kind") == "snapshot") & ~((F.col("exchange") == "v1") & (n % 3 == 0)), F.struct(F.lit("resync").alias("purpose"), "pair", F.lit(1).cast("long").alias("connection_generation")))
    frames = rows.select("exchange", "kind", F.col("ns").alias("wall_ns"), F.col("ns").alias("mono_ns"), F.when(F.col("kind") == "ws", "{}").alias("raw"), F.when(F.col("kind") == "snapshot", "{}").alias("payload"), F.when(F.col("kind") == "connection", F.col("connected")).alias("connected"), told.alias("snapshot_provenance"), "reason")
    path = shared_path(spark, "recorded")
    capture.record(frames, path, list(market.VENUES), 0, gzip=True)
    records = capture.read(spark, path)
    found = capture.integrity(records.withColumn("file", F.regexp_extract("file", r"exchange=(\w+)", 1)), allow_lossy=True)
    return found.select(F.col("file").alias("exchange"), "frames", "provenance", "verdict")


RECORDED_SQL = f"""WITH {FRAMES}, k AS (SELECT *, exchange = 'v0' AND (event_id % 53 = 0 OR event_id % 59 = 0) AS lost, kind = 'snapshot' AND exchange = 'v1' AND event_id % 3 = 0 AS bare FROM fr)
SELECT exchange, count(*) FILTER (NOT lost) AS frames, CASE WHEN bool_or(bare AND NOT lost) THEN 'incomplete' ELSE 'complete' END AS provenance, CASE WHEN bool_or(lost) THEN 'lossy' ELSE 'lossless' END AS verdict FROM k GROUP BY exchange"""


def _link_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes as frames of a connection: every 97th takes its book's link down and every 89th brings it up; of snapshots
    asked for, every 5th has no answer and every 3rd is older than the last update; every 11th update skips an id, as does one after a reset."""
    rows = market.quotes(spark, sf_dir).withColumn("block", block_of(F.col("ns"), market.NS_DAY))
    n = F.col("event_id")
    update = F.col("kind") != "snapshot"
    rows = running(rows, book.BOOK, book.ORDER, {"heard": ("sum", F.when(update, 1), True)})
    heard = F.coalesce("heard", F.lit(0))
    # An update covers [first, its number]; the one before it ended at its number - 1.
    first = heard + F.when((n % 11 == 0) | (F.col("kind") == "reset"), 1).otherwise(0)
    answer = heard - F.when(n % 3 == 2, 1).otherwise(0)
    frame = F.when(n % 97 == 0, "down").when(n % 89 == 0, "up").when(update, F.when(first > heard, "gap").otherwise("update"))
    frame = frame.when(n % 5 == 4, "failed").when(answer < heard, "stale").otherwise("snapshot")
    return settled(rows.select("pair", "venue", "ns", "event_id", "block", frame.alias("frame")), "frames")


def replay_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each frame: applied, buffered, skipped, a resync, a retry, or a reconnect."""
    return recovery.replay(_link_frames(spark, sf_dir))


RECOVERY_SQL = f"""WITH RECURSIVE {Q}, fr AS (
  SELECT pair, venue, ns, event_id, row_number() OVER (PARTITION BY pair, venue ORDER BY ns, event_id) AS n, CASE WHEN event_id % 97 = 0 THEN 'down' WHEN event_id % 89 = 0 THEN 'up'
    WHEN kind <> 'snapshot' THEN CASE WHEN event_id % 11 = 0 OR kind = 'reset' THEN 'gap' ELSE 'update' END WHEN event_id % 5 = 4 THEN 'failed' WHEN event_id % 3 = 2 THEN 'stale' ELSE 'snapshot' END AS frame FROM q
), st AS (
  SELECT pair, venue, 0::BIGINT AS n, 0::BIGINT AS ns, 0::BIGINT AS event_id, '' AS frame, '' AS outcome, 'waiting' AS mode, 1 AS attempt, 0 AS resyncs FROM (SELECT DISTINCT pair, venue FROM q)
  UNION ALL
  SELECT f.pair, f.venue, f.n, f.ns, f.event_id, f.frame,
    CASE WHEN f.frame = 'up' THEN 'connected' WHEN f.frame = 'down' THEN 'disconnected' WHEN mode = 'down' THEN 'skipped'
      WHEN mode = 'aligned' THEN CASE f.frame WHEN 'gap' THEN CASE WHEN resyncs < {recovery.RESYNCS} THEN 'resync' ELSE 'reconnect' END WHEN 'update' THEN 'applied' ELSE 'unasked' END
      WHEN f.frame IN ('update', 'gap') THEN 'buffered' WHEN f.frame = 'snapshot' THEN 'aligned' WHEN attempt < {recovery.ATTEMPTS} THEN 'retry' ELSE 'reconnect' END,
    CASE WHEN f.frame = 'up' THEN 'waiting' WHEN f.frame = 'down' OR mode = 'down' THEN 'down' WHEN mode = 'aligned' THEN CASE WHEN f.frame <> 'gap' THEN 'aligned' WHEN resyncs < {recovery.RESYNCS} THEN 'waiting' ELSE 'down' END
      WHEN f.frame = 'snapshot' THEN 'aligned' WHEN f.frame IN ('stale', 'failed') AND attempt >= {recovery.ATTEMPTS} THEN 'down' ELSE 'waiting' END,
    CASE WHEN f.frame = 'up' OR (mode = 'aligned' AND f.frame = 'gap') THEN 1 WHEN mode = 'waiting' AND f.frame IN ('stale', 'failed') THEN attempt + 1 WHEN mode = 'waiting' THEN attempt ELSE 0 END,
    CASE WHEN f.frame IN ('up', 'down') OR mode = 'down' OR (mode = 'aligned' AND f.frame = 'gap' AND resyncs >= {recovery.RESYNCS}) OR (mode = 'waiting' AND f.frame IN ('stale', 'failed') AND attempt >= {recovery.ATTEMPTS}) THEN 0
      WHEN mode = 'aligned' AND f.frame = 'gap' THEN resyncs + 1 ELSE resyncs END
  FROM st JOIN fr f ON f.pair = st.pair AND f.venue = st.venue AND f.n = st.n + 1
) SELECT event_id, pair, venue, ns, frame, outcome, CASE WHEN mode = 'waiting' THEN 'waiting:' || attempt ELSE mode END AS state, resyncs FROM st WHERE n > 0"""

QUERIES = {
    "capture_recorded": (capture_recorded, RECORDED_SQL),
    "replay_recovery": (replay_recovery, RECOVERY_SQL),
    "sequencing_apply": (sequencing_apply, APPLY_SQL),
    "resync_requests": (resync_requests, REQUESTS_SQL),
    "sequencing_align": (sequencing_align, ALIGN_SQL),
    "sequencing_envelopes": (sequencing_envelopes, ENVELOPES_SQL),
    "sequencing_resubscribe": (sequencing_resubscribe, RESUB_SQL),
    "sequencing_verify": (sequencing_verify, VERIFY_SQL),
    "replay_frames": (replay_frames, REPLAY_SQL),
    "replay_counts": (replay_counts, REPLAY_COUNTS_SQL),
    "replay_snapshots": (replay_snapshots, SNAPSHOTS_SQL),
    "replay_failures": (replay_failures, FAILURES_SQL),
    "replay_clock": (replay_clock, CLOCK_SQL),
    "replay_expiries": (replay_expiries, EXPIRIES_SQL),
    "replay_transitions": (replay_transitions, TRANSITIONS_SQL),
    "book_terminators": (book_terminators, TERMINATORS_SQL),
    "capture_integrity": (capture_integrity, INTEGRITY_SQL),
    "capture_frames": (capture_frames, CAPTURE_FRAMES_SQL),
    "capture_frame_counts": (capture_frame_counts, FRAME_COUNTS_SQL),
}
