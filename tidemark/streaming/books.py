"""Streaming books: the keyed fold of quotes, and idempotent rollups per micro-batch.

A book's state is what its chain says so far: its number, what it began with, the greatest sequence number,
and whether it has ended. It lives in Spark's state store by (pair, venue); rows of a micro-batch are taken
in event order, so the stream gives what the batch operators give on the same input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.book import LINKS
from tidemark.session import shared_path

REASONS = "event_id long, pair string, venue string, ns long, seq long, chain long, reason string, accepted boolean"
_CHAIN = "n long, chain long, kind string, bad boolean, top long, dead boolean, cut boolean"
#: Below every sequence number; what is held of a book before its first row.
NONE = -(2**62)
EMPTY = (0, 0, "none", False, NONE, False, False)


#: Reasons in the order in which they are tried; the last one is what is left.
_NAMES = np.array(["link_down", "link_up", "disconnected", "adapter_reset", "snapshot_incomplete", "snapshot_crossed", "ok", "book_stale", "out_of_order", "sequence_gap", "crossed_book", "book_incomplete", "ok"], object)
#: Rows of one frame that goes back to Spark.
SLICE = 1 << 16


def gathered(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """One key's rows (venue, ns, event_id, kind, bid, ask, off) in event order, of which each text is held once."""
    columns, once = ["venue", "ns", "event_id", "kind", "bid", "ask", "off"], {}
    parts = [{c: own[c].map(lambda t: once.setdefault(t, t)).to_numpy(object) if c in ("venue", "kind") else own[c].to_numpy() for c in columns} for own in batches]
    whole = {c: np.concatenate([p.pop(c) for p in parts]) for c in columns}
    order = np.lexsort((whole["event_id"], whole["ns"]))
    return pd.DataFrame({c: whole.pop(c)[order] for c in columns}, copy=False)


def accept(rows: pd.DataFrame, held: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """(reasons, sequence numbers, chains, what is held after) of one book's rows in event order: (kind, bid, ask,
    off). held: (n, chain, kind, bad, top, dead, cut), at first `EMPTY`.

    All chains are taken at once: what runs within a chain is a running maximum of numbers that a chain's place leads."""
    n, chain, head, bad, top, dead, cut = held
    kind, bid, ask = rows["kind"].to_numpy(object), rows["bid"].to_numpy(float, na_value=np.nan), rows["ask"].to_numpy(float, na_value=np.nan)
    if not len(kind):
        return np.empty(0, object), np.empty(0, np.int64), np.empty(0, np.int64), held
    crossed, hollow = bid >= ask, np.isnan(bid) | np.isnan(ask)
    downs, ups, delta, snapshot = (kind == k for k in ("down", "up", "delta", "snapshot"))
    link, place = downs | ups, np.arange(len(kind))
    last = np.maximum.accumulate(np.where(link, place, -1))
    down = np.where(last < 0, cut, downs[last]) & ~downs
    seq = n + np.cumsum(~link) + np.nan_to_num(rows["off"].to_numpy(float, na_value=np.nan)).astype(np.int64)
    mark = ~delta & ~down
    at = np.cumsum(mark)  # 0: the chain that is held
    marks = np.flatnonzero(mark)
    ready = np.concatenate(([head == "snapshot" and not bad], snapshot[marks] & ~(crossed | hollow)[marks]))[at]
    own = ~down & ~link
    low = min(int(seq.min()), top if top > NONE else int(seq.min())) - 1
    wide = max(int(seq.max()), top) - low + 1
    reached = np.maximum.accumulate(np.concatenate(([top - low if top > NONE else 0], at * wide + np.where(own, seq - low, 0))))
    known = (reached[:-1] // wide == at) & (reached[:-1] % wide > 0)
    before = reached[:-1] % wide + low
    new = delta & ~down & known
    gap, fresh = new & (seq > before + 1), new & (seq == before + 1)
    ended = np.maximum.accumulate(np.concatenate(([0 if dead else -1], np.where(gap | (fresh & crossed), at, -1))))
    tests = [downs, ups, down, kind == "reset", snapshot & hollow, snapshot & crossed, snapshot, (ended[:-1] == at) | ~ready, known & (seq <= before), gap, crossed, hollow]
    code = np.full(len(kind), len(tests), np.int8)
    for k in reversed(range(len(tests))):
        code[tests[k]] = k
    if len(marks):
        head, bad = kind[marks[-1]], bool(crossed[marks[-1]] | hollow[marks[-1]])
    over = int(reached[-1] % wide) if reached[-1] // wide == at[-1] else 0
    after = (int(n + np.count_nonzero(~link)), int(chain + len(marks)), head, bad, over + low if over else NONE, bool(ended[-1] == at[-1]), bool(downs[last[-1]]) if last[-1] >= 0 else cut)
    return _NAMES[code], seq, chain + at, after


def _accept(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = gathered(batches)
    found, seq, chains, held = accept(rows, tuple(state.get) if state.exists else EMPTY)
    state.update(held)
    ids, ns, links = rows["event_id"].to_numpy(), rows["ns"].to_numpy(), rows["kind"].isin(LINKS).to_numpy()
    del rows
    for a in range(0, len(ids), SLICE):
        own = slice(a, a + SLICE)
        out = pd.DataFrame({"event_id": ids[own], "pair": key[0], "venue": key[1], "ns": ns[own], "seq": seq[own], "chain": chains[own], "reason": found[own]})
        out["accepted"] = out["reason"].isin(["ok", "adapter_reset"])
        out["seq"] = out["seq"].astype("Int64").mask(links[own])
        yield out


def reasons(feed: DataFrame) -> DataFrame:
    """A stream of (event_id, pair, venue, ns, kind, bid, ask, off) as REASONS rows, like book.apply_reasons. A
    book's updates are numbered as they come, and `off` moves a number on or back."""
    own = feed.select("event_id", "pair", "venue", "ns", "kind", "bid", "ask", "off")
    return own.groupBy("pair", "venue").applyInPandasWithState(_accept, REASONS, _CHAIN, "append", GroupStateTimeout.NoTimeout)


def trusted(feed: DataFrame) -> DataFrame:
    """The same as rows (event_id, pair, venue, ns, trusted) of what changed a book, like book.tops_over_time."""
    rows = reasons(feed).where(~F.col("reason").isin("out_of_order", "disconnected"))
    return rows.select("event_id", "pair", "venue", "ns", (F.col("reason") == "ok").alias("trusted"))


def run_to_table(stream: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """All that is there now, written as Parquet with a checkpoint in the shared folder, and read back."""
    return run_into(stream, shared_path(spark, name))


#: The state store that keeps one entry for each key of a map, with timers.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_into(stream: DataFrame, path: str) -> DataFrame:
    """The same into a folder; another run goes on where the last one ended."""
    spark, key = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        started(stream, path).awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def started(stream: DataFrame, path: str) -> StreamingQuery:
    """A query over all that is there now, to Parquet with a checkpoint in a folder."""
    return stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()


def rollup_to_table(quotes: DataFrame, spark: SparkSession, width: int, name: str) -> DataFrame:
    """Counts by bucket and kind, through foreachBatch: each micro-batch writes its own partition, which a
    repeated batch overwrites, so nothing counts twice; reading sums them."""
    path = shared_path(spark, name)

    def upsert(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy((F.floor(F.col("ns") / width).cast("long") * width).alias("bucket_ns"), "kind").agg(F.count("*").alias("n"))
        counts.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")

    query = quotes.writeStream.foreachBatch(upsert).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("bucket_ns long, kind string, n long, batch int").parquet(f"{path}/rows").groupBy("bucket_ns", "kind").agg(F.sum("n").alias("n"))


def minute_counts(quotes: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Counts by pair and window of event time behind a watermark; what comes later than `late` is dropped."""
    timed = quotes.withColumn("at", F.timestamp_micros(F.floor(F.col("ns") / 1000).cast("long")))
    return timed.withWatermark("at", late).groupBy(F.window("at", width).alias("w"), "pair").agg(F.count("*").alias("n")).select(F.unix_micros("w.start").alias("start_us"), "pair", "n")
