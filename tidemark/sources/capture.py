"""Capture files: JSON lines (gzip by suffix) of a header, frames and a footer, with their integrity.

A file's lines keep no numbers in Spark, so records are told apart by their `type`, and frames are ordered
by their monotonic time and connection before snapshot before message.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

RECORD = (
    "type string, format string, version int, exchanges map<string,array<string>>, started_wall_ns long, exchange string, kind string, wall_ns long, mono_ns long, raw string, url string,"
    " payload string, error string, connected boolean, connection_generation long, reason string, frame_count long, clean boolean, status string,"
    " snapshot_provenance struct<purpose:string,pair:string,connection_generation:long>,"
    " frame_counts struct<attempted:long,accepted:long,flushed:long,dropped:map<string,map<string,long>>>"
)
KINDS = ("connection", "snapshot", "ws")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, parsed fields): every line of the capture files under a path; `type` is null where a
    line is no JSON object."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    return lines.withColumn("r", F.from_json("line", RECORD)).select("file", "line", "r.*")


def frames(records: DataFrame) -> DataFrame:
    """Frames with the order in which a replay takes them, and what is wrong with a bad one."""
    own = records.where("type = 'frame' or (type is null and kind is not null)")
    wrong = (
        F.when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "unknown_kind")
        .when(F.col("exchange").isNull() | F.col("wall_ns").isNull() | F.col("mono_ns").isNull(), "missing_field")
        .when((F.col("kind") == "ws") & F.col("raw").isNull(), "missing_raw")
        .when((F.col("kind") == "snapshot") & (F.col("payload").isNull() == F.col("error").isNull()), "payload_or_error")
        .when((F.col("kind") == "connection") & F.col("connected").isNull(), "missing_connected")
    )
    priority = F.when(F.col("kind") == "connection", 0).when(F.col("kind") == "snapshot", 1).otherwise(2)
    return own.withColumn("priority", priority).withColumn("wrong", wrong)


def integrity(records: DataFrame, allow_lossy: bool = False) -> DataFrame:
    """(file, frames, provenance, verdict): what each file's header, frames and footer say of each other.

    Verdicts: invalid_header, unsupported_version, missing_footer, writer_failure, count_mismatch,
    declared_frame_loss, lossy, lossless, legacy_unknown.
    """
    kind = F.col("type")
    is_frame = (kind == "frame") | (kind.isNull() & F.col("kind").isNotNull())
    footer = F.max_by(F.struct("frame_count", "clean", "status", "frame_counts"), F.when(kind == "footer", 1))
    dropped = F.aggregate(F.flatten(F.transform(F.map_values("footer.frame_counts.dropped"), lambda m: F.map_values(m))), F.lit(0).cast("long"), lambda a, x: a + x)
    by_file = records.groupBy("file").agg(
        F.max(F.when(kind == "header", F.struct("format", "version"))).alias("header"),
        footer.alias("footer"),
        F.count_if(is_frame).alias("frames"),
        F.every(F.when(is_frame & (F.col("kind") == "snapshot"), F.col("snapshot_provenance").isNotNull())).alias("proven"),
        F.count_if(kind == "footer").alias("footers"),
    )
    c = F.col("footer.frame_counts")
    lost = F.coalesce(dropped, F.lit(0))
    verdict = (
        F.when(F.col("header").isNull(), "invalid_header")
        .when(~F.col("header.version").isin(1, 2), "unsupported_version")
        .when((F.col("footers") == 0) & (F.col("header.version") == 1), "legacy_unknown")
        .when(F.col("footers") == 0, "missing_footer")
        .when(~F.coalesce(F.col("footer.clean"), F.lit(False)), "writer_failure")
        .when((F.col("footer.frame_count") != F.col("frames")) | (c["accepted"] != F.col("frames")) | (c["attempted"] != c["accepted"] + lost) | (c["flushed"] > c["accepted"]), "count_mismatch")
        .when(c.isNull(), "legacy_unknown")
        .when(lost > 0, "lossy" if allow_lossy else "declared_frame_loss")
        .otherwise("lossless")
    )
    return by_file.select("file", "frames", F.when(F.col("proven"), "complete").otherwise("incomplete").alias("provenance"), verdict.alias("verdict"))


def write(lines: DataFrame, path: str, gzip: bool = False) -> None:
    """Lines (line) as text files."""
    lines.select("line").write.option("compression", "gzip" if gzip else "none").text(path)


#: Why a writer drops a frame.
REASONS = ("queue_full", "writer_closed", "writer_failed", "serialization_error")
#: Most frames of one file: one task reads a packed file whole.
FILE_FRAMES = 250_000


def record(frames_: DataFrame, path: str, exchanges: list[str], started_wall_ns: int, gzip: bool = False) -> None:
    """Write frames as one capture for each exchange, in folders exchange=<name>. frames_: RECORD's columns of frames and
    `reason`, why a frame was dropped, else null.

    What a footer says is observed while the frames are written, so it counts what this run let through and lost, and
    nothing is read twice. A run that dies leaves no footer."""
    spark = frames_.sparkSession
    own = [c for c in frames_.columns if c != "reason"]
    counts = {f"{what}|{e}|{k}": F.count_if((F.col("exchange") == e) & (F.col("kind") == k) & c) for e in exchanges for k in KINDS for what, c in [("accepted", F.col("reason").isNull()), *[(r, F.col("reason") == r) for r in REASONS]]}
    seen = Observation()
    lines = frames_.observe(seen, *[c.alias(n) for n, c in counts.items()]).where("reason is null")
    lines = lines.select("exchange", F.to_json(F.struct(F.lit("frame").alias("type"), *own)).alias("line"))
    packed = "gzip" if gzip else "none"
    # Each task keeps a file open for each exchange; else it would sort its lines, which are far wider than its frames.
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    spark.conf.set(key, len(exchanges) + 1)
    try:
        lines.write.partitionBy("exchange").option("compression", packed).option("maxRecordsPerFile", FILE_FRAMES).text(path)
    finally:
        spark.conf.set(key, before)
    got, edges = seen.get, []
    for e in exchanges:
        accepted = {k: got[f"accepted|{e}|{k}"] for k in KINDS}
        dropped = {k: {r: got[f"{r}|{e}|{k}"] for r in REASONS if got[f"{r}|{e}|{k}"]} for k in KINDS}
        lost = {k: sum(d.values()) for k, d in dropped.items()}
        total = sum(accepted.values())
        header = {"type": "header", "format": "capture", "version": 2, "exchanges": {e: []}, "started_wall_ns": started_wall_ns}
        frame_counts = {"attempted": total + sum(lost.values()), "accepted": total, "flushed": total, "attempted_by_kind": {k: accepted[k] + lost[k] for k in KINDS}, "accepted_by_kind": accepted, "dropped": {k: d for k, d in dropped.items() if d}}
        footer = {"type": "footer", "frame_count": total, "counts": accepted, "clean": True, "status": "complete", "frame_counts": frame_counts}
        edges += [(e, json.dumps(x)) for x in (header, footer)]
    spark.createDataFrame(edges, "exchange string, line string").coalesce(1).write.mode("append").partitionBy("exchange").option("compression", packed).text(path)
