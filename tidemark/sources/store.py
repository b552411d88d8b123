"""Stored tables with versions: episodes, their rollup by minute, and fill-rate buckets, ticks and sessions.

Files are only ever added, in folders of their own. A version is one manifest that lists, for every table, which
folder holds each day, and with which schema; it is published by an exclusive rename, so a change of several tables
is there whole or not at all, a writer that dies leaves the last version, and of two that start from one version the
second is refused. Readers keep to one version and list the folders of the days that they ask for.

Folders of older schemas stay as they are: when they are read, steps from one schema to the next bring them up to
date, and `migrate` writes them anew.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators import history, stats
from tidemark.operators.episodes import upsert_fold
from tidemark.session import settled, shared_path, stamps
from tidemark.sources.market import NS_DAY, NS_MINUTE

KEY = ["start_ns", "pair", "buy", "sell"]
#: The column by whose day a table is parted; sessions have one part.
TIMES = {"episodes": "start_ns", "rollup": "bucket_ns", "buckets": "bucket_ns", "ticks": "bucket_ns", "sessions": None}
#: Version of the stored schemas.
FORMAT = 2
EPISODES = (
    "id long, pair string, quote string, buy string, sell string, start_ns long, end_ns long, close_reason string, buy_price long, sell_price long, max_size long, open_spread long, "
    "peak_ns long, peak_id long, peak_spread long, peak_size long, peak_profit long, close_spread long, buy_age long, sell_age long, skew long, max_skew long, evaluations long"
)
EMPTY = {
    "episodes": EPISODES,
    "rollup": "bucket_ns long, pair string, quote string, n long, max_spread long, sum_spread long, sum_profit long",
    "buckets": "bucket_ns long, session string",
    "ticks": "bucket_ns long, session string",
    "sessions": "session string, started_ns long",
}


def _with_peak_id(rows: DataFrame) -> DataFrame:
    """Format 1 didn't say which event an episode's peak came from."""
    return rows if "peak_id" in rows.columns else rows.withColumn("peak_id", F.lit(None).cast("long"))


#: From each format to the next, by table.
STEPS: dict[tuple[str, int], Callable[[DataFrame], DataFrame]] = {("episodes", 1): _with_peak_id}


class Conflict(RuntimeError):
    """Another writer published the next version first."""


class _Files:
    """The few file operations that a manifest needs, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self.path = spark._jvm, path
        self._fs = self._jvm.org.apache.hadoop.fs
        conf = spark._jsc.hadoopConfiguration()
        self.files = self._at(path).getFileSystem(conf)
        full = self.files.makeQualified(self._at(path))
        self._context = self._fs.FileContext.getFileContext(full.toUri(), conf)
        kind = getattr(self._fs, "Options$Rename")
        self._plain = spark.sparkContext._gateway.new_array(kind, 1)
        self._plain[0] = kind.NONE

    def _at(self, path: str):
        return self._fs.Path(path)

    def names(self, folder: str) -> list[str]:
        at = self._at(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self.files.listStatus(at)) if self.files.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.files.open(self._at(f"{self.path}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Write a file under another name and give it its own, unless there is one by then."""
        made = self.files.makeQualified(self._at(f"{self.path}/tmp/{uuid.uuid4().hex}"))
        stream = self.files.create(made, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        final = self.files.makeQualified(self._at(f"{self.path}/{name}"))
        self.files.mkdirs(final.getParent())
        if self.files.exists(final):
            raise Conflict(name)
        try:
            self._context.rename(made, final, self._plain)
        except Exception as error:
            raise Conflict(name) from error

    def remove(self, folder: str) -> None:
        self.files.delete(self._at(f"{self.path}/{folder}"), True)


class EpisodeStore:
    """The stored tables in the folder `path`; another application finds them there."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._files = spark, path, _Files(spark, path)
        self._read: dict[tuple, DataFrame] = {}

    # Versions.

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._files.names("versions") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, by default the last: {version, tables: {table: {day: {folder, format, rows,
        newest}}}, schemas: {folder: schema}}."""
        known = self.versions()
        if not known:
            return {"version": 0, "tables": {}, "schemas": {}}
        return json.loads(self._files.read(f"versions/{version or known[-1]:012d}.json"))

    def _commit(self, base: dict, changes: dict[str, dict[str, dict | None]], schemas: dict[str, str]) -> None:
        """Publish the version after `base` with some tables' days put in place of others; None removes a day."""
        tables = {t: dict(days) for t, days in base["tables"].items()}
        for name, days in changes.items():
            own = tables.setdefault(name, {})
            for day, entry in days.items():
                own.pop(day, None)
                if entry is not None:
                    own[day] = entry
        used = {e["folder"] for days in tables.values() for e in days.values()}
        held = {f: s for f, s in (base["schemas"] | schemas).items() if f in used}
        version = base["version"] + 1
        self._files.publish(f"versions/{version:012d}.json", json.dumps({"version": version, "tables": tables, "schemas": held}))

    # Reading.

    def table(self, name: str, since: int | None = None, until: int | None = None, version: int | None = None) -> DataFrame:
        """Rows of a table's days that reach into [since, until)."""
        return self._rows(self.manifest(version), name, since, until)

    def _rows(self, held: dict, name: str, since: int | None = None, until: int | None = None, days: set[int] | None = None) -> DataFrame:
        every = held["tables"].get(name, {})
        first, last = None if since is None else since // NS_DAY, None if until is None else (until - 1) // NS_DAY
        wanted = sorted((int(d), e["folder"], e["format"]) for d, e in every.items() if (first is None or int(d) >= first) and (last is None or int(d) <= last) and (days is None or int(d) in days))
        key = (held["version"], name, tuple(wanted))
        if key not in self._read:
            self._read[key] = self._load(held, name, wanted)
        return self._read[key]

    def _load(self, held: dict, name: str, wanted: list[tuple[int, str, int]]) -> DataFrame:
        if not wanted:
            known = [held["schemas"][e["folder"]] for e in held["tables"].get(name, {}).values()]
            return self.spark.createDataFrame([], StructType.fromJson(json.loads(known[0])) if known else EMPTY[name])
        groups: dict[tuple[str, int], list[str]] = {}
        for day, folder, form in wanted:
            groups.setdefault((held["schemas"][folder], form), []).append(f"{self.path}/{folder}/day={day}")
        parts = []
        for (schema, form), paths in groups.items():
            rows = self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*paths)
            for step in range(form, FORMAT):
                rows = STEPS.get((name, step), lambda r: r)(rows)
            parts.append(rows)
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def _span(self, name: str, since: int | None, until: int | None) -> DataFrame:
        rows = self.table(name, since, until)
        rows = rows if since is None else rows.where(F.col(TIMES[name]) >= since)
        return rows if until is None else rows.where(F.col(TIMES[name]) < until)

    def episodes(self, since: int | None = None, until: int | None = None) -> DataFrame:
        """Episodes that start in [since, until)."""
        return self._span("episodes", since, until)

    def rollup(self, since: int | None = None, until: int | None = None) -> DataFrame:
        """The rollup's buckets of [since, until)."""
        return self._span("rollup", since, until)

    def newest(self) -> int:
        """The greatest id of all episodes; 0 without any."""
        return max((e["newest"] for e in self.manifest()["tables"].get("episodes", {}).values() if e["newest"] is not None), default=0)

    # Writing.

    def _write(self, name: str, rows: DataFrame) -> tuple[DataFrame, dict[str, dict], dict[str, str]]:
        """(rows as written, entries by day, schema by folder) of files that no version lists yet. A day of very
        many rows is split over tasks."""
        folder, time = f"data/{name}/{uuid.uuid4().hex}", TIMES[name]
        day = F.lit(0).cast("long") if time is None else F.floor(F.col(time) / NS_DAY).cast("long")
        dealt = rows.withColumn("day", day).hint("rebalance", "day")
        dealt.write.partitionBy("day").parquet(f"{self.path}/{folder}")
        schema = rows.schema
        back = self.spark.read.schema(StructType([*schema, *dealt.select("day").schema])).parquet(f"{self.path}/{folder}")
        newest = F.max("id") if "id" in rows.columns else F.lit(None).cast("long")
        found = back.groupBy("day").agg(F.count("*").alias("n"), newest.alias("newest")).collect()  # a row a day
        entries = {str(r.day): {"folder": folder, "format": FORMAT, "rows": r.n, "newest": r.newest} for r in found}
        return back.drop("day"), entries, {folder: schema.json()}

    def _replaced(self, name: str, rows: DataFrame, days: set[int]) -> tuple[DataFrame, dict, dict]:
        """`_write`, with those of `days` that have no rows any more removed."""
        back, entries, schema = self._write(name, rows)
        return back, {str(d): None for d in days} | entries, schema

    def _days(self, rows: DataFrame, time: str) -> set[int]:
        return {r.day for r in rows.select(F.floor(F.col(time) / NS_DAY).cast("long").alias("day")).distinct().collect()}

    def flush(self, changes: DataFrame) -> None:
        """Fold changes into the episodes of equal key (a closed one stays as it is, else the change wins) and
        rebuild the rollup of the days that they touch, in one commit. Only those days are read and written."""
        base = self.manifest()
        changes = settled(changes, "changes")  # their days are read first
        days = self._days(changes, "start_ns")
        new = changes.withColumn("version", F.lit(1))
        if any(str(d) in base["tables"].get("episodes", {}) for d in days):
            old = self._rows(base, "episodes", days=days).withColumn("version", F.lit(0))
            new = old.unionByName(new, allowMissingColumns=True)
        columns = [c for c in new.columns if c != "version"]
        folded = upsert_fold(new, KEY, [c for c in columns if c not in KEY]).select(*columns)
        self._put(base, folded, days)

    def _put(self, base: dict, episodes: DataFrame, days: set[int], others: dict | None = None, schemas: dict | None = None) -> None:
        """Commit the episodes of some days with their rollup, and other tables' days."""
        back, entries, one = self._replaced("episodes", episodes, days)
        _, buckets, two = self._replaced("rollup", stats.rollup(back, NS_MINUTE), days)
        self._commit(base, {"episodes": entries, "rollup": buckets} | (others or {}), one | two | (schemas or {}))

    def append(self, **tables: DataFrame) -> None:
        """Add rows to buckets, ticks or sessions in one commit; buckets of equal keys add up when they are read."""
        base, changes, schemas = self.manifest(), {}, {}
        for name, rows in tables.items():
            days = {0} if TIMES[name] is None else self._days(rows, TIMES[name])
            old = self._rows(base, name, days=days)
            _, changes[name], one = self._replaced(name, old.unionByName(rows) if set(rows.columns) <= set(old.columns) else rows, days)
            schemas |= one
        self._commit(base, changes, schemas)

    def prune(self, cutoff: int, most: int) -> int:
        """Remove at most `most` episodes that start before the cutoff, the oldest first, rebuild their days' rollup, and
        remove buckets of whole minutes before the cutoff with the ticks and sessions that they leave alone, all in one
        commit; gives the number of episodes that went."""
        base = self.manifest()
        rows = self._rows(base, "episodes", until=cutoff)
        gone = history.prune_batch(rows.select("id", "start_ns"), cutoff, most).cache()
        days = self._days(gone, "start_ns")
        others, schemas = self._pruned(base, cutoff)
        left = self._rows(base, "episodes", days=days).join(gone.select("id"), "id", "left_anti").select(*rows.columns)
        n = gone.count()
        if n or others:
            self._put(base, left, days, others, schemas)
        gone.unpersist()
        return n

    def _pruned(self, base: dict, cutoff: int) -> tuple[dict, dict]:
        """(changes, schemas) of buckets, ticks and sessions."""
        if not base["tables"].get("buckets"):
            return {}, {}
        whole = cutoff - NS_MINUTE
        days = {int(d) for d in base["tables"]["buckets"] if int(d) <= whole // NS_DAY}
        tick_days = {int(d) for d in base["tables"].get("ticks", {}) if int(d) <= whole // NS_DAY}
        buckets, ticks, sessions = (self._rows(base, t) for t in ("buckets", "ticks", "sessions"))
        kept = buckets.where(F.col("bucket_ns") > whole)
        ticks_kept = ticks.where(F.col("bucket_ns") > whole).unionByName(ticks.where(F.col("bucket_ns") <= whole).join(kept.select("bucket_ns", "session").distinct(), ["bucket_ns", "session"], "left_semi").select(*ticks.columns))
        sessions_kept = sessions.where(F.col("started_ns") >= cutoff).unionByName(sessions.where(F.col("started_ns") < cutoff).join(ticks_kept.select("session").distinct(), "session", "left_semi").select(*sessions.columns))
        of = lambda rows, own: rows.where(F.floor(F.col("bucket_ns") / NS_DAY).isin(sorted(own)) if own else F.lit(False))
        _, one, a = self._replaced("buckets", of(kept, days), days)
        _, two, b = self._replaced("ticks", of(ticks_kept, tick_days), tick_days)
        _, three, c = self._replaced("sessions", sessions_kept, {0})
        return {"buckets": one, "ticks": two, "sessions": three}, a | b | c

    def migrate(self) -> int:
        """Write the days of older formats anew, in one commit; gives their number."""
        base, changes, schemas, n = self.manifest(), {}, {}, 0
        for name, every in base["tables"].items():
            days = {int(d) for d, e in every.items() if e["format"] < FORMAT}
            if days:
                _, changes[name], one = self._replaced(name, self._rows(base, name, days=days), days)
                schemas |= one
                n += len(days)
        if changes:
            self._commit(base, changes, schemas)
        return n

    def vacuum(self, keep: int = 2) -> int:
        """Remove folders that none of the last `keep` versions lists, and those versions' predecessors; gives the number
        of folders. Writers that haven't committed must be over."""
        known = self.versions()
        used = {e["folder"] for v in known[-keep:] for days in self.manifest(v)["tables"].values() for e in days.values()}
        found = [f"data/{t}/{f}" for t in self._files.names("data") for f in self._files.names(f"data/{t}")]
        for folder in set(found) - used:
            self._files.remove(folder)
        for v in known[:-keep]:
            self._files.remove(f"versions/{v:012d}.json")
        self._files.remove("tmp")
        return len(set(found) - used)


_made: dict[tuple[str, str], EpisodeStore] = {}


def store_of(spark: SparkSession, source: DataFrame, episodes: Callable[[], DataFrame]) -> EpisodeStore:
    """The store of the episodes of a table's files, made at its first use in this application; files that change make
    another. With tidemark.store.dir set, stores lie there and other applications find them."""
    mark = hashlib.sha256(repr(stamps(source)).encode()).hexdigest()
    key = spark.sparkContext.applicationId, mark
    if key not in _made:
        folder = spark.conf.get("tidemark.store.dir", None)
        made = EpisodeStore(spark, f"{folder.rstrip('/')}/{mark[:32]}" if folder else shared_path(spark, "episode-store"))
        if not made.versions():
            made.flush(episodes())
        _made[key] = made
    return _made[key]
