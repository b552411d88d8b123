"""History: searches, pages that start after a place, export lines, retention."""

from __future__ import annotations

import hashlib
import struct
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Comparisons that a search is made of.
_TESTS = {
    "=": lambda c, v: c == v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "set": lambda c, v: c.isNotNull() if v else c.isNull(),
}


class Search:
    """All of some comparisons (column, test, value); their order doesn't matter."""

    def __init__(self, *tests: tuple[str, str, object]):
        self.tests = tuple(sorted(tests, key=repr))

    def where(self, rows: DataFrame) -> DataFrame:
        """The rows that pass; the comparisons are plain, so they reach the scan."""
        for name, test, value in self.tests:
            rows = rows.where(_TESTS[test](F.col(name), value))
        return rows

    @property
    def mark(self) -> bytes:
        """Tells searches apart."""
        return hashlib.blake2b(repr(self.tests).encode(), digest_size=6).digest()


def search(since: int | None = None, until: int | None = None, closed: bool | None = None, **equal: object) -> Search:
    """Episodes that start in [since, until), are closed or open, and have the given values; None asks nothing."""
    if since is not None and until is not None and until <= since:
        raise ValueError("the span of time is empty")
    tests: list[tuple[str, str, object]] = [(name, "=", v) for name, v in equal.items() if v is not None]
    tests += [("start_ns", ">=", since)] if since is not None else []
    tests += [("start_ns", "<", until)] if until is not None else []
    if closed is not None:
        # An orphaned episode has a reason and no end, an open one neither.
        tests += [("close_reason", "set", closed)] + ([] if closed else [("end_ns", "set", False)])
    return Search(*tests)


class Place(NamedTuple):
    """Where a page ended, and the greatest id that its search may see."""

    start_ns: int
    id: int
    newest: int

    _FORM = struct.Struct(">qqq")

    def token(self, asked: Search) -> str:
        """A text that only the same search takes back: the numbers and a keyed digest of them."""
        body = self._FORM.pack(*self)
        return (body + hashlib.blake2b(body, digest_size=8, key=asked.mark).digest()).hex()

    @classmethod
    def of(cls, token: str, asked: Search) -> Place:
        try:
            place = cls(*cls._FORM.unpack(bytes.fromhex(token)[: cls._FORM.size]))
        except (ValueError, struct.error) as error:
            raise ValueError("not a place of a search") from error
        if place.token(asked) != token:
            raise ValueError("a place of another search")
        return place


_NEWEST_FIRST = ("start_ns", "id")


def page(episodes: DataFrame, asked: Search, limit: int, token: str | None = None, newest: int | None = None) -> tuple[DataFrame, str | None]:
    """(the newest `limit` episodes, token of the next page or None). The first page fixes the greatest id, which a
    store may know (`newest`), so that later ones don't see what comes in between. A page is read once, with one row
    more than it shows."""
    rows = asked.where(episodes)
    if token is None and newest is not None:
        rows = rows.withColumn("_newest", F.lit(newest).cast("long"))
    elif token is None:
        rows = rows.crossJoin(F.broadcast(episodes.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_newest"))))
    else:
        after = Place.of(token, asked)
        # The first comparison alone reaches the scan; the second one leaves out what the last page showed.
        rows = rows.where((F.col("start_ns") <= after.start_ns) & (F.col("id") <= after.newest))
        rows = rows.where((F.col("start_ns") < after.start_ns) | (F.col("id") < after.id))
        rows = rows.withColumn("_newest", F.lit(after.newest))
    found = rows.orderBy(*[F.desc(c) for c in _NEWEST_FIRST]).limit(limit + 1).collect()  # as many rows as a page shows
    more = Place(found[limit - 1].start_ns, found[limit - 1].id, found[0]._newest).token(asked) if len(found) > limit else None
    shown = episodes.sparkSession.createDataFrame([tuple(r)[:-1] for r in found[:limit]], episodes.schema)
    return shown, more


def export_lines(episodes: DataFrame, asked: Search, columns: list[str], limit: int) -> DataFrame:
    """(ord, line): JSON lines of the newest episodes and an end record with their number."""
    rows = asked.where(episodes).orderBy(F.desc("start_ns"), F.desc("id")).limit(limit)
    lines = rows.select(F.lit(0).alias("ord"), F.to_json(F.struct(F.lit("episode").alias("type"), *columns), {"ignoreNullFields": "false"}).alias("line"))
    end = rows.agg(F.count("*").alias("count")).select(F.lit(1).alias("ord"), F.to_json(F.struct(F.lit("end").alias("type"), "count")).alias("line"))
    return lines.unionByName(end)


def prune(episodes: DataFrame, rollup: DataFrame, cutoff: int, width: int, recompute) -> tuple[DataFrame, DataFrame]:
    """(episodes from cutoff on, rollup rebuilt in the buckets that lose episodes, others as they are)."""
    survivors = episodes.where(F.col("start_ns") >= cutoff)
    touched = (cutoff // width) * width
    rebuilt = recompute(survivors.where(F.col("start_ns") < touched + width))
    return survivors, rollup.where(F.col("bucket_ns") > touched).unionByName(rebuilt)


def prune_batch(episodes: DataFrame, cutoff: int, most: int) -> DataFrame:
    """What a prune of at most `most` episodes takes: the oldest that start before the cutoff."""
    return episodes.where(F.col("start_ns") < cutoff).orderBy("start_ns", "id").limit(most)


def unique_starts(episodes: DataFrame, route: list[str], start: str = "start_ns", order: str = "id") -> DataFrame:
    """Episodes with `unique_ns`: each route's starts, moved on where needed to come after the one before. The
    n-th is n more than the greatest of start minus its number so far, so no fold is needed."""
    w = Window.partitionBy(*route).orderBy(start, order)
    n = F.row_number().over(w)
    rows = episodes.withColumn("_n", n)
    return rows.withColumn("unique_ns", F.col("_n") + F.max(F.col(start) - F.col("_n")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_n")
