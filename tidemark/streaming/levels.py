"""Depth as a keyed stream: the levels of a book by price in the state store, changed one by one.

A book's state is a map from (side, price) to the last update of that level, so a batch touches the levels that it
mentions and no more; the best levels are read from the map at the batch's end. A deleted level keeps its place with
size 0, so an older update that comes in a later batch doesn't bring it back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

TOPS = "pair string, venue string, version long, side string, price long, size long, rank int"
_TOPS = [f.split()[0] for f in TOPS.split(", ")]


class _Levels(StatefulProcessor):
    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.levels = handle.getMapState("levels", "side string, price long", "size long, ns long, seq long")
        self.version = handle.getValueState("version", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for frame in rows:  # one frame at a time; of a level's updates in it the last one counts
            last = frame.sort_values(["ns", "seq"]).drop_duplicates(["side", "price"], keep="last")
            for side, price, size, ns, seq in last[["side", "price", "size", "ns", "seq"]].itertuples(index=False):
                at = (side, int(price))
                held = self.levels.getValue(at)
                if held is None or (held[1], held[2]) < (ns, seq):
                    self.levels.updateValue(at, (max(0, int(size)), int(ns), int(seq)))
        version = (self.version.get()[0] if self.version.exists() else 0) + 1
        self.version.update((version,))
        live = [(side, price, v[0]) for (side, price), v in self.levels.iterator() if v[0] > 0]
        # A row without a side says that the version is there even if the book is empty.
        out = [(*key, version, None, None, None, 0)]
        for name, best_first in (("bid", -1), ("ask", 1)):
            own = sorted((best_first * price, price, size) for side, price, size in live if side == name)[: max(0, self.n)]
            out += [(*key, version, name, price, size, k + 1) for k, (_, price, size) in enumerate(own)]
        yield pd.DataFrame(out, columns=_TOPS).astype({"price": "Int64", "size": "Int64"})


def top_n(updates: DataFrame, n: int) -> DataFrame:
    """A stream of (pair, venue, side, price, size, ns, seq) as TOPS rows: after each batch that mentions a book its best
    n levels of each side, under the book's next version."""
    own = updates.select("pair", "venue", "side", "price", "size", "ns", "seq")
    return own.groupBy("pair", "venue").transformWithStateInPandas(_Levels(n), TOPS, "Append", "None")


def newest(tops: DataFrame) -> DataFrame:
    """(pair, venue, side, price, size, rank) of each book's last version."""
    last = F.max("version").over(Window.partitionBy("pair", "venue"))
    return tops.withColumn("last", last).where("version = last and side is not null").select("pair", "venue", "side", "price", "size", "rank")
