"""Recovery of a book's stream that feeds back: gaps, snapshots that are asked for up to three times, reconnects, and
what is buffered, applied or skipped meanwhile.

What a frame does depends on the state that all frames before it have led to, so no window can tell it. But the
states are few, and each frame is a map from states to states. A block of frames is one map, the composition of its
frames'; maps of blocks compose to the state in which each block begins; and every block is then worked through on
its own from its true opening state. A book's frames are never in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.book import BOOK, ORDER

#: Snapshots asked for before a reconnect, and gaps of one connection that are mended book by book before it.
ATTEMPTS, RESYNCS = 3, 3
#: Kinds of frames. stale: a snapshot older than what was heard; failed: a request without an answer.
FRAMES = ["update", "gap", "snapshot", "stale", "failed", "up", "down"]


def _states() -> list[tuple[str, int, int]]:
    """(mode, attempt, resyncs): waiting for the answer to an attempt, aligned, or down until the link comes up."""
    live = [(m, k, n) for n in range(RESYNCS + 1) for m, k in [*[("waiting", k) for k in range(1, ATTEMPTS + 1)], ("aligned", 0)]]
    return [*live, ("down", 0, 0)]


STATES = _states()
_DOWN, _FIRST = ("down", 0, 0), ("waiting", 1, 0)


def step(state: tuple[str, int, int], frame: str) -> tuple[tuple[str, int, int], str]:
    """(next state, what became of the frame)."""
    mode, attempt, resyncs = state
    if frame == "up":
        return _FIRST, "connected"
    if frame == "down":
        return _DOWN, "disconnected"
    if mode == "down":
        return state, "skipped"
    if mode == "aligned":
        if frame == "gap":  # the book is given up; the connection is, after too many
            return (("waiting", 1, resyncs + 1), "resync") if resyncs < RESYNCS else (_DOWN, "reconnect")
        return state, "applied" if frame == "update" else "unasked"
    if frame in ("update", "gap"):
        return state, "buffered"
    if frame == "snapshot":
        return ("aligned", 0, resyncs), "aligned"
    return (("waiting", attempt + 1, resyncs), "retry") if attempt < ATTEMPTS else (_DOWN, "reconnect")


_AT = {s: k for k, s in enumerate(STATES)}
_NEXT = np.array([[_AT[step(s, f)[0]] for s in STATES] for f in FRAMES], np.uint8)
_OUTCOME = np.array([[step(s, f)[1] for s in STATES] for f in FRAMES], object)
NAMES = np.array([f"{m}:{k}" if m == "waiting" else m for m, k, _ in STATES], object)
START = _AT[_FIRST]


def _maps(pdf: pd.DataFrame) -> np.ndarray:
    """Maps of a block's frames in order."""
    return _NEXT[pdf.sort_values(ORDER)["frame"].map({f: k for k, f in enumerate(FRAMES)}).to_numpy()]


def composed(maps: np.ndarray) -> np.ndarray:
    """One map for all, by halves."""
    while len(maps) > 1:
        even = len(maps) // 2 * 2
        maps = np.concatenate([np.take_along_axis(maps[1:even:2], maps[0:even:2].astype(np.intp), 1), maps[even:]])
    return maps[0]


def entered(maps: np.ndarray, start: int) -> np.ndarray:
    """The state before each frame, by doubling: after k rounds each map stands for the 2^k frames up to its own."""
    upto, width = maps.copy(), 1
    while width < len(upto):
        upto[width:] = np.take_along_axis(upto[width:], upto[:-width].astype(np.intp), 1)
        width *= 2
    return np.concatenate([[start], upto[:-1, start]]).astype(np.int64)


def _summary(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf[[*BOOK, "block"]].iloc[:1].assign(to=[composed(_maps(pdf)).astype(int).tolist()])


def openings(frames: DataFrame) -> DataFrame:
    """(pair, venue, block, opening): the number of the state in which each block of frames begins. Only maps are gathered, a
    few bytes a block."""
    kinds = frames.schema
    schema = f"pair {kinds['pair'].dataType.simpleString()}, venue {kinds['venue'].dataType.simpleString()}, block long, to array<int>"
    maps = frames.select(*BOOK, "block", *ORDER, "frame").groupBy(*BOOK, "block").applyInPandas(_summary, schema)
    lists = maps.groupBy(*BOOK).agg(F.array_sort(F.collect_list(F.struct("block", "to"))).alias("maps"))
    none = F.struct(F.lit(START).alias("now"), F.expr("cast(array() as array<struct<block:long,opening:int>>)").alias("all"))
    walk = F.aggregate(
        "maps",
        none,
        lambda acc, m: F.struct(F.get(m["to"], acc["now"]).alias("now"), F.concat(acc["all"], F.array(F.struct(m["block"].alias("block"), acc["now"].alias("opening")))).alias("all")),
        lambda acc: acc["all"],
    )
    return lists.select(*BOOK, F.explode(walk).alias("o")).select(*BOOK, "o.block", "o.opening")


REPLAYED = "event_id long, pair string, venue string, ns long, frame string, outcome string, state string, resyncs int"


def _replayed(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = pdf.sort_values(ORDER)
    maps = _maps(rows)
    before = entered(maps, int(rows["opening"].iloc[0]))
    after = maps[np.arange(len(maps)), before]
    kinds = rows["frame"].map({f: k for k, f in enumerate(FRAMES)}).to_numpy()
    resyncs = np.array([n for _, _, n in STATES], np.int32)
    return rows[["event_id", *BOOK, "ns", "frame"]].assign(outcome=_OUTCOME[kinds, before], state=NAMES[after], resyncs=resyncs[after])


def replay(frames: DataFrame) -> DataFrame:
    """frames: (pair, venue, ns, event_id, block, frame) as REPLAYED rows: what became of each, and the state after it. A
    book begins waiting for its first snapshot; frames that come while it is down are skipped until its link is up."""
    own = frames.select("event_id", *BOOK, "ns", "block", "frame")
    joined = own.join(openings(own), [*BOOK, "block"])
    return joined.groupBy(*BOOK, "block").applyInPandas(_replayed, REPLAYED)
