"""Episodes as a keyed stream: the rows of a pair's micro-batch are aligned in numpy, and what goes on at its end
is kept for the next one, so the stream closes the episodes that the batch operators close.

State by pair: the last top of each venue with its trust, whether its lapse was seen, and each route's last
state with the episode that is open. Rows come in event order from batch to batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.routes import UNIT
from tidemark.streaming.books import EMPTY, accept, gathered

CLOSED = "id long, pair string, buy string, sell string, start_ns long, end_ns long, close_reason string, open_spread long, peak_ns long, peak_spread long, close_spread long"
ABSENT, BELOW, ABOVE = 0, 1, 2
_TOP = ["ns", "event_id", "trusted", "bid", "ask"]


def _tops(rows: pd.DataFrame, venue: str, held: dict | None, max_age: int, end: int) -> tuple[pd.DataFrame, list[tuple[int, int]], tuple]:
    """(what a venue's rows leave of its book, the held one first; its lapses as (ns, event_id); its chain)."""
    own = rows[rows["venue"] == venue]
    found, _, _, chain = accept(own, tuple(held["chain"]) if held else EMPTY)
    own = own.assign(trusted=found == "ok")[~np.isin(found, ["out_of_order", "disconnected"])][_TOP]
    seen = bool(held and held["lapsed"])
    if held and held["ns"] is not None:
        own = pd.concat([pd.DataFrame([{c: held[c] for c in _TOP}]), own], ignore_index=True)
    own = own.assign(bid=own["bid"].fillna(0).astype(np.int64), ask=own["ask"].fillna(1).astype(np.int64))
    at, following = own["ns"].to_numpy() + max_age + 1, np.append(own["ns"].to_numpy()[1:], np.iinfo(np.int64).max)
    lapse = (following > at) & (at <= end)
    if held and seen and len(lapse):
        lapse[0] = False
    return own.reset_index(drop=True), list(zip(at[lapse].tolist(), own["event_id"].to_numpy()[lapse].tolist(), strict=True)), chain


def _route(pair: str, route: int, buy: str, sell: str, ns: np.ndarray, ids: np.ndarray, code: np.ndarray, spread: np.ndarray, held: dict | None) -> tuple[list[tuple], dict]:
    """(closed episodes of one route, what goes on)."""
    last, now = (held["code"], held["open"]) if held else (-1, None)
    starts = np.flatnonzero(np.concatenate(([code[0] != last], code[1:] != code[:-1])))
    out: list[tuple] = []
    goes_on = not len(starts) or starts[0] > 0  # the first stretch has the state that is held
    edges = ([0] if goes_on else []) + starts.tolist()
    for a, b in zip(edges, [*edges[1:], len(code)], strict=True):
        fresh = a > 0 or not goes_on
        if fresh and now:  # this row's state closes what was open
            reason = "spread_closed" if code[a] == BELOW else "book_ineligible"
            out.append((now["id"], pair, buy, sell, now["start"], int(ns[a]), reason, now["first"], now["peak_ns"], now["peak"], int(spread[a]) if code[a] == BELOW else None))
            now = None
        if code[a] == ABOVE:
            top = a + int(np.argmax(spread[a:b]))
            if now is None:
                now = {"id": int(ids[a]) * 8 + route, "start": int(ns[a]), "first": int(spread[a]), "peak": int(spread[top]), "peak_ns": int(ns[top])}
            elif spread[top] > now["peak"]:
                now |= {"peak": int(spread[top]), "peak_ns": int(ns[top])}
    return out, {"code": int(code[-1]), "open": now}


def advance(pair: str, rows: pd.DataFrame, held: dict, end: int, venues: tuple[str, ...], max_age: int, threshold: int) -> list[tuple]:
    """What closes by `end` once some rows of a pair have come, in event order; brings `held` up to date."""
    tops, lapses = {}, []
    for v in venues:
        tops[v], gone, chain = _tops(rows, v, held["tops"].get(v), max_age, end)
        lapses += gone
        now = dict.fromkeys(_TOP) | {"lapsed": False}
        if len(tops[v]):
            newest = tops[v].iloc[-1]
            now = {c: (bool if c == "trusted" else int)(newest[c]) for c in _TOP} | {"lapsed": bool(newest["ns"] + max_age + 1 <= end)}
        held["tops"][v] = now | {"chain": list(chain)}
    gone = np.array(lapses, np.int64).reshape(-1, 2)
    ns, ids = (np.concatenate([rows[c].to_numpy(np.int64), gone[:, k]]) for k, c in enumerate(("ns", "event_id")))
    order = np.lexsort((ids, ns))
    ns, ids = ns[order], ids[order]
    new = (np.diff(ns, prepend=-1) != 0) | (np.diff(ids, prepend=-1) != 0)
    ns, ids = ns[new], ids[new]
    if not len(ns):
        return []
    legs = {}
    for v, own in tops.items():
        # The latest top at each time: both are in event order, so a merge of the two finds it.
        place = np.lexsort((np.concatenate([np.zeros(len(own)), np.ones(len(ns))]), np.concatenate([own["event_id"], ids]), np.concatenate([own["ns"], ns])))
        is_top = place < len(own)
        at = (np.cumsum(is_top) - 1)[~is_top]
        pick = lambda c, fill, own=own, at=at: np.where(at >= 0, own[c].to_numpy()[np.maximum(at, 0)], fill) if len(own) else np.full(len(at), fill)
        legs[v] = (pick("trusted", False).astype(bool) & (ns - pick("ns", 0).astype(np.int64) <= max_age), pick("bid", 0).astype(np.int64), pick("ask", 1).astype(np.int64))
    out: list[tuple] = []
    for k, (b, s) in enumerate(permutations(venues, 2)):
        both, bid, ask = legs[b][0] & legs[s][0], legs[s][1], legs[b][2]
        above = (bid > ask) & ((bid - ask) * UNIT >= threshold * ask)
        code = np.where(~both, ABSENT, np.where(above, ABOVE, BELOW))
        closed, held["routes"][str(k)] = _route(pair, k, b, s, ns, ids, code, (bid - ask) * UNIT // ask, held["routes"].get(str(k)))
        out += closed
    return out


def _frame(closed: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(closed, columns=[f.split()[0] for f in CLOSED.split(", ")]).astype({"close_spread": "Int64"})


def _fold(venues: tuple[str, ...], max_age: int, threshold: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = gathered(batches)
        held = json.loads(state.get[0]) if state.exists else {"tops": {}, "routes": {}}
        closed = advance(key[0], rows, held, int(rows["ns"].max()), venues, max_age, threshold)
        state.update((json.dumps(held),))
        yield _frame(closed)

    return run


_COLUMNS = ["event_id", "pair", "venue", "ns", "kind", "bid", "ask", "off"]


def closed_episodes(feed: DataFrame, venues: tuple[str, ...], max_age: int, threshold: int) -> DataFrame:
    """A stream of (event_id, pair, venue, ns, kind, bid, ask, off) as the episodes that close, in CLOSED rows. A lapse
    is noticed once a later row of its pair has come."""
    return feed.select(*_COLUMNS).groupBy("pair").applyInPandasWithState(_fold(venues, max_age, threshold), CLOSED, "held string", "append", GroupStateTimeout.NoTimeout)


class _Closing(StatefulProcessor):
    """`closed_episodes` with a timer at the lapse of each venue's book, so that a quiet pair's episodes close too."""

    def __init__(self, venues: tuple[str, ...], max_age: int, threshold: int):
        self.venues, self.max_age, self.threshold = venues, max_age, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", "held string")

    def _advance(self, pair: str, rows: pd.DataFrame, end: int) -> pd.DataFrame:
        held = json.loads(self.held.get()[0]) if self.held.exists() else {"tops": {}, "routes": {}, "timers": []}
        closed = advance(pair, rows, held, end, self.venues, self.max_age, self.threshold)
        # The first whole millisecond at which a book that still holds has lapsed.
        wanted = sorted({-(-(t["ns"] + self.max_age + 1) // 10**6) for t in held["tops"].values() if t["ns"] is not None and t["trusted"] and not t["lapsed"]})
        for at in set(held["timers"]) - set(wanted):
            self.handle.deleteTimer(at)
        for at in set(wanted) - set(held["timers"]):
            self.handle.registerTimer(at)
        held["timers"] = wanted
        self.held.update((json.dumps(held),))
        return _frame(closed)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        own = gathered(rows)
        yield self._advance(key[0], own, int(own["ns"].max()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        held = json.loads(self.held.get()[0])
        held["timers"] = [t for t in held["timers"] if t != at]
        self.held.update((json.dumps(held),))
        yield self._advance(key[0], pd.DataFrame(columns=_COLUMNS), at * 10**6)


def timed_episodes(feed: DataFrame, venues: tuple[str, ...], max_age: int, threshold: int, late: str = "1 hour") -> DataFrame:
    """The same with lapses by timers: an episode of a pair that hears nothing more closes at last receipt + max age
    + 1 ns, once the watermark, `late` behind the newest row of all pairs, has passed it. Rows that come later than `late`
    are dropped."""
    timed = feed.select(*_COLUMNS, F.timestamp_micros(F.floor(F.col("ns") / 1000).cast("long")).alias("at")).withWatermark("at", late)
    return timed.groupBy("pair").transformWithStateInPandas(_Closing(venues, max_age, threshold), CLOSED, "Append", "EventTime")
