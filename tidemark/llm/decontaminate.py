"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

A short test item inside a long document shares a vanishing part of the document's shingles, so whole
documents can't be compared with items. The search is therefore partitioned by size: items fall into
classes of at most 8, 16, 32, ... shingles, and for each class the documents are cut into overlapping
blocks of twice that size, at least one of which holds any run of an item whole. A block's Jaccard
similarity to an item it holds is then over a quarter, and 64 hash functions that each count as a band
miss a containment of 0.8 in a block with a chance under 1e-6. Blocks of a class are unions of the next
smaller class's, so all classes together hash every shingle 64 times once. Candidates are verified by
exact containment of the item's shingles in the whole document.

The benchmark is a stated query set: its signatures travel to the tasks in pieces of a bounded size, one
pass over the documents for each piece; documents stay where they are read and no shuffle is needed.

Defined cases: null and empty texts hold nothing; an item without words is found nowhere; an item with
fewer words than a shingle has one shingle, its whole sequence, and is found where these words stand
consecutively; repeated rows and items each count; empty tables give no rows; other columns are kept or
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import binary_array, binary_parts, materialize, row_key, slices, texts, window_hashes, word_hashes

SHINGLE, PERCENT = 5, 80
#: Shingles of a block of the smallest class; the next class doubles it.
UNIT = 8
HASHES = 64
#: Bytes of item shingles that go to the tasks at a time, and pieces that one pass of `decontaminate` takes.
PIECE_BYTES, CHAINED = 8 << 20, 4

_MULTIPLIERS = np.random.Generator(np.random.PCG64(97)).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _item_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            data, offsets = binary_parts(part.column(1))
            words, _, _, first = word_hashes(data, offsets, lower=True)
            n, sets = [], []
            for a, b in zip(first[:-1], first[1:], strict=True):
                n.append(min(size, int(b - a)))
                sets.append(np.unique(window_hashes(words[a:b], n[-1])).tobytes() if b > a else b"")
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int32()), binary_array(sets)], names=["item_id", "words", "hashes"])

    return run


@dataclass
class _Class:
    """Least hash values of the items of one size class, sorted, with a table of their leading bits."""

    values: np.ndarray
    items: np.ndarray
    bits: int
    table: np.ndarray


class ItemIndex:
    """What a task needs to find one piece of the items."""

    def __init__(self, words: list[int], sets: list[np.ndarray], size: int):
        self.sets, self.size = sets, size
        self.short = {m: np.array([i for i, w in enumerate(words) if w == m], np.int64) for m in set(words) if 0 < m < size}
        self.classes: list[_Class | None] = []
        n = np.array([len(s) for s in sets])
        whole = np.array([w == size for w in words], bool)
        at = UNIT
        while (whole & (n > at // 2 * (at > UNIT))).any():
            own = np.flatnonzero(whole & (n <= at) & (n > (at // 2 if at > UNIT else 0)))
            self.classes.append(self._class(own) if len(own) else None)
            at *= 2

    def _class(self, own: np.ndarray) -> _Class:
        values = np.concatenate([(_MULTIPLIERS[:, None] * self.sets[i]).min(1) for i in own])
        items = np.repeat(own, HASHES)
        order = np.argsort(values, kind="stable")
        # Least values are small numbers; their spread-out form is what tells them apart quickly.
        values, items = values[order], items[order]
        bits = int(np.clip(np.ceil(np.log2(len(values) * 64)), 16, 24))
        table = np.zeros(1 << bits, bool)
        table[_spread(values, bits)] = True
        return _Class(values, items, bits, table)

    def candidates(self, h: np.ndarray, first: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) pairs that share a least value in some block. h: shingle hashes, cut at `first`."""
        n = np.diff(first)
        found: set[tuple[int, int]] = set()
        if not len(h) or not self.classes:
            return found
        units = -(-n // UNIT)
        doc = np.repeat(np.arange(len(n)), units)
        local = np.arange(len(doc)) - np.repeat(np.cumsum(units) - units, units)
        starts = first[doc] + local * UNIT
        least = np.empty((HASHES, len(doc)), np.uint64)
        for k, a in enumerate(_MULTIPLIERS):
            least[k] = np.minimum.reduceat(h * a, starts)
        for own in self.classes:
            if own is not None:
                blocks = least.copy()
                pair = np.flatnonzero(doc[1:] == doc[:-1])
                blocks[:, pair] = np.minimum(least[:, pair], least[:, pair + 1])
                k, b = np.nonzero(own.table[_spread(blocks, own.bits)])
                value = blocks[k, b]
                lo, hi = np.searchsorted(own.values, value, "left"), np.searchsorted(own.values, value, "right")
                for d, x, y in zip(doc[b[hi > lo]], lo[hi > lo], hi[hi > lo], strict=True):
                    found.update((int(d), int(i)) for i in own.items[x:y])
            even = np.flatnonzero(local % 2 == 0)
            least = np.minimum.reduceat(least, even, axis=1)
            doc, local = doc[even], local[even] // 2
        return found

    def matches(self, data: np.ndarray, offsets: np.ndarray, percent: int) -> list[tuple[int, int, int]]:
        """(text, item, shared shingles) of all verified pairs."""
        words, _, _, first = word_hashes(data, offsets, lower=True)
        n = np.maximum(np.diff(first) - self.size + 1, 0)
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        h = window_hashes(words, self.size)[np.repeat(first[:-1], n) + place] if n.any() else np.zeros(0, np.uint64)
        cut = np.concatenate(([0], np.cumsum(n)))
        out = []
        by_doc: dict[int, list[int]] = {}
        for d, i in self.candidates(h, cut):
            by_doc.setdefault(d, []).append(i)
        for d, items in sorted(by_doc.items()):
            own = np.unique(h[cut[d] : cut[d + 1]])
            for i in sorted(items):
                shared = int(np.isin(self.sets[i], own, assume_unique=True).sum())
                if 100 * shared >= percent * len(self.sets[i]):
                    out.append((d, i, shared))
        for m, items in self.short.items():
            if len(words) < m:
                continue
            w = window_hashes(words, m)
            values = np.concatenate([self.sets[i] for i in items])
            order = np.argsort(values, kind="stable")
            at = np.flatnonzero(np.isin(w, values))
            d = np.searchsorted(first, at, side="right") - 1
            inside = at + m <= first[d + 1]
            pairs = set()
            for t, v in zip(d[inside], w[at[inside]], strict=True):
                lo, hi = np.searchsorted(values[order], v, "left"), np.searchsorted(values[order], v, "right")
                pairs.update((int(t), int(items[j])) for j in order[lo:hi])
            out += [(d_, i, 1) for d_, i in sorted(pairs)]
        return out


def _spread(values: np.ndarray, bits: int) -> np.ndarray:
    return (values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def _pieces(items: DataFrame, size: int, piece_bytes: int) -> Iterator[tuple[list, ItemIndex]]:
    """(item ids, index) of each bounded piece of the items."""
    id_type = items.schema["item_id"].dataType.simpleString()
    sets = texts(items, F.col("item_id")).mapInArrow(_item_sets(size), f"item_id {id_type}, words int, hashes binary").where("words > 0")
    sets = materialize(sets, "items")
    total = sets.agg(F.sum(F.octet_length("hashes") + 16)).first()[0] or 0
    # Twice as many pieces as needed, as ids don't spread evenly.
    pieces = max(1, -(-2 * total // piece_bytes)) if total > piece_bytes else 1
    for k in range(pieces):
        own = sets.where(F.pmod(F.xxhash64("item_id", "hashes"), F.lit(pieces)) == k).orderBy("item_id", "hashes").collect()
        if own:
            yield [r.item_id for r in own], ItemIndex([r.words for r in own], [np.frombuffer(bytes(r.hashes), np.uint64) for r in own], size)


def _over(docs: DataFrame, items: DataFrame, size: int, piece_bytes: int, apply: Callable[[DataFrame, list, object], DataFrame]) -> list[DataFrame]:
    context = docs.sparkSession.sparkContext
    return [apply(docs, ids, context.broadcast(index)) for ids, index in _pieces(items, size, piece_bytes)]


def matches(docs: DataFrame, items: DataFrame, size: int = SHINGLE, percent: int = PERCENT, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared) of each document row and item it holds.

    An item is held if `percent` of its distinct shingles or more are among the document's. docs:
    (doc_id, text); items: (item_id, text).
    """
    doc_type, item_type = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"]
    arrow_item = to_arrow_type(item_type.dataType)
    schema = f"doc_id {doc_type}, item_id {item_type.dataType.simpleString()}, n_shingles long, n_shared long"

    def search(ids: list, index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                got = index.value.matches(*binary_parts(part.column(1)), percent)
                if got:
                    d, i, shared = zip(*got, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(d)), pa.array([ids[k] for k in i], arrow_item), pa.array([len(index.value.sets[k]) for k in i], pa.int64()), pa.array(shared, pa.int64())],
                        names=["doc_id", "item_id", "n_shingles", "n_shared"],
                    )

        return run

    rows = texts(docs, F.col("doc_id"))
    found = _over(docs, items, size, piece_bytes, lambda _, ids, index: rows.mapInArrow(search(ids, index), schema))
    out = docs.sparkSession.createDataFrame([], schema)
    for one in found:
        out = one if one is found[0] else out.unionByName(one)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, size: int = SHINGLE, percent: int = PERCENT, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item."""

    def keep(percent_: int, index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                col = part.column(part.schema.get_field_index("text"))
                data, offsets = binary_parts(pc.fill_null(col, "").cast(pa.binary()))
                free = np.ones(part.num_rows, bool)
                free[[d for d, _, _ in index.value.matches(data, offsets, percent_)]] = False
                yield part.filter(pa.array(free))

        return run

    pieces = [docs.sparkSession.sparkContext.broadcast(index) for _, index in _pieces(items, size, piece_bytes)]
    if len(pieces) <= CHAINED:
        out = docs
        for index in pieces:
            out = out.mapInArrow(keep(percent, index), docs.schema)
        return out
    # Many pieces search a pass each, and what they find leaves by key.
    keyed = docs.withColumn("doc_id", row_key(F.col("doc_id"), F.col("text"))).select("doc_id", "text")
    held = materialize(matches(keyed, items, size, percent, piece_bytes).select(F.col("doc_id").alias("held")).distinct(), "held")
    rows = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), F.struct("*").alias("row"))
    return rows.join(held, F.col("key") == F.col("held"), "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])
