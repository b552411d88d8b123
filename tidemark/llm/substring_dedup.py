"""Removal of word sequences that repeat anywhere in the corpus, found through fixed-block anchors.

Every text is cut into non-overlapping reference blocks of half a window; any window of `window` words
holds one whole block. The blocks are the index and every rolling window of a block's length is a probe;
a probe's sequence that is also a reference block and starts at two places at least is a hit wherever it
stands. Hits are then extended: each window of `window` words that holds a hit is a repeat if the same
sequence starts at two places at least. Maximal exact repeats are the unions of these windows.

Texts are dealt out once, equal ones as one with their number of copies. A part of the texts sends each of
its sequences once, whatever the number of its places, as packed hashes by bucket; a bucket answers with
one bit for each. So a sequence that stands in a third of all rows is one entry for each part, the work is
linear in the words, and no pairs of places are formed. Bucket and 32 further bits of hash find the hits;
the longer windows are confirmed by 96 bits of two independent hashes.

Defined cases: a null text counts as empty and has no words; a text shorter than a window loses nothing;
repeated rows are separate documents, so long ones lose all words; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary_array, binary_parts, digest, slices, window_hashes, word_hashes

WINDOW = 35
#: Bytes of text for each bucket of hashes, and for each part of the texts.
BUCKET_BYTES, PART_BYTES = 16 << 20, 4 << 20
#: Digests that a task remembers to tell copies.
REMEMBERED = 200_000

_SENT = "bucket int, part int, hashes binary, flags binary"
_ANSWER = "part int, kind int, bucket int, found binary"
HITS, REPEATS = 0, 1


def _planes(a: np.ndarray, size: int) -> bytes:
    """The values' low `size` bytes, byte plane by byte plane: of sorted values the high ones compress."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize)[:, :size].T).tobytes()


def _values(b: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(b) // size, 8 if size > 4 else 4), np.uint8)
    out[:, :size] = np.frombuffer(b, np.uint8).reshape(size, -1).T
    return out.view(np.uint64 if size > 4 else np.uint32).ravel()


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, digest, text, copies): a task's texts once, and the copies it met as a number without text."""
    again: dict[bytes, list[int]] = {}

    def rows(parts: list, digests: list, texts: pa.Array, copies: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), binary_array(digests), texts, pa.array(copies, pa.int64())], names=["part", "digest", "text", "copies"])

    def flush() -> pa.RecordBatch:
        found = [(p, d, n) for d, (p, n) in again.items() if n]
        again.clear()
        parts, digests, n = (list(c) for c in zip(*found, strict=True)) if found else ([], [], [])
        return rows(parts, digests, pa.nulls(len(n), pa.binary()), n)

    for batch in batches:
        new = []
        for i, (p, d) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if d in again:
                again[d][1] += 1
            else:
                again[d] = [p, 0]
                new.append(i)
        own = batch.take(pa.array(new, pa.int64()))
        yield rows(own.column(0).to_pylist(), own.column(1).to_pylist(), own.column(2), [1] * len(new))
        if len(again) > REMEMBERED:
            yield flush()
    yield flush()


@dataclass
class _Set:
    """The distinct values of some hashes, sorted, and which of them each place has."""

    order: np.ndarray
    start: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, h: np.ndarray, second: np.ndarray | None = None) -> _Set:
        order = np.argsort(h, kind="stable") if second is None else np.lexsort((second, h))
        new = h[order][1:] != h[order][:-1]
        if second is not None:
            new |= second[order][1:] != second[order][:-1]
        start = np.flatnonzero(np.concatenate(([True], new))) if len(h) else np.zeros(0, np.int64)
        return cls(order, start, h[order][start])

    def any(self, flags: np.ndarray) -> np.ndarray:
        return np.logical_or.reduceat(flags[self.order], self.start) if len(self.start) else np.zeros(0, bool)

    def counts(self) -> np.ndarray:
        return np.diff(self.start, append=len(self.order))

    def at_places(self, found: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.order), bool)
        out[self.order] = np.repeat(found, self.counts())
        return out

    def cuts(self, bits: int) -> list[tuple[int, int, int]]:
        """(bucket, from, to) of the values by their first `bits` bits."""
        if not len(self.values):
            return []
        bucket = (self.values >> np.uint64(64 - bits)).astype(np.int64)
        at = np.flatnonzero(np.diff(bucket, prepend=-1))
        return list(zip(bucket[at].tolist(), at.tolist(), [*at[1:].tolist(), len(bucket)], strict=True))


class _Part:
    """The windows of one part's texts."""

    def __init__(self, table: pa.Table, window: int, block: int):
        texts = table.select(["text", "copies"]).combine_chunks()
        words, first, several = [], [np.zeros(1, np.int64)], []
        for batch in texts.to_batches():
            for part in slices([batch]):
                w, _, _, f = word_hashes(*binary_parts(part.column(0)), lower=False)
                first.append(f[1:] + first[-1][-1])
                words.append(w)
                several.append(np.asarray(part.column(1)) > 1)
        self.words, self.first = np.concatenate([np.zeros(0, np.uint64), *words]), np.concatenate(first)
        self.window, self.block = window, block
        n = np.diff(self.first)
        self.n_probes = np.where(n >= window, n - block + 1, 0)
        self.n_windows = np.where(n >= window, n - window + 1, 0)
        several = np.concatenate([np.zeros(0, bool), *several])
        self.copied, self.copied_windows = np.repeat(several, self.n_probes), np.repeat(several, self.n_windows)
        self.place = self._places(self.n_probes)
        self.probes = _Set.of(window_hashes(self.words, block)[np.repeat(self.first[:-1], self.n_probes) + self.place] if len(self.place) else np.zeros(0, np.uint64))

    @staticmethod
    def _places(count: np.ndarray) -> np.ndarray:
        return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)

    def extend(self, found: np.ndarray) -> None:
        """The windows that hold a hit; found: which of the distinct probes are hits."""
        hits = np.concatenate(([0], np.cumsum(self.probes.at_places(found))))
        at = np.repeat(np.cumsum(self.n_probes) - self.n_probes, self.n_windows) + self._places(self.n_windows)
        self.near = np.flatnonzero(hits[at + self.window - self.block + 1] > hits[at]) if len(at) else np.zeros(0, np.int64)
        start = (np.repeat(self.first[:-1], self.n_windows) + self._places(self.n_windows))[self.near]
        none = np.zeros(0, np.uint64)
        self.second = (window_hashes(self.words, self.window, 1)[start] >> np.uint64(32)) if len(start) else none
        self.repeats = _Set.of(window_hashes(self.words, self.window)[start] if len(start) else none, self.second)
        self.near_start = start

    def removed(self, found: np.ndarray) -> np.ndarray:
        """Which words lie in a repeat; found: which of the distinct windows are repeats."""
        cover = np.zeros(len(self.words) + 1, np.int32)
        start = self.near_start[self.repeats.at_places(found)]
        cover[start] += 1
        cover[start + self.window] -= 1
        return np.cumsum(cover)[:-1] > 0


def _sent(part: int, own: _Set, hashes: list[tuple[np.ndarray, int]], flags: list[np.ndarray], bits: int) -> pa.Table:
    """One row for each bucket with the distinct values' hashes (array, bytes of each) and flags."""
    rows = []
    for bucket, a, b in own.cuts(bits):
        rows.append((bucket, part, b"".join(_planes(h[a:b], n) for h, n in hashes), np.packbits(np.concatenate([f[a:b] for f in flags])).tobytes()))
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), binary_array(list(cols[2])), binary_array(list(cols[3]))], names=["bucket", "part", "hashes", "flags"])


def _part_of(table: pa.Table) -> int:
    return table.column("part")[0].as_py() if table.num_rows else 0


def _probes(window: int, block: int, bits: int):
    def run(table: pa.Table) -> pa.Table:
        own = _Part(table, window, block)
        probes = own.probes
        twice = (probes.counts() > 1) | probes.any(own.copied)
        short = (probes.values << np.uint64(bits)) >> np.uint64(32)
        return _sent(_part_of(table), probes, [(short, 4)], [twice, probes.any(own.place % block == 0)], bits)

    return run


def _answers(kind: int, sizes: list[int]):
    """For one bucket: which of the values that each part sent start twice, and for hits also as a block."""

    def run(table: pa.Table) -> pa.Table:
        cols, flags, counts = [[] for _ in sizes], [[], []], []
        for data, bits in zip(table.column("hashes").to_pylist(), table.column("flags").to_pylist(), strict=True):
            n, at = len(data) // sum(sizes), 0
            for k, size in enumerate(sizes):
                cols[k].append(_values(data[at : at + n * size], size))
                at += n * size
            own = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
            flags[0].append(own[:n])
            flags[1].append(own[n : 2 * n] if kind == HITS else own[:0])
            counts.append(n)
        h = [np.concatenate(c) for c in cols]
        values = _Set.of(*h)
        found = (values.counts() > 1) | values.any(np.concatenate(flags[0]))
        if kind == HITS:
            found &= values.any(np.concatenate(flags[1]))
        found = values.at_places(found)
        ends = np.cumsum(counts)
        answers = [np.packbits(found[a:b]).tobytes() if found[a:b].any() else None for a, b in zip(ends - counts, ends, strict=True)]
        n = table.num_rows
        out = pa.table([table.column("part"), pa.array([kind] * n, pa.int32()), table.column("bucket"), binary_array(answers)], names=["part", "kind", "bucket", "found"])
        return out.filter(pa.array([a is not None for a in answers], pa.bool_()))

    return run


def _found(answers: pa.Table, kind: int, own: _Set, bits: int) -> np.ndarray:
    """Which of the values a part sent were found."""
    by_bucket = {b: f for k, b, f in zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "found")), strict=True) if k == kind}
    out = np.zeros(len(own.values), bool)
    for bucket, a, b in own.cuts(bits):
        if bucket in by_bucket:
            out[a:b] = np.unpackbits(np.frombuffer(by_bucket[bucket], np.uint8))[: b - a]
    return out


def _extend(window: int, block: int, bits: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _sent(0, _Set.of(np.zeros(0, np.uint64)), [], [], bits)
        own = _Part(left, window, block)
        own.extend(_found(right, HITS, own.probes, bits))
        repeats = own.repeats
        twice = (repeats.counts() > 1) | repeats.any(own.copied_windows[own.near])
        second = own.second[repeats.order][repeats.start]
        return _sent(_part_of(left), repeats, [(repeats.values, 8), (second.astype(np.uint32), 4)], [twice], bits)

    return run


def _remove(window: int, block: int, bits: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        gone, first = None, None
        if left.num_rows and right.num_rows:
            own = _Part(left, window, block)
            own.extend(_found(right, HITS, own.probes, bits))
            gone, first = own.removed(_found(right, REPEATS, own.repeats, bits)), own.first.tolist()
        n_words, n_removed, kept = [], [], []
        for i, text in enumerate(left.column("text")):
            words = text.as_py().split()
            n_words.append(len(words))
            if gone is not None and (out := gone[first[i] : first[i + 1]]).any():
                words = [words[k] for k in np.flatnonzero(~out)]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words))
        return pa.table([left.column("digest"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), binary_array(kept)], names=["digest", "n_words", "n_removed", "kept"])

    return run


def distinct_texts(docs: DataFrame, window: int = WINDOW, bucket_bytes: int = BUCKET_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """(digest, n_words, n_removed, kept) of each distinct text of docs: (text as binary)."""
    block = (window + 1) // 2
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    bits = max(2, int(np.ceil(np.log2(max(1, size / bucket_bytes)))))
    parts = max(1, -(-size // part_bytes))
    named = docs.select(digest(F.col("text")).alias("digest"), "text")
    dealt = named.select(F.pmod(F.xxhash64("digest"), F.lit(parts)).cast("int").alias("part"), "digest", "text").mapInArrow(_distinct, "part int, digest binary, text binary, copies long")
    # Grouping by part and digest needs no second exchange after the one by part, which all passes share.
    texts = dealt.repartition("part").groupBy("part", "digest").agg(F.first("text", ignorenulls=True).alias("text"), F.sum("copies").alias("copies"))
    groups = texts.groupBy("part")
    hits = groups.applyInArrow(_probes(window, block, bits), _SENT).groupBy("bucket").applyInArrow(_answers(HITS, [4]), _ANSWER)
    longer = groups.cogroup(hits.groupBy("part")).applyInArrow(_extend(window, block, bits), _SENT)
    repeats = longer.groupBy("bucket").applyInArrow(_answers(REPEATS, [8, 4]), _ANSWER)
    out = groups.cogroup(hits.unionByName(repeats).groupBy("part")).applyInArrow(_remove(window, block, bits), "digest binary, n_words long, n_removed long, kept binary")
    return out.withColumn("kept", F.col("kept").cast("string"))


def dedup(docs: DataFrame, window: int = WINDOW, bucket_bytes: int = BUCKET_BYTES, part_bytes: int = PART_BYTES, kept: Column | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row; kept is the words left, joined by one space.

    A word goes if it lies in a window of `window` words whose sequence also starts at another place of
    the corpus, in the same document or another. docs: (doc_id, text). Where only a digest of the words
    left is needed, say so by `kept`, an expression over the column kept; no texts are then joined to rows.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    found = distinct_texts(docs.select("text"), window, bucket_bytes, part_bytes)
    found = found.select("digest", "n_words", "n_removed", (F.col("kept") if kept is None else kept).alias("kept"))
    rows = docs.select("doc_id", digest(F.col("text")).alias("digest"))
    return rows.join(found, "digest").select("doc_id", "n_words", "n_removed", "kept")
