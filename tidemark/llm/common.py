"""Helpers shared by the text operators: shared tables, Arrow slices and vectorised word hashes.

Words are the runs of bytes outside space and \\x09-\\x0D of a text's UTF-8 form. A null text counts
as empty. Hashes are 64 bits wide and the same on every executor; they are folds that aren't linear, so no
family of words or windows, however regular, has the same hash. Keys of rows have 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import shared_path

#: Bytes of text that a Python worker expands into arrays at a time; one longer text is taken alone.
SLICE_BYTES = 1 << 20

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_scopes: list[list[DataFrame]] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back, which cuts its lineage."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return owned(df.sparkSession.read.schema(df.schema).parquet(path), path)


def owned(out: DataFrame, path: str) -> DataFrame:
    """`out`, which reads what was written to `path`; scopes and `discard` know it from now on."""
    out._shared_path = path
    for own in _scopes:
        own.append(out)
    return out


@contextmanager
def scope() -> Iterator[list[DataFrame]]:
    """Tables that `materialize` writes inside are removed at the end, when the caller has read its result; those
    that the caller takes out of the list stay."""
    made: list[DataFrame] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes[:] = [own for own in _scopes if own is not made]
        discard(*made)


def discard(*tables: DataFrame) -> None:
    """Remove tables of `materialize` that no later plan reads."""
    for df in tables:
        path = getattr(df, "_shared_path", None)
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def once(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """(kept columns, columns). They are made by a generator, so that later filters and projections refer to
    their values and the optimiser doesn't write the expressions out again wherever one is used."""
    made = df.select(*keep, F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("_made"))
    return made.select(*keep, *[F.col("_made")[k].alias(k) for k in columns])


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, _UPPER, _UPPER.lower())


def crc_text(doc_id: Column) -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def digest(text: Column) -> Column:
    """128 bits of a text that isn't null."""
    return F.unhex(F.md5(text.cast("binary")))


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits of a row's content, so that repeated ids with other texts stay apart."""
    part = lambda c: F.coalesce(F.concat(F.lit("+"), c.cast("string")), F.lit("-"))
    return digest(F.concat(part(doc_id), F.lit("\n"), part(text)))


def texts(docs: DataFrame, *keep: Column) -> DataFrame:
    """(kept columns, text as binary); a null text becomes empty."""
    return docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that `column` holds at most `limit` bytes, or one row."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(np.asarray(pc.binary_length(col).fill_null(0), dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def binary_parts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values joined, offsets of the values) of a binary array without nulls."""
    if pa.types.is_large_binary(col.type):
        offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    else:
        offsets = np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if not len(col) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Masks that leave the first 0 .. 8 bytes of a little-endian number.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Words of more bytes are hashed one by one.
LONG_WORD = 64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose output bits all depend on all input bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end of each word; index of the first word of each text, and their number at last).

    `data` are the texts' bytes on end, cut at `offsets`; no word crosses a cut. A word's hash is a fold of
    its length and of eight bytes at a time.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | cut[1:n]
    end = word.copy()
    end[:-1] &= ~word[1:] | cut[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = _LOWER[data] if lower else data
    lanes = np.ndarray((n,), "<u8", padded, strides=(1,))
    size = ends - starts
    h = mix(size.astype(np.uint64) * _K1 ^ (lanes[starts] & _MASK[np.minimum(size, 8)]))
    live, at = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(live):
        left = size[live] - at
        h[live] = mix(h[live] ^ (lanes[starts[live] + at] & _MASK[np.minimum(left, 8)]))
        at += 8
        live = live[left > 8]
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(padded[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h, starts, ends, np.searchsorted(starts, offsets)


def _fold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order."""
    out = b * _K1
    out ^= out >> np.uint64(32)
    out += a
    out *= _K2
    out ^= out >> np.uint64(29)
    return out


def window_hashes(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of each `size` consecutive words of `words` (one text, or texts on end): stretches of 1, 2, 4, ..
    words are folded together. Other seeds give independent hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    have = mix(words + np.uint64(seed) * _K2) if seed else words
    out, at, width = None, 0, 1
    while True:
        if size & width:
            own = have[at : at + n]
            out = own if out is None else _fold(out, own)
            at += width
        width *= 2
        if width > size:
            return mix(out ^ np.uint64(size))
        have = _fold(have[: len(have) - width // 2], have[width // 2 :])


def shingle_sets(words: np.ndarray, first: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its `size`-word shingles.

    A text with fewer words has the hash of its whole sequence; one without words has none.
    """
    every = window_hashes(words, size)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(every[a : b - size + 1])
        else:
            yield window_hashes(words[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def binary_array(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
