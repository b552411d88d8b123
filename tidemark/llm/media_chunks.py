"""Media columns: payloads stored as 8-bit samples in content-defined chunks, each chunk once.

A payload becomes a mono WAVE file whose samples are its bytes. A rolling gear hash over the last 32 bytes
cuts the file where its leading bits are zero, so that equal stretches give equal chunks wherever they
stand. Chunks are compressed and keyed by their digest; a Spark aggregation keeps each digest once, which
is the chunk store, and every distinct file has its ordered list of digests, the manifest. Reading joins
the manifest with the store by digest, gathers a file's chunks, puts them in order, and verifies each
chunk's digest and the file's. Rows refer to files by digest, so copies share a file, its chunks and its
features, and a group of copies of any size is read back once.

Files of one chunk are read where their chunk is; only those of several chunks are shuffled once more.

Defined cases: a null text counts as empty and is one block of zeros; repeated rows each get their row and
share a file; an empty table gives no rows; other columns are ignored, whatever their names. A stored chunk
or file that doesn't match its digest raises an error.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary_array, materialize, slices

BLOCK = 64
RATE = 8000
#: Chunk bounds in bytes; a cut comes after about AVERAGE_BITS further bits' worth of bytes.
LEAST, MOST, AVERAGE_BITS = 2048, 65536, 13
_GEAR = np.random.Generator(np.random.PCG64(41)).integers(0, 1 << 32, 256, dtype=np.uint32)


def wave(payload: bytes) -> bytes:
    """A WAVE file of 8-bit mono samples; the payload's length is even, so no padding byte follows."""
    n = len(payload)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + payload


def samples(media: bytes) -> bytes:
    """The samples of such a file, by its chunk headers."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at = 12
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def payload_of(text: bytes) -> bytes:
    return text + bytes(-len(text) % BLOCK or (BLOCK if not text else 0))


def cuts(data: bytes) -> list[int]:
    """Ends of the content-defined chunks."""
    if len(data) <= LEAST:
        return [len(data)]
    h = _GEAR[np.frombuffer(data, np.uint8)]
    span = 1
    while span < 32:  # sums over 2, 4, .. 32 bytes, each older byte shifted one bit further
        older = h.copy()
        h[span:] += older[:-span] << np.uint32(span)
        span *= 2
    fits = np.flatnonzero(h >> np.uint32(32 - AVERAGE_BITS) == 0) + 1
    out, at = [], 0
    while len(data) - at > LEAST:
        k = np.searchsorted(fits, at + LEAST)
        end = min(int(fits[k]) if k < len(fits) else len(data), at + MOST, len(data))
        out.append(end)
        at = end
    if at < len(data):
        out.append(len(data))
    return out


def _chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _digest(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        n, media, digests = [], [], []
        for text in part.column(1):
            text = text.as_py()
            data = wave(payload_of(text))
            n.append(len(text))
            media.append(_digest(data))
            digests.append([_digest(p) for p in _chunks(data)])
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), binary_array(media), pa.array(digests, pa.list_(pa.binary()))], names=["doc_id", "n_bytes", "media", "digests"])


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=True)
    for part in slices(batches):
        parts: dict[bytes, bytes] = {}
        for text in part.column(0):
            for chunk in _chunks(wave(payload_of(text.as_py()))):
                name = _digest(chunk)
                if name not in parts:
                    parts[name] = pack.compress(chunk)
        yield pa.RecordBatch.from_arrays([binary_array(list(parts)), binary_array(list(parts.values()))], names=["digest", "bytes"])


def _source(docs: DataFrame, *keep: Column) -> DataFrame:
    return docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def files(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media, digests) of every row: the digest of its stored file, and of its chunks in order."""
    return _source(docs, F.col("doc_id")).mapInArrow(_files, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary, digests array<binary>")


def manifest(files_: DataFrame) -> DataFrame:
    """(media, seq, parts, digest): the ordered chunks of each distinct file of `files`."""
    distinct = files_.groupBy("media").agg(F.first("digests").alias("digests"))
    return distinct.select("media", F.size("digests").alias("parts"), F.posexplode("digests").alias("seq", "digest")).select("media", "seq", "parts", "digest")


def chunk_store(docs: DataFrame) -> DataFrame:
    """(digest, bytes): each distinct chunk once, compressed."""
    return _source(docs).mapInArrow(_store, "digest binary, bytes binary").groupBy("digest").agg(F.first("bytes").alias("bytes"))


def _joined(media: bytes, chunks: list[bytes], digests: list[bytes], unpack: zstandard.ZstdDecompressor) -> bytes:
    parts = [unpack.decompress(c) for c in chunks]
    if any(_digest(p) != d for p, d in zip(parts, digests, strict=True)):
        raise ValueError("a stored chunk doesn't match its digest")
    data = b"".join(parts)
    if _digest(data) != media:
        raise ValueError("a file put together from its chunks doesn't match its digest")
    return data


def feature(payload: bytes) -> str:
    """Mean, spread, share of zero crossings about the mean and the distinct values of the samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    n, total, squares = len(x), int(x.sum()), int((x * x).sum())
    above = x * n > total
    return f"mean={total * 1000 // n},var={(squares * n - total * total) * 1000 // (n * n)},cross={int((above[1:] != above[:-1]).sum())},values={len(np.unique(x))}"


_FEATURES = "media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of files given as (media, chunks), chunks being (seq, parts, digest, bytes) structs."""
    unpack = zstandard.ZstdDecompressor()
    kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        rows = []
        for media, chunks in zip(batch.column(0), batch.column(1), strict=True):  # one file's bytes at a time
            media, chunks = media.as_py(), sorted(chunks.as_py(), key=lambda c: c["seq"])
            if [c["seq"] for c in chunks] != list(range(chunks[0]["parts"])):
                raise ValueError("a file's list of chunks has gaps")
            data = _joined(media, [c["bytes"] for c in chunks], [c["digest"] for c in chunks], unpack)
            payload = samples(data)
            rows.append((media, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(data), media.hex(), feature(payload)))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in _FEATURES.split(", ")])


def read_back(manifest_: DataFrame, store: DataFrame) -> DataFrame:
    """(media, features of the payload) of each distinct file, read from its stored chunks."""
    found = manifest_.join(store, "digest").select("media", "parts", F.struct("seq", "parts", "digest", "bytes").alias("chunk"))
    one = found.where("parts = 1").select("media", F.array("chunk").alias("chunks"))
    more = found.where("parts > 1").groupBy("media").agg(F.collect_list("chunk").alias("chunks"))
    return one.unionByName(more).mapInArrow(_features, _FEATURES)


def stored(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of
    every row of docs: (doc_id, text)."""
    rows = materialize(files(docs), "media-files")
    features = read_back(manifest(rows), chunk_store(docs))
    return rows.join(features, "media").select("doc_id", "n_bytes", *[f.split()[0] for f in _FEATURES.split(", ")[1:]])
