"""SentencePiece encoding and decoding through the tokenizers library.

The model file's protobuf is parsed here (pieces, scores, types, trainer and normaliser settings) and
rebuilt as a tokenizers pipeline: the normaliser (the precompiled character map if there is one, the dummy
prefix, the metaspace marker), a unigram model from the scores or a byte-pair model whose merges follow
from them, and byte fallback. Texts are cut into chunks
in front of each run of markers; if no piece holds a marker after another character, which is checked when
the model is loaded, no piece crosses such a cut and a text's ids are its chunks' ids on end. A task encodes
each distinct chunk once, many of them on end in one string of the multithreaded `encode_batch_fast`, deals
the ids out by the bytes that each stands for, verifies them against the sentencepiece library, and keeps
ids and verdicts for the chunks to come. Decoding is checked by chunk as well.

Defined cases: a null or empty text has no ids and decodes to the empty text; repeated rows each get their
row; an empty table gives no rows; other columns are kept or ignored, whatever their names. A chunk whose
ids differ from the sentencepiece library's makes its texts' `parity` false.
For a model whose texts are cut, `parity` is the AND of its chunks' comparisons: the whole text isn't compared,
so joining the chunks rests on the check at load. A chunk of markers for which the library gives no ids is
compared with its own ids. Control, unknown, unused and byte pieces are never found in a text, though it may
spell their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers

from .common import slices

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Chunks that a task remembers, and characters on end in one call of the library.
REMEMBERED, TOGETHER = 300_000, 2048


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; fixed and length-delimited values as bytes."""

    def varint(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            b = data[at]
            out |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return out, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        elif tag & 7 == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        elif tag & 7 in (1, 5):
            n = 8 if tag & 7 == 1 else 4
            value, at = data[at : at + n], at + n
        else:
            raise ValueError("not a model file")
        yield tag >> 3, value


@dataclass
class Model:
    """What a SentencePiece model file says. Fields that it leaves out have the format's defaults."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra_spaces: bool = True
    escape_spaces: bool = True
    unk_id: int = 0

    @classmethod
    def parse(cls, data: bytes) -> Model:
        out = cls()
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                out.pieces.append((own.get(1, b"").decode(), float(np.frombuffer(own.get(2, bytes(4)), "<f4")[0]), own.get(3, NORMAL)))
            elif number == 2:
                own = dict(_fields(value))
                out.kind, out.byte_fallback, out.unk_id = own.get(3, UNIGRAM), bool(own.get(35, 0)), own.get(40, 0)
            elif number == 3:
                own = dict(_fields(value))
                out.charsmap = own.get(2, b"")
                out.dummy_prefix, out.remove_extra_spaces, out.escape_spaces = (bool(own.get(k, 1)) for k in (3, 4, 5))
        return out

    def separable(self) -> bool:
        """Whether no piece holds a marker after another character."""
        return not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in self.pieces if kind in (NORMAL, USER))

    def scores(self) -> list[float]:
        """Scores of a unigram model's pieces; those that the user defines are always preferred."""
        best = max((s for _, s, kind in self.pieces if kind == NORMAL), default=0.0)
        return [len(p.encode()) * best - 0.1 if kind == USER else s for p, s, kind in self.pieces]

    def hidden(self) -> re.Pattern | None:
        """The names of pieces that no text holds, as a pattern."""
        names = [re.escape(p) for p, _, kind in self.pieces if p and kind in (UNKNOWN, CONTROL, UNUSED, BYTE)]
        return re.compile("|".join(names)) if names else None

    def best_path(self, text: str) -> list[int]:
        """Unigram ids of a normalised text that spells the name of a hidden piece, which the tokenizers
        library would take for the piece."""
        scores = self.scores()
        known = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
        longest = max(map(len, known), default=1)
        unknown = min((s for _, s, kind in self.pieces if kind == NORMAL), default=0.0) - 10
        best: list[tuple[float, int, int]] = [(0.0, 0, -1)] + [(-np.inf, 0, -1)] * len(text)
        for a in range(len(text)):
            for b in range(a + 1, min(len(text), a + longest) + 1):
                i = known.get(text[a:b], -1)
                if i >= 0 or b == a + 1:
                    score = best[a][0] + (scores[i] if i >= 0 else unknown)
                    if score > best[b][0]:
                        best[b] = (score, a, i)
        path, at = [], len(text)
        while at:
            _, a, i = best[at]
            path.append((i, text[a:at]))
            at = a
        byte = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        out: list[int] = []
        last = None
        for i, own in reversed(path):
            if i < 0 and self.byte_fallback:
                out += [byte[f"<0x{b:02X}>"] for b in own.encode()]
            elif i >= 0 or last != -1:  # a run of unknown characters is one piece
                out.append(i if i >= 0 else self.unk_id)
            last = i
        return out

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces that make a piece, the best piece first."""
        known = {p: (-score, i) for i, (p, score, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
        found = []
        for p, rank in known.items():
            for k in range(1, len(p)):
                a, b = p[:k], p[k:]
                if a in known and b in known:
                    found.append((rank, known[a], known[b], (a, b)))
        return [pair for *_, pair in sorted(found)]

    def normaliser(self) -> normalizers.Normalizer:
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.remove_extra_spaces:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK if self.escape_spaces else " "))
        if self.escape_spaces:
            steps.append(normalizers.Replace(" ", MARK))
        return normalizers.Sequence(steps)

    def tokenizer(self) -> Tokenizer:
        """The model without its normaliser, for texts that are normalised."""
        if self.kind == UNIGRAM:
            model = models.Unigram([(p, s) for (p, _, _), s in zip(self.pieces, self.scores(), strict=True)], unk_id=self.unk_id, byte_fallback=self.byte_fallback)
        elif self.kind == BPE:
            model = models.BPE({p: i for i, (p, _, _) in enumerate(self.pieces)}, self.merges(), unk_token=self.pieces[self.unk_id][0], fuse_unk=True, byte_fallback=self.byte_fallback, cache_capacity=0)
        else:
            raise ValueError("unigram and byte-pair models only")
        out = Tokenizer(model)
        steps = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        out.decoder = decoders.Sequence(steps + ([decoders.Strip(" ", 1, 0)] if self.dummy_prefix else []))
        return out

    def bytes_of(self) -> list[bytes]:
        """What each id stands for in a decoded text; nothing for control pieces."""
        out = []
        for p, _, kind in self.pieces:
            if kind == BYTE:
                out.append(bytes([int(p[3:5], 16)]))
            elif kind == CONTROL:
                out.append(b"")
            elif kind == UNKNOWN:
                out.append(" ⁇ ".encode())
            else:
                out.append(p.replace(MARK, " ").encode())
        return out


class _Places(dict):
    """Numbers the chunks that it is asked for; `new` are those without ids."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        self.new.append(chunk)
        return n


class _Lists:
    """Lists of numbers on end, as arrays that grow by doubling."""

    def __init__(self):
        self.values, self.ends = np.zeros(1 << 16, np.int32), np.zeros(1, np.int64)

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        used = int(self.ends[-1])
        if used + len(values) > len(self.values):
            self.values = np.concatenate([self.values[:used], np.zeros(max(used, 2 * len(values)), np.int32)])
        self.values[used : used + len(values)] = values
        self.ends = np.concatenate([self.ends, used + np.cumsum(sizes)])

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of the lists `at` on end, their sizes)."""
        start, size = self.ends[at], self.ends[at + 1] - self.ends[at]
        into = np.cumsum(size) - size
        return self.values[np.arange(int(size.sum())) + np.repeat(start - into, size)], size


class Codec:
    """Encodes and decodes texts with a model file; remembers the chunks it has met."""

    def __init__(self, data: bytes):
        self.model = Model.parse(data)
        self.tokenizer, self.normaliser, self.bytes = self.model.tokenizer(), self.model.normaliser(), self.model.bytes_of()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.cuts = self.model.separable()
        self.cut = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        # Only a text of which nothing but blanks changes can be normalised by plain replacement.
        self.plain = not self.model.charsmap and not self.model.remove_extra_spaces and self.model.dummy_prefix and self.model.escape_spaces
        self.by_chunk = self.cuts and self.plain
        self.hidden = self.model.hidden() if self.model.kind == UNIGRAM else None
        # Bytes of a normalised text that an id stands for; 0 for the unknown piece, which may be of any size.
        self.size = np.array([1 if kind == BYTE else 0 if kind == UNKNOWN else len(p.encode()) for p, _, kind in self.model.pieces])
        self._forget()

    def _forget(self) -> None:
        self.places, self.ids = _Places(), _Lists()
        self.same, self.trip = np.zeros(0, bool), np.zeros(0, bool)

    def normalised(self, text: str) -> str:
        if not text:
            return ""
        return MARK + text.replace(" ", MARK) if self.plain else self.normaliser.normalize_str(text)

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text; a chunk that opens with one marker goes without it."""
        if not self.by_chunk:
            whole = self.normalised(text)
            return ([c for c in self.cut.findall(whole)] if self.cuts else [whole]) if whole else []
        if not text:
            return []
        if "  " not in text and text[0] != " " and text[-1] != " " and MARK not in text:
            return text.split(" ")
        return [c[1:] for c in self.cut.findall(self.normalised(text))]

    def _tokens(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids on end, ids of each) of normalised chunks. Several go on end to the library if their ids can
        be told apart by their bytes again."""
        groups: list[list[str]] = []
        held = TOGETHER
        for c in chunks:
            if held + len(c) > TOGETHER or not self.cuts:
                groups.append([])
                held = 0
            groups[-1].append(c)
            # Markers at a chunk's end would run into those of the next.
            held = TOGETHER if c.endswith(MARK) else held + len(c)
        ids, sizes = [], []
        for own, e in zip(groups, self.tokenizer.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False), strict=True):
            got = np.array(e.ids, np.int32)
            ends = np.cumsum([len(c.encode()) for c in own])
            parts = np.cumsum(self.size[got])
            if len(own) > 1 and (not len(parts) or parts[-1] != ends[-1] or (self.size[got] == 0).any()):
                one = [x.ids for x in self.tokenizer.encode_batch_fast(own, add_special_tokens=False)]
                ids += [np.array(x, np.int32) for x in one]
                sizes += map(len, one)
                continue
            ids.append(got)
            sizes += np.diff(np.searchsorted(parts, ends, side="right"), prepend=0).tolist() if len(own) > 1 else [len(got)]
        if self.hidden:
            lists = np.split(np.concatenate(ids), np.cumsum(sizes)[:-1])
            lists = [np.array(self.model.best_path(c), np.int32) if self.hidden.search(c) else x for c, x in zip(chunks, lists, strict=True)]
            ids, sizes = lists, [len(x) for x in lists]
        return np.concatenate(ids), np.array(sizes)

    def _learn(self, chunks: list[str]) -> None:
        whole = [MARK + c for c in chunks] if self.by_chunk else chunks
        ids, sizes = self._tokens(whole)
        ends = np.cumsum(sizes)
        same = np.ones(len(chunks), bool)
        if self.by_chunk:  # the library puts the first marker itself
            right = self.library.encode(chunks, num_threads=1)
            flat, n = np.fromiter(chain.from_iterable(right), np.int32), np.fromiter(map(len, right), np.int64, len(right))
            if len(flat) != len(ids) or (flat != ids).any() or (n != sizes).any():
                for i, (r, a, b) in enumerate(zip(right, ends - sizes, ends, strict=True)):
                    # A chunk of one marker only is an empty text to the library, so it is asked for with a neighbour.
                    r = r if chunks[i] else self.library.encode(MARK)[1:]
                    same[i] = not (r or chunks[i]) or r == ids[a:b].tolist()
        stored = [self.bytes[i] for i in ids.tolist()]
        trip = [b"".join(stored[a:b]) == c.replace(MARK, " ").encode() for c, a, b in zip(whole, (ends - sizes).tolist(), ends.tolist(), strict=True)]
        self.ids.add(ids, sizes)
        self.same, self.trip = np.concatenate([self.same, same]), np.concatenate([self.trip, trip])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts on end, ids of each, parity of each, whether each decodes to itself)."""
        if len(self.places) > REMEMBERED:
            self._forget()
        parts = [self.chunks(t) for t in texts]
        at = np.fromiter(map(self.places.__getitem__, chain.from_iterable(parts)), np.int64)
        if self.places.new:
            self._learn(self.places.new)
            self.places.new = []
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        ids, sizes = self.ids.take(at)
        sums = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[np.concatenate(([0], np.cumsum(n)))])
        count = sums(sizes)
        if self.by_chunk:
            marked = np.fromiter((MARK in t for t in texts), bool, len(texts))
            return ids, count, sums(~self.same[at]) == 0, (sums(~self.trip[at]) == 0) & ~marked
        own = [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] if texts else []
        return ids, count, np.array([self.library.encode(t) == x for t, x in zip(texts, own, strict=True)], bool), np.array([self.decode(x) == t for t, x in zip(texts, own, strict=True)], bool)

    def decode(self, ids: list[int]) -> str:
        data = b"".join([self.bytes[i] for i in ids])
        return (data[1:] if self.model.dummy_prefix and data[:1] == b" " else data).decode("utf-8", "replace")


def read_model(path: str) -> bytes:
    """The model file, read once on the driver: a tokenizer's own, bounded data."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, ids, parity, round_trip) of every row of docs: (doc_id, text).

    parity: the ids are the sentencepiece library's; round_trip: they decode to the text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for part in slices(batches):
            ids, count, parity, trip = codec.encode(pc.fill_null(part.column(1), "").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(parity, pa.bool_()), pa.array(trip, pa.bool_())], names=["doc_id", "ids", "parity", "round_trip"])

    return docs.select("doc_id", F.col("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, parity boolean, round_trip boolean")


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, text) of every row of encoded: (doc_id, ids); null ids decode to the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for part in batches:
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([codec.decode(i or []) for i in part.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")
