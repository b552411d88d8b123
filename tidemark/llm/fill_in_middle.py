"""Fill-in-middle transformation: texts cut at line ends into prefix, middle and suffix, and put together anew.

Lines and markers are recognised by one small automaton over bytes. A chunk of a text doesn't know in which
state it is entered, so it gives its transition function: for each state it may be entered in, the state it is
left in and the number of lines that start in it. Such functions compose, and composition is associative:
chunks compose to groups, groups to the text, and the text's total gives the number of lines; going back down,
each group and each chunk learns its entry state and the lines before it, and the one chunk in which a cut lies
finds it. Inside a chunk the same composition runs over its bytes, in rounds that halve.

Texts of one chunk are done where they lie. Only texts of several chunks are dealt out by chunk, and only their
functions, a few hundred bytes a chunk, are gathered, at most `GROUP` of them at a time. In the end each text is
put together where its row is, as one row of Spark's holds a text whole anyway.

Defined cases: a null text counts as empty; an empty text is plain; a null id counts as the empty text in the
hash; repeated rows each get their row; an empty table gives no rows; other columns are ignored, whatever
their names. Bytes that aren't UTF-8 are kept as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_key, slices, texts

# The markers and the seed of the choices.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = "7"
#: Shares of texts that are transformed, and of these in suffix-prefix-middle form, in per cent.
RATE, SPM_RATE = 100, 50
#: Bytes of a chunk, and functions composed in one group.
CHUNK, GROUP = 1 << 16, 256

#: Classes of bytes: any other, newline, <, a marker's letter, >.
OTHER, NEWLINE, OPEN, LETTER, CLOSE = range(5)
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("\n")], _CLASS[ord("<")], _CLASS[ord(">")] = NEWLINE, OPEN, CLOSE
_CLASS[[m[1] for m in (PREFIX, SUFFIX, MIDDLE)]] = LETTER
#: A state is 4 * (in a line) + progress of a marker: none, after <, after its letter, found.
STATES, FOUND = 8, 3


def _step(state: int, kind: int) -> tuple[int, int]:
    """(next state, lines that start) of one byte."""
    inside, marker = divmod(state, 4)
    if marker != FOUND:
        marker = FOUND if (marker, kind) == (2, CLOSE) else 1 if kind == OPEN else 2 if (marker, kind) == (1, LETTER) else 0
    return 4 * (kind != NEWLINE) + marker, int(not inside)


_NEXT = np.array([[_step(s, k)[0] for s in range(STATES)] for k in range(5)], np.uint8)
_STARTS = np.array([[_step(s, k)[1] for s in range(STATES)] for k in range(5)], np.int64)


def transition(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state left in, lines started) of some bytes, for each state that they may be entered in."""
    kind = _CLASS[data]
    # A run of other bytes does what its first one does, but for the line, which the first one starts.
    keep = kind != OTHER
    keep[:1] = True
    keep[1:] |= kind[:-1] != OTHER
    kind = kind[keep]
    if not len(kind):
        return np.arange(STATES, dtype=np.uint8), np.zeros(STATES, np.int64)
    to, count = _NEXT[kind], _STARTS[kind]
    while len(to) > 1:  # neighbours compose; an odd one waits
        even = len(to) // 2 * 2
        left, right = to[0:even:2].astype(np.intp), slice(1, even, 2)
        joined = np.take_along_axis(to[right], left, 1), count[0:even:2] + np.take_along_axis(count[right], left, 1)
        to, count = (np.concatenate([j, rest[even:]]) for j, rest in zip(joined, (to, count), strict=True))
    return to[0], count[0]


def line_start(data: np.ndarray, k: int, inside: bool) -> int:
    """Place of the byte at which line k (from 0) starts among those that start in `data`."""
    starts = np.flatnonzero(data[:-1] == 10) + 1
    if not inside:
        starts = np.concatenate([[0], starts])
    return int(starts[k])


def points(data: np.ndarray) -> int:
    """Code points of some bytes: those that go on with an earlier byte's don't count."""
    return int(((data & 0xC0) != 0x80).sum())


def put_together(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    """The output of a form; a plain text goes by as prefix."""
    if form == "plain":
        return prefix + middle + suffix
    if form == "psm":
        return b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
    return b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))


def restore(form: str, output: bytes) -> bytes:
    """The text that gave an output; no part of a transformed text holds a marker."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    a, at = output[len(first) :].split(second, 1)
    b, middle = at.split(MIDDLE, 1)
    return (a + middle + b) if form == "psm" else (b + middle + a)


_OUT = "doc_id {id}, n long, form string, prefix_chars long, middle_chars long, output {out}, restored {out}"


def _rows(rows: list[tuple], kind: pa.DataType, digests: bool) -> pa.RecordBatch:
    out = pa.string() if digests else pa.binary()
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.int64(), out, out]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"])


def _row(doc_id, n: int, form: str, chars: tuple[int, int] | None, text: bytes, a: int, b: int, digests: bool) -> tuple:
    output = put_together(form, text[:a], text[a:b], text[b:])
    back = restore(form, output)
    if digests:
        output, back = hashlib.sha256(output).hexdigest(), hashlib.sha256(back).hexdigest()
    return (doc_id, n, form, *(chars or (None, None)), output, back)


def form_of(h: tuple[int, int], n: int, marked: bool, rate: int, spm: int) -> str:
    return "plain" if not n or marked or h[0] % 100 >= rate else "spm" if h[1] % 100 < spm else "psm"


def _short(rate: int, spm: int, digests: bool):
    """Texts of one chunk: (doc_id, h1 .. h4, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for doc_id, h1, h2, h3, h4, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                data = np.frombuffer(text, np.uint8)
                to, count = transition(data)
                n = int(count[0])
                form = form_of((h3, h4), n, to[0] % 4 == FOUND, rate, spm)
                a, b = (line_start(data, k, False) if k < n else len(data) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
                chars = None if form == "plain" else (points(data[:a]), points(data[a:b]))
                rows.append(_row(doc_id, n, form, chars, text, a, b, digests))
            yield _rows(rows, part.schema.field(0).type, digests)

    return run


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, seq, to, starts, points) of chunks (key, seq, bytes)."""
    for part in slices(batches, "bytes"):
        to, starts, chars = [], [], []
        for chunk in part.column(2):
            data = np.frombuffer(chunk.as_py(), np.uint8)
            f, c = transition(data)
            to.append(f.astype(np.int32))
            starts.append(c)
            chars.append(points(data))
        yield pa.RecordBatch.from_arrays(
            [part.column(0), part.column(1), pa.array(to, pa.list_(pa.int32())), pa.array(starts, pa.list_(pa.int64())), pa.array(chars, pa.int64())], names=["key", "seq", "to", "starts", "points"]
        )


def _composed(chunks: Column) -> Column:
    """The composition of an array of functions (to, starts, points) in order."""
    none = F.struct(
        F.sequence(F.lit(0), F.lit(STATES - 1)).alias("to"), F.array_repeat(F.lit(0).cast("long"), STATES).alias("starts"), F.lit(0).cast("long").alias("points")
    )
    return F.aggregate(
        chunks,
        none,
        lambda acc, f: F.struct(
            F.transform(acc["to"], lambda s: F.get(f["to"], s)).alias("to"),
            F.zip_with(acc["starts"], acc["to"], lambda c, s: c + F.get(f["starts"], s)).alias("starts"),
            (acc["points"] + f["points"]).alias("points"),
        ),
    )


def _entered(parts: Column, entry: Column) -> Column:
    """For each function of an array: where it is entered, as (seq, state, lines before, code points before)."""
    walk = F.aggregate(
        parts,
        F.struct(entry.alias("at"), F.expr("array()").cast("array<struct<seq:long,state:int,lines:long,points:long>>").alias("all")),
        lambda acc, f: F.struct(
            F.struct(
                F.get(f["to"], acc["at"]["state"]).alias("state"),
                (acc["at"]["lines"] + F.get(f["starts"], acc["at"]["state"])).alias("lines"),
                (acc["at"]["points"] + f["points"]).alias("points"),
            ).alias("at"),
            F.concat(acc["all"], F.array(F.struct(f["seq"].alias("seq"), acc["at"]["state"].alias("state"), acc["at"]["lines"].alias("lines"), acc["at"]["points"].alias("points")))).alias("all"),
        ),
        lambda acc: acc["all"],
    )
    return walk


def scan(long_texts: DataFrame, chunk: int = CHUNK, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(totals, entries) of texts (key, text): totals are (key, n, marked, points) of each text, entries
    (key, seq, state, lines, points) of each chunk, with what lies before it."""
    number = F.expr(f"int((length(text) + {chunk - 1}) div {chunk})")
    pieces = F.transform(F.sequence(F.lit(0), number - 1), lambda i: F.struct(i.cast("long").alias("seq"), F.substring(F.col("text"), i * chunk + 1, F.lit(chunk)).alias("bytes")))
    pieces = long_texts.select("key", F.explode(pieces).alias("piece")).select("key", "piece.seq", "piece.bytes").repartition("key", "seq")
    functions = pieces.mapInArrow(_functions, "key binary, seq long, to array<int>, starts array<long>, points long")
    # Rows that repeat give the same functions; one of each counts.
    functions = functions.groupBy("key", "seq").agg(F.first(F.struct("to", "starts", "points")).alias("f")).select("key", "seq", "f.*")
    functions = functions.withColumn("grp", F.expr(f"seq div {group}"))
    groups = materialize(functions.groupBy("key", "grp").agg(F.array_sort(F.collect_list(F.struct("seq", "to", "starts", "points"))).alias("parts")), "fim-functions")
    whole = groups.select("key", F.struct(F.col("grp").alias("seq"), _composed(F.col("parts")).alias("f")).alias("g"))
    whole = whole.groupBy("key").agg(F.array_sort(F.collect_list("g")).alias("g"))
    whole = whole.select("key", F.transform("g", lambda g: F.struct(g["seq"].alias("seq"), g["f"]["to"].alias("to"), g["f"]["starts"].alias("starts"), g["f"]["points"].alias("points"))).alias("parts"))
    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("lines"), F.lit(0).cast("long").alias("points"))
    whole = materialize(whole.select("key", _composed(F.col("parts")).alias("total"), _entered(F.col("parts"), start).alias("groups")), "fim-groups")
    totals = whole.select("key", F.get("total.starts", F.lit(0)).alias("n"), (F.get("total.to", F.lit(0)) % 4 == FOUND).alias("marked"), "total.points")
    at = whole.select("key", F.explode("groups").alias("at")).select("key", F.col("at.seq").alias("grp"), F.struct("at.state", "at.lines", "at.points").alias("entry"))
    entries = groups.join(at, ["key", "grp"]).select("key", F.explode(_entered(F.col("parts"), F.col("entry"))).alias("e")).select("key", "e.*")
    return totals, entries


def _long(rate: int, spm: int, digests: bool, chunk: int):
    """Texts of several chunks: (doc_id, h3, h4, n, marked, points, cuts, text); cuts are (line, seq, state, lines, points)."""

    def place(text: np.ndarray, cut: dict, n: int, total: int) -> tuple[int, int]:
        if cut["line"] >= n:
            return len(text), total
        base = cut["seq"] * chunk
        data = text[base : base + chunk]
        at = line_start(data, cut["line"] - cut["lines"], cut["state"] >= 4)
        return base + at, cut["points"] + points(data[:at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for i in range(part.num_rows):  # one text at a time
                doc_id, h3, h4, n, marked, total, cuts, text = (c[i].as_py() for c in part.columns)
                data = np.frombuffer(text, np.uint8)
                form = form_of((h3, h4), n, marked, rate, spm)
                (a, pa_), (b, pb) = (place(data, c, n, total) for c in sorted(cuts, key=lambda c: c["line"]))
                rows.append(_row(doc_id, n, form, None if form == "plain" else (pa_, pb - pa_), text, a, b, digests))
            yield _rows(rows, part.schema.field(0).type, digests)

    return run


def transform(docs: DataFrame, rate: int = RATE, spm: int = SPM_RATE, seed: str = SEED, digests: bool = False, chunk: int = CHUNK, group: int = GROUP) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output, restored) of every row of docs: (doc_id, text).

    n: the text's lines. output: the transformed text; restored: the text, rebuilt from output and form. Both
    are bytes, or with `digests` the hex SHA-256 of these.
    """
    hex_ = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring(hex_, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = texts(docs, F.col("doc_id"), *h, row_key(F.col("doc_id"), F.col("text")).alias("key"))
    out = _OUT.format(id=docs.schema["doc_id"].dataType.simpleString(), out="string" if digests else "binary")
    short = rows.where(F.length("text") <= chunk).drop("key").mapInArrow(_short(rate, spm, digests), out)
    long_ = rows.where(F.length("text") > chunk)
    totals, entries = scan(long_.select("key", "text"), chunk, group)
    ids = long_.select("key", "h1", "h2").distinct()
    wanted = totals.join(ids, "key").select("key", "n", "marked", "points", F.explode(F.array(F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1))).alias("line"))
    # The last chunk before which no more lines start than the cut's; a cut behind the last line is the end.
    before = entries.select("key", "seq", "state", "lines", F.col("points").alias("before"))
    found = wanted.join(before, "key").where("lines <= line").groupBy("key", "n", "marked", "points", "line").agg(F.max(F.struct("lines", "seq", "state", "before")).alias("c"))
    return short.unionByName(_finish(long_, found, rate, spm, digests, chunk, out))


def _finish(long_: DataFrame, found: DataFrame, rate: int, spm: int, digests: bool, chunk: int, out: str) -> DataFrame:
    cut = F.struct("line", F.col("c.seq").alias("seq"), F.col("c.state").alias("state"), F.col("c.lines").alias("lines"), F.col("c.before").alias("points"))
    cuts = found.groupBy("key", "n", "marked", "points").agg(F.collect_list(cut).alias("cuts"))
    # Equal cuts are one row.
    cuts = cuts.withColumn("cuts", F.when(F.size("cuts") == 1, F.concat("cuts", "cuts")).otherwise(F.col("cuts")))
    joined = long_.join(cuts, "key").select("doc_id", "h3", "h4", "n", "marked", "points", "cuts", "text")
    return joined.mapInArrow(_long(rate, spm, digests, chunk), out)
