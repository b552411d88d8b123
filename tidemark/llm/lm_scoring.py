"""Text scores of a log-bilinear language model, trained in numpy by noise-contrastive estimation.

Words of all training documents are counted, and every word belongs to a class of the model: the most
frequent words are classes of their own, all others fall into the class of their ending, of which the most
frequent have one each. The numbers of both kinds grow with the cube root of the vocabulary, so that the
tables of pairs of classes stay small beside it. Within the class of an ending a word has its smoothed share
of the count, and the end of a text is a class of its own. The log-bilinear model predicts the class's vector
from the two preceding classes' vectors, each through a matrix.

Texts are dealt out by their digest to groups of about `GROUP` tokens, copies of a text evenly over the groups, so what a
group holds and their number follow from the corpus alone. A group counts its (class, class, class) triples, cuts their
occurrences into shares of at most `TOGETHER`, and trains the model over these in a random order that is fixed, with noise words drawn from the unigram distribution in place of a normaliser, and
the groups' parameters are averaged, weighted by their occurrences, through a tree; some rounds of this cover all
documents each. How the input is split over files or tasks moves nothing.

Scores are normalised exactly. Matrix products give the score of each class after each preceding class at
either distance; the normalisers of all pairs of preceding classes are one more product of the two tables'
exponentials. A word's log probability is then three look-ups and its share of its class.

Defined cases: a null text counts as empty and has its end as the only token; repeated rows each get their
row; without training documents all words are unknown and the model stays the one it starts from; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_array, binary_parts, crc_text, materialize, row_key, slices, texts, word_hashes

DIM, NOISE, ROUNDS = 24, 32, 2
#: Classes of single words, and of endings, for each cube root of the vocabulary.
WORD_CLASSES, ENDING_CLASSES = 5, 2
#: Words that a task takes together when it counts.
CHUNK_WORDS = 2_000_000
BATCH = 1024
#: Occurrences of one triple that a step takes together; more are spread over further steps, so that the most
#: frequent ones don't fill the batches they are in. Tokens of one group.
TOGETHER, GROUP = 8, 1_500_000
#: Stands for the end of a text among word hashes.
END = 0
#: Distinct words that one task of the join with counts holds.
JOINED_WORDS = 500_000
#: Parameters in one row of the averaging, and groups in which the first level averages.
BLOCK, SALTS = 4096, 1024


@dataclass(frozen=True)
class Classes:
    """The model's classes: words by hash, in order, then endings, in order, all other words, and the end; the
    tokens of each, and its distinct words."""

    hashes: np.ndarray
    endings: np.ndarray
    counts: np.ndarray
    distinct: np.ndarray

    @property
    def size(self) -> int:
        return len(self.counts)

    @property
    def narrow(self) -> str:
        """A type that holds every class."""
        return "<u2" if self.size <= 1 << 16 else "<u4"

    @property
    def end(self) -> int:
        return self.size - 1

    @property
    def total(self) -> int:
        return int(self.counts.sum())

    def is_word(self, classes: np.ndarray) -> np.ndarray:
        """Which classes hold one token only: a frequent word, or the end."""
        return (classes < len(self.hashes)) | (classes == self.end)

    def of(self, h: np.ndarray, ending: np.ndarray) -> np.ndarray:
        words, endings = len(self.hashes), len(self.endings)
        out = np.full(len(h), words + endings, np.int64)
        for known, asked, base in ((self.endings, ending, words), (self.hashes, h, 0)):
            if len(known):
                at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
                out = np.where(known[at] == asked, base + at, out)
        return out

    def unigram(self) -> np.ndarray:
        own = self.counts + 0.5
        return own / own.sum()

    def denominator(self) -> np.ndarray:
        """By class, log10 of what a word's smoothed count is divided by for its share; 0 for single words."""
        out = np.log10(self.counts + 0.1 * (self.distinct + 1))
        out[self.is_word(np.arange(self.size))] = 0
        return out


def _endings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The last three bytes of each word, lower-cased, as a number; fewer of a shorter word."""
    out = np.zeros(len(ends), np.int64)
    for k in range(3):
        at = ends - 1 - k
        byte = data[np.maximum(at, 0)].astype(np.int64)
        byte += 32 * ((byte >= 65) & (byte <= 90))
        out |= np.where(at >= starts, byte, 0) << (8 * k)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, e, c) of the words of training rows and their endings, summed over many texts at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size, ends = 0, 0

    def flush() -> pa.RecordBatch:
        h, e = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        h, at, c = np.unique(h, return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(e[at].astype(np.int32)), pa.array(c.astype(np.int64))], names=["h", "e", "c"])

    for part in slices(batches):
        data, offsets = binary_parts(part.column(0))
        words, starts, stops, _ = word_hashes(data, offsets, lower=True)
        held.append((words, _endings(data, starts, stops)))
        size, ends = size + len(words), ends + part.num_rows
        if size > CHUNK_WORDS:
            yield flush()
            held, size = [], 0
    yield flush()
    some = [END] if ends else []
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([0] if ends else [], pa.int32()), pa.array([ends] if ends else [], pa.int64())], names=["h", "e", "c"])


def _tokens(part: pa.RecordBatch, column: int, classes: Classes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(class of each token, the class before it, the one before that, first token of each text); each text
    ends in the end class, which also stands before its start."""
    data, offsets = binary_parts(part.column(column))
    h, begin, stop, first = word_hashes(data, offsets, lower=True)
    n, end = len(first) - 1, classes.end
    w = np.full(len(h) + n, end, np.int64)
    w[np.arange(len(h)) + np.repeat(np.arange(n), np.diff(first))] = classes.of(h, _endings(data, begin, stop))
    starts = first[:-1] + np.arange(n)
    return w, *_before(w, starts, end), starts


def _before(w: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The class before each token and the one before that, of texts on end that each end in `end`."""
    before = np.concatenate(([end], w[:-1]))[: len(w)]
    before2 = np.concatenate(([end, end], w[:-2]))[: len(w)]
    before2[starts] = end
    return before, before2


class LogBilinear:
    """vector(next) ~ R[before] @ C1 + R[before2] @ C2; score = that @ Q[class] + b[class]."""

    def __init__(self, unigram: np.ndarray, dim: int, params: np.ndarray | None = None):
        m, self.dim, self.q, self.log_q = len(unigram), dim, unigram, np.log(unigram).astype(np.float32)
        rng = np.random.default_rng(1)
        if params is None:
            eye = np.eye(dim).ravel()
            params = np.concatenate([rng.normal(0, 0.3, m * dim), rng.normal(0, 0.05, m * dim), eye, 0.5 * eye, np.log(unigram)])
        self.params = params.astype(np.float32)
        cut = np.cumsum([m * dim, m * dim, dim * dim, dim * dim])
        r, q, c1, c2, self.b = np.split(self.params, cut)
        self.r, self.out, self.c1, self.c2 = r.reshape(m, dim), q.reshape(m, dim), c1.reshape(dim, dim), c2.reshape(dim, dim)
        self.seen = [np.full(x.shape, 1e-8, np.float32) for x in (self.r, self.out, self.c1, self.c2, self.b)]

    def _move(self, k: int, param: np.ndarray, grad: np.ndarray, rate: float) -> None:
        self.seen[k] += grad * grad
        param -= rate * grad / np.sqrt(self.seen[k])

    def step(self, w: np.ndarray, i1: np.ndarray, i2: np.ndarray, weight: np.ndarray, noise: np.ndarray, rate: float) -> None:
        """One noise-contrastive step over weighted (word, before, before2), with shared noise words."""
        r1, r2, qw, qn = self.r[i1], self.r[i2], self.out[w], self.out[noise]
        hat = r1 @ self.c1 + r2 @ self.c2
        log_k, log_q = np.float32(np.log(len(noise))), self.log_q
        good = _sigmoid(np.einsum("ij,ij->i", hat, qw) + self.b[w] - log_k - log_q[w]) - 1
        bad = _sigmoid(hat @ qn.T + (self.b[noise] - log_k - log_q[noise]))
        weight = (weight / weight.sum()).astype(np.float32)
        good, bad = good * weight, bad * weight[:, None]
        d = good[:, None] * qw + bad @ qn
        both = np.concatenate([w, noise])
        out = _scatter(len(self.q), both, np.concatenate([good[:, None] * hat, bad.T @ hat]))
        bias = np.bincount(both, np.concatenate([good, bad.sum(0)]), len(self.q)).astype(np.float32)
        before = _scatter(len(self.q), np.concatenate([i1, i2]), np.concatenate([d @ self.c1.T, d @ self.c2.T]))
        grads = [before, out, r1.T @ d, r2.T @ d, bias]
        for k, (param, grad) in enumerate(zip((self.r, self.out, self.c1, self.c2, self.b), grads, strict=True)):
            self._move(k, param, grad, rate)

    def train(self, codes: np.ndarray, counts: np.ndarray, rng: np.random.Generator, noise: int, rate: float = 0.03) -> None:
        """A pass over the distinct (before2, before, word), coded as one number, by their counts."""
        m, sums = len(self.q), np.cumsum(self.q)
        order = rng.permutation(len(codes))
        w, i1, i2 = ((codes // k % m).astype(np.int32) for k in (1, m, m * m))
        for a in range(0, len(order), BATCH):
            own = order[a : a + BATCH]
            drawn = np.minimum(np.searchsorted(sums, rng.random(noise)), m - 1)
            self.step(w[own], i1[own], i2[own], counts[own], drawn, rate)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores by (before, class) and (before2, class), and log normalisers by (before, before2)."""
        t1, t2 = (self.r @ self.c1 @ self.out.T).astype(np.float32), (self.r @ self.c2 @ self.out.T + self.b).astype(np.float32)
        m1, m2 = t1.max(1, keepdims=True), t2.max(1, keepdims=True)
        z = np.log(np.maximum(np.exp(t1 - m1) @ np.exp(t2 - m2).T, 1e-300)) + m1 + m2.T
        return t1, t2, z


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.minimum(-x, 80)))


def _scatter(size: int, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of rows by index, as one count over all their cells."""
    dim = rows.shape[1]
    cells = (at[:, None] * dim + np.arange(dim)).ravel()
    return np.bincount(cells, rows.ravel(), size * dim).reshape(size, dim).astype(rows.dtype)


def _sequences(classes: Classes):
    """Texts to (key, seq): a text's digest and the classes of its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            w, _, _, starts = _tokens(part, 0, classes)
            w, ends = w.astype(classes.narrow), np.append(starts[1:], len(w)) if len(starts) else starts
            keys = [hashlib.md5(t.as_py(), usedforsecurity=False).digest() for t in part.column(0)]
            yield pa.RecordBatch.from_arrays([binary_array(keys), binary_array([w[a:b].tobytes() for a, b in zip(starts, ends, strict=True)])], names=["key", "seq"])

    return run


def _counted(classes: Classes):
    """One group's texts (grp, key, seq, copies) as the triples (before2, before, word) in them, coded as one number and in
    order, with their counts."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")  # in the same order whatever order they come in
        seqs, copies = (table.column(c).to_pylist() for c in ("seq", "copies"))
        w = [np.frombuffer(x, classes.narrow) for x in seqs]
        sizes = np.array([len(x) for x in w])
        i1, i2 = _before(words := np.concatenate(w).astype(np.int64), np.cumsum(sizes) - sizes, classes.end)
        codes, n = (i2 * classes.size + i1) * classes.size + words, np.repeat(np.array(copies), sizes)
        order = np.argsort(codes, kind="stable")
        codes, n = codes[order], n[order]
        first = np.flatnonzero(np.diff(codes, prepend=-1))
        parts = [codes[first].astype("<i8").tobytes(), np.add.reduceat(n, first).astype("<i4").tobytes()]
        return pa.table([table.slice(0, 1).column("grp"), *[binary_array([p]) for p in parts]], names=["grp", "code", "n"])

    return run


def groups_of(training: DataFrame, classes: Classes, group: int = GROUP) -> DataFrame:
    """(grp, code, n as arrays): the triples of each group of texts of about `group` tokens, written. Copies of a text are
    one row with their number, dealt out evenly over the groups."""
    texts_ = training.mapInArrow(_sequences(classes), "key binary, seq binary").groupBy("key").agg(F.first("seq").alias("seq"), F.count("*").alias("c"))
    groups = max(1, -(-classes.total // group))
    dealt = texts_.select("key", "seq", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.least("c", F.lit(groups)) - 1)).alias("j"))
    dealt = dealt.select(F.pmod(F.xxhash64("key") + F.col("j"), F.lit(groups)).cast("int").alias("grp"), "key", "seq", (F.floor((F.col("c") - F.col("j") - 1) / groups) + 1).cast("long").alias("copies"))
    # A group is a row of many MB, and a Parquet file holds a hundred rows before it looks at their size, so each group has
    # a partition and a file of its own, however many there are.
    return materialize(dealt.repartitionById(groups, F.col("grp")).groupBy("grp").applyInArrow(_counted(classes), "grp int, code binary, n binary"), "lm-triples")


def _train(classes: Classes, params: np.ndarray | None, dim: int, noise: int, round_: int):
    """Groups of `groups_of` to their parameters after a pass over the shares of their triples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                grp = batch.column(0)[i].as_py()
                code, n = (np.frombuffer(batch.column(k)[i].as_py(), t) for k, t in ((1, "<i8"), (2, "<i4")))
                shares = -(-n // TOGETHER)
                model, rng = LogBilinear(classes.unigram(), dim, params), np.random.default_rng([100 + round_, grp])
                model.train(np.repeat(code, shares), np.repeat(n / shares, shares), rng, noise)
                learnt = model.params.astype(np.float64)
                blocks = [learnt[a : a + BLOCK] for a in range(0, len(learnt), BLOCK)]
                m = len(blocks)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(m), pa.int32()), pa.array([grp % SALTS] * m, pa.int32()), pa.array([float(n.sum())] * m), binary_array([b.tobytes() for b in blocks])],
                    names=["block", "salt", "weight", "params"],
                )

    return run


def _mean(table: pa.Table) -> pa.Table:
    """The weighted mean of one block's parameters."""
    rows = sorted(zip(table.column("weight").to_pylist(), table.column("params").to_pylist(), strict=True))  # any order of arrival gives the same sum
    total = sum(w for w, _ in rows)
    sums = sum(w * np.frombuffer(p) for w, p in rows)
    one = table.slice(0, 1)
    return pa.table([one.column("block"), one.column("salt"), pa.array([total]), binary_array([(sums / total).tobytes()])], names=["block", "salt", "weight", "params"])


_PARAMS = "block int, salt int, weight double, params binary"


def classes_of(counts: DataFrame, words: int = WORD_CLASSES, endings: int = ENDING_CLASSES) -> Classes:
    """Classes whose number grows with the cube root of the vocabulary. counts: (h, e, c) of all words and the
    end."""
    grow = max(1, counts.count()) ** (1 / 3)
    own = counts.where(F.col("h") != END)
    top = sorted((r.h & (2**64 - 1), r.c) for r in own.orderBy(F.desc("c"), "h").limit(int(np.ceil(words * grow))).collect())
    rest = own.where(~F.col("h").isin([h - 2**64 if h >= 2**63 else h for h, _ in top])) if top else own
    sums = [F.sum("c").alias("c"), F.count("*").alias("n")]
    kinds = sorted((r.e, r.c, r.n) for r in rest.groupBy("e").agg(*sums).orderBy(F.desc("c"), "e").limit(int(np.ceil(endings * grow))).collect())
    every = rest.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.count("*").alias("n")).first()
    ends = counts.where(F.col("h") == END).first()
    c = [n for _, n in top] + [n for _, n, _ in kinds] + [every.c - sum(n for _, n, _ in kinds), ends.c if ends else 0]
    n = [1] * len(top) + [k for *_, k in kinds] + [every.n - sum(k for *_, k in kinds), int(ends is not None)]
    return Classes(np.array([h for h, _ in top], np.uint64), np.array([e for e, *_ in kinds], np.int64), np.array(c, np.int64), np.array(n, np.int64))


def fit(training: DataFrame, classes: Classes, dim: int = DIM, noise: int = NOISE, rounds: int = ROUNDS, group: int = GROUP) -> np.ndarray | None:
    """Parameters of the model, from all training texts. training: (text as binary)."""
    groups, params = groups_of(training, classes, group), None
    for k in range(rounds):
        rows = groups.mapInArrow(_train(classes, params, dim, noise, k), _PARAMS)
        for keys in (("block", "salt"), ("block",)):
            rows = rows.groupBy(*keys).applyInArrow(_mean, _PARAMS)
        blocks = rows.orderBy("block").collect()
        params = np.concatenate([np.frombuffer(bytes(r.params)) for r in blocks]) if blocks else None
    return params


def _rare(classes: Classes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            data, offsets = binary_parts(part.column(1))
            h, begin, stop, first = word_hashes(data, offsets, lower=True)
            doc = np.repeat(np.arange(part.num_rows), np.diff(first))
            rare = ~classes.is_word(classes.of(h, _endings(data, begin, stop)))
            h, doc = h[rare], doc[rare]
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            at = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))) if len(h) else np.zeros(0, np.int64)
            tf = np.diff(at, append=len(h))
            head = np.diff(doc[at], prepend=-1) != 0
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc[at])), pa.array(h[at].view(np.int64)), pa.array(tf.astype(np.int32)), pa.array(head.astype(np.int32))], names=["key", "h", "tf", "copies"])

    return run


def _score(classes: Classes, params: np.ndarray | None, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t1, t2, z = LogBilinear(classes.unigram(), dim, params).tables()
        word = classes.is_word(np.arange(classes.size))
        log_c, share = np.where(word, np.log10(classes.counts + 0.1), 0.0), classes.denominator()
        sure = word & (classes.counts > 0)
        for part in slices(batches):
            w, i1, i2, starts = _tokens(part, 2, classes)
            if not len(starts):
                continue
            sums = lambda x: np.add.reduceat(x, starts)
            model = t1[i1, w].astype(float) + t2[i2, w] - z[i1, i2]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    pa.array(np.diff(starts, append=len(w)), pa.int64()),
                    pa.array(sums(sure[w].astype(np.int64))),
                    pa.array(sums(log_c[w])),
                    pa.array(sums(model / np.log(10) - share[w])),
                ],
                names=["key", "doc_id", "n_tokens", "n_sure", "base", "model"],
            )

    return run


def score(docs: DataFrame, training: DataFrame | None = None, words: int = WORD_CLASSES, endings: int = ENDING_CLASSES, dim: int = DIM, noise: int = NOISE, rounds: int = ROUNDS, group: int = GROUP) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of docs.

    base_score sums log10((c + 0.1) / (N + 0.1 (V + 1))) over tokens, score is the model's log10
    probability. docs: (doc_id, text); training: (text), those that teach; all of docs unless given.
    """
    taught = texts(docs if training is None else training)
    counts = materialize(taught.mapInArrow(_count, "h long, e int, c long").groupBy("h").agg(F.min("e").alias("e"), F.sum("c").alias("c")), "lm-counts")
    classes = classes_of(counts, words, endings)
    params = fit(taught, classes, dim, noise, rounds, group)

    key = row_key(F.col("doc_id"), F.col("text")).alias("key")
    rare = texts(docs, key).mapInArrow(_rare(classes), "key binary, h long, tf int, copies int")
    c = F.coalesce("c", F.lit(0))
    # The counts of a task are held in memory, so their number decides on the number of tasks.
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(classes.distinct.sum()) // JOINED_WORDS))
    # Repeated rows share a key, so their sums are divided by their number.
    sums = (
        rare.repartition(tasks, "h")
        .join(counts.select("h", "c").repartition(tasks, "h").hint("shuffle_hash"), "h", "left")
        .groupBy("key")
        .agg(F.sum(F.col("tf") * F.log10(c + 0.1)).alias("log_c"), F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("known"), F.sum("copies").alias("copies"))
        .select("key", (F.col("log_c") / F.col("copies")).alias("log_c"), (F.col("known") / F.col("copies")).cast("long").alias("known"))
    )
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = texts(docs, key, F.col("doc_id")).mapInArrow(_score(classes, params, dim), f"key binary, doc_id {id_type}, n_tokens long, n_sure long, base double, model double")
    log_c = F.coalesce("log_c", F.lit(0.0))
    base_total = float(np.log10(classes.total + 0.1 * (int(classes.distinct.sum()) + 1)))
    return rows.join(sums, "key", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_sure") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(classes.total).cast("long").alias("train_tokens"),
        (F.col("base") + log_c - F.col("n_tokens") * base_total).alias("base_score"),
        (F.col("model") + log_c).alias("score"),
    )


def held_out(doc_id, folds: int = 10):
    """Whether a row is kept from training."""
    return crc_text(doc_id) % folds == 0
