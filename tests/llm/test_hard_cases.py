"""Texts that are made to break an operator: regular words, very long texts, odd ids, names of pieces."""

import math
import random
import re
import struct
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, license_scan, media_chunks, minhash_dedup, quality_classifier, sentencepieces, substring_dedup
from tidemark.llm.common import binary_parts, window_hashes, word_hashes
from tidemark.llm.license_texts import PHRASES, TEMPLATES, Template

SCHEMA = "doc_id long, text string"


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def prose(rng, n, vocabulary=5000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.mark.parametrize("n", [8, 16, 64, 65, 1024, 4096])
def test_regular_words_have_different_hashes(n):
    import pyarrow as pa

    col = pa.array([thue_morse(n).encode(), thue_morse(n, "b", "a").encode(), b"\x00" * n, b"\x00" * (n + 1)], pa.binary())
    h = word_hashes(*binary_parts(col), lower=False)[0]
    assert len(set(h.tolist())) == 4
    one, other = np.uint64(12345), np.uint64(987654321)
    flip = np.array([bin(i).count("1") % 2 for i in range(n)], bool)
    a, b = np.where(flip, one, other), np.where(flip, other, one)
    assert window_hashes(a, n)[0] != window_hashes(b, n)[0] != window_hashes(b, n, 1)[0]


def test_regular_words_stay_apart_in_the_operators(spark):
    rng = random.Random(1)
    x, y = thue_morse(1024), thue_morse(1024, "b", "a")
    left, right = prose(rng, 20), prose(rng, 20)
    rows = [(1, f"{left} {x} {right}"), (2, f"{left} {y} {right}")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.n_removed for r in substring_dedup.dedup(df, 35).collect()} == {0}
    items = spark.createDataFrame([(1, " ".join([x] * 5))], "item_id long, text string")
    texts = spark.createDataFrame([(1, " ".join([x] * 9)), (2, " ".join([y] * 9))], SCHEMA)
    assert [r.doc_id for r in decontaminate.matches(texts, items).collect()] == [1]
    assert {r.component_id for r in minhash_dedup.dedup(texts, 2).collect()} == {1, 2}


@pytest.mark.parametrize("kind", ["int", "smallint", "string", "date", "decimal(10,2)", "binary"])
def test_ids_of_any_type(spark, kind):
    rng = random.Random(2)
    item = prose(rng, 30)
    one = {"date": "2026-01-01", "decimal(10,2)": "7.25"}.get(kind, "7")
    docs = spark.createDataFrame([(one, f"{prose(rng, 50)} {item}"), (None, prose(rng, 50))], "doc_id string, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    items = spark.createDataFrame([(one, item)], "item_id string, text string").withColumn("item_id", F.col("item_id").cast(kind))
    got = decontaminate.matches(docs, items)
    assert got.schema["item_id"].dataType == items.schema["item_id"].dataType
    assert got.count() == 1 and got.select("doc_id").join(docs, "doc_id").count() == 1


def test_a_benchmark_of_many_pieces(spark):
    rng = random.Random(3)
    items = [(i, prose(rng, 30)) for i in range(40)]
    docs = [(i, f"{prose(rng, 40)} {items[i % 40][1] if i % 3 == 0 else ''} {prose(rng, 40)}") for i in range(60)] + [(99, None), (0, "again")]
    df = spark.createDataFrame(docs, SCHEMA).withColumn("key", F.lit(1)).withColumn("held", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    few, many = (decontaminate.decontaminate(df, bench, piece_bytes=b) for b in (1 << 20, 1500))
    assert few.columns == many.columns == df.columns
    assert sorted(map(repr, few.collect())) == sorted(map(repr, many.collect())) and few.count() == 42


def test_long_media(spark):
    rng = np.random.default_rng(5)
    long = "".join(map(chr, rng.integers(97, 123, 10_000_000)))
    rows = [(1, long), (2, long), (3, long[:5_000_000] + "!" + long[5_000_000:]), (4, None)]
    got = {r.doc_id: r for r in media_chunks.stored(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].media_sha256 == got[2].media_sha256 != got[3].media_sha256
    assert got[3].n_bytes == 10_000_001 and got[3].payload_bytes == 10_000_064 and got[4].payload_bytes == 64
    names = {bytes(r.digest) for r in media_chunks.chunk_store(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(names) < 1.1 * len(media_chunks._chunks(media_chunks.wave(media_chunks.payload_of(long.encode()))))


def _field(number, value):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def unigram_model():
    """A small unigram model file: scores by hand, control, unknown and byte pieces."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    rng = random.Random(4)
    words = ["▁", "▁the", "▁a", "th", "er", "he", "in", "ing", "▁in", "un", "k", "s", "<", ">", "/", "0", "x", "4", "1", "on", "an", *"abcdefghijlmnopqrtuvwy", "▁▁"]
    pieces += [(w, -rng.uniform(2, 9), 1) for w in words]
    out = b"".join(_field(1, _field(1, p.encode()) + _field(2, s) + _field(3, kind)) for p, s, kind in pieces)
    trainer = _field(3, 1) + _field(35, 1)
    normaliser = _field(1, b"identity") + _field(3, 1) + _field(4, 0) + _field(5, 1)
    return out + _field(2, trainer) + _field(3, normaliser)


def test_unigram_equals_the_library(spark):
    model = unigram_model()
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = random.Random(5)
    texts = ["<s>", "<unk> a </s>", "the <0x41> thing", "x<0x41><0x4", "日本 the 🙂é", "", " ", "  in  the ", None]
    texts += ["".join(rng.choice("the inganounk <>/0x41s") for _ in range(rng.randint(1, 80))) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    for r in sentencepieces.encode(rows, model).collect():
        assert list(r.ids) == library.encode(texts[r.doc_id] or ""), texts[r.doc_id]
        assert r.parity and r.round_trip


def brute_licences(rows, templates, stretch, rare, agree, slack, coverage):
    """labels and score by doc_id, in plain Python."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    vocabulary = {w for t in templates for w in cut(t.text)}
    files = {i: cut(t) for i, t in rows}
    df = Counter(w for ws in files.values() for w in set(ws) & vocabulary)
    idf = {w: math.log((len(rows) + 1) / (df[w] + 0.5)) for w in vocabulary}
    out = {}
    for i, ws in files.items():
        base = {label for p, label in PHRASES.items() if any(ws[k : k + len(p.split())] == p.split() for k in range(len(ws)))}
        found, best = set(), 0.0
        placed = [(k, w) for k, w in enumerate(ws) if w in vocabulary]
        rarest = []
        for s in {k // stretch for k, _ in placed}:
            rarest += sorted((-idf[w], w, k) for k, w in placed if k // stretch == s)[:rare]
        for t in templates:
            own, keys = cut(t.text), [cut(k) for k in t.keys]
            if not all(w in ws for key in keys for w in key):
                continue
            votes = [(k - p, w) for _, w, k in rarest for p, x in enumerate(own) if x == w]
            for shift in (0, slack):
                for b in {(o + shift) // (2 * slack) for o, _ in votes}:
                    mine = [(o, w) for o, w in votes if (o + shift) // (2 * slack) == b]
                    if len({w for _, w in mine}) < agree:
                        continue
                    low, high = min(mine)[0], max(mine)[0]
                    stands = all(
                        any(ws[k : k + len(key)] == key for k in range(max(0, low + at - slack), high + at + slack + 1) if k + len(key) <= high + len(own) + slack and k >= low - slack)
                        for key in keys
                        for at in [next(a for a in range(len(own)) if own[a : a + len(key)] == key)]
                    )
                    near = {w for k, w in placed if low - slack <= k < high + len(own) + slack}
                    part = sum(idf[w] for w in sorted(near & set(own))) / sum(idf[w] for w in sorted(set(own)))
                    if stands and part >= coverage:
                        found.add(t.label)
                        best = max(best, min(1.0, part))
        out[i] = (",".join(sorted(base | found)), max(best, 1.0 if base else 0.0))
    return out


def test_licences_equal_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for i in range(160):
        own = prose(rng, rng.randint(0, 60), 200).split()
        for t in rng.sample(TEMPLATES, rng.choice([0, 0, 1, 1, 2])):
            words = re.sub(r"\s+", " ", t.text).split(" ")
            if rng.random() < 0.3:  # a few words more, or the notice's end lost
                words.insert(rng.randrange(len(words)), "so to say")
            if rng.random() < 0.3:
                words = words[: rng.randint(1, len(words))]
            at = rng.randint(0, len(own))
            own[at:at] = words
        rows.append((i, " ".join(own)))
    rows += [(200, None), (201, ""), (202, "the of and license"), (203, " ".join(["mit license"] * 50)), (204, "distributed under the terms of the GNU General Public License version 3"), (3, rows[3][1])]
    want = brute_licences(rows[:-1] + [(-1, rows[-1][1])], TEMPLATES, license_scan.STRETCH, license_scan.RARE, license_scan.AGREE, license_scan.SLACK, license_scan.COVERAGE)
    got = license_scan.scan(spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit(1)).withColumn("words", F.lit(2))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.labels == want[r.doc_id][0], (rows[r.doc_id] if r.doc_id < 160 else r.doc_id)
        assert r.score == pytest.approx(want[r.doc_id][1], abs=1e-9)
    assert {r.doc_id: r.labels for r in got}[204] == "gpl-3" and len({x for r in got for x in r.labels.split(",")}) > 15


def test_licence_words_of_equal_weight(spark):
    templates = [Template("one", "alpha beta gamma", ("alpha beta",)), Template("two", "beta alpha gamma", ("beta alpha",))]
    rows = [(1, "x alpha beta gamma y"), (2, "beta alpha gamma"), (3, "alpha gamma beta"), (4, "gamma")]
    got = {r.doc_id: r.labels for r in license_scan.scan(spark.createDataFrame(rows, SCHEMA), templates, {}).collect()}
    assert got == {1: "one", 2: "two", 3: "", 4: ""}


def test_rules_as_columns_equal_rules_in_numpy(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["BUY!! ", "a.b,c; ", "wörd ", "9 9\n", "same line\n"]) * rng.randint(0, 40) + prose(rng, rng.randint(0, 50))) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 2 == 0 or i % 5 == 0)) for i in range(400)], "doc_id long, quality int")
    df = spark.createDataFrame(rows, SCHEMA)
    model = quality_classifier.fit(df, labels)
    x = quality_classifier.with_statistics(df, "doc_id").toPandas().set_index("doc_id")
    want = dict(zip(x.index, model.predict(x[quality_classifier.FEATURES].to_numpy()), strict=True))
    got = {r.doc_id: r.score for r in quality_classifier.score(df, model, "doc_id").collect()}
    assert got == pytest.approx(want, abs=1e-12) and len(model.rules) > 2
    tie = quality_classifier.RuleModel(0.0, ())
    assert {(r.score, r.predicted) for r in quality_classifier.score(df, tie, "doc_id").collect()} == {(0.5, 1)}
    assert quality_classifier.keep(df, tie).count() == 400


def test_an_id_of_many_rows_teaches_once(spark):
    one = spark.createDataFrame([(2, "good text here."), (3, "BAD!!")], SCHEMA)
    many = one.unionByName(spark.range(30_000).select(F.lit(2).cast("long").alias("doc_id"), F.lit("good text here.").alias("text")))
    labels = spark.createDataFrame([(2, 1), (3, 0)], "doc_id long, quality int")
    assert quality_classifier.fit(one, labels) == quality_classifier.fit(many, labels)


def test_a_scope_removes_its_tables(spark):
    import os

    from tidemark.llm.common import materialize, scope

    with scope() as made:
        gone, stays = (materialize(spark.range(3), "scope-test") for _ in range(2))
        made[:] = [df for df in made if df is not stays]
        assert gone.count() == 3
    assert stays.count() == 3 and not os.path.exists(gone._shared_path)
