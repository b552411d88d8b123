"""A term that gives an entity away goes at every place of every text."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tidemark.llm import pii

SCHEMA = "doc_id long, text string"


def prose(rng, n):
    return " ".join(f"w{rng.randrange(2000)}" for _ in range(n))


def test_a_telling_term_goes_far_from_its_entity_and_without_it(spark):
    rng = random.Random(7)
    rows = [(i, f"{prose(rng, 25)} Ms Zorblatt wrote from ann@home.org on {prose(rng, 20)}") for i in range(12)]
    far = f"Zorblatt {prose(rng, 400)} ann@home.org {prose(rng, 400)} zorblatt"
    rows += [(12, far), (13, f"{prose(rng, 30)} ZORBLATT {prose(rng, 30)}"), (14, "zorblatt@else.org"), (15, prose(rng, 60)), (16, None)]
    rows += [(20 + i, prose(rng, 60)) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert not [i for i, t in got.items() if t and "zorblatt" in t.lower()]
    assert got[14] == "[EMAIL]" and got[15] == rows[15][1] and got[16] is None
    spans = {r.doc_id: r.spans for r in pii.report(df).collect()}
    assert f"term:0:8,email:{far.index('ann@')}:{far.index('ann@') + 12}" in spans[12] and spans[12].endswith(f"term:{len(far) - 8}:{len(far)}")
    assert spans[14] == "email:0:17" and spans[15] == ""


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_places_of_all_terms(spark, n):
    rng = random.Random(n)
    text = "".join(rng.choice(["Wort", "üx", "\U0001f642", "a1"]) + rng.choice([" ", ", ", "\n\n"]) for _ in range(n))
    for t in (text, " " + text, text + "end"):
        got = spark.createDataFrame([(1, t)], SCHEMA).select(pii._located(F.col("text"), pii.TERM, 4).alias("p")).first().p
        assert [(x.start, x.end, x.value) for x in got] == [(m.start(), m.end(), m[0]) for m in re.finditer(pii.TERM, t)]


def test_terms_are_generalised_to_their_class(spark):
    rng = random.Random(3)
    # Each term stands beside the entity in 20 contexts and 3 times elsewhere: generalised, but not removed.
    rows = [(i, f"{prose(rng, 30)} Quorn vex7 88123 blip ann@home.org {prose(rng, 30)}") for i in range(20)]
    rows += [(100 + i, f"{prose(rng, 30)} {w} {prose(rng, 30)}") for i, w in enumerate(["Quorn", "vex7", "88123", "blip"] * 12)]
    rows += [(200 + i, prose(rng, 500)) for i in range(60)]
    got = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert "[NAME] [CODE] [NUMBER] [WORD] [EMAIL]" in got[0]
    assert "[NAME]" in got[100] and "[CODE]" in got[101] and "[NUMBER]" in got[102] and "[WORD]" in got[103]


def test_a_text_of_very_many_spans(spark):
    text = " ".join(f"name{i} u{i}@example{i % 7}.org" for i in range(20_000))
    began = time.perf_counter()
    got = pii.report(spark.createDataFrame([(1, text), (2, None)], SCHEMA)).collect()
    assert {r.doc_id: r.n_email for r in got} == {1: 20_000, 2: 0}
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame([(1, text)], SCHEMA)).collect()}
    assert "@" not in clean[1] and clean[1].count("[EMAIL]") == 20_000
    assert time.perf_counter() - began < 90


def test_pieces_of_overlapping_spans_and_long_texts(spark):
    text = "x" * 20_000 + " card 4111 1111 1111 1111 +1 (234) 567-8901 " + "é" * 40_000 + "a@b.cc"
    rows = spark.createDataFrame([(1, text)], SCHEMA).select("doc_id", "text", pii.base_spans(F.col("text")).alias("spans"))
    r = pii.with_pieces(rows, ["doc_id"]).first()
    ends = [0, *[s.end for s in r.spans]]
    assert [p.piece for p in r.pieces] == [text[max(ends[: k + 1]) : max(max(ends[: k + 1]), r.spans[k].start) if k < len(r.spans) else len(text)] for k in range(len(r.pieces))]
    assert pii.sanitise(spark.createDataFrame([(1, text)], SCHEMA)).first().text.endswith("é[EMAIL]")


def brute_windows(text):
    """(left, right) of each span: the nearest characters outside spans, each span between as a line's end."""
    spans, pieces, at = [], [], 0
    for m in re.finditer(r"[a-z0-9]+@[a-z]+(?:\.[a-z]+)+|(?<![0-9])[0-9]+(?:\.[0-9]+){3}", text):
        pieces.append(text[at : m.start()])
        spans.append(m[0])
        at = m.end()
    pieces.append(text[at:])
    n = pii.WINDOW_CHARS
    return [(s, "\n".join(pieces[: i + 1])[-n:], "\n".join(pieces[i + 1 :])[:n]) for i, s in enumerate(spans)]


def test_windows_reach_over_any_number_of_spans(spark):
    rng = random.Random(11)
    texts = [f"Zorblatt {' '.join('10.0.0.%d' % i for i in range(n))} ann@home.org {prose(rng, 40)}" for n in (0, 1, 10, 20, 60, 130)]
    for _ in range(30):
        texts.append(" ".join(rng.choice(["w%d" % rng.randrange(99), "u%d@home.org" % rng.randrange(5), "10.0.0.%d" % rng.randrange(9), "x" * rng.randrange(1, 150)]) for _ in range(rng.randrange(1, 60))))
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    rows = df.select("doc_id", "text", pii.base_spans(F.col("text")).alias("spans"))
    got = pii._windows(pii.with_pieces(rows, ["doc_id"])).groupBy("entity", "term").count().collect()
    want = {}
    for t in texts:
        for span, left, right in brute_windows(t):
            left = left if len(left) < pii.WINDOW_CHARS else re.sub(f"^{pii.TERM}", "", left)
            right = right if len(right) < pii.WINDOW_CHARS else re.sub(f"{pii.TERM}$", "", right)
            for term in re.findall(pii.TERM, f"{left}\n{right}".lower()):
                want[span, term] = want.get((span, term), 0) + 1
    assert sorted(r["count"] for r in got) == sorted(want.values())
    # Up to sixty addresses between take 60 of the 120 characters and their spaces the rest.
    assert want["ann@home.org", "zorblatt"] == 4
