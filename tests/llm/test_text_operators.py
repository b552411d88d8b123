"""The text operators against brute force on small tables, with nulls, empty and long texts, repeated rows,
empty tables and columns of clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, license_scan, lm_scoring, media_chunks, minhash_dedup, pii, quality_classifier, sentencepieces, substring_dedup, url_filters
from tidemark.llm.queries import model_path

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
#: Names that the operators use themselves.
CLASH = {"key": 1, "words": "w", "row": 2, "part": "p", "spans": None, "node": "n", "h": 5, "doc": 3}


def prose(rng, n, vocabulary=300):
    return " ".join(f"w{int(rng.random() ** 2 * vocabulary)}" for _ in range(n))


def texts():
    rng = random.Random(1)
    out = [None, "", "   ", "one", "two words", prose(rng, 40), prose(rng, 40), prose(rng, 9000)]
    base = prose(rng, 120, 900)
    out += [base, base, base + " more words here", prose(rng, 30) + " " + base[:300] + " " + prose(rng, 30)]
    out += ["Ünï \u2028 cödé \ttabs\nlines \u212aelvin İx", "A" * 3000]
    out += [prose(rng, rng.randint(20, 200), 900) for _ in range(30)]
    passage = prose(rng, 50, 5000)
    out += [prose(rng, 20) + " " + passage + " " + prose(rng, 20) for _ in range(3)] + [passage + " " + passage]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(5, texts()[5])]  # a row that repeats
    return table(spark, rows)


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("doc_id", "text", *[F.lit(v).cast("string" if v is None else "string" if isinstance(v, str) else "int").alias(k) for k, v in CLASH.items()]).repartition(3)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def words(text, lower=True):
    return WORDS.findall((text or "").translate(LOWER) if lower else text or "")


def test_lm_scores(spark, docs):
    held = lm_scoring.held_out(F.col("doc_id"))
    got = lm_scoring.score(docs, docs.where(~held), words=10, endings=4, dim=8, rounds=1).collect()
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    train = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            train.update([*words(t), "</s>"])
    total, distinct = sum(train.values()), len(train)
    want = []
    for i, t in rows:
        own = [*words(t), "</s>"]
        want.append((i, len(own), sum(w in train for w in own), total, sum(math.log10((train[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in own)))
    found = sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    for a, b in zip(found, sorted(want), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9)
    assert all(r.score < 0 for r in got)


def test_lm_is_normalised_and_learns(spark):
    rng = np.random.default_rng(0)
    follow = rng.integers(0, 20, (20, 2))
    docs = []
    for i in range(400):
        w, own = int(rng.integers(20)), []
        for _ in range(60):
            own.append(f"x{w}")
            w = int(follow[w][rng.integers(2)])
        docs.append((i, " ".join(own)))
    df = table(spark, docs)
    held = lm_scoring.held_out(F.col("doc_id"))
    got = lm_scoring.score(df, df.where(~held), words=4, endings=2, dim=8, rounds=4).where(held).agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] > got[1] + 0.1 * got[2]  # each word follows from the one before
    model = lm_scoring.LogBilinear(np.full(6, 1 / 6), 4)
    t1, t2, z = model.tables()
    p = np.exp(t1[:, None, :] + t2[None, :, :] - z[:, :, None])
    assert np.allclose(p.sum(2), 1)


def test_lm_probabilities_of_all_words_sum_to_one(spark):
    """Scores of "a x" for every known word x, one unknown word and the end are the whole probability."""
    rng = random.Random(2)
    train = table(spark, [(i, " ".join(rng.choice(["a", "b", "cat", "bat", "rat", "dog", "fog", "Ab"]) for _ in range(30))) for i in range(50)])
    known = ["a", "b", "cat", "bat", "rat", "dog", "fog", "ab"]
    rows = [(0, "a")] + [(1 + i, f"a {x}") for i, x in enumerate(known)]
    for words_, endings in ((1, 1), (0.5, 0.4), (9, 9)):
        counts = train.select(F.col("text").cast("binary").alias("text")).mapInArrow(lm_scoring._count, "h long, e int, c long").groupBy("h").agg(F.min("e").alias("e"), F.sum("c").alias("c"))
        classes = lm_scoring.classes_of(counts, words_, endings)
        params = lm_scoring.fit(train.select(F.col("text").cast("binary").alias("text")), classes, 4, 8, 1)
        t1, t2, z = lm_scoring.LogBilinear(classes.unigram(), 4, params).tables()
        got = {r.doc_id: r.score for r in lm_scoring.score(table(spark, rows), train, words_, endings, 4, 8, 1).collect()}

        def kind(x):
            import pyarrow as pa
            from tidemark.llm.common import binary_parts, word_hashes

            data, offsets = binary_parts(pa.array([x.encode()], pa.binary()))
            h, a, b, _ = word_hashes(data, offsets, True)
            return int(classes.of(h, lm_scoring._endings(data, a, b))[0])

        tf = Counter(w for r in train.collect() for w in words(r.text))
        log = lambda c, before, before2: t1[before, c] + t2[before2, c] - z[before, before2]
        for i, x in enumerate(known):
            ca, cx, end = kind("a"), kind(x), classes.end
            share = lambda w, c: 0.0 if classes.is_word(np.array([c]))[0] else math.log10(tf[w] + 0.1) - math.log10(classes.counts[c] + 0.1 * (classes.distinct[c] + 1))
            want = (log(ca, end, end) + log(cx, ca, end) + log(end, cx, ca)) / math.log(10) + share("a", ca) + share(x, cx)
            assert got[1 + i] == pytest.approx(want, abs=1e-4)
        for c in range(classes.size):  # the words of a class and one unknown word share it whole
            own = [w for w in tf if kind(w) == c]
            if own and not classes.is_word(np.array([c]))[0]:
                assert sum((tf[w] + 0.1) for w in own) + 0.1 == pytest.approx(classes.counts[c] + 0.1 * (classes.distinct[c] + 1))


def test_lm_scores_do_not_depend_on_how_rows_are_split(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 60, 400)) for i in range(300)]
    runs = [lm_scoring.score(table(spark, rows).repartition(n), words=6, endings=2, dim=8, group=4000).collect() for n in (1, 8, 32)]
    first, *others = ({r.doc_id: r.score for r in x} for x in runs)
    assert all(x[i] == pytest.approx(first[i], rel=1e-9) for x in others for i in first)


def test_lm_groups_hold_all_triples_and_copies_are_dealt_evenly(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(0, 40), 60)) for i in range(300)] + [(1000 + i, "a b a b c") for i in range(500)] + [(2000, None), (2001, "")]
    train = table(spark, rows).select(F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    counts = train.mapInArrow(lm_scoring._count, "h long, e int, c long").groupBy("h").agg(F.min("e").alias("e"), F.sum("c").alias("c"))
    classes = lm_scoring.classes_of(counts, 4, 2)
    got = lm_scoring.groups_of(train, classes, 900).collect()
    found = Counter()
    for r in got:
        code, n = np.frombuffer(r.code, "<i8"), np.frombuffer(r.n, "<i4")
        assert (np.diff(code) > 0).all()
        found.update(dict(zip(code.tolist(), n.tolist())))
    import pyarrow as pa

    w, i1, i2, _ = lm_scoring._tokens(pa.RecordBatch.from_arrays([pa.array([(t or "").encode() for _, t in rows], pa.binary())], names=["text"]), 0, classes)
    assert found == Counter(((i2 * classes.size + i1) * classes.size + w).tolist())
    sizes = [int(np.frombuffer(r.n, "<i4").sum()) for r in got]
    assert len(got) == -(-classes.total // 900) and max(sizes) < 2 * min(sizes)


def test_lm_learns_more_from_more_data(spark):
    rng = np.random.default_rng(1)
    follow = rng.integers(0, 60, (60, 60, 2))

    def text():
        own = [int(x) for x in rng.integers(0, 60, 2)]
        for _ in range(80):
            own.append(int(follow[own[-2], own[-1]][rng.integers(2)]))
        return " ".join(f"x{w}" for w in own)

    rows = [(i, text()) for i in range(1600)]
    held = table(spark, rows[:100])
    means = []
    for n in (50, 300, 1500):
        got = lm_scoring.score(held, table(spark, rows[100 : 100 + n]), words=30, endings=2, dim=16, group=100_000)
        means.append(got.agg(F.sum("score") / F.sum("n_tokens")).first()[0])
    assert means[0] + 0.01 < means[1] < means[2] - 0.01


def test_lm_without_training_rows(spark, docs):
    got = lm_scoring.score(docs, docs.limit(0), dim=4).collect()
    assert {r.n_known for r in got} == {0} and {r.base_score for r in got} == {0.0}
    assert lm_scoring.score(docs.limit(0)).count() == 0


def test_url_verdicts(spark):
    rules = [url_filters.Rule("allow", "ok.example", "/"), url_filters.Rule("block", "example", "/bad/"), url_filters.Rule("block", "ok.example", "/x/")]
    urls = ["http://A.ok.EXAMPLE/x/1", "https://ok.example/bad/", "http://n.example/bad/q?x#y", "http://notexample/bad/", None, "no scheme", "http://www.spam.test/p.html?b=2&a=1&utm_x=3#f", "http://spam.test:80/p?a=1&b=2", "http://spam.test/other", "://", "a://h"]
    listed = ["http://spam.test/p/?a=1&b=2"] + [f"http://filler{i}.test/{i}" for i in range(3000)]
    pages = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls)] + [(0, urls[0], "k")], "page_id long, url string, key string")
    got = url_filters.judge(pages, rules, spark.createDataFrame([(u,) for u in listed], "url string")).collect()
    assert len(got) == len(urls) + 1
    by = {r.page_id: r for r in got}
    assert [by[i].verdict for i in range(len(urls))] == ["block", "block", "block", "allow", "allow", "allow", "block", "block", "allow", "allow", "allow"]
    assert (by[0].host, by[0].path, by[0].rule) == ("a.ok.example", "/x/1", "ok.example/x/") and by[4].host == "" and by[10].host == "h"
    assert all(r.possible_hit for r in got if r.listed)
    assert url_filters.judge(pages.limit(0), rules, spark.createDataFrame([], "url string")).count() == 0


def test_sentencepiece_equals_the_library(spark, docs):
    import sentencepiece

    model = sentencepieces.read_model(model_path())
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    odd = [(100, " lead"), (101, "trail "), (102, "two  blanks   three"), (103, "▁mark ▁"), (104, "\n\t日本語 🙂 <s> <0x41>"), (105, " ")]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    encoded = sentencepieces.encode(rows, model)
    own = {r.doc_id: r.text or "" for r in rows.collect()}
    for r in encoded.collect():
        assert list(r.ids) == library.encode(own[r.doc_id]), own[r.doc_id][:40]
        assert r.parity
        assert r.round_trip == ("▁" not in own[r.doc_id])
    back = {r.doc_id: r.text for r in sentencepieces.decode(encoded, model).collect()}
    assert back == {i: t.replace("▁", " ") for i, t in own.items()}
    assert sentencepieces.encode(rows.limit(0), model).count() == 0


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(text):
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    out = []
    for k, (kind, pattern) in enumerate(kinds):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def test_pii_base_spans(spark, docs):
    odd = [
        "a@b.c", "x..y%+@dom-ain.co.uk, z@w", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1 and 001.002.003.255", "99999999999999.1.1.1", "4111 1111-1111 1111", "41111111111111112", "card 4111111111111111 5500005555555559",
        "+1 (234) 567-8901 x", "+12", "+1234567890123456", "+49 30 1234567 8901", "é@ö.de ü+1 234 567 8900", "1 2 3 4 5 6 7 8 9 0 1 2 3 4", "..@..", "a@-.-", "🙂 a@b.cc 🙂 1.1.1.1", "@" * 500 + "a@b.c", "1." * 300, "+" + "(" * 300 + "1",
    ]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(200 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    got = {r.doc_id: r for r in pii.report(rows).collect()}
    for r in rows.collect():
        want = brute_spans(r.text or "")
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(text.encode()).hexdigest(), (r.text, got[r.doc_id].spans)
        assert [got[r.doc_id][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x[3] == k for x in want) for k in ("email", "ip", "card", "phone")]
    assert pii.report(rows.limit(0)).count() == 0


def test_pii_terms_equal_brute_force_and_go(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        rows.append((i, f"{prose(rng, 25)} Ms Zorblatt wrote from ann@home.org on day {i} {prose(rng, 20)}" if i % 5 == 0 else prose(rng, 60)))
    df = table(spark, rows)
    got = {r.doc_id: r.spans for r in pii.report(df).collect()}

    pair, contexts, entity, term, where = Counter(), defaultdict(set), Counter(), Counter(), []
    for i, t in rows:
        term.update(re.findall(pii.TERM, t.lower()))
        spans = brute_spans(t)
        for a, k, b, _ in spans:
            lo, hi = max(0, a - pii.WINDOW_CHARS), b + pii.WINDOW_CHARS
            name = (k, t[a:b].lower())
            for m in re.finditer(pii.TERM, t[lo:a]):
                if (a - lo < pii.WINDOW_CHARS or m.start() > 0) and not any(x < lo + m.end() and lo + m.start() < y for x, _, y, _ in spans):
                    where.append((i, name, m[0].lower(), lo + m.start(), lo + m.end(), t[lo:a] + "|" + t[b:hi]))
            for m in re.finditer(pii.TERM, t[b:hi]):
                if m.end() < pii.WINDOW_CHARS and not any(x < b + m.end() and b + m.start() < y for x, _, y, _ in spans):
                    where.append((i, name, m[0].lower(), b + m.start(), b + m.end(), t[lo:a] + "|" + t[b:hi]))
    for _, e, w, _, _, c in where:
        pair[e, w] += 1
        contexts[e, w].add(c)
        entity[e] += 1
    n = sum(term.values())
    share = {p: math.log2(c * n / (term[p[1]] * entity[p[0]])) / math.log2(n / entity[p[0]]) for p, c in pair.items() if len(contexts[p]) >= pii.CONTEXTS}
    want = defaultdict(set)
    for i, e, w, a, b, _ in where:
        if share.get((e, w), 0) >= pii.GENERALISE:
            want[i].add((a, 9, b, "term"))
    for i, t in rows:
        every = sorted([*brute_spans(t), *want[i]])
        assert got[i] == ",".join(f"{k}:{a}:{b}" for a, _, b, k in every)
    assert any(want.values())
    clean = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert set(clean[0].asDict()) == {"doc_id", "text", *CLASH} and clean[0].words == "w"
    assert all("ann@home.org" not in r.text and "Zorblatt" not in r.text for r in clean.values())
    assert clean[1].text == rows[1][1]


def test_media(spark, docs):
    got = collected(media_chunks.stored(docs))
    want = []
    for r in docs.select("doc_id", "text").collect():
        data = (r.text or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        file = media_chunks.wave(payload)
        want.append((r.doc_id, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(file), hashlib.sha256(file).hexdigest(), media_chunks.feature(payload)))
    assert got == sorted(want, key=repr)
    store, manifest = media_chunks.chunk_store(docs), media_chunks.manifest(media_chunks.files(docs))
    digests = [bytes(r.digest) for r in store.collect()]
    assert len(digests) == len(set(digests)) < manifest.count() + 2
    assert media_chunks.stored(docs.limit(0)).count() == 0
    broken = store.withColumn("bytes", F.lit(__import__("zstandard").compress(b"else")))
    with pytest.raises(Exception, match="digest"):
        media_chunks.read_back(manifest, broken).collect()


def test_chunks_meet_again_after_an_insertion():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 400_000, dtype=np.uint8).tobytes()
    a, b = (set(media_chunks._chunks(x)) for x in (data, data[:1000] + b"inserted" + data[1000:]))
    assert len(a & b) >= len(a) - 2 and b"".join(media_chunks._chunks(data)) == data


@pytest.mark.parametrize("window", [35, 5])
def test_substring_dedup(spark, docs, window):
    rows = [(r.doc_id, words(r.text, lower=False)) for r in docs.select("doc_id", "text").collect()]
    count = Counter(tuple(w[i : i + window]) for _, w in rows for i in range(len(w) - window + 1))
    want = []
    for i, w in rows:
        gone = {j for k in range(len(w) - window + 1) if count[tuple(w[k : k + window])] > 1 for j in range(k, k + window)}
        want.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    assert collected(substring_dedup.dedup(docs, window, bucket_bytes=4000, part_bytes=9000)) == sorted(want, key=repr)
    assert substring_dedup.dedup(docs.limit(0)).count() == 0


def test_decontamination(spark, docs):
    source = texts()
    items = [(0, " ".join(source[7].split()[4000:4040])), (1, " ".join(source[8].split()[10:80])), (2, prose(random.Random(9), 40, 10_000)), (3, "one"), (4, "two WORDS"), (5, None), (6, ""), (7, " ".join(source[7].split()[100:130] + source[7].split()[8000:8030])), (1, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(r.doc_id, words(r.text)) for r in docs.select("doc_id", "text").collect()]
    want = []
    for i, w in rows:
        for j, t in items:
            q = words(t)
            n = min(5, len(q))
            own = {tuple(q[k : k + n]) for k in range(len(q) - n + 1)} if q else set()
            shared = own & {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
            if own and 100 * len(shared) >= 80 * len(own):
                want.append((i, j, len(own), len(shared)))
    assert len(want) > 5
    assert collected(decontaminate.matches(docs, bench)) == sorted(want, key=repr)
    assert collected(decontaminate.matches(docs, bench, piece_bytes=200)) == sorted(want, key=repr)
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in rows if i not in {x[0] for x in want})
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0 and decontaminate.matches(docs.limit(0), bench).count() == 0


def test_license_scan(spark, docs):
    odd = ["Released under the MIT License. Under the  mit-license!", "licensed under CC BY-NC 4.0", "Apache License, Version 2.0", "under the \u212ait license", "nothing here", "This work is licensed under the GNU General Public License, version 3.", "gnu general public license version"]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(300 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    got = {r.doc_id: r for r in license_scan.scan(rows).collect()}
    for r in rows.collect():
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").translate(LOWER))
        places = [(k, label) for p, label in license_scan.PHRASES.items() for k in range(len(own)) if own[k : k + len(p.split())] == p.split()]
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.base_labels) == (len(own), len(places), ",".join(sorted({x for _, x in places}))), r.text
        assert (g.first_word, g.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert set(g.base_labels.split(",")) <= set(g.labels.split(",")) | {""} and 0 <= g.score <= 1
    assert got[305].labels == "gpl-3" and got[306].labels == ""
    assert license_scan.scan(rows.limit(0)).count() == 0


def components(rows, size):
    sets = []
    for _, t in rows:
        w = words(t)
        n = min(size, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = defaultdict(lambda: 10**9)
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least[find(k)], i)
    return [(i, len(sets[k]), least[find(k)], i == least[find(k)]) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, size):
    rng, rows = random.Random(6), [(i, t) for i, t in enumerate(texts())]
    for g in range(6):  # groups around a text, so that copies are near the text but not near each other
        base = prose(rng, 150, 2000).split()
        for _ in range(25):
            own = list(base)
            for _ in range(rng.randint(0, 14)):
                own[rng.randrange(len(own))] = f"z{rng.randrange(99_999)}"
            rows.append((len(rows) + 100 * g, " ".join(own)))
    rows.append(rows[5])
    df = table(spark, rows)
    got = minhash_dedup.dedup(df, size, shingles=2000).select("doc_id", "n_shingles", "component_id", "kept")
    assert collected(got) == sorted(components(rows, size), key=repr)
    kept = minhash_dedup.keep(df, size)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted({i for i, _, _, k in components(rows, size) if k})
    assert minhash_dedup.dedup(df.limit(0), size).count() == 0


def test_quality_classifier(spark):
    rng, rows, labels = random.Random(8), [], []
    for i in range(600):
        good = i % 3 > 0
        t = prose(rng, rng.randint(30, 90), 3000).capitalize() + "." if good else rng.choice(["BUY NOW!! " * rng.randint(5, 30), "### $$$ %%% " * rng.randint(5, 30), "a a a " * 30])
        rows.append((i, t))
        labels.append((i, int(good)))
    df = table(spark, [*rows, (600, None), (601, ""), (5, rows[5][1])])
    marks = spark.createDataFrame([*labels, (5, None)], "doc_id long, quality int")
    model = quality_classifier.fit(df, marks)
    got = {r.doc_id: r for r in quality_classifier.score(df, model, "doc_id").collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i].predicted == labels[i][1] for i in held]) > 0.95
    assert len(model.rules) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    kept = quality_classifier.keep(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}
    none = quality_classifier.fit(df, marks.limit(0))
    assert {r.score for r in quality_classifier.score(df, none, "doc_id").collect()} == {0.5}
    assert quality_classifier.score(df.limit(0), model, "doc_id").count() == 0
