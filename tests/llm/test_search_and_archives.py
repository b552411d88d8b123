"""Hard negatives, fill-in-middle and archives against brute force, with nulls, empty and long texts, ties, repeated
rows, empty tables and columns of clashing names."""

import gzip
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import fill_in_middle, hard_negatives, warc
from tidemark.session import shared_path

CLASH = {"key": 1, "cell": "c", "block": 2, "n": 5, "same": None, "top": 7, "parts": "p", "id": 9, "anchor": "a", "vec": 3}


def clashing(df):
    return df.select("*", *[F.lit(v).cast("int" if isinstance(v, int) else "string").alias(k) for k, v in CLASH.items()])


def shown(df):
    return sorted((repr(tuple(r)) for r in df.collect()))


# Fill-in-middle.


def brute_middle(doc_id, text):
    t = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    n = len(units)
    x = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "plain" if not t or re.search("<[PSM]>", t) else "spm" if h[3] % 100 < 50 else "psm"
    out = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    sizes = (None, None) if form == "plain" else (len(p), len(m))
    return (doc_id, n, form, *sizes, *(hashlib.sha256(z.encode()).hexdigest() for z in (out, t)))


def middle_texts():
    rng = random.Random(0)
    rows = [(0, None), (1, ""), (2, "\n"), (3, "a"), (4, "a\n"), (5, "\n\n\n"), (6, "x<P>y"), (7, "<M"), (8, "<<S>"), (None, "a\nb\nc"), (9, "é\nü\n漢字\n" * 30)]
    for i in range(10, 150):
        letters = ["a", "\n", "é", "<", "P", ">", "S", "漢", " b"] if i % 2 else ["a", "\n", "é", "漢", " b\n", "<"]
        rows.append((i, "".join(rng.choice(letters) for _ in range(rng.randint(1, 120)))))
    rows += [rows[50], rows[50], rows[9], (500, "x" * 1000), (501, "x" * 1000 + "\n"), (502, "x" * 50 + "\n" * 50), (503, "long line\n" * 40_000)]
    return rows


@pytest.mark.parametrize(("chunk", "group"), [(1 << 16, 256), (7, 3), (1 << 16, 2)])
def test_fill_in_middle(spark, chunk, group):
    rows = middle_texts() if chunk > 7 else [r for r in middle_texts() if len(r[1] or "") < 2000]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert shown(fill_in_middle.transform(df, digests=True, chunk=chunk, group=group)) == sorted(repr(brute_middle(*r)) for r in rows)


def test_fill_in_middle_of_nothing_and_at_other_rates(spark):
    df = spark.createDataFrame(middle_texts(), "doc_id long, text string")
    assert fill_in_middle.transform(df.limit(0)).count() == 0
    assert {r.form for r in fill_in_middle.transform(df, rate=0).collect()} == {"plain"}
    assert {r.form for r in fill_in_middle.transform(df, spm=0).collect()} == {"plain", "psm"}
    texts = {r.doc_id: r for r in fill_in_middle.transform(df.where("doc_id between 10 and 60")).collect()}
    assert all(bytes(texts[i].restored).decode() == t for i, t in middle_texts() if i in texts)


def test_transitions_compose():
    rng = np.random.default_rng(1)
    for _ in range(200):
        data = rng.choice(np.frombuffer("ab\n<PS>é".encode(), np.uint8), rng.integers(0, 60))
        cut = int(rng.integers(0, len(data) + 1))
        (f, c), (g, d), (h, e) = (fill_in_middle.transition(x) for x in (data[:cut], data[cut:], data))
        assert (g[f] == h).all() and (c + d[f] == e).all()
        for s in range(fill_in_middle.STATES):  # byte by byte
            at, lines = s, 0
            for b in data:
                at, k = fill_in_middle._step(at, int(fill_in_middle._CLASS[b]))
                lines += k
            assert (at, lines) == (h[s], e[s])


# Archives.


def page_rows():
    rng = random.Random(0)
    big = lambda s: (s * 2000)[:1500]
    rows = [(1, "http://a/x", None), (2, None, ""), (3, "http://a/b\r\nWARC: x", big("q\r\n\r\nWARC/1.0")), (4, "u", big("é")), (5, "u", big("é")), (6, "http://h?x", big("é")), (7, "u", "x" * 999), (8, "u", "x" * 999)]
    rows += [(9, "u", "y" * 1000), (10, "u", "y" * 1000), (None, "u", "y" * 1000), (None, "n", "z" * 1000), (11, "d", "w" * 1200), (11, "d", "w" * 1200), (12, "d", "v" * 1200), (12, "e", "v" * 1200)]
    rows += [(i, f"http://h{i}.org/p", rng.choice([big("A"), big("B"), "s" * i, big(str(i))])) for i in range(20, 120)]
    return [*rows, (500, "http://big", "漢<\n" * 300_000)]


def test_archives(spark):
    rows = page_rows()
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        b, t = (h or "").encode(), top[h or ""]
        again = len(b) >= 1000 and i != (None if t < 0 else t)
        want.append(repr((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", t if again else None)))
    df = clashing(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4))
    assert shown(warc.archived(df)) == sorted(want)
    assert warc.archived(df.limit(0)).count() == 0


def test_a_capture_is_one_nested_row_with_its_payload(spark):
    path = shared_path(spark, "test-warc")
    warc.write(spark.createDataFrame([(1, "http://a.org/x?y=1", "é" * 600), (2, "http://b.org", "é" * 600)], "page_id long, url string, html string"), path)
    got = {r.metadata.fields["page_id"]: r for r in warc.captures(warc.records(spark, path)).collect()}
    assert [(got[k].type, got[k].n_requests, got[k].n_metadata) for k in "12"] == [("revisit", 1, 1), ("response", 1, 1)]
    assert bytes(got["2"].payload).decode() == "é" * 600 and bytes(got["1"].payload) == b"" and got["1"].refers_to == got["2"].capture_id
    assert got["1"].uri == "http://a.org/x?y=1" and bytes(got["1"].request.payload) == b""


def record(kind, name, to=(), block=b"", extra=""):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {name}\r\n" + "".join(f"WARC-Concurrent-To: {x}\r\n" for x in to) + extra
    return head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def test_concurrent_records_in_either_direction_and_over_steps(spark, tmp_path):
    http = "Content-Type: application/http\r\n"
    data = [record("warcinfo", "<i>"), record("request", "<q1>"), record("response", "<r1>", ["<q1>"], b"HTTP/1.1 200 OK\r\n\r\nbody", http), record("metadata", "<m1>", ["<q1>"])]
    data += [record("response", "<r2>"), record("request", "<q2>", ["<r2>"]), record("metadata", "<m3>", ["<m2>"]), record("metadata", "<m2>", ["<r2>"]), record("metadata", "<lost>", ["<nowhere>"])]
    (tmp_path / "a.warc").write_bytes(b"".join(data[:4]))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in data[4:]))
    got = {r.capture_id: r for r in warc.captures(warc.records(spark, str(tmp_path))).collect()}
    assert set(got) == {"<r1>", "<r2>"} and bytes(got["<r1>"].payload) == b"body"
    assert (got["<r1>"].request.record_id, got["<r1>"].metadata.record_id) == ("<q1>", "<m1>")
    assert (got["<r2>"].request.record_id, got["<r2>"].metadata.record_id, got["<r2>"].n_metadata) == ("<q2>", "<m2>", 2)


def test_broken_archives_raise():
    whole = record("response", "<r>", block=b"HTTP/1.1 200 OK\r\n\r\nbody", extra="Content-Type: application/http\r\nWARC-Payload-Digest: sha1:" + hashlib.sha1(b"body").hexdigest() + "\r\n")
    assert [r["payload"] for r in warc.parse(gzip.compress(whole) + gzip.compress(whole))] == [b"body"] * 2
    for broken, why in ((whole[:-8], "ends inside"), (whole.replace(b"body", b"bodi"), "digest"), (b"HTTP/1.1 x\r\n\r\n", "version"), (whole[:30], "headers"), (whole.replace(b"body", b"body!!!!"), "longer")):
        with pytest.raises(ValueError, match=why):
            list(warc.parse(broken))


# Hard negatives.


def brute_negatives(rows, positives=5, negatives=3):
    kept = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        q = [int(np.floor(256 * float(np.float32(x)))) for x in v]
        own = (label, np.array(q, "<f8").tobytes(), q)
        kept[i] = min(kept.get(i, own), own)
    dim, ids = max((len(x[2]) for x in kept.values()), default=0), np.array(sorted(kept))
    x = np.array([kept[i][2] + [0] * (dim - len(kept[i][2])) for i in ids], object).reshape(len(ids), dim)
    labels, out = np.array([kept[i][0] for i in ids]), []
    for k, i in enumerate(ids):
        if i % 50:
            continue
        s = x @ x[k]
        for ps, pid in sorted((-s[j], ids[j]) for j in range(len(ids)) if labels[j] == labels[k] and j != k)[:positives]:
            near = sorted((-s[j], ids[j]) for j in range(len(ids)) if labels[j] != labels[k] and -50 * ps <= 100 * s[j] <= -95 * ps)[:negatives]
            out += [(int(i), int(pid), r + 1, int(nid), int(-ps), int(-ns)) for r, (ns, nid) in enumerate(near)]
    return sorted(out)


def vectors(n, dim, clusters, seed=0, spread=0.3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) / np.sqrt(dim)
    if clusters:
        c = rng.normal(size=(clusters, dim))
        x = (c / np.linalg.norm(c, axis=1)[:, None])[rng.integers(0, clusters, n)] + spread * x
    return [(i, int(rng.integers(4)), [float(np.float32(v)) for v in x[i]]) for i in range(n)]


def negative_cases():
    clustered = vectors(400, 8, 12)
    odd = [(None, 1, [1.0] * 6), (300, None, [1.0] * 6), (350, 1, None), (400, 2, [float("nan")] * 6), (401, 2, [float("inf")] * 6), (402, 1, [None, 1.0]), (450, 1, [0.5, 0.5]), (451, 1, []), (500, 0, [0.0] * 6), (100, 3, [0.1] * 6), (100, 3, [0.2] * 6)]
    return {
        "no structure": vectors(900, 16, 0),
        "clusters": vectors(900, 16, 12),
        "a third are copies of one": clustered + [(1000 + i, i % 3, clustered[0][2]) for i in range(300)],
        "odd rows": vectors(200, 6, 12) + odd,
        "large numbers": [(i, i % 2, [1e5 * (i + 1), 2e5]) for i in range(60)],
    }


@pytest.mark.parametrize("case", list(negative_cases()))
def test_hard_negatives(spark, case):
    rows = negative_cases()[case]
    df = clashing(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3))
    want = brute_negatives(rows)
    assert want and sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 50 == 0, block=64, leaf=8).collect()) == want


def test_hard_negatives_of_nothing(spark):
    df = spark.createDataFrame(vectors(60, 4, 3), "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert hard_negatives.mine(df, F.lit(False)).count() == 0


def test_intervals_hold_and_rule_out_groups():
    space = hard_negatives.Space(16, "<i2", "f4")
    x = np.floor(256 * np.array([v for _, _, v in vectors(4000, 16, 12, spread=0.1)]))
    names = hard_negatives._NAMES
    a, b = (hard_negatives.Block(dict(zip(names, hard_negatives.packed(0, 0, np.arange(len(y)), np.zeros(len(y)), y, np.zeros((len(y), 2)), space, 32), strict=True)), space) for y in (x[:400], x))
    for p, (s, t) in enumerate(a.nodes):
        for q, (u, v) in enumerate(b.nodes[:40]):
            own = space.scores(a.vecs[s:t], b.vecs[u:v])
            i, j = np.array([p]), np.array([q])
            lo, hi = hard_negatives.intervals(a.centres[i], a.radii[i], b.centres[j], b.radii[j], a.cones[i], b.cones[j])
            assert lo[0] <= own.min() and own.max() <= hi[0]
    every = np.where(a.ids[:, None] == b.ids[None, :], np.iinfo(np.int64).min, space.scores(a.vecs, b.vecs))
    best = np.sort(every, axis=1)[:, :-6:-1]
    wanted = hard_negatives.Wanted(best[:, 4:].copy(), np.full((400, 1), 2**62), 5)
    made = hard_negatives.search(a, b, space, wanted, True)
    assert made < 0.2 * 400 * 4000 and (wanted.score[:, 0] == best).all()
