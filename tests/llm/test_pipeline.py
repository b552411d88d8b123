"""The pipeline's stages, one after another, each held against what it must do to its own input."""

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from tidemark.llm import quality_classifier, sentencepieces
from tidemark.llm.queries import model_path, oracle_sql, queries
from tidemark.session import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = table(spark, SF, "documents"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs, after))
        docs = after
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_keep_the_columns(spark, stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "near duplicates", "benchmark decontamination", "personal data", "encoding"]
    for before, after in stages[:-1]:
        assert after.columns == before.columns and after.schema == before.schema


def test_filters_take_effect(spark, stages):
    before, after = stages[0]
    model = quality_classifier.fit(before, table(spark, SF, "labels"))
    want = {r.doc_id for r in quality_classifier.score(before, model, "doc_id").collect() if r.predicted}
    assert set(rows(after)) == want and len(want) < before.count()
    con = duckdb.connect()
    for k, (before, after) in ((1, stages[1]), (2, stages[2])):
        con.register("documents", before.toPandas())
        con.register("benchmark", table(spark, SF, "benchmark").toPandas())
        if k == 1:
            sql = oracle_sql()["op9_minhash_dedup"].replace("len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]", "len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]").replace("range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]", "range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')")
            want = {r[0] for r in con.execute(sql).fetchall() if r[3]}
        else:
            want = set(rows(before)) - {r[0] for r in con.execute(oracle_sql()["op7_decontamination"]).fetchall()}
        assert set(rows(after)) == want
        assert all(rows(before)[i] == r for i, r in rows(after).items())


def test_texts_are_sanitised_and_encoded(spark, stages):
    before, after = stages[3]
    a, b = rows(before), rows(after)
    assert set(a) == set(b) and any(a[i].text != b[i].text for i in a)
    assert all("[EMAIL]" in b[i].text for i in a if " @" not in a[i].text and "@example." in a[i].text)
    docs, encoded = stages[4]
    texts = {r.doc_id: r.text for r in sentencepieces.decode(encoded, sentencepieces.read_model(model_path())).collect()}
    assert texts == {r.doc_id: r.text or "" for r in docs.collect()}
    assert all(r.parity and r.round_trip for r in encoded.collect())


def test_run_gives_the_last_stage(spark, stages):
    assert {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, SF).collect()} == {i: list(r.ids) for i, r in rows(stages[-1][1]).items()}
    assert "pipeline" in __spark_entry__.queries()


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_gives_what_its_sql_gives(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(oracle_sql()[name])
    names, want = [d[0] for d in found.description], found.fetchall()
    got = queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    shown = lambda rows, cols: sorted(tuple("-" if r[k] is None else str(r[k]) for _, k in sorted((c, k) for k, c in enumerate(cols))) for r in rows)
    assert shown(got.collect(), got.columns) == shown(want, names)
