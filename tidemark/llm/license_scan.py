"""Licence detection by a positional index over the rare words of licence templates.

Words are lower-cased runs of letters, digits and non-ASCII characters. The document frequency of each
template word over all files gives its IDF. A file's highest-IDF licence words, the rarest of each stretch of
it, are looked up in the templates' postings; every posting at template position p for a word at file
position i votes for the offset i - p. Two different rare words whose offsets lie close together make a
candidate, so a few inserted words do no harm. There the template's mandatory key phrases must stand whole
at their positions, and the IDF-weighted share of the template's words found around them must be enough.

Files without all words of some template's key phrases can't get its label and aren't looked up. Each text
is cut into words once; all else works on its licence words. Everything is built of DataFrame functions.

Defined cases: a null text counts as empty, has no words, places or labels and a score of 0. Words of equal
IDF rank by name and place. Repeated rows each get their row. An empty table gives no rows. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .license_texts import PHRASES, TEMPLATES, Template

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a stretch, and how many of its licence words, the rarest, are looked up.
STRETCH, RARE = 8, 4
#: Different rare words that must agree, words by which their offsets may differ, and share of the weight.
AGREE, SLACK, COVERAGE = 2, 8, 0.5


def words(text: Column) -> Column:
    """Lower-cased words. Only A-Z meet ASCII words: the two other letters whose lower case begins with
    an ASCII letter are put out of the way first."""
    kept = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\ue000")), F.lit("\u0130"), F.lit("\ue001"))
    return F.array_remove(F.split(F.lower(kept), SEPARATORS, -1), "")


def words_of(text: str) -> list[str]:
    """The words of a template or phrase."""
    return [w for w in re.split(SEPARATORS, text.lower()) if w]


def _places(words_: Column, phrase: str) -> Column:
    """Starts of `phrase`, from 0; looked for only where all its words occur."""
    own = phrase.split()
    has = F.lit(True)
    for w in dict.fromkeys(own):
        has = has & F.array_contains(words_, w)
    at = F.filter(F.sequence(F.lit(0), F.size(words_) - 1), lambda i: F.slice(words_, i + 1, len(own)) == F.array(*map(F.lit, own)))
    return F.when(has, at).otherwise(F.expr("cast(array() as array<int>)"))


def _files(docs: DataFrame, vocabulary: list[str], templates: list[Template], phrases: dict[str, str]) -> DataFrame:
    """(id, doc_id, n_words, at0 .., known, fits, placed) of every row: its licence words, the templates whose
    key phrases' words it has, and if there are any, the places of its licence words."""
    rows = docs.select(F.monotonically_increasing_id().alias("id"), "doc_id", words(F.col("text")).alias("words"))
    words_ = F.col("words")
    licence = F.filter(F.transform(words_, lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: x["w"].isin(*vocabulary)) if vocabulary else F.expr("cast(array() as array<struct<i:int,w:string>>)")
    # A generator makes the arrays once; the columns after it refer to them.
    made = rows.select("id", "doc_id", F.size("words").cast("long").alias("n_words"), *[_places(words_, p).alias(f"at{k}") for k, p in enumerate(phrases)], F.explode(F.array(licence)).alias("placed"))
    made = made.select("*", F.explode(F.array(F.array_distinct(F.col("placed")["w"]))).alias("known"))
    has = []
    for k, t in enumerate(templates):
        all_ = F.lit(True)
        for w in dict.fromkeys(w for key in t.keys for w in words_of(key)):
            all_ = all_ & F.array_contains("known", w)
        has.append(F.when(all_, F.lit(k)))
    fits = F.array_compact(F.array(*has)) if has else F.expr("cast(array() as array<int>)")
    made = made.select("*", F.explode(F.array(fits)).alias("fits"))
    return made.withColumn("placed", F.when(F.size("fits") > 0, F.col("placed")))


def _candidates(files: DataFrame, weight: dict[str, float], templates: list[Template], stretch: int, rare: int, agree: int, slack: int) -> DataFrame:
    """(id, template, low, high): offsets, close together, for which rare words vote."""
    spark = files.sparkSession
    idf = spark.createDataFrame([(w, v) for w, v in weight.items()], "w string, idf double")
    postings = spark.createDataFrame([(w, k, p) for k, t in enumerate(templates) for p, w in enumerate(words_of(t.text))], "w string, template int, place int")
    placed = files.where(F.size("fits") > 0).select("id", "fits", F.explode("placed").alias("x")).select("id", "fits", "x.i", "x.w").join(F.broadcast(idf), "w")
    by_stretch = placed.groupBy("id", "fits", F.floor(F.col("i") / stretch).alias("stretch")).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("idf")).alias("rank"), "w", "i"))), 1, rare).alias("top"))
    rarest = by_stretch.select("id", "fits", F.explode("top").alias("x")).select("id", "fits", "x.i", "x.w")
    votes = rarest.join(F.broadcast(postings), "w").where(F.array_contains("fits", F.col("template"))).select("id", "template", "w", (F.col("i") - F.col("place")).alias("offset"))
    # Offsets fall into bins of twice the slack that overlap by half.
    half = votes.select("*", F.explode(F.array(F.lit(0), F.lit(slack))).alias("shift"))
    binned = half.groupBy("id", "template", "shift", F.floor((F.col("offset") + F.col("shift")) / (2 * slack)).alias("bin")).agg(F.collect_set("w").alias("agreed"), F.min("offset").alias("low"), F.max("offset").alias("high"))
    return binned.where(F.size("agreed") >= agree).select("id", "template", "low", "high").distinct()


def _labels(files: DataFrame, candidates: DataFrame, weight: dict[str, float], templates: list[Template], slack: int, coverage: float) -> DataFrame:
    """(id, more, part): labels of the candidates that hold all key phrases and enough of the template."""
    about = []
    for k, t in enumerate(templates):
        own = words_of(t.text)
        keys = [words_of(key) for key in t.keys]
        at = [next(i for i in range(len(own)) if own[i : i + len(key)] == key) for key in keys]
        about.append((k, t.label, len(own), {w: weight[w] for w in own}, list(zip(at, keys, strict=True))))
    about = files.sparkSession.createDataFrame(about, "template int, label string, size int, weights map<string,double>, keys array<struct<at:int,words:array<string>>>")
    rows = candidates.join(files.select("id", "placed"), "id").join(F.broadcast(about), "template")
    near = F.filter("placed", lambda x: (x["i"] >= F.col("low") - slack) & (x["i"] < F.col("high") + F.col("size") + slack))
    rows = rows.select("id", "label", "low", "high", "weights", "keys", F.explode(F.array(near)).alias("near"))
    rows = rows.withColumn("word_at", F.map_from_entries("near"))

    def stands(key: Column) -> Column:
        first = lambda x: (x["w"] == key["words"][0]) & (x["i"] >= F.col("low") + key["at"] - slack) & (x["i"] <= F.col("high") + key["at"] + slack)
        whole = lambda x: F.forall(F.sequence(F.lit(0), F.size(key["words"]) - 1), lambda k: F.element_at("word_at", x["i"] + k).eqNullSafe(F.get(key["words"], k)))
        return F.exists("near", lambda x: first(x) & whole(x))

    own = F.array_intersect(F.col("near")["w"], F.map_keys("weights"))
    total = lambda ws: F.aggregate(F.array_sort(ws), F.lit(0.0), lambda acc, w: acc + F.element_at("weights", w))
    part = total(own) / F.greatest(total(F.map_keys("weights")), F.lit(1e-12))
    found = rows.where(F.forall("keys", stands)).select("id", "label", F.least(part, F.lit(1.0)).alias("part"))
    return found.where(F.col("part") >= coverage).groupBy("id").agg(F.array_sort(F.collect_set("label")).alias("more"), F.max("part").alias("part"))


def scan(
    docs: DataFrame,
    templates: list[Template] | None = None,
    phrases: dict[str, str] | None = None,
    stretch: int = STRETCH,
    rare: int = RARE,
    agree: int = AGREE,
    slack: int = SLACK,
    coverage: float = COVERAGE,
) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every file.

    rare: highest-IDF licence words that are looked up of each stretch of `stretch` words; agree: different
    words that a candidate needs, at offsets that differ by `slack` about; coverage: IDF-weighted share of the
    template's words to be found around it. docs: (doc_id, text).
    """
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    vocabulary = sorted({w for t in templates for w in words_of(t.text)})
    files = materialize(_files(docs.select("doc_id", "text"), vocabulary, templates, phrases), "licence-files")
    # At most as many counts as the templates have words.
    counts = {r.w: r.n for r in files.select(F.explode("known").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    total = files.count()
    weight = {w: math.log((total + 1) / (counts.get(w, 0) + 0.5)) for w in vocabulary}
    found = _labels(files, _candidates(files, weight, templates, stretch, rare, agree, slack), weight, templates, slack, coverage)

    every = F.flatten(F.array(*[F.col(f"at{k}") for k in range(len(phrases))])) if phrases else F.expr("cast(array() as array<int>)")
    labels = F.array_compact(F.array(*[F.when(F.size(f"at{k}") > 0, F.lit(label)) for k, label in enumerate(phrases.values())]))
    none = F.expr("cast(array() as array<string>)")
    base = files.select("id", "doc_id", "n_words", every.alias("at"), (F.array_sort(F.array_distinct(labels)) if phrases else none).alias("base"))
    return base.join(found, "id", "left").select(
        "doc_id",
        "n_words",
        F.size("at").cast("long").alias("n_base"),
        F.array_min("at").cast("long").alias("first_word"),
        F.array_max("at").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.greatest(F.when(F.size("base") > 0, F.lit(1.0)).otherwise(0.0), F.coalesce("part", F.lit(0.0))).alias("score"),
    )
