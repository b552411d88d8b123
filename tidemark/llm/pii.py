"""Personal data: patterns for protected entities, and terms whose co-occurrence gives them away.

Patterns find e-mail and IP addresses, card and phone numbers with code-point offsets. Every value found
is a protected entity. Over the whole corpus the operator counts, for each entity and each term within a
window of characters around it, how often they stand together, and for each such term how often it occurs at
all. A term discloses an entity by PMI(term; entity) / IC(entity), the share of the entity's information
content that seeing the term gives away; a term beside several places of an entity counts at each, so the
share is taken as 1 at most. A term at or above one threshold for some entity is generalised to its class
(number, code, name, word), at or above a higher one removed, at all its places in all texts, whether they
name the entity or not. A pair counts only if it was seen in several different contexts, so copies of one
passage are no evidence. Everything is built of DataFrame functions.

Texts are cut once into the pieces between their spans; windows, terms and sanitised texts are made of these
pieces, so the work grows with the length of a text and the number of its spans, not with their product.

Defined cases: a null text counts as empty and has no spans. Repeated rows each get their row. An empty
table gives no rows. Other columns are ignored, whatever their names. A longest match that fails its test
(range, digits, Luhn) is dropped and not searched again. A window is the nearest `WINDOW_CHARS` characters on either
side that lie outside spans, over however many spans; each span between counts as one character, at which terms end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import blocks_for, with_possible
from .common import materialize, once, row_key

# Letters of either case, digits and all beyond ASCII make terms.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Kind, quick test, pattern. Possessive repeats and the look-behinds only keep a run of
# characters from being tried again from each of its places; what matches stays the same.
KINDS = [
    ("email", "@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"[0-9](?:[\x20-]?[0-9]){13}", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
]
# What stands in place of a span, and of a term by its class.
TAGS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
CLASSES = [("[NUMBER]", r"^[0-9]+\z"), ("[CODE]", r"[0-9]"), ("[NAME]", r"^\p{Lu}"), ("[WORD]", "")]

#: Characters outside spans on each side of an entity whose words count as its window.
WINDOW_CHARS = 120
#: Share of an entity's information content at which a term is generalised, and removed.
GENERALISE, REMOVE = 0.75, 0.9
#: Different contexts in which a term must stand beside an entity before it counts as evidence.
CONTEXTS = 3

#: Elements that are folded in one go, as the time of one fold grows with the square of what it gathers, and
#: characters of the blocks that pieces are cut from, as cutting counts characters from a string's start.
CHUNK, BLOCK_CHARS = 256, 16384

_SPAN = "struct<start:int,kind:int,end:int,value:string>"
_PIECE = "struct<kind:int,value:string,from:int,to:int,free:boolean>"


def _let(value: Column, body) -> Column:
    """body(value), where the value is made once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _folded(items: Column, step, element: str, first: Column | None = None) -> Column:
    """What a fold over `items` gives: step(at, item) is a struct of the next `at`, an int, and of `one`, an
    element or null."""
    none, many = F.expr(f"cast(array() as array<{element}>)"), F.expr(f"cast(array() as array<array<{element}>>)")

    def inner(acc: Column, x: Column) -> Column:
        got = step(acc["at"], x)
        return F.struct(got["at"].alias("at"), F.when(got["one"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(got["one"]))).alias("out"))

    def whole(items_: Column) -> Column:
        def outer(acc: Column, k: Column) -> Column:
            chunk = F.aggregate(F.slice(items_, k * CHUNK + 1, F.lit(CHUNK)), F.struct(acc["at"].alias("at"), none.alias("out")), inner)
            return _let(chunk, lambda c: F.struct(c["at"].alias("at"), F.concat(acc["out"], F.array(c["out"])).alias("out")))

        start = F.struct((F.lit(0) if first is None else first).cast("int").alias("at"), many.alias("out"))
        last = F.floor((F.size(items_) - 1) / CHUNK).cast("int")
        return F.flatten(F.aggregate(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), start, outer, lambda acc: acc["out"]))

    return _let(items, whole)


def _located(text: Column, pattern: str | Column, kind: int, at: Column | None = None) -> Column:
    """Spans of a pattern's matches, with offsets in code points from `at`."""

    def step(at_: Column, x: Column) -> Column:
        begin = at_ + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["match"]), F.lit(0))
        one = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["match"].alias("value"))
        return F.struct(end.alias("at"), F.when(x["match"].isNotNull(), one).alias("one"))

    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    matches, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    return _folded(F.zip_with(gaps, matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match"))), step, _SPAN, at)


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(value, r"\.", -1), lambda p: F.regexp_replace(p, r"^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: F.coalesce((F.length(p) <= 3) & (p.try_cast("int") <= 255), F.lit(False)))
    digits = F.regexp_replace(value, "[^0-9]+", "")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _test(kind: str):
    return lambda span: _holds(kind, span["value"])


def _of_kind(k: int):
    return lambda span: span["kind"] == k


def base_spans(text: Column) -> Column:
    """All base spans of a text that isn't null, by start and then kind."""
    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    found = []
    for k, (kind, test, pattern) in enumerate(KINDS):
        quick = F.contains(text, F.lit(test)) if test == "@" else text.rlike(test)
        found.append(F.when(quick, F.filter(_located(text, pattern, k), _test(kind))).otherwise(none))
    return F.array_sort(F.flatten(F.array(*found)))


def with_pieces(rows: DataFrame, keep: list[str]) -> DataFrame:
    """(kept columns, spans, pieces) of rows: (kept columns, text, spans). A piece is the text between a span
    and all before it, as (kind, value, from, free, piece) with the kind and value of the span that follows it;
    the last one has kind -1. A span that begins before another has ended isn't free."""

    def step(at: Column, s: Column) -> Column:
        one = F.struct(s["kind"].alias("kind"), s["value"].alias("value"), at.alias("from"), F.greatest(at, s["start"]).alias("to"), (s["start"] >= at).alias("free"))
        return F.struct(F.greatest(at, s["end"]).alias("at"), one.alias("one"))

    text, n = F.col("text"), F.col("n")
    rows = once(rows, [*keep, "text", "spans"], n=F.length(text))
    last = F.struct(F.lit(-1).alias("kind"), F.lit("").alias("value"), F.coalesce(F.array_max(F.col("spans")["end"]), F.lit(0)).alias("from"), n.alias("to"), F.lit(False).alias("free"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor(n / BLOCK_CHARS).cast("int")), lambda k: F.substring(text, k * BLOCK_CHARS + 1, F.lit(BLOCK_CHARS)))
    rows = once(rows, [*keep, "spans"], cut=F.concat(_folded(F.col("spans"), step, _PIECE), F.array(last)), blocks=blocks)

    def piece(c: Column) -> Column:
        a, b = (F.floor(c[x] / BLOCK_CHARS).cast("int") for x in ("from", "to"))
        begin = lambda k: F.greatest(c["from"] - k * BLOCK_CHARS, F.lit(0))
        own = F.transform(F.sequence(a, b), lambda k: F.substring(F.get("blocks", k), begin(k) + 1, c["to"] - k * BLOCK_CHARS - begin(k)))
        return F.struct(c["kind"].alias("kind"), c["value"].alias("value"), c["from"].alias("from"), c["free"].alias("free"), F.array_join(own, "").alias("piece"))

    return once(rows, [*keep, "spans"], pieces=F.transform("cut", piece))


def _windows(rows: DataFrame) -> DataFrame:
    """(entity, term, context) of each term beside each entity. rows: (spans, pieces)."""
    head = F.transform("pieces", lambda p: F.substring(p["piece"], F.lit(1), F.lit(WINDOW_CHARS)))
    tail = F.transform("pieces", lambda p: F.substring(p["piece"], F.greatest(F.length(p["piece"]) - WINDOW_CHARS, F.lit(0)) + 1, F.lit(WINDOW_CHARS)))
    rows = once(rows.where(F.size("spans") > 0), ["pieces"], heads=head, tails=tail)
    reach = WINDOW_CHARS + 1  # each piece comes with a character of its own, so further ones are out of the window

    def sides(p: Column, i: Column) -> Column:
        left = F.array_join(F.slice("tails", F.greatest(i + 2 - reach, F.lit(1)), F.least(i + 1, F.lit(reach))), "\n")
        right = F.array_join(F.slice("heads", i + 2, F.lit(reach)), "\n")
        left = F.substring(left, F.greatest(F.length(left) - WINDOW_CHARS, F.lit(0)) + 1, F.lit(WINDOW_CHARS))
        return F.struct(p["kind"].alias("kind"), p["value"].alias("value"), left.alias("left"), F.substring(right, F.lit(1), F.lit(WINDOW_CHARS)).alias("right"))

    one = rows.select(F.explode(F.filter(F.transform("pieces", sides), lambda e: e["kind"] >= 0)).alias("e")).select("e.*")
    # a word that the window's outer edge may have cut is dropped
    cut = lambda c, at: F.when(F.length(c) < WINDOW_CHARS, F.col(c)).otherwise(F.regexp_replace(c, at, ""))
    both = F.concat(cut("left", f"^{TERM}"), F.lit("\n"), cut("right", rf"{TERM}\z"))
    entity = F.sha2(F.concat(F.col("kind").cast("string"), F.lit(":"), F.lower("value")), 256)
    terms = one.select(entity.alias("entity"), F.xxhash64("left", "right").alias("context"), F.explode(F.regexp_extract_all(F.lower(both), F.lit(TERM), F.lit(0))).alias("term"))
    return terms.select("entity", "term", "context")


def disclosures(docs: DataFrame, windows: DataFrame, contexts: int = CONTEXTS, generalise: float = GENERALISE) -> DataFrame:
    """(entity, term, disclosure) of the pairs at or above `generalise`, from counts over all documents."""
    # Each aggregation is by a key finer than the entity first, so that one hot entity is spread out.
    by_context = windows.groupBy("entity", "term", "context").agg(F.count("*").alias("n"))
    pairs = by_context.groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("contexts"))
    pairs = materialize(pairs, "pii-pairs")
    sizes = pairs.groupBy("entity").agg(F.sum("n_both").alias("n_entity"))
    counts = (
        docs.select(F.explode(F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), SEPARATORS, -1)).alias("term"))
        .where("term <> ''")
        .groupBy("term")
        .agg(F.count("*").alias("n_term"))
    )
    counts = materialize(counts.join(pairs.where(F.col("contexts") >= contexts).select("term").distinct().withColumn("asked", F.lit(True)), "term", "left").groupBy("term", "asked").agg(F.sum("n_term").alias("n_term")).groupBy("asked", F.when(F.col("asked"), F.col("term")).alias("term")).agg(F.sum("n_term").alias("n_term")), "pii-terms")
    total = counts.agg(F.sum("n_term").alias("n")).first().n or 0
    both = pairs.where(F.col("contexts") >= contexts).join(counts.where("asked").select("term", "n_term"), "term").join(sizes, "entity")
    pmi = F.log2(F.col("n_both") * float(max(total, 1)) / (F.col("n_term") * F.col("n_entity").cast("double")))
    content = F.log2(float(max(total, 1)) / F.col("n_entity"))
    share = F.when(content > 0, F.least(pmi / content, F.lit(1.0))).otherwise(F.lit(0.0))
    return both.select("entity", "term", share.alias("disclosure")).where(F.col("disclosure") >= generalise)


def find(docs: DataFrame, contexts: int = CONTEXTS, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(key, doc_id, base, terms) of every row; spans are (start, kind, end, value), and a term's value is
    what stands in its place: its class, or nothing if it is removed. docs: (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), "doc_id", text.alias("text"))
    spans = once(keyed, ["key", "doc_id", "text"], spans=base_spans(F.col("text")))
    windows = materialize(_windows(with_pieces(spans.where(F.size("spans") > 0).select("text", "spans"), [])), "pii-windows")
    told = disclosures(docs, windows, contexts, generalise)
    actions = materialize(told.groupBy("term").agg((F.max("disclosure") >= remove).alias("gone")), "pii-told")
    # Words are cheap to look up and dear to locate: a text is searched for its own told words only.
    words = keyed.select("key", F.explode(F.array_distinct(F.split("text", SEPARATORS, -1))).alias("word"))
    telling = words.join(actions.select("term"), F.lower("word") == F.col("term"), "left_semi").groupBy("key")
    inside = TERM.removesuffix("+")
    pattern = F.concat(F.lit(f"(?<!{inside})(?:"), F.array_join(F.array_sort(F.collect_set("word")), "|"), F.lit(f")(?!{inside})"))
    telling = materialize(telling.agg(pattern.alias("pattern")), "pii-telling")
    # Only texts that a filter of the telling keys lets pass are dealt out to meet their patterns.
    likely = with_possible(keyed.select("key", "text"), "key", telling.select("key"), blocks_for(telling.count(), 16)).where("possible").drop("possible")
    found = once(likely.join(telling.hint("merge"), "key"), ["key", "pattern", "text"], spans=base_spans(F.col("text")))
    pieces = with_pieces(found, ["key", "pattern"])
    places = F.flatten(F.transform("pieces", lambda p: _located(p["piece"], F.col("pattern"), len(KINDS), p["from"])))
    every = pieces.select("key", F.explode(places).alias("t")).select("key", F.lower("t.value").alias("term"), "t")
    class_ = F.lit(CLASSES[-1][0])
    for tag, pattern in reversed(CLASSES[:-1]):
        class_ = F.when(F.col("t.value").rlike(pattern), F.lit(tag)).otherwise(class_)
    one = F.struct("t.start", "t.kind", "t.end", F.when(F.col("gone"), F.lit("")).otherwise(class_).alias("value"))
    terms = every.join(actions, "term").groupBy("key").agg(F.array_sort(F.collect_set(one)).alias("terms"))
    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    found = spans.select("key", "doc_id", F.col("spans").alias("base")).join(terms, "key", "left")
    return found.withColumn("terms", F.coalesce("terms", none))


def listing(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k[0]) for k in KINDS], F.lit("term"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term) of every row."""
    found = find(docs)
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{kind[0]}") for k, kind in enumerate(KINDS)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(listing(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listing(F.array_sort(F.concat("base", "terms"))).alias("spans"),
        F.size("terms").cast("long").alias("n_term"),
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """All rows and columns of docs, their text without personal data and telling terms; of overlapping spans
    the first gives what stands in their place.

    Other columns keep their values whatever their names; a null text stays null.
    """
    found = find(docs).select("key", F.array_sort(F.concat("base", "terms")).alias("spans")).groupBy("key").agg(F.first("spans").alias("spans"))
    rows = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), F.struct("*").alias("row"))
    both = rows.join(found.where(F.size("spans") > 0), "key", "left").select("row", "spans")
    names = docs.columns
    same = both.where(F.col("spans").isNull()).select(*[F.col("row")[c].alias(c) for c in names])
    pieces = with_pieces(both.where(F.col("spans").isNotNull()).select("row", F.col("row")["text"].alias("text"), "spans"), ["row"])

    def replaced(p: Column) -> Column:
        out = p["value"]
        for k, (name, *_) in enumerate(KINDS):
            out = F.when(p["kind"] == k, F.lit(TAGS[name])).otherwise(out)
        return F.concat(p["piece"], F.when(p["free"], out).otherwise(F.lit("")))

    text = F.array_join(F.transform("pieces", replaced), "")
    return same.unionByName(pieces.select(*[(text if c == "text" else F.col("row")[c]).alias(c) for c in names]))
