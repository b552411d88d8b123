"""Near-duplicate documents by banded MinHash, sequential Bayesian verification and exact confirmation.

A document is the set of its distinct word shingles. Documents with the same set are one node from the
start. Each node's MinHash signature is cut into bands; nodes that share a band are candidates. A bucket's
pivot is the node that meets most others over all bands, which is a group's likely origin; all nodes of a
bucket are first compared with it. Nodes that this leaves in another component than the pivot are compared
with the others of the pivot's group, block by block inside the tasks, so a group of copies costs one
comparison each and no pairs are emitted but links.
Candidates go through the signature batch by batch: after n hashes with m agreements the posterior
probability of a similarity over the threshold is known, and a pair is dropped once it falls under the
chosen miss probability. Survivors are confirmed on their full shingle sets.

Defined cases: a null or empty text, or one without words, has no shingles and is linked with nothing; a
text with fewer words than a shingle has its whole sequence as the only one; repeated rows have equal
sets; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_array, binary_parts, discard, materialize, mix, row_key, shingle_sets, slices, texts, word_hashes
from .graph import components

ROWS, BANDS, BATCH = 5, 32, 32
#: Chance to drop a pair at the threshold in one look at a batch.
MISS = 1e-9
#: Shingles on either side of a comparison in one task, and tasks that a group's nodes are sized in.
BLOCK_SHINGLES, SALTS = 100_000, 16

_MULTIPLIERS = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = np.random.Generator(np.random.PCG64(78)).integers(1, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, hashes) least values of each hash function over each set; no set is empty."""
    all_, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(_MULTIPLIERS), len(sets)), np.uint64)
    for k, a in enumerate(_MULTIPLIERS):
        out[k] = np.minimum.reduceat(all_ * a, starts)
    return out.T


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            data, offsets = binary_parts(part.column(2))
            words, _, _, first = word_hashes(data, offsets, lower=True)
            sets = list(shingle_sets(words, first, size))
            full = [i for i, s in enumerate(sets) if len(s)]
            nodes, bands, bits = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            if full:
                least = signatures([sets[i] for i in full])
                keys = mix((least.reshape(len(full), BANDS, ROWS) * _BAND).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                low = (mix(least) & np.uint64(255)).astype(np.uint8)
                for j, i in enumerate(full):
                    nodes[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                    bands[i], bits[i] = keys[j], low[j].tobytes()
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), binary_array(nodes), pa.array(bands, pa.list_(pa.int64())), binary_array(bits)],
                names=["key", "doc_id", "n_shingles", "node", "bands", "bits"],
            )

    return run


def least_matches(threshold: float, miss: float) -> list[tuple[int, int]]:
    """(n, m): after n hashes, pairs with under m agreements are dropped.

    With a flat prior the posterior chance of a similarity over the threshold after m of n agreements is
    P(Binomial(n + 1, p) <= m), where p also counts chance agreement of eight bits.
    """
    p = threshold + (1 - threshold) / 256
    out = []
    for n in range(BATCH, ROWS * BANDS + 1, BATCH):
        total, m = 0.0, 0
        while m <= n:
            total += comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def _prune(threshold: float, miss: float):
    looks = least_matches(threshold, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if not part.num_rows:
                continue
            a, b = (binary_parts(part.column(i))[0].reshape(part.num_rows, -1) for i in (2, 3))
            alive, matches, done = np.arange(part.num_rows), np.zeros(part.num_rows, np.int32), 0
            for n, m in looks:
                matches[alive] += (a[alive, done:n] == b[alive, done:n]).sum(1, dtype=np.int32)
                alive, done = alive[matches[alive] >= m], n
            yield part.select(["u", "v"]).take(pa.array(alive))

    return run


def _compare(size: int, percent: int, looks: list[tuple[int, int]]):
    """For one group: the links between its left and its right nodes that have different roots.

    A left node's signature is held against all right ones batch by batch; survivors' full sets are
    intersected with its own by marks over the group's numbered shingles.
    """

    def run(table: pa.Table) -> pa.Table:
        node, root, bits = (table.column(c).to_pylist() for c in ("node", "root", "bits"))
        left = np.asarray(table.column("is_left"))
        sets = []
        for text in table.column("text").to_pylist():
            words, _, _, first = word_hashes(np.frombuffer(text, np.uint8), np.array([0, len(text)]), lower=True)
            sets.append(next(shingle_sets(words, first, size)))
        lengths = np.array([len(x) for x in sets])
        starts = np.cumsum(lengths) - lengths
        ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
        sign = np.frombuffer(b"".join(bits), np.uint8).reshape(len(node), -1)
        names = {r: k for k, r in enumerate(dict.fromkeys(root))}
        roots = np.array([names[r] for r in root])
        rights, mark = np.flatnonzero(~left), np.zeros(int(ids.max(initial=-1)) + 1, bool)
        out: list[tuple[bytes, bytes]] = []
        for x in np.flatnonzero(left):
            alive, matches, done = rights[roots[rights] != roots[x]], 0, 0
            for n, m in looks:
                matches = matches + (sign[alive, done:n] == sign[x, done:n]).sum(1, dtype=np.int32)
                alive, matches, done = alive[matches >= m], matches[matches >= m], n
            if not len(alive):
                continue
            own = ids[starts[x] : starts[x] + lengths[x]]
            mark[own] = True
            at = np.arange(int(lengths[alive].sum())) + np.repeat(starts[alive] - np.cumsum(lengths[alive]) + lengths[alive], lengths[alive])
            both = np.add.reduceat(mark[ids[at]], np.cumsum(lengths[alive]) - lengths[alive], dtype=np.int64)
            mark[own] = False
            good = alive[100 * both >= percent * (lengths[x] + lengths[alive] - both)]
            out += [(node[x], node[y]) for y in good]
        cols = list(zip(*out, strict=True)) if out else [[], []]
        return pa.table([binary_array(list(cols[0])), binary_array(list(cols[1]))], names=["u", "v"])

    return run


def _salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))


def _copied(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _links(sides: DataFrame, nodes: DataFrame, text: DataFrame, size: int, percent: int, miss: float, shingles: int) -> DataFrame:
    """The links (u, v) between left and right nodes of each group. sides: (group, node, root, is_left).

    A group is cut into blocks of about `shingles` shingles on either side, and each left block meets each
    right one, so that a task holds two blocks however large the group is.
    """
    sized = sides.join(nodes.select("node", "key", "bits", "n_shingles"), "node")
    weight = lambda side: F.sum(F.when(F.col("is_left") == side, F.col("n_shingles")).otherwise(0))
    blocks = sized.groupBy("group").agg(*[F.ceil((weight(s) + 1) / shingles).cast("int").alias(n) for s, n in ((True, "lefts"), (False, "rights"))])
    # The sizes are copied so that the nodes of a large group meet them in several tasks.
    cut = _salted(sized).join(_copied(blocks), ["group", "salt"])
    own = lambda n: F.array(F.pmod(F.xxhash64("node"), F.col(n)).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    dealt = cut.withColumn("i", F.explode(F.when(F.col("is_left"), own("lefts")).otherwise(every("lefts"))))
    dealt = dealt.withColumn("j", F.explode(F.when(F.col("is_left"), every("rights")).otherwise(own("rights"))))
    whole = text.groupBy("key").agg(F.first("text").alias("text"))
    rows = dealt.join(whole.join(dealt.select("key").distinct(), "key"), "key").select("group", "i", "j", "node", "root", "is_left", "bits", "text")
    return rows.groupBy("group", "i", "j").applyInArrow(_compare(size, percent, least_matches(percent / 100, miss)), "u binary, v binary")


def _near(pairs: DataFrame, nodes: DataFrame, percent: int, miss: float) -> DataFrame:
    """The pairs (u, v) that their signatures leave likely."""
    bits = nodes.select("node", "bits")
    return (
        pairs.join(bits.select(F.col("node").alias("u"), F.col("bits").alias("bits_u")), "u")
        .join(bits.select(F.col("node").alias("v"), F.col("bits").alias("bits_v")), "v")
        .select("u", "v", "bits_u", "bits_v")
        .mapInArrow(_prune(percent / 100, miss), "u binary, v binary")
    )


def dedup(docs: DataFrame, size: int = 5, percent: int = 80, miss: float = MISS, shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(key, doc_id, n_shingles, component_id, kept) of every row.

    Documents are linked if 100 * shared >= percent * joint shingles; component_id is the least doc_id
    that links lead to and kept tells the row that has it. docs: (doc_id, text); key is row_key.
    """
    source = texts(docs, row_key(F.col("doc_id"), F.col("text")).alias("key"), F.col("doc_id"))
    sketches = materialize(
        source.select("key", "doc_id", "text").mapInArrow(_sketch(size), f"key binary, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, node binary, bands array<long>, bits binary"),
        "dedup-sketches",
    )
    full = sketches.where(F.col("node").isNotNull())
    nodes = materialize(
        full.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.min("key").alias("key"), F.first("bands").alias("bands"), F.first("bits").alias("bits"), F.first("n_shingles").alias("n_shingles")),
        "dedup-nodes",
    )
    banded = nodes.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    crowded = materialize(banded.join(shared, "band"), "dedup-crowded")
    # The node that meets most others over all its bands is a group's likely origin and becomes the pivot.
    degrees = crowded.groupBy("node").agg(F.sum("n").alias("degree"))
    ranked = crowded.join(degrees, "node").select("band", "node", F.struct("degree", "node").alias("rank"))
    pivots = ranked.groupBy("band").agg(F.max("rank").alias("top")).select("band", F.col("top.node").alias("pivot"))
    members = materialize(crowded.select("band", "node").join(pivots, "band"), "dedup-buckets")
    discard(crowded)
    text = source.select("key", "text")

    stars = materialize(members.where("node <> pivot").select(F.col("pivot").alias("u"), F.col("node").alias("v")).distinct(), "dedup-stars")
    discard(members)
    near = _near(stars, nodes, percent, miss)
    near = materialize(near.select(F.col("u").alias("group"), F.col("v").alias("node")), "dedup-survivors")
    sides = near.select("group", "node", F.col("node").alias("root"), F.lit(False).alias("is_left"))
    heads = near.select("group").distinct().select("group", F.col("group").alias("node"), F.col("group").alias("root"), F.lit(True).alias("is_left"))
    links = materialize(_links(sides.unionByName(heads), nodes, text, size, percent, miss, shingles), "dedup-links")
    roots = materialize(components(links), "dedup-roots")

    # Nodes that meet in a bucket meet its pivot there. Those that the pivots left in other components are
    # held against everyone of their pivot's group.
    placed = stars.select(F.col("u").alias("group"), F.col("v").alias("node")).join(roots, "node", "left").select("group", "node", F.coalesce("root", "node").alias("root"))
    placed = placed.join(roots.select(F.col("node").alias("group"), F.col("root").alias("group_root")), "group", "left")
    placed = placed.withColumn("is_left", F.col("root") != F.coalesce("group_root", "group"))
    split = placed.groupBy("group").agg(F.sum(F.col("is_left").cast("int")).alias("lefts"), F.count("*").alias("n")).where("lefts > 0 and n > 1").select("group")
    placed = materialize(_salted(placed).join(_copied(split), ["group", "salt"]).select("group", "node", "root", "is_left"), "dedup-apart")
    sides = placed.where("is_left").unionByName(placed.withColumn("is_left", F.lit(False)))
    more = materialize(_links(sides, nodes, text, size, percent, miss, shingles), "dedup-links")
    joined = links.unionByName(more).unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v")))
    final = materialize(components(joined), "dedup-roots")
    discard(stars, near, links, roots, placed, more)

    rooted = nodes.select("node", "least_id").join(final, "node", "left").select("node", "least_id", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(least, "root").select("node", "component_id")
    rows = sketches.select("key", "doc_id", "n_shingles", "node")
    out = rows.where(F.col("node").isNotNull()).join(named, "node").select("key", "doc_id", "n_shingles", "component_id")
    alone = rows.where(F.col("node").isNull()).select("key", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, that have the least doc_id of their group. Rows of equal id
    and text stand for one document and stay once."""
    kept = dedup(docs, size, percent).where("kept").select(F.col("key").alias("kept_key")).distinct()
    rows = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), F.struct("*").alias("row"))
    stays = rows.join(kept, F.col("key") == F.col("kept_key"), "left_semi").groupBy("key").agg(F.first("row").alias("row"))
    return stays.select(*[F.col("row")[c].alias(c) for c in docs.columns])
