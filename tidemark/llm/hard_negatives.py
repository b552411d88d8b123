"""Hard-negative mining by dual-tree search: for each anchor its best rows of its own label, and for each of these
positives the best rows of other labels whose scores lie within given shares of the positive's.

Vectors become integers, so scores, which are inner products, are exact. Rows and anchors each have a tree: its
upper part, at most `CELLS` cells cut by median planes, is fitted on a bounded sample and every row goes down it;
below, each cell is dealt out to blocks of about `BLOCK` rows, and a block's own tree has a ball and a cone around each
node. For two nodes with centres c, d and radii r, s all inner products lie within <c, d> +- (|c| s + |d| r + r s), and
for greatest angles a, b to c and d, within the norms' products times cos(angle of c and d -+ (a + b)). A pair of cells, then of nodes, whose interval can't hold a score that some anchor of the group still needs is left out
with all its anchors at once; pairs of leaves that remain are scored by one product of matrices. What an anchor
needs at first comes from its own block, and rises as blocks are searched, best pairs first.

Anchors and rows meet as blocks through joins by block; a task keeps the best few of each anchor of the pairs it
gets, and an aggregation by anchor picks among tasks. Where vectors have no structure (independent directions in
many dimensions) intervals rule out little, and the work is that of scoring every anchor against every row in blocks.

Defined cases: rows with a null id, a null label, a null vector or a component that is null or not finite take
no part. Shorter vectors count as filled up with zeros. Of rows that repeat an id the least by (label, vector)
counts. Ties go to the smaller id. An empty table, or one without anchors, gives no rows; other columns are ignored,
whatever their names. Scores that don't fit 64 bits raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Rows of the sample that the upper tree is fitted on, its most cells, rows of a block, anchors of a block.
SAMPLE, CELLS, BLOCK, ANCHORS = 20_000, 1024, 1024, 4096
#: Rows of a leaf; blocks of rows that a task holds one block of anchors against.
LEAF, RUN = 64, 16
#: Components become floor(SCALE * x).
SCALE = 256


class Space(NamedTuple):
    """Length of all vectors and the type that holds their components and, exactly, sums of their products."""

    dim: int
    held: str
    summed: str

    def vectors(self, parts: list[bytes]) -> np.ndarray:
        """Vectors as rows, filled up with zeros."""
        size = np.array([len(p) for p in parts])
        if len(parts) and (size == 8 * self.dim).all():
            return np.frombuffer(b"".join(parts), "<f8").reshape(-1, self.dim)
        out = np.zeros((len(parts), self.dim))
        for i, p in enumerate(parts):
            out[i, : len(p) // 8] = np.frombuffer(p, "<f8")
        return out

    def scores(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Exact inner products of all rows of a with all of b."""
        if self.summed != "object":
            return (a.astype(self.summed) @ b.astype(self.summed).T).astype(np.int64)
        whole = [np.array([[int(v) for v in row] for row in x], object).reshape(len(x), self.dim) for x in (a, b)]
        out = whole[0] @ whole[1].T if self.dim else np.zeros((len(a), len(b)), object)
        return out.astype(np.int64)  # raises if one doesn't fit


def space_of(rows: DataFrame) -> Space:
    most = rows.agg(F.max(F.length("vec")), F.max("largest")).first()
    dim, largest = int(most[0] or 0) // 8, float(most[1] or 0)
    product = dim * largest * largest
    return Space(dim, "<i2" if largest < 2**15 else "<f8", "f4" if product < 2**24 else "f8" if product < 2**53 else "object")


def _quantised(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(3)
            flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.cumsum(np.asarray(col.value_lengths(), np.int64)) if len(col) else np.zeros(0, np.int64)
            with np.errstate(all="ignore"):
                q = np.floor(scale * flat)
            q[q == 0] = 0.0
            vecs, largest = [], []
            for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True) if len(ends) else []:
                vecs.append(q[a:b].astype("<f8").tobytes())
                largest.append(float(np.abs(q[a:b]).max()) if b > a else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(vecs, pa.binary()), pa.array(largest, pa.float64())], names=["vec_id", "label", "anchor", "vec", "largest"])

    return run


def quantise(rows: DataFrame, anchor: Column, scale: float = SCALE) -> DataFrame:
    """(vec_id, label, anchor, vec, largest) of the rows that take part; vec holds whole numbers as doubles."""
    vec = F.col("embedding").cast("array<double>")
    sound = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    own = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vec.isNotNull() & sound)
    own = own.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), vec.alias("embedding"))
    made = own.mapInArrow(_quantised(scale), "vec_id long, label long, anchor boolean, vec binary, largest double")
    return made.groupBy("vec_id").agg(F.min(F.struct("label", "vec", "anchor", "largest")).alias("r")).select("vec_id", "r.label", "r.anchor", "r.vec", "r.largest")


class Planes:
    """The upper tree: at node k, rows with <x, axis> <= cut go to node 2k + 1, others to 2k + 2."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.axis: dict[int, np.ndarray] = {}
        self.cut: dict[int, float] = {}
        queue, self.leaves = [(0, sample)], 1
        while queue and self.leaves < cells:
            node, x = queue.pop(0)
            if len(x) < 2:
                continue
            axis = widest(x)
            along = x @ axis
            cut = float(np.median(along))
            low = along <= cut
            if low.all():  # more than half are equal along it: cut below them
                cut = float(along[along < cut].max()) if (along < cut).any() else cut
                low = along <= cut
            if low.all():
                continue
            self.axis[node], self.cut[node] = axis, cut
            self.leaves += 1
            queue += [(2 * node + 1, x[low]), (2 * node + 2, x[~low])]

    def of(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row comes to."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if node not in self.axis or not len(at):
                out[at] = node
                continue
            low = x[at] @ self.axis[node] <= self.cut[node]
            todo += [(2 * node + 1, at[low]), (2 * node + 2, at[~low])]
        return out


def widest(x: np.ndarray) -> np.ndarray:
    """A direction in which rows spread widely: a few rounds of the power method from the row furthest out."""
    off = x - x.mean(0)
    axis = off[np.argmax((off * off).sum(1))]
    for _ in range(4):
        size = np.linalg.norm(axis)
        if not size:
            break
        axis = off.T @ (off @ (axis / size))
    size = np.linalg.norm(axis)
    return axis / size if size else axis


def order_of(x: np.ndarray, leaf: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(order of rows, nodes): a tree over rows put in that order, each node cut at the widest gap along its widest
    direction that leaves a quarter on either side. Node k spans rows nodes[k], its children are 2k + 1 and 2k + 2."""
    order = np.arange(len(x))
    depth = max(0, int(np.ceil(np.log2(max(1, len(x) / leaf))))) + (len(x) > leaf)
    nodes = [(0, len(x))]
    for k in range(2**depth - 1):
        a, b = nodes[k]
        half = a + (b - a + 1) // 2
        if b - a > 1:
            own = order[a:b]
            along = x[own] @ widest(x[own])
            by = np.argsort(along, kind="stable")
            order[a:b] = own[by]
            least = max(1, (b - a) // 4)
            gaps = np.diff(along[by])[least - 1 : b - a - least]
            if len(gaps) and gaps.max() > 0:
                half = a + least + int(np.argmax(gaps))
        nodes += [(a, half), (half, b)]
    return order, nodes


def balls(x: np.ndarray, nodes: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centres, radii, cones) of nodes over rows in their order; a cone is (greatest angle to the centre, least and
    greatest norm), the angle pi where a vector or the centre is zero."""
    centres, radii, cones = np.zeros((len(nodes), x.shape[1])), np.zeros(len(nodes)), np.zeros((len(nodes), 3))
    norms = np.linalg.norm(x, axis=1)
    for k, (a, b) in enumerate(nodes):
        if b > a:
            centres[k] = x[a:b].mean(0)
            radii[k] = np.sqrt(((x[a:b] - centres[k]) ** 2).sum(1).max())
            size = np.linalg.norm(centres[k])
            low, high = norms[a:b].min(), norms[a:b].max()
            angle = np.arccos(np.clip((x[a:b] @ centres[k]) / (norms[a:b] * size), -1, 1)).max() if low and size else np.pi
            cones[k] = angle, low, high
    return centres, radii, cones


def intervals(c: np.ndarray, r: np.ndarray, d: np.ndarray, s: np.ndarray, a: np.ndarray | None = None, b: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner products of node pairs by their balls and, if given, cones; a little wider than exact ones so
    that rounding can't matter."""
    mid, u, v = (c * d).sum(-1), np.linalg.norm(c, axis=-1), np.linalg.norm(d, axis=-1)
    wide = u * s + v * r + r * s
    wide = wide + 1e-6 * (np.abs(mid) + wide) + 1e-3
    low, high = mid - wide, mid + wide
    if a is not None:
        apart, open_ = np.arccos(np.clip(mid / np.maximum(u * v, 1e-300), -1, 1)), a[:, 0] + b[:, 0]
        most, least = np.cos(np.maximum(apart - open_, 0)), np.cos(np.minimum(apart + open_, np.pi))
        near, far = a[:, 1] * b[:, 1], a[:, 2] * b[:, 2]
        slack = 1e-6 * far + 1e-3
        low = np.maximum(low, np.where(least >= 0, near, far) * least - slack)
        high = np.minimum(high, np.where(most >= 0, far, near) * most + slack)
    return low, high


_BLOCK = "cell long, block long, n long, ids binary, labels binary, vecs binary, extra binary, nodes binary, centres binary, radii binary, cones binary"
_NAMES = [f.split()[0] for f in _BLOCK.split(", ")]
_KINDS = [pa.int64()] * 3 + [pa.binary()] * 8


class Block:
    """One block's rows in the order of its tree."""

    def __init__(self, row: dict, space: Space):
        self.n = row["n"]
        self.ids, self.labels = (np.frombuffer(row[k], "<i8") for k in ("ids", "labels"))
        self.vecs = np.frombuffer(row["vecs"], space.held).reshape(self.n, space.dim)
        self.extra = np.frombuffer(row["extra"], "<i8").reshape(self.n, -1)
        self.nodes = np.frombuffer(row["nodes"], "<i8").reshape(-1, 2)
        self.centres = np.frombuffer(row["centres"], "<f8").reshape(len(self.nodes), space.dim)
        self.radii = np.frombuffer(row["radii"], "<f8")
        self.cones = np.frombuffer(row["cones"], "<f8").reshape(-1, 3)

    def leaf(self, k: np.ndarray) -> np.ndarray:
        return 2 * k + 1 >= len(self.nodes)


def packed(cell: int, block: int, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, extra: np.ndarray, space: Space, leaf: int) -> list:
    order, nodes = order_of(x, leaf)
    x = x[order]
    centres, radii, cones = balls(x, nodes)
    return [cell, block, len(ids), ids[order].astype("<i8").tobytes(), labels[order].astype("<i8").tobytes(), x.astype(space.held).tobytes(), extra[order].astype("<i8").tobytes(), np.array(nodes, "<i8").tobytes(), centres.tobytes(), radii.tobytes(), cones.tobytes()]


def _column(table: pa.Table, k: int) -> np.ndarray:
    return table.column(k).to_numpy().astype(np.int64)


def _block(space: Space, leaf: int):
    """A group (cell, block, vec_id, label, vec, extra) as a block."""

    def run(table: pa.Table) -> pa.Table:
        extra = np.array(table.column(5).to_pylist(), np.int64).reshape(table.num_rows, -1)
        row = packed(table.column(0)[0].as_py(), table.column(1)[0].as_py(), _column(table, 2), _column(table, 3), space.vectors(table.column(4).to_pylist()), extra, space, leaf)
        return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(row, _KINDS, strict=True)], names=_NAMES)

    return run


def blocks(rows: DataFrame, space: Space, size: int, leaf: int, name: str) -> DataFrame:
    """Blocks of rows (vec_id, label, vec, extra array<long>): by cell of a tree fitted on a sample, cells of many
    rows, copies of one vector too, over several blocks."""
    total = rows.count()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec").collect()
    planes = Planes(space.vectors([bytes(r.vec) for r in sample]), min(CELLS, -(-total // size)))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = planes.of(space.vectors(b.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), *b.columns], names=["cell", "vec_id", "label", "vec", "extra"])

    dealt = rows.select("vec_id", "label", "vec", "extra").mapInArrow(cells, "cell long, vec_id long, label long, vec binary, extra array<long>")
    dealt = materialize(dealt, f"{name}-cells")
    counts = sorted((r.cell, r.n) for r in dealt.groupBy("cell").agg(F.count("*").alias("n")).collect())
    parts, at = {}, 0
    for cell, n in counts:  # at most CELLS of them
        parts[cell] = (at, -(-n // size))
        at += parts[cell][1]
    if not parts:
        return dealt.sparkSession.createDataFrame([], _BLOCK)
    # Few literals: first number of a cell's blocks, and how many.
    spread = dealt.sparkSession.createDataFrame([(c, *v) for c, v in parts.items()], "cell long, first long, parts long")
    dealt = dealt.join(F.broadcast(spread), "cell").withColumn("block", F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts")))
    dealt = dealt.select("cell", "block", "vec_id", "label", "vec", "extra")
    return materialize(dealt.groupBy("block").applyInArrow(_block(space, leaf), _BLOCK), name)


def cell_balls(found: DataFrame, space: Space, bounds: bool) -> list[tuple]:
    """(cell, centre, radius, least and greatest score of any slot) of each cell: a ball around its blocks' balls. The
    centre is the mean of the cell's blocks' centres; at most CELLS rows come to the driver."""

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                b = Block(row, space)
                half = b.extra.shape[1] // 2
                lo, hi = (int(b.extra[:, :half].min()), int(b.extra[:, half:].max())) if bounds else (0, 0)
                out.append((row["cell"], b.centres[0].tolist(), float(b.radii[0]), lo, hi))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["cell", "c", "r", "lo", "hi"])

    rows = found.mapInArrow(roots, "cell long, c array<double>, r double, lo long, hi long")
    exploded = rows.select("cell", F.posexplode("c").alias("i", "v")).groupBy("cell", "i").agg(F.avg("v").alias("v"))
    centre = exploded.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("m"))
    joined = rows.join(centre.select("cell", F.col("m.v").alias("m")), "cell", "left")
    far = F.sqrt(F.aggregate(F.zip_with("c", F.coalesce("m", F.col("c")), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    out = joined.groupBy("cell").agg(F.first(F.coalesce("m", "c")).alias("m"), F.max(far + F.col("r")).alias("r"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return [(r.cell, np.array(r.m), r.r, r.lo, r.hi) for r in out.collect()]


class Wanted:
    """The best `k` rows of each anchor and slot found so far: from the slot's least to its greatest score."""

    def __init__(self, least: np.ndarray, most: np.ndarray, k: int):
        self.least, self.most, self.k = least, most, k
        self.score = np.full((*least.shape, k), np.iinfo(np.int64).min)
        self.id = np.full((*least.shape, k), -1, np.int64)
        self.have = np.zeros(least.shape, np.int64)

    def need(self) -> np.ndarray:
        """Least score that still counts, for each anchor and slot."""
        return np.where(self.have == self.k, np.maximum(self.least, self.score[:, :, -1]), self.least)

    def offer(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, fits: np.ndarray) -> None:
        """Scores of anchors `rows` with rows `ids`; those that don't fit stay out."""
        need, low = self.need()[rows], np.iinfo(np.int64).min
        for slot in range(self.least.shape[1]):
            own = fits & (score >= need[:, slot, None]) & (score <= self.most[rows, slot, None])
            if not own.any():
                continue
            if score.shape[1] > self.k:  # no row below the k-th best of these counts; equal ones may, by id
                held = np.where(own, score, low)
                own &= held >= np.partition(held, -self.k, axis=1)[:, -self.k, None]
            a, b = np.nonzero(own)
            live = np.unique(a)
            at = rows[live]
            old = self.id[at, slot] >= 0
            o, oc = np.nonzero(old)
            who = np.concatenate([a, live[o]])
            s = np.concatenate([score[a, b], self.score[at, slot][o, oc]])
            i = np.concatenate([ids[b], self.id[at, slot][o, oc]])
            order = np.lexsort((i, -s, who))
            who, s, i = who[order], s[order], i[order]
            first = np.concatenate([[True], who[1:] != who[:-1]])
            rank = np.arange(len(who)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            keep = rank < self.k
            target = rows[who[keep]]
            self.score[target, slot, rank[keep]] = s[keep]
            self.id[target, slot, rank[keep]] = i[keep]
            self.have[rows[live], slot] = np.minimum(self.k, np.bincount(who, minlength=len(rows))[live])


def search(a: Block, b: Block, space: Space, wanted: Wanted, same: bool) -> int:
    """Hold a block of anchors against a block of rows; gives the number of scores made."""
    need, most = wanted.need().min(1), wanted.most.max(1)
    none = wanted.most.max(1) < wanted.least.min(1)
    need = np.where(none, np.iinfo(np.int64).max, need)
    inf = np.iinfo(np.int64).max
    low = np.array([need[x:y].min() if y > x else inf for x, y in a.nodes], np.float64)
    high = np.array([most[x:y].max() if y > x else -inf for x, y in a.nodes], np.float64)
    p, q = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        lo, hi = intervals(a.centres[p], a.radii[p], b.centres[q], b.radii[q], a.cones[p], b.cones[q])
        live = (hi >= low[p]) & (lo <= high[p]) & (a.nodes[p, 1] > a.nodes[p, 0]) & (b.nodes[q, 1] > b.nodes[q, 0])
        p, q, hi = p[live], q[live], hi[live]
        pl, ql = a.leaf(p), b.leaf(q)
        if (pl & ql).all():
            break
        # Children of both, or of the one that has some.
        p = np.where(pl, p, 2 * p + 1), np.where(pl, -1, 2 * p + 2)
        q = np.where(ql, q, 2 * q + 1), np.where(ql, -1, 2 * q + 2)
        pairs = [(x, y) for x in p for y in q]
        p, q = (np.concatenate(v) for v in zip(*pairs, strict=True))
        real = (p >= 0) & (q >= 0)
        p, q = p[real], q[real]
    scored = 0
    for leaf in np.unique(p):  # one product of matrices for each leaf of anchors
        rows = np.arange(*a.nodes[leaf])
        rows = rows[~none[rows]]
        cols = np.concatenate([np.arange(*b.nodes[k]) for k in q[p == leaf]])
        score = space.scores(a.vecs[rows], b.vecs[cols])
        equal = a.labels[rows, None] == b.labels[None, cols]
        fits = (equal if same else ~equal) & (a.ids[rows, None] != b.ids[None, cols])
        wanted.offer(rows, score, b.ids[cols], fits)
        scored += score.size
    return scored


def _found(space: Space, k: int, same: bool, slots: int):
    """Pairs of blocks (a, b structs) to (anchor_id, slot, id, score): the best k of each slot in this task. A block of
    anchors carries its slots' least and greatest scores in `extra`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, tuple[np.ndarray, Wanted]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                x, y = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                a, b = Block(x, space), Block(y, space)
                if x["block"] not in states:
                    states[x["block"]] = (a.ids, Wanted(a.extra[:, :slots].copy(), a.extra[:, slots:].copy(), k))
                search(a, b, space, states[x["block"]][1], same)
        for ids, found in states.values():
            who, slot, place = np.nonzero(found.id >= 0)
            cols = [ids[who], slot, found.id[who, slot, place], found.score[who, slot, place]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["anchor_id", "slot", "id", "score"])

    return run


def matched(anchors: DataFrame, rows: DataFrame, space: Space, k: int, same: bool, slots: int) -> DataFrame:
    """(anchor_id, slot, id, score): for each anchor and slot the best k rows of the same label, or of others, between
    the slot's least and greatest score, found by tasks; a caller takes the best k of all."""
    spark = rows.sparkSession
    left, right = cell_balls(anchors, space, True), cell_balls(rows, space, False)
    pairs = []
    for cell, c, r, lo, hi in left:
        if right:
            low, high = intervals(c[None], np.array([r]), np.array([x[1] for x in right]), np.array([x[2] for x in right]))
            pairs += [(cell, right[j][0], -float(high[j])) for j in np.flatnonzero((high >= lo) & (low <= hi))]
    cells = spark.createDataFrame(pairs, "a_cell long, b_cell long, rank double")
    own = lambda df, name: df.select(F.col("cell").alias(f"{name}_cell"), F.struct(*_NAMES).alias(name))
    numbers = rows.select(F.col("cell").alias("b_cell"), F.col("block").alias("b_block"))
    runs = max(1, -(-rows.count() // RUN))
    turn = F.pmod(F.xxhash64(F.col("b_block")), F.lit(runs))
    # Blocks of rows go to the blocks of anchors by number; a run of theirs meets one copy of a block of anchors.
    asked = anchors.select(F.col("cell").alias("a_cell"), F.col("block").alias("a_block")).join(cells, "a_cell").join(numbers, "b_cell").select("a_block", "b_block", turn.alias("run"), "rank")
    met = asked.join(own(rows, "b").select("b", F.col("b.block").alias("b_block")), "b_block")
    copies = anchors.select(F.col("block").alias("a_block"), F.struct(*_NAMES).alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(runs - 1).cast("long"))).alias("run"))
    both = met.join(copies, ["a_block", "run"]).sortWithinPartitions("rank").select("a", "b")
    return both.mapInArrow(_found(space, k, same, slots), "anchor_id long, slot long, id long, score long")


def _best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _seeds(space: Space, k: int):
    """Blocks of rows to their anchors (vec_id, label, vec, extra): what each needs, from its own block: its k-th best
    score there, or all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.iinfo(np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                b = Block({n: batch.column(j)[i].as_py() for j, n in enumerate(_NAMES)}, space)
                at = np.flatnonzero(b.extra[:, 0])
                wanted = Wanted(np.full((len(at), 1), top.min + 1), np.full((len(at), 1), top.max), k)
                if len(at):
                    equal = b.labels[at, None] == b.labels[None, :]
                    wanted.offer(np.arange(len(at)), space.scores(b.vecs[at], b.vecs), b.ids, equal & (b.ids[at, None] != b.ids[None, :]))
                extra = [[int(v), top.max] for v in wanted.need()[:, 0]]
                vecs = [v.astype("<f8").tobytes() for v in b.vecs[at]]
                cols = [pa.array(b.ids[at], pa.int64()), pa.array(b.labels[at], pa.int64()), pa.array(vecs, pa.binary()), pa.array(extra, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "label", "vec", "extra"])

    return run


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = SCALE, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows: (vec_id, label, embedding).

    For each anchor, a row where `anchor` holds, and each of its best `positives` other rows of its label: the best
    `negatives` rows of other labels with low% of the positive's score <= score <= high% of it.
    """
    made = materialize(quantise(rows, anchor, scale), "vectors")
    space = space_of(made)
    index = blocks(made.select("vec_id", "label", "vec", F.array(F.col("anchor").cast("long")).alias("extra")), space, block, leaf, "rows")
    asking = materialize(index.select(*_NAMES).mapInArrow(_seeds(space, positives), "vec_id long, label long, vec binary, extra array<long>"), "anchors")
    near = matched(blocks(asking, space, ANCHORS, leaf, "anchor-blocks"), index, space, positives, True, 1)
    near = materialize(_best(near, ["anchor_id"], positives).select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("slot")), "positives")
    # 100 * score within [low, high] * positive score, as whole scores; a slot without a positive takes nothing.
    least, most = (F.expr(f"cast({f}(cast(positive_score as decimal(20, 0)) * {share} / 100) as long)") for f, share in (("ceil", low), ("floor", high)))
    windows = near.groupBy("anchor_id").agg(F.collect_list(F.struct("slot", least.alias("least"), most.alias("most"))).alias("w"))
    span = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda s: F.get(F.filter("w", lambda x: x["slot"] == s), F.lit(0)))
    windows = windows.select(F.col("anchor_id").alias("vec_id"), span.alias("w"))
    top = 2**62
    fits = lambda x, name, other: F.when(x["least"] <= x["most"], x[name]).otherwise(F.lit(other))
    extra = F.concat(F.transform("w", lambda x: fits(x, "least", top)), F.transform("w", lambda x: fits(x, "most", -top)))
    asking = materialize(asking.drop("extra").join(windows, "vec_id").select("vec_id", "label", "vec", extra.alias("extra")), "windows")
    found = matched(blocks(asking, space, ANCHORS, leaf, "window-blocks"), index, space, negatives, False, positives)
    best = _best(found, ["anchor_id", "slot"], negatives)
    out = best.join(near, ["anchor_id", "slot"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
