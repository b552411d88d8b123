"""Text quality by a sparse ensemble of rules over text statistics.

Small gradient-boosted trees are grown in numpy on a bounded sample of labelled rows; every path from a
root to a node becomes a conjunctive rule; an L1-penalised logistic regression (proximal gradient) keeps
few of them; and the kept rules are compiled into one Spark column, so scoring runs in the JVM over all
documents. Labels, language, source and id are never inputs of a score.

Defined cases: null and empty texts have all statistics 0 and are scored like any other; without
labelled rows every score is 0.5; rows with a null label don't teach; an id that stands for several texts
teaches with the least of them; repeated rows each get their row; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_text, once

#: Labelled rows that teach at most: the ones with the smallest hash of their id.
TRAIN_ROWS = 20_000


def statistics() -> dict[str, Column]:
    """Statistics of a text by name; `words`, `lines` and `s` are columns that `with_statistics` makes."""
    s, words, lines = F.col("s"), F.col("words"), F.col("lines")
    chars = F.greatest(F.length(s), F.lit(1))
    share = lambda keep: F.length(F.regexp_replace(s, f"[^{keep}]+", "")) / chars
    n = F.greatest(F.size(words), F.lit(1))
    return {
        "n_chars": F.length(s).cast("double"),
        "n_words": F.size(words).cast("double"),
        "word_length": F.length(s) / n,
        "upper": share("A-Z"),
        "digits": share("0-9"),
        "symbols": share("#$%&*+=<>|{}~^@_\\\\\\[\\]/"),
        "stops": share(".,;:"),
        "marks": share("!?"),
        "distinct_words": F.size(F.array_distinct(words)) / n,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
        "line_length": F.length(s) / F.greatest(F.size(lines), F.lit(1)),
    }


FEATURES = ["n_chars", "n_words", "word_length", "upper", "digits", "symbols", "stops", "marks", "distinct_words", "distinct_lines", "line_length"]


def with_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """(kept columns, FEATURES) of every row; docs: (kept columns, text)."""
    s = F.coalesce(F.col("text"), F.lit(""))
    blanks = s
    for c in "\t\n\x0b\x0c\r":  # one blank to cut at is much cheaper than a class of them
        blanks = F.replace(blanks, F.lit(c), F.lit(" "))
    words, lines = (F.array_remove(F.split(c, cut, -1), "") for c, cut in ((blanks, " "), (s, "\n")))
    parts = once(docs, list(keep), s=s, words=words, lines=lines)
    return once(parts, list(keep), **{k: c.cast("double") for k, c in statistics().items()})


#: A condition: (feature index, is at most, threshold).
Condition = tuple[int, bool, float]


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], depth: int, least: int, path: tuple[Condition, ...] = ()) -> tuple[list[tuple[Condition, ...]], list]:
    """Paths to all nodes under the root, and the leaves as (path, step)."""
    step = -g.sum() / (h.sum() + 1.0)
    best, split = 1e-6, None
    if depth and len(g) >= 2 * least:
        whole = g.sum() ** 2 / (h.sum() + 1.0)
        for f, at in enumerate(cuts):
            if not len(at):
                continue
            bin_ = np.searchsorted(at, x[:, f], side="left")  # bin b: value <= at[b]
            gs, hs, ns = (np.cumsum(np.bincount(bin_, v, len(at) + 1))[:-1] for v in (g, h, np.ones_like(g)))
            gain = gs**2 / (hs + 1.0) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1.0) - whole
            gain[(ns < least) | (len(g) - ns < least)] = -1
            if gain.max() > best:
                best, split = gain.max(), (f, at[int(gain.argmax())])
    if split is None:
        return [], [(path, step)]
    f, t = split
    left = x[:, f] <= t
    rules, leaves = [], []
    for side, is_le in ((left, True), (~left, False)):
        own = (*path, (f, is_le, float(t)))
        below, ends = _grow(x[side], g[side], h[side], cuts, depth - 1, least, own)
        rules += [own, *below]
        leaves += ends
    return rules, leaves


def _holds(x: np.ndarray, rule: tuple[Condition, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, is_le, t in rule:
        out &= (x[:, f] <= t) if is_le else (x[:, f] > t)
    return out


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient for the L1-penalised logistic loss; the intercept goes free."""
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    b, w = float(np.log(rate / (1 - rate))), np.zeros(z.shape[1])
    # The greatest singular value by the small product; z stays in single precision and isn't copied.
    lipschitz = 0.25 * (float(np.linalg.eigvalsh((z.T @ z).astype(float))[-1]) / len(z) + 1.0)
    vb, v, t = b, w.copy(), 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(vb + z @ v.astype(z.dtype)))) - y
        nb = vb - r.mean() / lipschitz
        nw = v - (z.T @ r.astype(z.dtype)) / len(z) / lipschitz
        nw = np.sign(nw) * np.maximum(np.abs(nw) - penalty / lipschitz, 0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vb, v = nb + (t - 1) / nt * (nb - b), nw + (t - 1) / nt * (nw - w)
        b, w, t = nb, nw, nt
    return b, w


@dataclass(frozen=True)
class RuleModel:
    """Weighted conjunctions over FEATURES."""

    intercept: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def logit(self) -> Column:
        out = F.lit(self.intercept)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for f, is_le, t in rule:
                holds = holds & (F.col(FEATURES[f]) <= t if is_le else F.col(FEATURES[f]) > t)
            out = out + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return out

    def score(self) -> Column:
        return 1 / (1 + F.exp(-self.logit()))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.intercept + sum((w * _holds(x, r) for r, w in self.rules), np.zeros(len(x))))))


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, seed: int = 7) -> RuleModel:
    """Rules from boosted trees, weighted by the lasso whose penalty does best on a fifth of the rows."""
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 1) / (len(y) + 2)
        return RuleModel(float(np.log(rate / (1 - rate))) if len(y) else 0.0, ())
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.01, 0.99, 50))) for f in range(x.shape[1])]
    score, found = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        own = rng.random(len(y)) < 0.7
        rules, leaves = _grow(x[own], (p - y)[own], (p * (1 - p))[own], cuts, depth, max(5, len(y) // 500))
        found |= dict.fromkeys(rules)
        for path, step in leaves:
            score = score + 0.3 * step * _holds(x, path)
    rules = list(found)
    if not rules:
        return RuleModel(float(np.log(y.mean() / (1 - y.mean()))), ())
    z = np.empty((len(x), len(rules)), np.float32)
    for k, r in enumerate(rules):
        z[:, k] = _holds(x, r)
    check = rng.random(len(y)) < 0.2
    losses = {}
    for penalty in (3e-2, 1e-2, 3e-3, 1e-3):
        b, w = _lasso(z[~check], y[~check], penalty)
        p = np.clip(1 / (1 + np.exp(-(b + z[check] @ w))), 1e-6, 1 - 1e-6)
        losses[penalty] = -(y[check] * np.log(p) + (1 - y[check]) * np.log(1 - p)).mean() if check.any() else 0.0
    b, w = _lasso(z, y, min(losses, key=losses.get))
    return RuleModel(float(b), tuple((r, float(v)) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-9))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS, held_out_fold: int = 1, folds: int = 3) -> RuleModel:
    """A model of labels.quality from at most `max_rows` labelled rows outside the held-out fold.

    The sample is bounded, so it may be broadcast and its statistics collected.
    """
    known = labels.select("doc_id", F.col("quality").cast("double").alias("y"))
    known = known.where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & (crc_text(F.col("doc_id")) % folds != held_out_fold))
    # Hashes are even: those under this bound are a half more than needed, so few rows are left to sort.
    share = 1.5 * max_rows / max(1, known.count())
    if share < 1:
        known = known.where(F.xxhash64("doc_id") < int(-(2**63) + share * 2**64))
    taught = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows)
    # One text for each labelled id, so that repeated ids don't make the sample grow.
    texts = docs.select("doc_id", "text").join(F.broadcast(taught), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = with_statistics(texts, "doc_id", "y")
    found = rows.orderBy("doc_id", *FEATURES, "y").select("y", *FEATURES).toArrow()
    data = np.stack([c.to_numpy() for c in found.columns], 1)
    return fit_rules(data[:, 1:], data[:, 0])


def score(docs: DataFrame, model: RuleModel, *keep: str) -> DataFrame:
    """(kept columns, score, predicted) of every row; the text may be among the kept."""
    rows = with_statistics(docs.select(F.struct(*keep).alias("row"), "text"), "row")
    out = rows.select("row", model.score().alias("score"))
    return out.select(*[F.col("row")[c].alias(c) for c in keep], "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep(docs: DataFrame, model: RuleModel, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that score `least` or more."""
    rows = with_statistics(docs.select(F.struct("*").alias("row"), "text"), "row")
    return rows.where(model.score() >= least).select(*[F.col("row")[c].alias(c) for c in docs.columns])
