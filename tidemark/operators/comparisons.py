"""Books held against snapshots of them: at exact update ids, at rebuilds, within brackets of time, and what
follows from disagreements that last."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import following, preceding, running
from tidemark.session import settled

LEVEL = ["pair", "side", "price"]


def book_at(actions: DataFrame, targets: DataFrame, width: int) -> DataFrame:
    """(id, pair, side, price, size, action_id): the levels of each target's book at its very update id, deleted ones
    with size 0. actions: (pair, side, price, size, update_id); targets: (id, pair, at_id).

    Of actions of one id a deletion counts last. A level's state holds from its action to the next of its price, so
    states and targets meet by pair and bin of `width` ids, and the history is read once however many targets there are.
    Actions after the last target of all bear on none and go no further than the scan.
    """
    end = F.broadcast(targets.agg(F.max("at_id").alias("end")))
    said = actions.crossJoin(end).where("update_id <= end").groupBy(*LEVEL, "update_id").agg(F.max(F.struct((F.col("size") <= 0).alias("gone"), "size")).alias("a")).select(*LEVEL, "update_id", F.col("a.size").alias("size"))
    bin_ = lambda c: F.floor(c / width).cast("long")
    rows = settled(said.withColumn("block", bin_(F.col("update_id") / 16)), "actions")
    states = following(rows, LEVEL, ["update_id"], F.col("update_id"), "to_id", grows=True).drop("block")
    last = targets.groupBy("pair").agg(F.max("at_id").alias("last"))
    until = F.least(F.col("to_id") - 1, F.col("last"))  # least() passes over a null, the end of a level's last state
    binned = states.join(last, "pair").where(until >= F.col("update_id")).withColumn("bin", F.explode(F.sequence(bin_(F.col("update_id")), bin_(until))))
    met = binned.join(targets.withColumn("bin", bin_(F.col("at_id"))), ["pair", "bin"]).where("update_id <= at_id and (to_id is null or at_id < to_id)")
    return met.select("id", "pair", "side", "price", "size", F.col("update_id").alias("action_id"))


def snapshot_comparison(snapshot: DataFrame, stream: DataFrame, traded: DataFrame) -> DataFrame:
    """Levels of REST snapshots (id, pair, side, price, size) against the stream's books of `book_at`.

    outcome: exact_match, size_differs, rest_only or stream_only; for levels that the snapshot alone has,
    last_action: deleted or never, and whether the price traded. traded: (pair, price).
    """
    rest = snapshot.select("id", *LEVEL, F.col("size").alias("rest_size"))
    own = stream.select("id", *LEVEL, F.col("size").alias("stream_size"), "action_id")
    both = rest.join(own, ["id", *LEVEL], "full_outer").where("rest_size is not null or stream_size > 0")
    live = F.coalesce(F.col("stream_size") > 0, F.lit(False))
    outcome = F.when(F.col("rest_size").isNull(), "stream_only").when(~live, "rest_only").when(F.col("rest_size") == F.col("stream_size"), "exact_match").otherwise("size_differs")
    both = both.withColumn("outcome", outcome).join(traded.distinct().withColumn("traded", F.lit(True)), ["pair", "price"], "left")
    only = F.col("outcome") == "rest_only"
    return both.select("id", *LEVEL, "outcome", F.when(only, F.when(F.col("action_id").isNull(), "never").otherwise("deleted")).alias("last_action"), F.when(only, F.coalesce("traded", F.lit(False))).alias("traded"))


def drift_classes(old: DataFrame, fresh: DataFrame, mentions: DataFrame, now: Column, stale: int) -> DataFrame:
    """Levels of a book before and after it is rebuilt: agree, size_differs, and for a level that is missing
    from the old book or a ghost in it, whether its price was last mentioned over `stale` ago (stale), or
    lately or never (unannounced). mentions: (pair, side, price, seen_ns)."""
    a, b = old.select(*LEVEL, F.col("size").alias("old_size")), fresh.select(*LEVEL, F.col("size").alias("new_size"))
    both = a.join(b, LEVEL, "full_outer").join(mentions, LEVEL, "left")
    age = F.when(F.coalesce(now - F.col("seen_ns") > stale, F.lit(False)), "stale").otherwise("unannounced")
    kind = F.when(F.col("old_size").isNull(), F.concat(F.lit("missing_"), age)).when(F.col("new_size").isNull(), F.concat(F.lit("ghost_"), age))
    return both.withColumn("drift", F.coalesce(kind, F.when(F.col("old_size") == F.col("new_size"), "agree").otherwise("size_differs")))


def run_lengths(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """(keys, first, length) of runs of consecutive ordinals; rows hold one for each key and ordinal."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(ordinal))
    return rows.withColumn("_run", F.col(ordinal) - place).groupBy(*keys, "_run").agg(F.min(ordinal).alias("first"), F.count("*").alias("length")).drop("_run")


def signatures(rows: DataFrame, keys: list[str], element: list[str]) -> DataFrame:
    """(keys, n, sign): the set of elements of each key as a fingerprint that no order bears on, the sum of their
    hashes beside their number, so that a set is one small row whatever its size. Elements that repeat count once."""
    own = rows.select(*keys, *element).distinct()
    half = lambda seed: F.sum(F.xxhash64(F.lit(seed), *element).cast("decimal(38,0)"))
    return own.groupBy(*keys).agg(F.count("*").alias("n"), F.struct(half(1).alias("a"), half(2).alias("b")).alias("sign"))


def set_streaks(signs: DataFrame, keys: list[str], ordinal: str, block: int) -> DataFrame:
    """Signatures with `streak`: how many comparisons in a row, up to this one, have found the same set. A comparison
    without any element has no row and ends a streak, as does another set."""
    rows = settled(signs.withColumn("block", F.floor(F.col(ordinal) / block).cast("long")), "signs")
    rows = preceding(rows, keys, [ordinal], F.struct("sign", ordinal), "was")
    goes_on = F.coalesce((F.col("was.sign") == F.col("sign")) & (F.col(f"was.{ordinal}") == F.col(ordinal) - 1), F.lit(False))
    rows = running(settled(rows.withColumn("first", F.when(~goes_on, F.col(ordinal))), "firsts"), keys, [ordinal], {"start": ("last", F.col("first"), True)})
    return rows.select(*keys, ordinal, "n", "sign", (F.col(ordinal) - F.col("start") + 1).alias("streak"))


def rank_bucket(rank: Column) -> Column:
    """best, 1-4 or 5-19 by the number of levels before one; deeper beyond."""
    return F.when(rank == 0, "best").when(rank <= 4, "1-4").when(rank <= 19, "5-19").otherwise("deeper")


def corroborated(before: Column, after: Column, least: int) -> Column:
    """The smaller of two differences that are both at least `least` in size and of one sign, else null."""
    same = (F.signum(before) == F.signum(after)) & (F.abs(before) >= least) & (F.abs(after) >= least)
    return F.when(same, F.when(F.abs(before) <= F.abs(after), before).otherwise(after))


def with_cooldown(triggers: DataFrame, keys: list[str], time: str, cooldown: int) -> DataFrame:
    """Triggers (keys, time) with `fired`: the first of a key, and each one `cooldown` or more after the last
    that fired. Rows of a key that lie closer together than the cooldown form a chain; a chain is worked
    through in order, and what fires in one never bears on another."""
    order = Window.partitionBy(*keys).orderBy(time)
    far = F.coalesce(F.col(time) - F.lag(time).over(order) >= cooldown, F.lit(True))
    chains = triggers.withColumn("_chain", F.sum(far.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))

    def fire(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, last, out = pdf.sort_values(time, kind="stable"), None, []
        for t in pdf[time].tolist():
            out.append(last is None or t - last >= cooldown)
            last = t if out[-1] else last
        return pdf.assign(fired=out).drop(columns="_chain")

    schema = ", ".join(f"{c} {t}" for c, t in triggers.dtypes) + ", fired boolean"
    return chains.groupBy(*keys, "_chain").applyInPandas(fire, schema)
