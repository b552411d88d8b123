"""Statistics over episodes: rollups, windows, lifetimes, time series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def floor_to(time: Column, width: int) -> Column:
    return F.floor(time / width).cast("long") * width


def window_ns(label: str) -> int:
    """Nanoseconds of a window such as 4h, 1d or 1w; an hour for what isn't one of the known ones."""
    hours = {"1h": 1, "4h": 4, "24h": 24, "1d": 24, "72h": 72, "1w": 168}
    return hours.get(label, 1) * 3600 * 10**9


def nearest_rank(values: Column, fraction: float) -> Column:
    """The element at min(n - 1, floor(fraction * n)), from 0, of a sorted array; null if it is empty."""
    n = F.size(values)
    return F.when(n > 0, F.element_at(values, (F.least(n - 1, F.floor(n * F.lit(fraction))) + 1).cast("int")))


def rollup(episodes: DataFrame, width: int) -> DataFrame:
    """(bucket_ns, pair, quote, n, max_spread, sum_spread, sum_profit)."""
    return episodes.groupBy(floor_to(F.col("start_ns"), width).alias("bucket_ns"), "pair", "quote").agg(
        F.count("*").alias("n"), F.max("peak_spread").alias("max_spread"), F.sum("peak_spread").alias("sum_spread"), F.sum("peak_profit").alias("sum_profit")
    )


def by_window(episodes: DataFrame, windows: dict[str, int]) -> DataFrame:
    """Count, widest spread and profit by quote asset of the trailing windows that end with the last
    start; one pass for all windows."""
    now = F.broadcast(episodes.agg(F.max("start_ns").alias("now")))
    spans = F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.lit(v).alias("span")) for k, v in windows.items()]))
    rows = episodes.select("start_ns", "quote", "peak_spread", "peak_profit").crossJoin(now).withColumn("w", spans).where("start_ns >= now - w.span")
    return rows.groupBy(F.col("w.label").alias("label"), "quote").agg(F.count("*").alias("n"), F.max("peak_spread").alias("max_spread"), F.sum("peak_profit").alias("profit"))


def most_common(counts: DataFrame, key: str, latest: bool) -> DataFrame:
    """The key of the largest n; ties go to the greatest key if `latest`, else to the least."""
    return counts.orderBy(F.desc("n"), F.desc(key) if latest else F.asc(key)).limit(1)


def percentiles(rows: DataFrame, keys: list[str], value: str, fractions: dict[str, float], ceil: bool = False) -> DataFrame:
    """Nearest-rank percentiles of `value` by keys (rank floor(f n) + 1, at most n; or ceil(f n)), exact and without gathering a group: values are ranked
    by counts of equal ones, so a group costs as many rows as it has distinct values."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys)
    ranked = counts.withColumn("upto", F.sum("c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(w))
    rank = lambda f: F.ceil(F.col("n") * F.lit(f)) if ceil else F.least(F.col("n"), F.floor(F.col("n") * F.lit(f)) + 1)
    at = lambda f: F.min(F.when(F.col("upto") >= rank(f), F.col(value)))
    return ranked.groupBy(*keys).agg(F.max("n").alias("n"), *[at(f).alias(name) for name, f in fractions.items()], F.max(value).alias("longest"))


def window_summary(by_minute: DataFrame, lives: DataFrame) -> DataFrame:
    """One row of a window's statistics from its rollup by minute (whole minutes and the rest of a partial one) and its
    closed episodes (life): count, widest and mean spread, profit by quote as name=value, the busiest pair (ties to the
    least), the busiest minute (ties to the latest), and lifetimes. Windows without episodes have null in all but the count."""
    total = by_minute.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("max_spread").alias("max_spread"), F.floor(F.try_divide(F.sum("sum_spread"), F.sum("n"))).cast("long").alias("mean_spread"))
    profits = by_minute.groupBy("quote").agg(F.sum("sum_profit").alias("p"))  # as many rows as quote assets
    profit = profits.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "quote", F.col("p").cast("string")))), ";").alias("profit"))
    pair = most_common(by_minute.groupBy("pair").agg(F.sum("n").alias("n")), "pair", latest=False).agg(F.max("pair").alias("top_pair"), F.max("n").alias("top_n"))
    minute = most_common(by_minute.groupBy("bucket_ns").agg(F.sum("n").alias("n")), "bucket_ns", latest=True).agg(F.max("bucket_ns").alias("peak_minute_ns"), F.max("n").alias("peak_n"))
    life = percentiles(lives.withColumn("all", F.lit(1)), ["all"], "life", {"p50": 0.5, "p90": 0.9}).agg(F.coalesce(F.max("n"), F.lit(0)).alias("closed"), F.max("p50").alias("life_p50"), F.max("p90").alias("life_p90"), F.max("longest").alias("life_max"))
    out = total
    for one in (profit, pair, minute, life):  # one row each
        out = out.crossJoin(one)
    return out
