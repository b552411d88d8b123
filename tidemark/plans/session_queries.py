"""Queries over fill-rate sessions, and over variants of the research settings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import fillrates, leadlag, netsignal, pricing, research, stats
from tidemark.plans import common, pricing_queries, research_queries
from tidemark.session import settled, shared_path
from tidemark.sources import market, store

DAY, HOUR = market.NS_DAY, market.NS_HOUR
START = 1_704_844_800 * 10**9  # 2024-01-10
SAMPLES, E = pricing_queries.SAMPLES, common.EPISODES
KEYS = ["session", "bucket_ns", "pair", "venue", "notional", "side"]


def _sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples in sessions of four days; each has the settings of its number's rest by three."""
    number = F.floor((F.col("tick") - START) / (4 * DAY)).cast("long")
    rows = pricing_queries._samples(spark, sf_dir).withColumn("n", number)
    config = fillrates.fingerprint(F.lit(pricing_queries.TICK), F.pmod("n", F.lit(3)))
    return rows.withColumn("config", config).withColumn("session", fillrates.session_id(F.lit(START) + F.col("n") * 4 * DAY, config))


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampled(spark, sf_dir).groupBy("session", "config").agg(F.min("tick").alias("first_tick"), F.max("tick").alias("last_tick"), F.count_distinct("tick").alias("ticks"))


SAMPLED = (
    SAMPLES
    + f""", sd AS (SELECT *, floor((tick - {START})::DOUBLE / {4 * DAY})::BIGINT AS n FROM sm
), sc AS (SELECT *, sha256('{pricing_queries.TICK}|' || ((n % 3) + 3) % 3) AS config FROM sd
), ss AS (SELECT *, ({START} + n * {4 * DAY}) || '-' || substr(config, 1, 16) AS session FROM sc
), se AS (SELECT session, config, min(tick) AS first_tick, max(tick) AS last_tick, count(DISTINCT tick) AS ticks FROM ss GROUP BY ALL)"""
)
_OUT = pricing_queries._OUT


def fill_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by id with the fingerprint of their settings and their ticks."""
    return _sessions(spark, sf_dir)


SESSIONS_SQL = f"WITH {SAMPLED} SELECT * FROM se"


def _session_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of a day by session, written in two parts that are added up."""
    rows = _sampled(spark, sf_dir)
    bucket = (F.floor(F.col("tick") / DAY).cast("long") * DAY).alias("bucket_ns")
    counts = [F.count("*").alias("samples"), *[F.count_if(F.col("outcome") == o).alias(o) for o in fillrates.OUTCOMES]]
    part = F.floor(F.col("tick") / pricing_queries.TICK) % 2
    parts = rows.groupBy("session", bucket, "pair", "venue", "notional", "side", part.alias("part")).agg(*counts).drop("part")
    return fillrates.upserted(parts, KEYS)


BUCKETS = SAMPLED + f", sb AS (SELECT session, tick // {DAY} * {DAY} AS bucket_ns, pair, venue, notional, side, count(*) AS samples, {_OUT} FROM ss GROUP BY ALL)"


def fill_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session_buckets(spark, sf_dir)


UPSERT_SQL = f"WITH {BUCKETS} SELECT * FROM sb"


def fill_rate_by_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen days by the settings' fingerprint and row key, with how much of them the samples cover."""
    return fillrates.by_config(_session_buckets(spark, sf_dir), _sessions(spark, sf_dir), START, START + 16 * DAY, pricing_queries.TICK)


BY_CONFIG_SQL = f"""WITH {BUCKETS}, b AS (SELECT config, pair, venue, notional, side, sum(samples)::BIGINT AS samples, {", ".join(f"sum({o})::BIGINT AS {o}" for o in fillrates.OUTCOMES)} FROM sb JOIN se USING (session) WHERE bucket_ns >= {START} AND bucket_ns < {START + 16 * DAY} GROUP BY ALL)
SELECT *, CASE WHEN filled + insufficient > 0 THEN filled * 1000000 // (filled + insufficient) END AS fill_rate, (samples * {pricing_queries.TICK // 10**9} * 1000000 // {16 * DAY // 10**9})::BIGINT AS coverage FROM b"""


def fill_session_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of each session that have a bucket of v0 in which something was filled."""
    ticks = _sampled(spark, sf_dir).select("session", "config", "tick", (F.floor(F.col("tick") / DAY).cast("long") * DAY).alias("bucket_ns")).distinct()
    hits = _session_buckets(spark, sf_dir).where("venue = 'v0' and filled > 0")
    return ticks.join(hits, ["session", "bucket_ns"], "left_semi").groupBy("session", "config").agg(F.count("*").alias("ticks"))


MINUTES_SQL = f"WITH {BUCKETS} SELECT session, config, count(*) AS ticks FROM (SELECT DISTINCT session, config, tick, tick // {DAY} * {DAY} AS bucket_ns FROM ss) t WHERE EXISTS (SELECT 1 FROM sb WHERE sb.session = t.session AND sb.bucket_ns = t.bucket_ns AND venue = 'v0' AND filled > 0) GROUP BY ALL"


def fill_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions and ticks that a prune of all buckets before 2024-01-20 leaves without any bucket."""
    kept = _session_buckets(spark, sf_dir).where(F.col("bucket_ns") >= START + 10 * DAY)
    sessions = _sessions(spark, sf_dir).select("session", F.lit(None).cast("long").alias("tick")).join(kept, "session", "left_anti")
    ticks = _sampled(spark, sf_dir).select("session", "tick", (F.floor(F.col("tick") / DAY).cast("long") * DAY).alias("bucket_ns")).distinct()
    return sessions.unionByName(ticks.join(kept, ["session", "bucket_ns"], "left_anti").select("session", "tick"))


ORPHANS_SQL = f"""WITH {BUCKETS}, k AS (SELECT * FROM sb WHERE bucket_ns >= {START + 10 * DAY})
SELECT session, NULL::BIGINT AS tick FROM se WHERE session NOT IN (SELECT session FROM k)
UNION ALL SELECT session, tick FROM (SELECT DISTINCT session, tick FROM ss) t WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.session = t.session AND k.bucket_ns = t.tick // {DAY} * {DAY})"""


_CUTOFF = START + 5 * DAY + 30 * 10**9


def store_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store holds after a prune of at most a hundred episodes before a cutoff: by table, rows and a checksum. The
    episodes, the rollup of their days, buckets, ticks and sessions go in one commit."""
    made = store.EpisodeStore(spark, shared_path(spark, "retention-store"))
    made.flush(common.episode_store(spark, sf_dir).episodes())
    buckets = _session_buckets(spark, sf_dir)
    sessions = _sessions(spark, sf_dir).select("session", F.col("first_tick").alias("started_ns"))
    made.append(buckets=buckets.select("session", "bucket_ns", "pair", "venue", "notional", "side", "samples"), ticks=buckets.select("bucket_ns", "session").distinct(), sessions=sessions)
    made.prune(_CUTOFF, 100)
    sums = {"episodes": F.sum("id"), "rollup": F.sum("sum_profit"), "buckets": F.sum("samples"), "ticks": F.sum(F.col("bucket_ns") / DAY), "sessions": F.sum(F.floor(F.col("started_ns") / HOUR))}
    out = [made.table(t).agg(F.lit(t).alias("held"), F.count("*").alias("n"), F.coalesce(c, F.lit(0)).cast("long").alias("checksum")) for t, c in sums.items()]
    return reduce(DataFrame.unionByName, out)


_LAST_MINUTE = _CUTOFF - 60 * 10**9
RETENTION_SQL = f"""WITH {E}, {BUCKETS.split(common.TRUSTED, 1)[1].lstrip(", ")}, gone AS (SELECT id FROM ep WHERE start_ns < {_CUTOFF} ORDER BY start_ns, id LIMIT 100
), le AS (SELECT * FROM ep WHERE id NOT IN (SELECT id FROM gone)), kb AS (SELECT * FROM sb WHERE bucket_ns > {_LAST_MINUTE}
), kt AS (SELECT DISTINCT bucket_ns, session FROM sb b WHERE bucket_ns > {_LAST_MINUTE}), ks AS (SELECT * FROM se WHERE first_tick >= {_CUTOFF} OR session IN (SELECT session FROM kt))
SELECT 'episodes' AS held, count(*) AS n, coalesce(sum(id), 0)::BIGINT AS checksum FROM le
UNION ALL SELECT 'rollup', count(*), coalesce(sum(p), 0)::BIGINT FROM (SELECT start_ns // 60000000000 AS m, pair, quote, sum(peak_profit) AS p FROM le GROUP BY ALL)
UNION ALL SELECT 'buckets', count(*), coalesce(sum(samples), 0)::BIGINT FROM kb UNION ALL SELECT 'ticks', count(*), coalesce(sum(bucket_ns // {DAY}), 0)::BIGINT FROM kt
UNION ALL SELECT 'sessions', count(*), coalesce(sum(first_tick // {HOUR}), 0)::BIGINT FROM ks"""


#: Variant: (hours of a bin, least overlaps, half hours of a lag step, windows).
KNOBS = {"base": (2, 10, 2, 4), "bin_half": (1, 10, 2, 4), "bin_double": (4, 10, 2, 4), "overlap_half": (2, 5, 2, 4), "overlap_double": (2, 20, 2, 4), "step_half": (2, 10, 1, 4), "step_double": (2, 10, 4, 4), "windows_half": (2, 10, 2, 2), "windows_double": (2, 10, 2, 8)}
_LAST = research_queries.LAGS[-1]


def lead_lag_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best lags with each of four settings halved and doubled: the bins, the least overlap, the lag step, and the windows,
    for which the sign of the lag must be the same in all parts that have one.

    One contrast over all bins and parts: returns are made once for each bin, over a grid of the finest step, and a
    variant picks its lags."""
    quotes = common.trusted_quotes(spark, sf_dir)
    rows = None
    for hours in sorted({k[0] for k in KNOBS.values()}):
        one = leadlag.returns(leadlag.ticks(quotes, hours * HOUR)).withColumn("hours", F.lit(hours))
        rows = one if rows is None else rows.unionByName(one)
    rows = settled(rows, "returns")
    span = F.broadcast(rows.where("hours = 2").agg(F.min("start_ns").alias("lo"), F.max("end_ns").alias("hi")))
    parts = [F.struct(F.lit(0).alias("windows"), F.lit(0).alias("part"))]
    parts += [F.when(F.col("hours") == 2, F.struct(F.lit(n).alias("windows"), leadlag.part_of(F.col("start_ns"), F.col("lo"), F.col("hi"), n).alias("part"))) for n in (2, 8)]
    rows = rows.crossJoin(span).withColumn("w", F.explode(F.array_compact(F.array(*parts)))).select("pair", "venue", "start_ns", "end_ns", "value", "hours", "w.windows", "w.part")
    left, right = research_queries._sides(rows, spark)
    keys = [*research_queries._KEYS, "hours", "windows", "part"]
    lags = spark.createDataFrame([(x,) for x in range(-_LAST, _LAST + 1, HOUR // 2)], "lag long")
    points = settled(leadlag.contrast(left, right, lags, keys, 12 * HOUR), "points")
    out = None
    for name, (hours, least, step, windows) in KNOBS.items():
        own = points.where((F.col("hours") == hours) & (F.col("windows") == (0 if windows == 4 else windows)) & (F.col("lag") % (step * HOUR // 2) == 0))
        best = leadlag.best_lag(own, keys, least if windows == 4 else 5, step * HOUR // 2, _LAST)
        if windows == 4:
            one = best.select(F.lit(name).alias("variant"), *research_queries._KEYS, "status", "lag")
        else:
            ok = F.col("status") == "ok"
            signs = best.groupBy(*research_queries._KEYS).agg(F.count_if(ok).alias("n"), F.count_distinct(F.when(ok, F.signum("lag"))).alias("signs"))
            status = F.when(F.col("n") < 2, "insufficient_data").when(F.col("signs") == 1, "stable").otherwise("unstable")
            one = signs.select(F.lit(name).alias("variant"), *research_queries._KEYS, status.alias("status"), F.lit(None).cast("long").alias("lag"))
        out = one if out is None else out.unionByName(one)
    return out


def _variant_sql(name: str, hours: int, least: int, step: int, windows: int) -> str:
    if windows != 4:
        parts = research_queries.STABILITY_SQL.replace("least(3, (start_ns - lo) * 4 ", f"least({windows - 1}, (start_ns - lo) * {windows} ")
        return f"SELECT '{name}' AS variant, pair, l, r, CASE WHEN ok_parts < 2 THEN 'insufficient_data' WHEN stable THEN 'stable' ELSE 'unstable' END AS status, NULL::BIGINT AS lag FROM ({parts})"
    points = research_queries.POINTS.replace(f"ns // {research_queries.BIN} ", f"ns // {hours * HOUR} ")
    points = points.replace(", ".join(f"({x})" for x in research_queries.LAGS), ", ".join(f"({x})" for x in range(-_LAST, _LAST + 1, step * HOUR // 2)))
    return f"""SELECT '{name}' AS variant, * FROM (WITH {points}, g AS (SELECT *, round(abs(rho), 10) AS h FROM pt WHERE novl >= {least} AND rho IS NOT NULL),
t AS (SELECT pair, l, r, count(*) AS ties, min({{'away': abs(lag), 'lag': lag}}) AS b FROM g JOIN (SELECT pair, l, r, max(h) AS h FROM g GROUP BY ALL) USING (pair, l, r, h) GROUP BY pair, l, r)
SELECT k.pair, k.l, k.r, CASE WHEN b IS NULL THEN 'insufficient_data' WHEN ties > 1 THEN 'tied_maximum' WHEN b.away >= {_LAST} THEN 'maximum_at_grid_edge' ELSE 'ok' END AS status, b.lag AS lag FROM (SELECT DISTINCT pair, l, r FROM pt) k LEFT JOIN t USING (pair, l, r))"""


SENSITIVITY_SQL = " UNION ALL ".join(_variant_sql(n, *knobs) for n, knobs in KNOBS.items())


def lag_runner_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best and the second best lag of each pair of venues by the size of the correlation."""
    points = research_queries._points(spark, sf_dir).where("overlaps >= 10 and rho is not null")
    w = Window.partitionBy(*research_queries._KEYS).orderBy(F.desc(F.round(F.abs("rho"), 10)), F.abs("lag"), "lag")
    ranked = points.withColumn("rank", F.row_number().over(w)).where("rank <= 2")  # a grid has few lags
    return ranked.groupBy(*research_queries._KEYS).agg(F.max(F.when(F.col("rank") == 1, F.col("lag"))).alias("best_lag"), F.max(F.when(F.col("rank") == 2, F.col("lag"))).alias("second_lag"))


RUNNER_SQL = f"""WITH {research_queries.POINTS}, k AS (SELECT *, row_number() OVER (PARTITION BY pair, l, r ORDER BY round(abs(rho), 10) DESC, abs(lag), lag) AS n FROM pt WHERE novl >= 10 AND rho IS NOT NULL)
SELECT pair, l, r, max(lag) FILTER (n = 1) AS best_lag, max(lag) FILTER (n = 2) AS second_lag FROM k GROUP BY pair, l, r"""


def gate_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gate_sensitivity by notional, with the survivors' share of all and the kept share of the profit (1e-6)."""
    cutoffs = spark.createDataFrame([(h * HOUR,) for h in (1, 2, 4, 6)], "cutoff long")
    # Every cutoff sees all rows, so a notional's totals are in each of its groups.
    both = research.gate_sensitivity(research_queries._ledgers(spark, sf_dir), cutoffs, ("notional",), winners=F.count_if(F.col("net") > 0), all_profit=F.sum("peak_profit"))
    share = lambda a, b: F.floor(F.try_divide(F.col(a) * 1_000_000, F.col(b))).cast("long")
    return both.select("notional", "cutoff", "quote", "retained", "rejected", "unknown", "survivors", share("survivors", "winners").alias("survivor_share"), share("profit", "all_profit").alias("profit_share"))


GATE_SHARES_SQL = f"""WITH {research_queries.LEDGERS}, o AS (SELECT *, {research_queries._OLDEST} AS oldest FROM le), c(cutoff) AS (VALUES {", ".join(f"({h * HOUR})" for h in (1, 2, 4, 6))}),
g AS (SELECT notional, cutoff, quote, count(*) FILTER (oldest <= cutoff) AS retained, count(*) FILTER (oldest > cutoff) AS rejected, count(*) FILTER (oldest IS NULL) AS unknown, count(*) FILTER (oldest <= cutoff AND net > 0) AS survivors,
  count(*) FILTER (net > 0) AS winners, sum(CASE WHEN oldest <= cutoff THEN peak_profit ELSE 0 END)::BIGINT AS profit, sum(peak_profit)::BIGINT AS all_profit FROM o, c GROUP BY ALL)
SELECT notional, cutoff, quote, retained, rejected, unknown, survivors, CASE WHEN winners <> 0 THEN CAST(floor(survivors * 1e6::DOUBLE / winners) AS BIGINT) END AS survivor_share, CASE WHEN all_profit <> 0 THEN CAST(floor(profit * 1e6::DOUBLE / all_profit) AS BIGINT) END AS profit_share FROM g"""


def band_lifetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifetimes of episodes by the band of their age and skew at the opening: p50 and p90 at rank ceil(f n)."""
    rows = research.dimensions(common.episode_store(spark, sf_dir).episodes()).withColumn("life", F.col("end_ns") - F.col("start_ns"))
    return stats.percentiles(rows, ["dimension", "band"], "life", {"p50": 0.5, "p90": 0.9}, ceil=True)


BAND_LIVES_SQL = f"""WITH {E}, d AS (SELECT 'age' AS dimension, {research_queries._band_sql(f"({research_queries._OLDEST}) // 1000000")} AS band, end_ns - start_ns AS life FROM ep UNION ALL SELECT 'skew', {research_queries._band_sql("skew // 1000000")}, end_ns - start_ns FROM ep
), l AS (SELECT dimension, band, list(life ORDER BY life) AS v FROM d WHERE life IS NOT NULL GROUP BY ALL)
SELECT dimension, band::INTEGER AS band, len(v) AS n, v[CAST(ceil(len(v) * 0.5) AS BIGINT)] AS p50, v[CAST(ceil(len(v) * 0.9) AS BIGINT)] AS p90, v[-1] AS longest FROM l"""


def theoretical_overlap_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """theoretical_overlap of every variant: by variant, intervals, covered starts and the mean coverage."""
    end = market.quotes(spark, sf_dir).agg(F.max("ns")).first()[0] or 0
    rows = netsignal.overlap(research_queries._intervals(spark, sf_dir), common.episode_store(spark, sf_dir).episodes(), HOUR, end)
    return rows.groupBy("variant").agg(F.count("*").alias("n"), F.count_if("start_covered").alias("covered_starts"), F.floor(F.sum("coverage") / F.count("*")).cast("long").alias("mean_coverage"))


OVERLAP_ALL_SQL = f"""WITH {research_queries.INTERVALS}, m AS (SELECT max(ns) AS e FROM q), a AS (SELECT *, coalesce(close_ns, e) AS stop FROM iv, m WHERE coalesce(close_ns, e) > open_ns),
b AS (SELECT pair, buy, sell, start_ns AS b0, coalesce(end_ns, e) AS b1 FROM ep, m WHERE coalesce(end_ns, e) > start_ns), x AS (
SELECT variant, coalesce(bool_or(b0 <= open_ns AND open_ns < b1), false) AS start_covered, CAST(floor(sum(CASE WHEN b0 IS NULL THEN 0 ELSE greatest(0, least(stop, b1) - greatest(open_ns, b0)) END)::DOUBLE * 1e6 / (stop - open_ns)) AS BIGINT) AS coverage
FROM a LEFT JOIN b ON b.pair = a.pair AND b.buy = a.buy AND b.sell = a.sell AND b0 < stop AND b1 > open_ns GROUP BY variant, a.pair, a.buy, a.sell, notional, open_ns, stop)
SELECT variant, count(*) AS n, count(*) FILTER (start_covered) AS covered_starts, CAST(floor(sum(coverage) / count(*)) AS BIGINT) AS mean_coverage FROM x GROUP BY variant"""


def route_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matched prices of one requested route, at each notional."""
    levels = common.live_levels(spark, sf_dir).where("pair = 'P1-USD' and venue in ('v0', 'v2')")
    rows = pricing.matched_routes(levels, market.notionals(spark), market.fees(spark)).where("buy = 'v0' and sell = 'v2'")
    return rows.select("pair", "buy", "sell", "notional", "gross", "net", F.col("gross").isNull().alias("insufficient_depth"))


ROUTE_SQL = f"WITH {pricing_queries.MATCHED} SELECT pair, buy, sell, notional, gross, net, gross IS NULL AS insufficient_depth FROM mr WHERE pair = 'P1-USD' AND buy = 'v0' AND sell = 'v2'"

QUERIES = {
    "store_retention": (store_retention, RETENTION_SQL),
    "fill_sessions": (fill_sessions, SESSIONS_SQL),
    "fill_upsert": (fill_upsert, UPSERT_SQL),
    "fill_rate_by_config": (fill_rate_by_config, BY_CONFIG_SQL),
    "fill_session_minutes": (fill_session_minutes, MINUTES_SQL),
    "fill_orphans": (fill_orphans, ORPHANS_SQL),
    "lead_lag_sensitivity": (lead_lag_sensitivity, SENSITIVITY_SQL),
    "lag_runner_up": (lag_runner_up, RUNNER_SQL),
    "gate_shares": (gate_shares, GATE_SHARES_SQL),
    "band_lifetimes": (band_lifetimes, BAND_LIVES_SQL),
    "theoretical_overlap_all": (theoretical_overlap_all, OVERLAP_ALL_SQL),
    "route_prices": (route_prices, ROUTE_SQL),
}
