"""Queries over the research datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import leadlag, netsignal, research, stats
from tidemark.plans import common
from tidemark.session import derived, table
from tidemark.sources import market

E = common.EPISODES
_NOTIONALS = ", ".join(f"({n})" for n in market.NOTIONALS)
_FEES = ", ".join(f"('{v}', {f})" for v, f in sorted(market.FEES.items()))

LEDGERS = (
    E
    + f""", nl(notional) AS (VALUES {_NOTIONALS}), fe(venue, fee) AS (VALUES {_FEES}), le AS (
  SELECT ep.*, notional, peak_size * buy_price >= notional AS priced, CASE WHEN peak_size * buy_price >= notional THEN peak_spread - b.fee - s.fee END AS net
  FROM ep JOIN fe b ON b.venue = buy JOIN fe s ON s.venue = sell, nl
)"""
)


def _ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.ledgers(common.episode_store(spark, sf_dir).episodes(), market.notionals(spark), market.fees(spark))


def survival_by_notional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.survival(_ledgers(spark, sf_dir))


SURVIVAL_SQL = f"""WITH {LEDGERS} SELECT notional, quote, count(*) AS observations, count(*) FILTER (priced) AS priced, count(*) FILTER (NOT priced) AS insufficient,
  count(*) FILTER (net > 0) AS survivors, sum(CASE WHEN net > 0 THEN CAST(floor(notional * net / 100000000) AS BIGINT) ELSE 0 END)::BIGINT AS net_profit FROM le GROUP BY notional, quote"""


def fee_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("halved", v, f // 2) for v, f in market.FEES.items()] + [("full", v, f) for v, f in market.FEES.items()] + [("without_v2", v, f) for v, f in market.FEES.items() if v != "v2"]
    return research.fee_scenario(common.episode_store(spark, sf_dir).episodes(), spark.createDataFrame(rows, "scenario string, venue string, fee long"))


_SCENARIOS = ", ".join(
    f"('{s}', '{v}', {f})"
    for s, rows in {"halved": {v: f // 2 for v, f in market.FEES.items()}, "full": market.FEES, "without_v2": {v: f for v, f in market.FEES.items() if v != "v2"}}.items()
    for v, f in rows.items()
)
SCENARIO_SQL = f"""WITH {E}, sc(scenario, venue, fee) AS (VALUES {_SCENARIOS}), r AS (
  SELECT n.scenario, quote, buy_price * peak_size AS notional, peak_spread - b.fee - s.fee AS net FROM ep CROSS JOIN (SELECT DISTINCT scenario FROM sc) n
  LEFT JOIN sc b ON b.scenario = n.scenario AND b.venue = buy LEFT JOIN sc s ON s.scenario = n.scenario AND s.venue = sell)
SELECT scenario, quote, count(*) AS episodes, count(*) FILTER (net IS NULL) AS unpriced, count(*) FILTER (net > 0) AS survivors,
  sum(CASE WHEN net > 0 THEN CAST(floor(notional * net / 100000000) AS BIGINT) ELSE 0 END)::BIGINT AS net_profit FROM r GROUP BY scenario, quote"""


def episode_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = common.episode_store(spark, sf_dir).episodes()
    spreads = stats.percentiles(found, ["buy", "sell"], "peak_spread", {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    reasons = found.groupBy("buy", "sell").agg(F.count_if(F.col("close_reason") == "spread_closed").alias("spread_closed"), F.count_if(F.col("close_reason") == "book_ineligible").alias("ineligible"), F.sum("peak_profit").alias("profit"))
    return spreads.join(reasons, ["buy", "sell"])


SUMMARY_SQL = f"""WITH {E}, l AS (SELECT buy, sell, list(peak_spread ORDER BY peak_spread) AS v, count(*) FILTER (close_reason = 'spread_closed') AS spread_closed,
  count(*) FILTER (close_reason = 'book_ineligible') AS ineligible, sum(peak_profit)::BIGINT AS profit FROM ep GROUP BY buy, sell)
SELECT buy, sell, len(v) AS n, {", ".join(f"v[1 + least(len(v) - 1, CAST(floor(len(v) * {f}) AS BIGINT))] AS {n}" for n, f in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99)))}, v[-1] AS longest, spread_closed, ineligible, profit FROM l"""


def _band_sql(value: str) -> str:
    edges = " ".join(f"WHEN {value} <= {e} THEN {k}" for k, e in enumerate(research.BAND_EDGES_MS))
    return f"CASE WHEN {value} IS NULL THEN -1 {edges} ELSE {len(research.BAND_EDGES_MS)} END"


_OLDEST = "CASE WHEN buy_age IS NOT NULL AND sell_age IS NOT NULL THEN greatest(buy_age, sell_age) END"


def age_skew_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.route_table(spark, sf_dir)
    return research.band_table(rows, common.episode_store(spark, sf_dir).episodes(), spark)


BANDS_SQL = f"""WITH {E}, k AS (SELECT unnest(['age', 'skew']) AS dimension, r.band FROM range({len(research.BAND_EDGES_MS) + 1}) r(band)),
ev AS (SELECT dimension, {_band_sql("v // 1000000")} AS band, count(*) AS evaluations FROM (SELECT 'age' AS dimension, {_OLDEST} AS v FROM rt UNION ALL SELECT 'skew', skew FROM rt) GROUP BY ALL),
op AS (SELECT dimension, {_band_sql("v // 1000000")} AS band, count(*) AS opened, count(*) FILTER (close_reason = 'book_ineligible') AS ineligible, max(life) AS longest
  FROM (SELECT 'age' AS dimension, {_OLDEST} AS v, close_reason, end_ns - start_ns AS life FROM ep UNION ALL SELECT 'skew', skew, close_reason, end_ns - start_ns FROM ep) GROUP BY ALL)
SELECT dimension, band::INTEGER AS band, coalesce(evaluations, 0) AS evaluations, coalesce(opened, 0) AS opened, coalesce(ineligible, 0) AS ineligible, coalesce(opened, 0) * 1000000 // evaluations AS open_rate, longest
FROM (SELECT dimension, band FROM k UNION SELECT dimension, band FROM ev WHERE band = -1) LEFT JOIN ev USING (dimension, band) LEFT JOIN op USING (dimension, band)"""


def gate_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    cutoffs = spark.createDataFrame([(h * market.NS_HOUR,) for h in (1, 2, 4, 6)], "cutoff long")
    return research.gate_sensitivity(_ledgers(spark, sf_dir).where(F.col("notional") == market.NOTIONALS[0]), cutoffs)


GATES_SQL = f"""WITH {LEDGERS}, o AS (SELECT *, {_OLDEST} AS oldest FROM le WHERE notional = {market.NOTIONALS[0]}), c(cutoff) AS (VALUES {", ".join(f"({h * market.NS_HOUR})" for h in (1, 2, 4, 6))})
SELECT cutoff, quote, count(*) FILTER (oldest <= cutoff) AS retained, count(*) FILTER (oldest > cutoff) AS rejected, count(*) FILTER (oldest IS NULL) AS unknown,
  count(*) FILTER (oldest <= cutoff AND net > 0) AS survivors, sum(CASE WHEN oldest <= cutoff THEN peak_profit ELSE 0 END)::BIGINT AS profit FROM o, c GROUP BY cutoff, quote"""

SIGNALS = (
    E
    + f""", nl(notional) AS (VALUES {_NOTIONALS}), fe(venue, fee) AS (VALUES {_FEES}), sg0 AS (
  SELECT pair, buy, sell, notional, ns, event_id, st AS state, CASE WHEN st = 'priced' THEN spread - bf - sfee END AS net FROM (
    SELECT rt.*, notional, b.fee AS bf, s.fee AS sfee, CASE WHEN state = 'absent' THEN 'ineligible' WHEN size * ask < notional THEN 'insufficient_depth' ELSE 'priced' END AS st
    FROM rt JOIN fe b ON b.venue = buy JOIN fe s ON s.venue = sell, nl)
), sg AS (
  SELECT pair, buy, sell, notional, ns, event_id, state, net FROM (
    SELECT *, lag(state) OVER w AS s0, lag(net) OVER w AS n0 FROM sg0 WINDOW w AS (PARTITION BY pair, buy, sell, notional ORDER BY ns, event_id))
  WHERE s0 IS NULL OR s0 <> state OR n0 IS DISTINCT FROM net
)"""
)


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return netsignal.signals(common.route_table(spark, sf_dir, "moved"), market.notionals(spark), market.fees(spark))


def net_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir)


SIGNAL_SQL = f"WITH {SIGNALS} SELECT * FROM sg"
VARIANTS = [("plain", 0, 0, 0), ("detector", common.THRESHOLD, 0, 0), ("hysteresis", 200_000, 300_000, 0), ("delayed", 0, 0, market.NS_HOUR)]


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return netsignal.intervals(_signals(spark, sf_dir), spark.createDataFrame(VARIANTS, "variant string, threshold long, hysteresis long, delay long"))


def net_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _intervals(spark, sf_dir)


INTERVALS = (
    SIGNALS
    + f""", va(variant, threshold, hysteresis, delay) AS (VALUES {", ".join(str(v) for v in VARIANTS)}), fl AS (
  SELECT *, CASE WHEN net > threshold THEN 1 WHEN state <> 'priced' OR net <= threshold - hysteresis THEN 0 END AS flag FROM sg, va
), lt AS (
  SELECT *, coalesce(last_value(flag IGNORE NULLS) OVER w, 0) AS lit, lead(ns) OVER w AS next_ns, lead(state) OVER w AS next_state FROM fl WINDOW w AS (PARTITION BY variant, pair, buy, sell, notional ORDER BY ns, event_id)
), rn AS (
  SELECT *, sum(ch) OVER (PARTITION BY variant, pair, buy, sell, notional ORDER BY ns, event_id) AS run FROM (
    SELECT *, CASE WHEN lit <> coalesce(lag(lit) OVER (PARTITION BY variant, pair, buy, sell, notional ORDER BY ns, event_id), 0) THEN 1 ELSE 0 END AS ch FROM lt)
), iv AS (
  SELECT variant, pair, buy, sell, notional, open_ns + delay AS open_ns, l.n AS close_ns, peak_net, l.net AS last_net,
    CASE WHEN l.s IS NULL THEN 'end_of_capture' WHEN l.s = 'priced' THEN 'spread_closed' WHEN l.s = 'ineligible' THEN 'invalidated' ELSE 'insufficient_depth' END AS close_reason
  FROM (SELECT variant, pair, buy, sell, notional, run, delay, min(ns) AS open_ns, max(net) AS peak_net, arg_max({{'n': next_ns, 's': next_state, 'net': net}}, (ns, event_id)) AS l FROM rn WHERE lit = 1 GROUP BY ALL)
  WHERE l.n IS NULL OR l.n > open_ns + delay
)"""
)
INTERVALS_SQL = f"WITH {INTERVALS} SELECT * FROM iv"


def theoretical_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = market.quotes(spark, sf_dir).agg(F.max("ns")).first()[0] or 0
    return netsignal.overlap(_intervals(spark, sf_dir).where("variant = 'plain'"), common.episode_store(spark, sf_dir).episodes(), market.NS_HOUR, end)


OVERLAP_SQL = f"""WITH {INTERVALS}, m AS (SELECT max(ns) AS e FROM q), a AS (SELECT *, coalesce(close_ns, e) AS stop FROM iv, m WHERE variant = 'plain' AND coalesce(close_ns, e) > open_ns),
b AS (SELECT pair, buy, sell, start_ns AS b0, coalesce(end_ns, e) AS b1 FROM ep, m WHERE coalesce(end_ns, e) > start_ns)
SELECT variant, a.pair, a.buy, a.sell, notional, open_ns, coalesce(bool_or(b0 <= open_ns AND open_ns < b1), false) AS start_covered,
  CAST(floor(sum(CASE WHEN b0 IS NULL THEN 0 ELSE greatest(0, least(stop, b1) - greatest(open_ns, b0)) END)::DOUBLE * 1e6 / (stop - open_ns)) AS BIGINT) AS coverage
FROM a LEFT JOIN b ON b.pair = a.pair AND b.buy = a.buy AND b.sell = a.sell AND b0 < stop AND b1 > open_ns GROUP BY variant, a.pair, a.buy, a.sell, notional, open_ns, stop"""

BIN = 2 * market.NS_HOUR
LAGS = [k * market.NS_HOUR for k in range(-6, 7)]
VENUE_PAIRS = [("v0", "v1"), ("v0", "v2"), ("v1", "v2")]

TICKS = (
    common.TRUSTED
    + f""", tk AS (
  SELECT pair, venue, ns // {BIN} AS bin, max({{'ns': ns, 'id': event_id, 'm': bid + ask}}) AS t FROM tr WHERE trusted AND bid > 0 AND ask > 0 AND ns > 0 GROUP BY ALL
), ti AS (SELECT pair, venue, bin, t.ns AS ns, t.m AS mid2 FROM tk
), re AS (
  SELECT pair, venue, start_ns, ns AS end_ns, ln(mid2 / p0) AS value FROM (
    SELECT *, lag(mid2) OVER w AS p0, lag(ns) OVER w AS start_ns FROM ti WINDOW w AS (PARTITION BY pair, venue ORDER BY ns)) WHERE start_ns < ns
)"""
)


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a book and bin, made once for all queries of all quotes."""
    return derived(table(spark, sf_dir, "events"), "ticks", lambda: leadlag.ticks(common.trusted_quotes(spark, sf_dir), BIN))


def tick_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ticks(spark, sf_dir)


TICKS_SQL = f"WITH {TICKS} SELECT * FROM ti"


def return_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leadlag.returns(_ticks(spark, sf_dir)).withColumn("value", F.round("value", 9))


RETURNS_SQL = f"WITH {TICKS} SELECT pair, venue, start_ns, end_ns, round(value, 9) AS value FROM re"


def _sides(rows: DataFrame, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Return series of the left and the right venue of each unordered pair of venues."""
    both = F.broadcast(spark.createDataFrame(VENUE_PAIRS, "l string, r string"))
    left = rows.join(both, F.col("venue") == F.col("l")).drop("venue")
    right = rows.join(both, F.col("venue") == F.col("r")).drop("venue")
    return left, right


_KEYS = ["pair", "l", "r"]


def _lags(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in LAGS], "lag long")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _sides(leadlag.returns(_ticks(spark, sf_dir)), spark)
    return leadlag.contrast(left, right, _lags(spark), _KEYS, 12 * market.NS_HOUR)


def hy_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).select(*_KEYS, "lag", "overlaps", F.round("contrast", 9).alias("contrast"), F.round("rho", 6).alias("rho"))


POINTS = (
    TICKS
    + f""", vp(l, r) AS (VALUES {", ".join(str(v) for v in VENUE_PAIRS)}), lg(lag) AS (VALUES {", ".join(f"({x})" for x in LAGS)}), a AS (SELECT re.*, l, r FROM re JOIN vp ON venue = l), b AS (SELECT re.*, l, r FROM re JOIN vp ON venue = r
), pt AS (
  SELECT k.pair, k.l, k.r, lg.lag, coalesce(n, 0) AS novl, coalesce(c, 0.0) AS contrast, CASE WHEN n > 0 AND va > 0 AND vb > 0 THEN c / sqrt(va * vb) END AS rho
  FROM (SELECT DISTINCT pair, l, r FROM a) k CROSS JOIN lg
  LEFT JOIN (SELECT a.pair, a.l, a.r, lag, count(*) AS n, sum(a.value * b.value) AS c FROM a JOIN b USING (pair, l, r), lg WHERE least(a.end_ns, b.end_ns - lag) > greatest(a.start_ns, b.start_ns - lag) GROUP BY ALL) s ON s.pair = k.pair AND s.l = k.l AND s.r = k.r AND s.lag = lg.lag
  JOIN (SELECT pair, l, r, sum(value * value) AS va FROM a GROUP BY ALL) x ON x.pair = k.pair AND x.l = k.l AND x.r = k.r
  JOIN (SELECT pair, l, r, sum(value * value) AS vb FROM b GROUP BY ALL) y ON y.pair = k.pair AND y.l = k.l AND y.r = k.r
)"""
)
HY_SQL = f'''WITH {POINTS} SELECT pair, l, r, lag, novl AS "overlaps", round(contrast, 9) AS contrast, round(rho, 6) AS rho FROM pt'''


def lead_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leader of each pair of venues, and by how much."""
    best = leadlag.best_lag(_points(spark, sf_dir), _KEYS, 10, market.NS_HOUR, LAGS[-1])
    leader = F.when(F.col("status") != "ok", F.lit(None)).when(F.col("lag") > 0, F.col("l")).when(F.col("lag") < 0, F.col("r"))
    return best.withColumn("leader", leader)


LEAD_SQL = f"""WITH {POINTS}, g AS (SELECT *, round(abs(rho), 10) AS h FROM pt WHERE novl >= 10 AND rho IS NOT NULL),
t AS (SELECT pair, l, r, count(*) AS ties, min({{'away': abs(lag), 'lag': lag, 'rho': rho}}) AS b FROM g JOIN (SELECT pair, l, r, max(h) AS h FROM g GROUP BY ALL) USING (pair, l, r, h) GROUP BY pair, l, r),
s AS (SELECT k.*, b.lag AS lag, round(b.rho, 6) AS rho, CASE WHEN b IS NULL THEN 'insufficient_data' WHEN ties > 1 THEN 'tied_maximum' WHEN b.away >= {LAGS[-1]} THEN 'maximum_at_grid_edge' ELSE 'ok' END AS status
  FROM (SELECT DISTINCT pair, l, r FROM pt) k LEFT JOIN t USING (pair, l, r))
SELECT pair, l, r, status, lag, rho, CASE WHEN status <> 'ok' THEN NULL WHEN lag > 0 THEN l WHEN lag < 0 THEN r END AS leader FROM s"""


def window_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best lags of four equal parts of the time, and whether the parts that have one agree on its sign."""
    rows = leadlag.returns(_ticks(spark, sf_dir))
    bounds = F.broadcast(rows.agg(F.min("start_ns").alias("lo"), F.max("end_ns").alias("hi")))
    parts = rows.crossJoin(bounds).withColumn("part", leadlag.part_of(F.col("start_ns"), F.col("lo"), F.col("hi"), 4)).drop("lo", "hi")
    left, right = _sides(parts, spark)
    keys = [*_KEYS, "part"]
    best = leadlag.best_lag(leadlag.contrast(left, right, _lags(spark), keys, 12 * market.NS_HOUR), keys, 5, market.NS_HOUR, LAGS[-1])
    ok = F.col("status") == "ok"
    signs = best.groupBy(*_KEYS).agg(F.count_if(ok).alias("ok_parts"), F.count_distinct(F.when(ok, F.signum("lag"))).alias("signs"))
    return signs.select(*_KEYS, "ok_parts", F.when(F.col("ok_parts") >= 2, F.col("signs") == 1).alias("stable"))


STABILITY_SQL = f"""WITH {TICKS}, vp(l, r) AS (VALUES {", ".join(str(v) for v in VENUE_PAIRS)}), lg(lag) AS (VALUES {", ".join(f"({x})" for x in LAGS)}
), rp AS (SELECT re.*, least(3, (start_ns - lo) * 4 // (hi - lo + 1)) AS part FROM re, (SELECT min(start_ns) AS lo, max(end_ns) AS hi FROM re)
), a AS (SELECT rp.*, l, r FROM rp JOIN vp ON venue = l), b AS (SELECT rp.*, l, r FROM rp JOIN vp ON venue = r
), x AS (SELECT pair, l, r, part, sum(value * value) AS va FROM a GROUP BY ALL), y AS (SELECT pair, l, r, part, sum(value * value) AS vb FROM b GROUP BY ALL
), s AS (SELECT a.pair, a.l, a.r, a.part, lag, count(*) AS n, sum(a.value * b.value) AS c FROM a JOIN b USING (pair, l, r, part), lg WHERE least(a.end_ns, b.end_ns - lag) > greatest(a.start_ns, b.start_ns - lag) GROUP BY ALL
), pt AS (SELECT pair, l, r, part, lag, n, round(abs(c / sqrt(va * vb)), 10) AS h FROM x JOIN y USING (pair, l, r, part) LEFT JOIN s USING (pair, l, r, part) WHERE va > 0 AND vb > 0
), g AS (SELECT * FROM pt WHERE n >= 5), m AS (SELECT pair, l, r, part, count(*) AS ties, min({{'away': abs(lag), 'lag': lag}}) AS b FROM g JOIN (SELECT pair, l, r, part, max(h) AS h FROM g GROUP BY ALL) USING (pair, l, r, part, h) GROUP BY ALL
), k AS (SELECT DISTINCT pair, l, r, part FROM x JOIN y USING (pair, l, r, part)), o AS (SELECT k.*, b.lag AS lag, coalesce(ties = 1 AND b.away < {LAGS[-1]}, false) AS ok FROM k LEFT JOIN m USING (pair, l, r, part))
SELECT pair, l, r, count(*) FILTER (ok) AS ok_parts, CASE WHEN count(*) FILTER (ok) >= 2 THEN count(DISTINCT sign(lag)) FILTER (ok) = 1 END AS stable FROM o GROUP BY pair, l, r"""

SURROGATES = 20  # of each sign


def surrogate_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lead_lag with the null of circular shifts of the right series as the last step of its status."""
    left, right = _sides(leadlag.returns(_ticks(spark, sf_dir)), spark)
    shifts = spark.createDataFrame([(x,) for x in leadlag.surrogate_shifts(LAGS[-1], SURROGATES)], "shift long")
    rows = leadlag.surrogate_null(left, right, _lags(spark), shifts, _KEYS, 10, market.NS_HOUR, LAGS[-1], 12 * market.NS_HOUR)
    return rows.select(*_KEYS, "status", "lag", "rho", "surrogates", *[F.round(c, 6).alias(c) for c in ("p95", "exceedance", "p_value")])


QUERIES = {
    "survival_by_notional": (survival_by_notional, SURVIVAL_SQL),
    "fee_scenario": (fee_scenario, SCENARIO_SQL),
    "episode_summary": (episode_summary, SUMMARY_SQL),
    "age_skew_bands": (age_skew_bands, BANDS_SQL),
    "gate_sensitivity": (gate_sensitivity, GATES_SQL),
    "net_signal": (net_signal, SIGNAL_SQL),
    "net_intervals": (net_intervals, INTERVALS_SQL),
    "theoretical_overlap": (theoretical_overlap, OVERLAP_SQL),
    "tick_series": (tick_series, TICKS_SQL),
    "return_intervals": (return_intervals, RETURNS_SQL),
    "hy_contrast": (hy_contrast, HY_SQL),
    "lead_lag": (lead_lag, LEAD_SQL),
    "window_stability": (window_stability, STABILITY_SQL),
    "surrogate_null": (surrogate_null, None),
}
