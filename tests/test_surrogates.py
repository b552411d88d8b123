"""The surrogate null of lead and lag: a planted lead is told from noise, and all equals brute force."""

import math
import random

import pytest

from tidemark.operators import leadlag

LAGS = [100 * k for k in range(-5, 6)]
LEAST = 30


def series(rng, planted):
    walk, other = [0.0], [0.0]
    for _ in range(6000):
        walk.append(walk[-1] + rng.gauss(0, 0.001))
        other.append(other[-1] + rng.gauss(0, 0.001))
    out = {}
    for side, lag in (("l", 0), ("r", 200)):
        at = sorted({rng.randrange(300, 59_000) for _ in range(250)})
        own = walk if side == "l" or planted else other
        ticks = [(t, own[(t - lag) // 10]) for t in at]
        out[side] = [(a, b, y - x) for (a, x), (b, y) in zip(ticks, ticks[1:], strict=False)]
    return out


def height(left, right):
    """The greatest |rho| over the grid, or None."""
    best = None
    for lag in LAGS:
        pairs = [a * b for a0, a1, a in left for b0, b1, b in right if min(a1, b1 - lag) > max(a0, b0 - lag)]
        if len(pairs) >= LEAST:
            rho = abs(sum(pairs)) / math.sqrt(sum(x[2] ** 2 for x in left) * sum(x[2] ** 2 for x in right))
            best = max(rho, best or 0)
    return best


def test_a_planted_lead_is_told_from_noise(spark):
    rng = random.Random(5)
    rets = {"planted": series(rng, True), "noise": series(rng, False), "short": {s: [(0, 10, 0.1), (10, 20, 0.2)] for s in "lr"}}
    schema = "k string, start_ns long, end_ns long, value double"
    left, right = (spark.createDataFrame([(k, *x) for k, v in rets.items() for x in v[s]], schema) for s in "lr")
    shifts = leadlag.surrogate_shifts(500, 20)
    assert sorted(shifts)[::39] == [-50_500, 50_500] and min(map(abs, shifts)) == 3000 and len(set(shifts)) == 40
    frame = lambda xs, name: spark.createDataFrame([(x,) for x in xs], f"{name} long")
    got = {r.k: r for r in leadlag.surrogate_null(left, right, frame(LAGS, "lag"), frame(shifts, "shift"), ["k"], LEAST, 100, 500, 400).collect()}
    assert (got["planted"].status, got["planted"].lag) == ("ok", 200) and got["planted"].p_value == pytest.approx(1 / 41)
    assert got["noise"].status in ("null_not_rejected", "maximum_at_grid_edge")
    assert (got["short"].status, got["short"].surrogates, got["short"].p_value) == ("insufficient_data", 0, None)
    for k in ("planted", "noise"):
        if got[k].surrogates == 0:
            continue
        a, b = rets[k]["l"], rets[k]["r"]
        lo, hi = min(a[0][0], b[0][0]), max(a[-1][1], b[-1][1])
        tops = []
        for shift in shifts:
            moved = [(lo + (x - lo + shift) % (hi - lo), y - x, v) for x, y, v in b]
            tops.append(height(a, [(s, s + d, v) for s, d, v in moved if s + d <= hi]))
        tops = sorted(x for x in tops if x is not None)
        times = sum(x >= height(a, b) for x in tops)
        assert got[k].surrogates == len(tops) and got[k].p95 == pytest.approx(tops[math.ceil(0.95 * len(tops)) - 1])
        assert got[k].exceedance == pytest.approx(times / len(tops)) and got[k].p_value == pytest.approx((times + 1) / (len(tops) + 1))


def test_too_few_surrogates_are_rejected():
    with pytest.raises(ValueError, match="at least 10"):
        leadlag.surrogate_shifts(500, 9)
