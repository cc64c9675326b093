"""Threshold fits and the sequential detector against a twin that keeps every peak."""

from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import peaks
from pulsegrid.functions.peaks import ALARM, GRID, run_drift, run_plain
from pulsegrid.operators import alerts as A
from pulsegrid.operators import spot
from pulsegrid.operators import threshold as T


def exact_shape(y):
    """(gamma, sigma) from a dense scan for stationary points, refined by bisection."""
    w = lambda t: (1 + np.log1p(t * y).mean()) * (1 / (1 + t * y)).mean() - 1
    best = (-np.log(y.mean()), 0.0, y.mean())
    left = -np.geomspace(1 / y.max() * (1 - 1e-6), 1e-3 / y.mean(), 4000)
    for grid in (left, np.geomspace(1e-3 / y.mean(), 300 / y.mean(), 4000)):
        values = np.array([w(t) for t in grid])
        for i in np.flatnonzero(np.sign(values[:-1]) != np.sign(values[1:])):
            a, b = grid[i], grid[i + 1]
            for _ in range(60):
                m = (a + b) / 2
                a, b = (m, b) if np.sign(w(m)) == np.sign(w(a)) else (a, m)
            gamma = np.log1p(a * y).mean()
            sigma = gamma / a
            best = max(best, (-np.log(sigma) - gamma, gamma, sigma))
    return float(np.clip(best[1], -0.5, 0.5)), best[2]


def exact_level(init, y, n, risk):
    gamma, sigma = exact_shape(y)
    r = n * risk / len(y)
    offset = sigma / gamma * (r**-gamma - 1) if abs(gamma) > 1e-8 else -sigma * np.log(r)
    return min(init + offset, init + 0.5 * abs(init))


def exact_stream(base, live, q, risk):
    init = np.sort(base)[int(q * len(base))]
    peaks = list(base[base > init] - init)
    level, accepted, out = exact_level(init, np.array(peaks), len(base), risk), 0, []
    for x in live:
        if x > init and x > level:
            out.append(("ALARM", level))
            continue
        if x > init:
            peaks.append(x - init)
            level = exact_level(init, np.array(peaks), len(base) + accepted, risk)
        out.append(("ABNORMAL" if x > init else "NORMAL", level))
        accepted += 1
    return out


@pytest.mark.parametrize("name", ["normal", "exponential", "pareto", "uniform"])
def test_fit_is_near_the_exact_maximum(spark, name):
    rng = np.random.default_rng(11)
    draw = {"normal": rng.normal, "exponential": rng.exponential, "pareto": lambda size: rng.pareto(4, size), "uniform": rng.uniform}[name]
    x = draw(size=4000)
    df = spark.createDataFrame([("s", float(v)) for v in x], "series string, score double")
    r = T.fit_thresholds(df, ["series"], "score", 0.95, 1e-3).first()
    init = np.sort(x)[int(0.95 * 4000)]
    assert r["init"] == init and r["peaks"] == (x > init).sum()
    assert abs(r["threshold"] - exact_level(init, x[x > init] - init, 4000, 1e-3)) < 1e-2


def test_lower_tail_mirrors_upper(spark):
    x = np.random.default_rng(1).normal(size=999)
    up = spark.createDataFrame([("s", float(v)) for v in x], "series string, score double")
    down = up.withColumn("score", -F.col("score"))
    # The cap holds for upper tails only, so the risk keeps the level below it.
    a = T.fit_thresholds(up, ["series"], quantile=0.98, risk=1e-2, tail="upper").first()
    b = T.fit_thresholds(down, ["series"], quantile=0.98, risk=1e-2, tail="lower").first()
    assert a["init"] == -b["init"] and a["threshold"] < 1.5 * a["init"]
    assert abs(a["threshold"] + b["threshold"]) < 1e-9


def test_no_peaks_gives_the_initial_threshold(spark):
    df = spark.createDataFrame([("s", 1.0)] * 50, "series string, score double")
    r = T.fit_thresholds(df, ["series"]).first()
    assert (r["peaks"], r["threshold"], r["gamma"]) == (0, 1.0, None)


def stream_case(spark):
    rng = np.random.default_rng(123)
    base, live = rng.normal(size=200), rng.normal(size=300)
    rows = [("s", i, float(v)) for i, v in enumerate(np.r_[base, live])]
    return base, live, spark.createDataFrame(rows, "series string, idx long, score double")


def found(spark, df, depth):
    base, live = df.where("idx < 200"), df.where("idx >= 200")
    states = spot.start_states(base, ["series"], ["idx"], "score", 0.9, 1e-2, depth=depth)
    return [(r["status"], r["threshold"]) for r in spot.detect(live, states, ["series"], ["idx"], "score", depth).orderBy("idx").collect()]


def test_stream_equals_twin(spark):
    base, live, df = stream_case(spark)
    got, want = found(spark, df, 0), exact_stream(base, live, 0.9, 1e-2)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert max(abs(g[1] - w[1]) for g, w in zip(got, want)) < 1e-2
    assert "ALARM" in [g[0] for g in got]


@pytest.mark.parametrize("depth", [0, 10])
def test_split_series_equal_one_pass(spark, depth):
    _, _, df = stream_case(spark)
    whole = found(spark, df, depth)
    spark.conf.set("spark.pulsegrid.maxGroupRows", "60")
    try:
        parts = found(spark, df, depth)
    finally:
        spark.conf.unset("spark.pulsegrid.maxGroupRows")
    assert [a[0] for a in whole] == [b[0] for b in parts]
    assert np.allclose([a[1] for a in whole], [b[1] for b in parts], atol=1e-9)


def test_grid_is_the_same_on_both_sides(spark):
    got = [r[0] for r in spark.range(T.GRID_SIZE).select("id", T.grid_value(F.col("id")).alias("g")).orderBy("id").select("g").collect()]
    assert np.allclose(got, GRID, rtol=1e-12)


def brute_alerts(crossed, persistence, pause):
    active = cooldown = 0
    out = []
    for i, c in enumerate(crossed):
        if not c:
            active = 0
        elif cooldown > 0:
            cooldown -= 1
        else:
            active += 1
            if active >= persistence:
                out.append(i)
                active, cooldown = 0, pause
    return out


@pytest.mark.parametrize("size", [None, "20"])
@pytest.mark.parametrize("persistence,pause", [(1, 0), (2, 3), (3, 1)])
def test_alerts_equal_brute_force(spark, size, persistence, pause):
    values = np.random.default_rng(9).uniform(0, 100, 300)
    df = spark.createDataFrame([("svc", "cpu", i, float(v)) for i, v in enumerate(values)], "service string, metric string, idx long, value double")
    rule = A.AlertRule("cpu", "warn", "WARN", 40.0, persistence, pause)
    if size:
        spark.conf.set("spark.pulsegrid.maxGroupRows", size)
    try:
        got = sorted(r["idx"] for r in A.alerts(A.crossings(df, [rule]), ["service", "metric"], ["idx"]).collect())
    finally:
        spark.conf.unset("spark.pulsegrid.maxGroupRows")
    assert got == brute_alerts(values >= 40, persistence, pause)


def climbing(spark):
    """Scores that climb by steps: what a run accepts decides whether the next one alarms, so assumed states stay wrong."""
    rng = np.random.default_rng(11)
    base = rng.exponential(size=200) + 1
    live = rng.exponential(size=900) * np.linspace(1, 6, 900) + 1
    rows = [("s", i, float(v)) for i, v in enumerate(np.r_[base, live])]
    return spark.createDataFrame(rows, "series string, idx long, score double")


@pytest.mark.parametrize("depth", [0, 5])
def test_work_stays_linear_when_runs_depend_on_each_other(spark, monkeypatch, depth):
    df = climbing(spark)
    whole = found(spark, df, depth)
    written, ordered_passes = [], []
    monkeypatch.setattr(spot, "durable", lambda df, name="cut", real=spot.durable: written.append(name) or real(df, name))
    monkeypatch.setattr(spot, "_in_order", lambda *a, real=spot._in_order: ordered_passes.append(1) or real(*a))
    spark.conf.set("spark.pulsegrid.maxGroupRows", "60")
    try:
        parts = found(spark, df, depth)
    finally:
        spark.conf.unset("spark.pulsegrid.maxGroupRows")
    assert [a[0] for a in whole] == [b[0] for b in parts]
    assert np.allclose([a[1] for a in whole], [b[1] for b in parts], atol=1e-9)
    assert {"ALARM", "ABNORMAL"} <= {a[0] for a in whole}
    # Some 30 runs, each of which would take a round of its own; two rounds and one pass in order instead.
    assert ordered_passes == [1] and written.count("changes") == spot.ROUNDS


def plain_drift(state, scores, update_with_alarm=False):
    """The drift detector row by row."""
    status, thresholds, recent = [], [], deque(state.recent, maxlen=max(len(state.recent), 1))
    for score in scores.tolist():
        mean = sum(recent) / len(recent) if recent else 0.0
        alarm = 0
        if state.sign * (score - mean - state.init) > 0:
            alarm = peaks._judge(state, score - mean, update_with_alarm)
        status.append(alarm)
        thresholds.append(state.threshold + mean)
        if alarm != peaks.ALARM:
            state.accepted += 1
            recent.append(score)
    return status, thresholds, list(recent)


@pytest.mark.parametrize("depth", [0, 1, 7, 30])
@pytest.mark.parametrize("cuts", [[], [1, 2, 500], list(range(50, 1000, 50))])
@pytest.mark.parametrize("update_with_alarm", [False, True])
def test_drift_jumps_equal_row_by_row(depth, cuts, update_with_alarm):
    rng = np.random.default_rng(depth)
    scores = rng.exponential(size=1000) * np.where(np.arange(1000) % 97 < 5, 6, 1)
    start = lambda: peaks.PeakState(init=1.5, sign=1, risk=1e-2, baseline=100, threshold=2.5, total=100, recent=tuple([1.0] * depth))
    want_state, state = start(), start()
    want = plain_drift(want_state, scores, update_with_alarm)
    got = [peaks.run_drift(state, part, update_with_alarm) for part in np.split(scores, cuts)]
    assert np.concatenate([g[0] for g in got]).tolist() == want[0] and {0, 1, 2} <= set(want[0])
    assert np.allclose(np.concatenate([g[1] for g in got]), want[1], rtol=1e-9)
    assert np.allclose(state.recent, want[2]) and state.accepted == want_state.accepted and state.total == want_state.total


@pytest.mark.parametrize("seed", range(30))
def test_firing_by_runs_equals_row_by_row(seed):
    rng = np.random.default_rng(seed)
    for _ in range(60):
        persistence, pause = int(rng.integers(0, 5)), int(rng.integers(0, 5))
        crossed = rng.uniform(size=int(rng.integers(0, 40))) < rng.choice([0.2, 0.6, 0.95])
        for active, cooldown in A._all_states(persistence, pause):
            state, want = (active, cooldown), []
            for c in crossed.tolist():
                *state, hit = A.step(c, *state, persistence, pause)
                want.append(hit)
            got, *after = A.fire(crossed, active, cooldown, persistence, pause)
            assert got.tolist() == want and after == list(state)
