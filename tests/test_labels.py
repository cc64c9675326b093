"""Interval labels, periods, segments and overlaps on hand-written cases and against brute force."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import evaluate as E
from pulsegrid.operators import labels as L
from pulsegrid.operators import ordered, timegrid
from pulsegrid.operators.windows import sliding_windows, window_label
from pulsegrid.sources import readers

T0 = datetime(2024, 5, 1)


def at(s):
    return T0 + timedelta(seconds=s)


def points(spark, seconds):
    return spark.createDataFrame([(at(s),) for s in seconds], "ts timestamp_ntz")


def spans(spark, faults=(), normal=()):
    rows = [(at(a), at(b), 1) for a, b in faults] + [(at(a), at(b), 0) for a, b in normal]
    return spark.createDataFrame(rows, "start_ts timestamp_ntz, end_ts timestamp_ntz, label int")


def labels_of(df):
    return [r["label"] for r in df.orderBy("ts").collect()]


@pytest.fixture(params=["broadcast", "sweep"])
def way(request, spark):
    if request.param == "sweep":
        spark.conf.set("spark.pulsegrid.broadcastIntervals", "0")
        spark.conf.set("spark.pulsegrid.maxGroupRows", "40" if "brute" in request.node.name else "2")
    yield request.param
    spark.conf.unset("spark.pulsegrid.broadcastIntervals")
    spark.conf.unset("spark.pulsegrid.maxGroupRows")


@pytest.mark.parametrize(
    "seconds,faults,normal,want",
    [
        ([0, 1, 2], [(1, 2)], [(0, 1), (2, 3)], [0, 1, 1]),
        ([0, 1, 2, 3, 4], [], [(1, 3)], [-1, 0, 0, 0, -1]),
        ([0, 1], [], [(0, 1)], [0, 0]),
        ([0, 5], [], [], [0, 0]),
    ],
)
def test_hand_cases(spark, way, seconds, faults, normal, want):
    assert labels_of(L.label_points(points(spark, seconds), spans(spark, faults, normal))) == want


def random_spans(rng, n, longest):
    starts = rng.integers(0, 900, n)
    return [(int(s), int(s + rng.integers(0, longest))) for s in starts]


def test_labels_equal_brute_force(spark, way):
    rng = np.random.default_rng(2)
    faults, normal = random_spans(rng, 40, 15), random_spans(rng, 6, 200)
    seconds = sorted(set(rng.integers(0, 1100, 300).tolist()))
    want = [1 if any(a <= s <= b for a, b in faults) else 0 if any(a <= s <= b for a, b in normal) else -1 for s in seconds]
    assert labels_of(L.label_points(points(spark, seconds), spans(spark, faults, normal))) == want


def test_overlaps_equal_brute_force(spark, way):
    rng = np.random.default_rng(3)
    faults, normal = random_spans(rng, 40, 30), random_spans(rng, 10, 60)
    wins = [(i, at(s), at(s + 20)) for i, s in enumerate(range(0, 1000, 17))]
    df = spark.createDataFrame(wins, "window_id long, window_start timestamp_ntz, window_end timestamp_ntz")
    got = {r["window_id"]: (r["faults"], r["normals"]) for r in L.overlap_counts(df, spans(spark, faults, normal)).collect()}
    hit = lambda s, xs: sum(a <= s + 20 and b >= s for a, b in xs)
    assert got == {i: (hit(s, faults), hit(s, normal)) for i, s in enumerate(range(0, 1000, 17))}
    pairs = L.overlapping_faults(df, spans(spark, faults, normal), bin_seconds=13)
    assert pairs.count() == sum(hit(s, faults) for s in range(0, 1000, 17))


def test_unlabelled_periods(spark, way):
    df = points(spark, [0, 1, 2, 3, 10, 11, 20]).withColumn("label", F.when(F.second("ts") == 3, 0).otherwise(-1))
    got = [tuple(r) for r in L.unlabelled_periods(df).orderBy("start_ts").collect()]
    assert got == [(at(0), at(2), 3), (at(10), at(11), 2), (at(20), at(20), 1)]


def brute_segments(labels):
    out, start = [], None
    for i, y in enumerate(labels):
        if y == 1 and start is None:
            start = i
        elif y == 0 and start is not None:
            out.append((start, i - 1))
            start = None
    return out + ([(start, len(labels) - 1)] if start is not None else [])


@pytest.mark.parametrize("labels", [[0, 1, 1, 1, 0], [1, -1, 1, 0, -1, 1, -1], [0, 0], [-1, -1], [1] * 30 + [0] * 3 + [1, -1, -1]])
def test_segments(spark, way, labels):
    df = spark.createDataFrame(list(enumerate(labels)), "idx long, label int")
    assert [tuple(r) for r in L.segments(df).orderBy("start_idx").collect()] == brute_segments(labels)


def test_segment_metrics(spark):
    labels, alarms = [0, 1, 1, 0, 1, 0, 0], [1, 0, 1, 0, 0, 0, 1]
    df = spark.createDataFrame([(i, y, a) for i, (y, a) in enumerate(zip(labels, alarms))], "idx long, label int, alarm int")
    r = E.segment_metrics(df).first()
    assert (r["segments"], r["detected"], r["alarms"], r["valid_alarms"]) == (2, 1, 3, 1)
    assert abs(r["segment_f1"] - 2 * (1 / 3) * 0.5 / (1 / 3 + 0.5)) < 1e-12 and not r["meets_target"]
    c = E.confusion(df).first()
    assert c["tp"] + c["fp"] + c["tn"] + c["fn"] == 7


def test_ranking_of_one_class_is_zero(spark):
    r = E.ranking_metrics(spark.createDataFrame([(1, 0.5), (1, 0.2)], "label int, score double")).first()
    assert (r["roc_auc"], r["average_precision"]) == (0.0, 0.0)


@pytest.mark.parametrize("n,size,stride", [(20, 10, 1), (20, 10, 3), (9, 10, 1), (10, 10, 5), (57, 4, 3)])
def test_window_count(spark, small_groups, n, size, stride):
    df = spark.range(n).select(F.lit("s").alias("series"), F.col("id").alias("ts"), (F.col("id") % 5 - 3).cast("int").alias("y"))
    columns = {"steps": ("list", F.col("ts")), "lo": ("min", F.col("y")), "hi": ("max", F.col("y"))}
    rows = sliding_windows(df, ["series"], ["ts"], columns, size, stride).orderBy("win_id").collect()
    assert len(rows) == (max(0, (n - size) // stride + 1) if n >= size else 0)
    assert all(r["steps"] == list(range(i * stride, i * stride + size)) for i, r in enumerate(rows))


def test_window_label(spark):
    df = spark.createDataFrame([(0, 1), (-1, 1), (-1, 0), (0, 0)], "lo int, hi int")
    assert [r[0] for r in df.select(window_label(F.col("lo"), F.col("hi"))).collect()] == [1, 1, -1, 0]


def test_session_record(spark, folder):
    import json

    record = {
        "session_start": "2024-05-01T00:00:00Z", "session_end": "2024-05-01T01:00:00Z",
        "fault_events": [
            {"event_id": "1", "fault_type": "cpu", "start_ts": "2024-05-01T00:00:01Z", "end_ts": "2024-05-01T00:00:02Z", "params": {"load": 2}},
            {"event_id": "2", "start_ts": "2024-05-01T00:00:01Z"}, {"event_id": "3", "start_ts": "soon", "end_ts": "later"},
        ],
        "normal_windows": [{"start_ts": "2024-05-01T00:00:00+00:00", "end_ts": "2024-05-01T00:00:01Z"}],
    }
    for name, value in (("ok", record), ("bad", {k: v for k, v in record.items() if k != "normal_windows"})):
        with open(f"{folder}/{name}.json", "w") as f:
            json.dump(value, f)
    got = readers.session_intervals(readers.read_session(spark, f"{folder}/ok.json"))
    assert sorted(r["label"] for r in got.collect()) == [0, 1]
    with pytest.raises(Exception, match="normal_windows"):
        readers.session_intervals(readers.read_session(spark, f"{folder}/bad.json")).collect()


@pytest.mark.parametrize("sweep", ["points", "windows", "gaps"])
def test_a_busy_instant_is_split(spark, monkeypatch, sweep):
    """15,000 rows of one instant: no run of any sweep holds more than the limit, and labels are those of the instant."""
    busy = spark.range(15_000).select(F.lit(1_000).alias("sec"), "id").unionByName(spark.range(500).select((F.col("id") * 4).alias("sec"), (F.col("id") + 20_000).alias("id")))
    points = busy.select("id", F.timestamp_seconds("sec").alias("ts"))
    intervals = spark.createDataFrame([(900, 1_000, 1), (1_000, 1_100, 0), (100, 200, 0)], "a long, b long, label int").select(
        F.timestamp_seconds("a").alias("start_ts"), F.timestamp_seconds("b").alias("end_ts"), "label"
    )
    largest = []

    def watched(df, keys, order, group_rows=None, sizes=None, real=ordered.split_runs):
        runs = real(df, keys, order, group_rows, sizes)
        if runs is not None:
            largest.append(runs.groupBy(ordered.RUN).count().agg(F.max("count")).first()[0])
        return runs

    monkeypatch.setattr(ordered, "split_runs", watched)
    spark.conf.set("spark.pulsegrid.maxGroupRows", "2000")
    spark.conf.set(L.BROADCAST_INTERVALS, "1")
    try:
        if sweep == "points":
            labels = {r["label"]: r["count"] for r in L.label_points(points, intervals).groupBy("label").count().collect()}
            assert labels == {1: 15_000 + 26, 0: 25 + 26, -1: 500 - 77}
        elif sweep == "windows":
            windows = points.select(F.col("id").alias("window_id"), F.col("ts").alias("window_start"), F.col("ts").alias("window_end"))
            got = L.overlap_counts(windows, intervals).groupBy("faults", "normals").count().collect()
            assert {(r[0], r[1]): r[2] for r in got} == {(1, 1): 15_001, (1, 0): 25, (0, 1): 51, (0, 0): 423}
        else:
            got = timegrid.time_gaps(points.withColumn("metric", F.lit("m"))).first()
            assert (got["gap_count"], got["max_gap"]) == (499, 4.0)
    finally:
        spark.conf.unset("spark.pulsegrid.maxGroupRows")
        spark.conf.unset(L.BROADCAST_INTERVALS)
    assert largest and max(largest) <= 2_000
