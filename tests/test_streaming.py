"""Streams give what the batch form gives."""

import numpy as np
from pyspark.sql import functions as F

from pulsegrid.operators import alerts as A
from pulsegrid.operators import spot
from pulsegrid.operators.labels import unlabelled_periods as batch_periods
from pulsegrid.operators.metrics import fit_scaler
from pulsegrid.operators.timegrid import resample
from pulsegrid.plans import streams
from pulsegrid.plans.registry import registered
from pulsegrid.storage import durable
from pulsegrid.streaming import align, detect, landing, scoring
from pulsegrid.streaming.alerts import alerts_stream


def scores(spark, n=600, seed=123):
    rng = np.random.default_rng(seed)
    rows = [(s, i, float(abs(v))) for s in ("a", "b") for i, v in enumerate(rng.normal(size=n))]
    return spark.createDataFrame(rows, "series string, idx long, score double")


def as_stream(spark, df, folder, files=5):
    """Files that arrive one per micro-batch, in order of ``idx`` or ``ts``."""
    order = "idx" if "idx" in df.columns else "ts"
    cut = df.agg(F.min(order), F.max(order)).first()
    for i in range(files):
        lo = cut[0] + (cut[1] - cut[0]) * i / files
        hi = cut[0] + (cut[1] - cut[0]) * (i + 1) / files
        part = df.where((F.col(order) >= lo) & ((F.col(order) < hi) | F.lit(i == files - 1)))
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return scoring.read_stream(spark, f"{folder}/in", df.schema, files_per_batch=1)


def drain(query_df, spark, folder, name, mode="append"):
    q = (
        query_df.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-ck")
        .outputMode(mode).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(query_df.schema).parquet(f"{folder}/{name}")


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def check_detector(spark, folder, depth):
    detect.use_rocksdb(spark)
    data = scores(spark)
    base, live = data.where("idx < 300"), data.where("idx >= 300")
    states = durable(spot.start_states(base, ["series"], ["idx"], "score", 0.9, 1e-2, depth=depth))
    batch = spot.detect(live, states, ["series"], ["idx"], "score", depth)
    streamed = drain(
        detect.detect_stream(as_stream(spark, live, folder), states, ["series"], ["idx"], "score", depth), spark, folder, "found"
    )
    got, want = rows(streamed, "series", "idx"), rows(batch, "series", "idx")
    assert len(got) == 600
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([r[4] for r in got], [r[4] for r in want])
    assert {r[3] for r in got} == {"NORMAL", "ABNORMAL", "ALARM"}


def test_detector_stream_equals_batch(spark, folder):
    check_detector(spark, folder, 0)


def test_drift_detector_stream_equals_batch(spark, folder):
    check_detector(spark, folder, 10)


def test_alert_stream_equals_batch(spark, folder):
    detect.use_rocksdb(spark)
    rng = np.random.default_rng(5)
    data = spark.createDataFrame(
        [("svc", "cpu", i, float(v)) for i, v in enumerate(rng.uniform(0, 100, 400))], "service string, metric string, idx long, value double"
    )
    rules = [A.AlertRule("cpu", "warn", "WARN", 60.0, 2, 3), A.AlertRule("cpu", "low", "WARN", -30.0, 1, 2)]
    batch = A.alerts(A.crossings(data, rules), ["service", "metric"], ["idx"])
    stream = A.crossings(as_stream(spark, data, folder), rules)
    fired = drain(alerts_stream(stream, ["service", "metric"], ["idx"], keep_ms=None), spark, folder, "alerts")
    assert rows(fired.select("idx", "state"), "idx", "state") == rows(batch.select("idx", "state"), "idx", "state")
    assert fired.count() > 20


def timed(spark, n=300):
    rng = np.random.default_rng(3)
    return spark.createDataFrame(
        [(i, "cpu" if i % 2 else "mem", float(v), -1 if i % 50 < 20 else 0) for i, v in enumerate(rng.normal(size=n))],
        "sec long, metric string, value double, label int",
    ).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("sec"))).drop("sec")


def as_timed_stream(spark, df, folder):
    bounds = [r[0] for r in df.select("ts").distinct().orderBy("ts").collect()]
    step = len(bounds) // 5
    for i in range(5):
        part = df.where((F.col("ts") >= bounds[i * step]) & (F.col("ts") < bounds[(i + 1) * step] if i < 4 else F.lit(True)))
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return scoring.read_stream(spark, f"{folder}/in", df.schema, files_per_batch=1)


def test_aligned_stream_equals_batch(spark, folder):
    data = timed(spark)
    got = drain(align.aligned(as_timed_stream(spark, data, folder), "10 seconds"), spark, folder, "grid")
    want = {(r["metric"], r["ts"]): r["value"] for r in resample(data, "10 seconds").collect()}
    found = {(r["metric"], r["ts"]): r["value"] for r in got.collect()}
    last = max(t for _, t in want)
    closed = {k for k in want if (last - k[1]).total_seconds() > 60}
    assert closed <= set(found) <= set(want)
    assert all(abs(found[k] - want[k]) < 1e-12 for k in found)


def test_unlabelled_sessions_equal_batch(spark, folder):
    data = timed(spark)
    got = rows(drain(align.unlabelled_periods(as_timed_stream(spark, data, folder)), spark, folder, "periods"), "start_ts")
    want = rows(batch_periods(data), "start_ts")
    assert got == want[: len(got)] and len(got) >= len(want) - 2


def test_duplicates_are_dropped(spark, folder):
    data = timed(spark)
    twice = data.unionByName(data)
    got = drain(align.deduplicated(as_timed_stream(spark, twice, folder), ["metric", "ts"]), spark, folder, "once")
    assert got.count() == data.count()


def test_monitor_and_slices(spark, folder):
    data = timed(spark)
    stats = durable(fit_scaler(data))
    thresholds = durable(stats.select("metric", F.lit(2.0).alias("threshold")))
    stream = as_timed_stream(spark, data, folder)
    scoring.start_monitor(
        scoring.score_stream(stream, stats, thresholds), f"{folder}/alarms", f"{folder}/alarms-ck", once=True
    ).awaitTermination()
    want = data.join(stats, "metric").where("abs((value - mean) / std) > 2").count()
    assert spark.read.parquet(f"{folder}/alarms").count() == want > 0
    assert scoring.latest_alarms(spark, f"{folder}/alarms", 3).count() == 3
    for _ in range(2):
        scoring.collect_slices(stream, f"{folder}/slices", f"{folder}/slices-ck").awaitTermination()
    assert spark.read.parquet(f"{folder}/slices").count() == data.count()


def test_micro_batches_do_not_grow_with_the_table(spark, monkeypatch):
    from pulsegrid.plans import streams

    monkeypatch.setattr(streams, "BATCH_ROWS", 100)
    df = spark.range(1000).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 7 % 1000).alias("ts"))
    path, seen = [], []
    monkeypatch.setattr(streams, "read_stream", lambda s, p, *a, **k: path.append((p, k["files_per_batch"])) or scoring.read_stream(s, p, *a, **k))
    q = streams._stream_of(df).writeStream.foreachBatch(lambda b, _: seen.append(b.agg(F.count("ts"), F.min("ts"), F.max("ts")).first())).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(seen) == 10 and sum(r[0] for r in seen) == 1000
    assert max(r[0] for r in seen) <= 150
    assert all(a[2] < b[1] for a, b in zip(seen, seen[1:]))


def test_replayed_batches_land_once(spark, folder):
    data = timed(spark)
    stream = as_timed_stream(spark, data, folder)
    landing.land_slices_once(stream, f"{folder}/slices", f"{folder}/ck").awaitTermination()
    once = rows(landing.landed(spark, f"{folder}/slices", data.schema).drop("batch", "slice"), "ts")
    assert once == rows(data, "ts")
    batches = [r["batch"] for r in landing.ledger(spark, f"{folder}/slices").collect()]
    assert sorted(batches) == [0, 1, 2, 3, 4]
    again = durable(landing.landed(spark, f"{folder}/slices", data.schema).where("batch = 2").select(*data.columns))
    landing.slice_writer(f"{folder}/slices")(again, 2)
    assert rows(landing.landed(spark, f"{folder}/slices", data.schema).drop("batch", "slice"), "ts") == once
    # A batch without its line in the ledger is not seen; its repetition is.
    write = landing.slice_writer(f"{folder}/slices")
    data.limit(7).withColumn("slice", F.lit("x")).write.partitionBy("slice").parquet(f"{folder}/slices/rows/batch=9")
    assert landing.landed(spark, f"{folder}/slices", data.schema).count() == data.count()
    write(data.limit(7), 9)
    assert landing.landed(spark, f"{folder}/slices", data.schema).count() == data.count() + 7


def test_status_of_replayed_batches(spark, folder):
    data = timed(spark).withColumn("alarm", (F.abs("value") > 1).cast("int"))
    landing.keep_status(as_timed_stream(spark, data, folder), f"{folder}/status", f"{folder}/ck", ["metric"], ["ts"]).awaitTermination()
    bounds = [r[0] for r in data.select("ts").distinct().orderBy("ts").collect()]
    part = durable(data.where(F.col("ts") >= bounds[4 * (len(bounds) // 5)]))
    landing.status_writer(f"{folder}/status", ["metric"], ["ts"])(part, 4)
    got = {r["metric"]: (r["alarms"], r["ts"], r["value"]) for r in landing.current_status(spark, f"{folder}/status", ["metric"], ["ts"], data.schema).collect()}
    for metric in ("cpu", "mem"):
        hits = sorted((r["ts"], r["value"]) for r in data.where("alarm = 1").collect() if r["metric"] == metric)
        assert got[metric] == (len(hits), *hits[-1])


def test_expiring_alert_stream_equals_batch(spark, folder):
    """A series falls silent twice, once inside and once between micro-batches; what it had counted is gone, and the run ends."""
    detect.use_rocksdb(spark)
    rng = np.random.default_rng(8)
    seconds = np.cumsum(np.where(rng.uniform(size=300) < 0.03, 900, rng.integers(1, 30, 300)))
    data = spark.createDataFrame(
        [("svc", "cpu", i, int(s), float(v)) for i, (s, v) in enumerate(zip(seconds, rng.uniform(0, 100, 300)))], "service string, metric string, idx long, sec long, value double"
    ).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("sec"))).drop("sec")
    rules = [A.AlertRule("cpu", "warn", "WARN", 40.0, 2, 6)]
    plain = A.alerts(A.crossings(data, rules), ["service", "metric"], ["idx"]).count()
    batch = rows(A.alerts(A.crossings(data, rules), ["service", "metric"], ["idx"], keep_ms=600_000).select("idx"), "idx")
    stream = A.crossings(as_timed_stream(spark, data, folder), rules)
    fired = drain(alerts_stream(stream, ["service", "metric"], ["idx"], 600_000), spark, folder, "alerts")
    assert rows(fired.select("idx"), "idx") == batch and len(batch) != plain


def test_rows_that_meet_by_id_come_in_larger_batches(spark, folder, monkeypatch):
    """What a micro-batch costs besides its rows must not outgrow the table: batches of the repeated rows are larger than those of series."""
    base = spark.range(6_000).select(
        F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,0,cast(id as int) * 10,0)").alias("ts"),
        F.lit(1).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.format_string('{"k": %d}', F.col("id") % 3).alias("props"),
    )
    base.write.parquet(f"{folder}/events.parquet")
    batches = []

    def drained(stream, real=streams._drain):
        out = real(stream)
        batches.append(len(spark.read.text(out.inputFiles()[0].rsplit("/rows/", 1)[0] + "/checkpoint/commits").select("_metadata.file_name").distinct().collect()))
        return out

    monkeypatch.setattr(streams, "_drain", drained)
    monkeypatch.setattr(streams, "BATCH_ROWS", 1_000)
    monkeypatch.setattr(streams, "ID_BATCH_ROWS", 2_000)
    got = registered()["stream_dedup"].run(spark, folder)
    assert sorted(r[0] for r in got.select("event_id").collect()) == list(range(6_000))
    assert 6 <= batches[0] <= 8
