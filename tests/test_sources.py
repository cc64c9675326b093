"""Readers, sinks, log templates, splits and the ledger."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import timeparse
from pulsegrid.operators import experiments as X
from pulsegrid.operators import logs, metrics, splits, traces
from pulsegrid.plans.registry import registered
from pulsegrid.sources import readers, sinks
from pulsegrid.storage import new_table_path

LINE = "2025-01-01T00:01:00.002Z INFO 1006 --- [io-1010-exec-10] app.web : GET /items 200"


def write(path, text):
    with open(path, "w") as f:
        f.write(text)
    return path


def test_log_files(spark, folder):
    write(f"{folder}/LOGS_a.txt", LINE + "\nnot a record\n")
    write(f"{folder}/LOGS_b_structured.txt", LINE + "\n")
    write(f"{folder}/other.txt", LINE + "\n")
    got = readers.read_log_directory(spark, folder).collect()
    assert len(got) == 1
    assert (got[0]["log_level"], got[0]["process_id"], got[0]["thread"], got[0]["message"]) == ("INFO", "1006", "io-1010-exec-10", "GET /items 200")
    assert readers.read_logs(spark, f"{folder}/LOGS_a.txt").count() == 1


def test_line_with_the_field_mark(spark):
    odd = LINE.replace("GET", "G\u0001ET").replace("app.web", "app\u0001web")
    r = logs.parse_logs(spark.createDataFrame([(odd,), ("plain",)], "value string")).first()
    assert (r["thread"], r["logger"], r["message"]) == ("io-1010-exec-10", "app\u0001web", "G\u0001ET /items 200")


@pytest.mark.parametrize("wrap", [lambda r: r, lambda r: {"logs": r}, lambda r: {"data": r}])
def test_log_json(spark, folder, wrap):
    records = [
        {"timestamp": "2025-01-01T00:01:00.002Z", "level": "WARN", "pid": 7, "thread": "t", "logger": "l", "message": "m"},
        {"time": 1735689660, "severity": "ERROR", "msg": "x"},
    ]
    write(f"{folder}/logs.json", json.dumps(wrap(records)))
    got = sorted(r["value"] for r in readers.read_log_json(spark, f"{folder}/logs.json").collect())
    assert got == ["2025-01-01T00:01:00.000Z ERROR 0 --- [] logger : x", "2025-01-01T00:01:00.002Z WARN 7 --- [t] l : m"]


def test_metric_csv_reads_only_needed_columns(spark, folder):
    path = write(f"{folder}/m.csv", "_time,_measurement,_field,_value,counter,op,extra\n1000,cpu,usage,\"1,5\",3,r,z\n2000,mem,,7,,w,z\n")
    spec = metrics.MetricSpec("load", "cpu_usage", "cpu", "usage", {"op": "r", "absent": "x"})
    rows = readers.read_metrics_csv(spark, path, [spec])
    assert rows.columns == ["_time", "_measurement", "_field", "_value", "op"]
    got = metrics.select_metrics(rows, [spec]).collect()
    assert [(r["metric"], r["value"]) for r in got] == [("cpu_usage", 15.0)]
    assert [r["metric"] for r in metrics.missing_metrics(metrics.select_metrics(rows, [spec]), [spec]).collect()] == []
    assert metrics.group_columns([spec], ["cpu_usage"]) == {"load": ["cpu_usage"]}
    assert readers.metric_times(spark, path).count() == 2
    with pytest.raises(ValueError, match="_measurement"):
        readers.read_metrics_csv(spark, write(f"{folder}/bad.csv", "_time,x\n1,2\n"))


@pytest.mark.parametrize("unit,text", [("s", "1700000000"), ("ms", "1700000000000"), ("us", "1700000000000000"), ("ns", "1700000000000000000"), ("iso", "2023-11-14T22:13:20Z")])
def test_label_csv_units(spark, folder, unit, text):
    path = write(f"{folder}/l.csv", f"_time,anomaly_label\n{text},1\n")
    r = readers.read_labels_csv(spark, path, unit=unit).first()
    assert (r["label"], r["ts"]) == (1, datetime(2023, 11, 14, 22, 13, 20))


def test_label_csv_sums_beyond_a_long(spark, folder):
    rows = spark.range(12_000).select(
        F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,0,0,cast(id as int))").alias("ts"),
        F.col("id").alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 4}').alias("props"),
    )
    rows.write.parquet(f"{folder}/events.parquet")
    first = int(datetime(2024, 1, 1, tzinfo=timezone.utc).timestamp())
    got = registered()["label_csv_units"].run(spark, folder).collect()
    want = sum(first + i for i in range(12_000)) * 1_000_000
    assert want > 2**63 and {(r["unit"], r["label"], r["n"], int(r["sum_us"])) for r in got} == {(u, 0, 12_000, want) for u in ("s", "ms", "us", "ns", "iso")}
    few = f"{folder}/few"
    rows.limit(10).write.parquet(f"{few}/events.parquet")
    assert dict(registered()["label_csv_units"].run(spark, few).dtypes)["sum_us"] == "bigint"


def test_trace_dictionary_and_matrix(spark, folder):
    trace = readers.read_trace(spark, write(f"{folder}/t.dat", "1.5 x open y\n2.5 x read\n\n3.5 x open\n"))
    assert [(r["timestamp"], r["system_call"]) for r in trace.orderBy("timestamp").collect()] == [(1.5, "open"), (2.5, "read"), (3.5, "open")]
    known = readers.read_dictionary(spark, write(f"{folder}/d.dat", "id system_call\n4 open\n"))
    full = traces.extend_dictionary(trace, known, ["timestamp"])
    assert sorted((r["id"], r["system_call"]) for r in full.collect()) == [(4, "open"), (5, "read")]
    chunks = traces.chunked(traces.encode_calls(trace.withColumn("label", F.lit(0)), full), ["timestamp"], size=2)
    bags = traces.call_bags(chunks, [4, 5])
    assert sorted(tuple(r) for r in bags.collect()) == [(0, 1, 1, 0), (1, 1, 0, 0)]
    assert traces.call_bags_long(chunks).count() == 3
    sinks.write_bags(bags.drop("chunk"), f"{folder}/bags", "csv")
    assert readers.read_feature_matrix(spark, f"{folder}/bags").count() == 2
    wide = readers.read_wide_csv(spark, write(f"{folder}/w.csv", "a,type,momentum,time\n1.5,dos,pre,9\n"), ["time"])
    assert wide.columns == ["a", "type", "momentum"] and wide.first()["a"] == 1.5


def test_sinks(spark, folder):
    labels = spark.createDataFrame([(datetime(2024, 1, 1), -1), (datetime(2024, 1, 1), 1)], "ts timestamp, label int")
    assert sinks.write_labels(labels, f"{folder}/labels")
    assert readers.read_labels_csv(spark, f"{folder}/labels").first()["label"] == 1
    assert not sinks.write_labels(labels.where("label = -1"), f"{folder}/none")
    sinks.write_result(spark.createDataFrame([(float("nan"), 1.0, float("inf"))], "a double, b double, c double"), f"{folder}/result")
    assert json.loads(spark.read.text(f"{folder}/result").first()[0]) == {"a": None, "b": 1.0, "c": None}
    start, stop = datetime(2024, 1, 1), datetime(2024, 1, 1, 1)
    rows = spark.range(120).select(F.expr("timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,0,cast(id as int),0)").alias("ts"), "id")
    for _ in range(2):
        sinks.land_slices(rows, f"{folder}/slices", start, stop)
    landed = spark.read.parquet(f"{folder}/slices")
    assert landed.count() == 60 and landed.select("slice").distinct().count() == 6
    sinks.write_log_lines(spark.createDataFrame([(LINE,)], "value string"), f"{folder}/lines")
    assert logs.conformance(spark.read.text(f"{folder}/lines")).first()["matched"] == 1
    sinks.write_metrics(rows, f"{folder}/metrics")
    assert spark.read.parquet(f"{folder}/metrics").count() == 120


def test_time_ranges(spark):
    now = datetime(2024, 1, 1, 12, tzinfo=timezone.utc)
    assert timeparse.parse_start("-3600s", now) == datetime(2024, 1, 1, 11, tzinfo=timezone.utc)
    assert timeparse.parse_start("2024-01-01T00:00:00Z", now) == datetime(2024, 1, 1, tzinfo=timezone.utc)
    assert timeparse.parse_start("soon", now) is None
    pieces = timeparse.time_slices(spark, datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 25)).orderBy("slice_start").collect()
    assert [(r[0].minute, r[1].minute) for r in pieces] == [(0, 10), (10, 20), (20, 25)]
    sessions = spark.createDataFrame([("2024-01-01T00:00:00Z", "2024-01-01T01:00:00Z"), ("2024-01-01T00:00:00Z", None), ("2999-01-01T00:00:00Z", None)], "session_start string, session_end string")
    got = timeparse.session_ranges(sessions, F.lit(datetime(2024, 2, 1))).collect()
    assert got[0]["range_start"] == datetime(2023, 12, 31, 23, 58) and got[0]["range_stop"] == datetime(2024, 1, 1, 1, 2)
    assert got[1]["range_stop"] is None and got[2]["range_start"] is None
    short = timeparse.session_ranges(sessions, F.lit(datetime(2024, 2, 1)), first_minutes=5).first()
    assert short["range_stop"] == datetime(2024, 1, 1, 0, 7)


def test_splits(spark, small_groups):
    df = spark.range(200).select("id", F.when(F.col("id") % 4 == 0, 1).when(F.col("id") % 4 == 1, -1).otherwise(0).alias("label"))
    got = splits.supervised_split(df, ["id"])
    counts = {(r["split"], r["label"]): r["count"] for r in got.groupBy("split", "label").count().collect()}
    assert counts == {("train", 0): 80, ("val", 0): 4, ("test", 0): 16, ("val", 1): 10, ("test", 1): 40}
    tiny = splits.supervised_split(spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "id long, label int"), ["id"], train_ratio=0.5)
    assert sorted(r["split"] for r in tiny.collect()) == ["test", "train", "val"]
    seeds = splits.supervised_split(df.withColumn("seed", F.explode(F.array(F.lit(1), F.lit(2)))), ["id"], seed="seed", keys=["seed"])
    assert seeds.groupBy("seed", "split").count().where("split = 'train' and count = 80").count() == 2
    folds = splits.stratified_folds(df, ["id"], "label", 5, 1).groupBy("label", "fold").count()
    assert folds.where("label = 0").select("count").distinct().count() == 1


def test_experiments(spark, folder):
    grid = X.parameter_grid(spark, {"spot_type": ["SPOT", "dSPOT"], "depth": [5, 10], "risk": 1e-3})
    assert sorted((r["spot_type"], r["depth"]) for r in grid.collect()) == [("SPOT", None), ("dSPOT", 5), ("dSPOT", 10)] or grid.count() == 3
    assert X.sample_grid(grid, 2, 7).collect() == X.sample_grid(grid, 2, 7).collect()
    configs = X.check_configs(spark.createDataFrame([("a", 0.9, 1e-3, 0.8), ("b", 1.5, 1e-3, 0.8)], "config string, quantile double, risk double, train_ratio double"))
    rows = spark.range(10).withColumnRenamed("id", "win_id")
    done = X.sweep(rows, configs, [1, 2], lambda r: r.groupBy("config", "seed").agg(F.sum("win_id").alias("total")))
    got = sorted((r["config"], r["seed"], r["total"], r["error"]) for r in done.collect())
    assert got == [("a", 1, 45, None), ("a", 2, 45, None), ("b", 1, None, "quantile outside 0..1"), ("b", 2, None, "quantile outside 0..1")]
    ledger = X.ledger_rows(done, "sweep", F.concat_ws("-", "config", F.col("seed").cast("string")), ["config", "seed"], ["total"])
    for _ in range(2):
        sinks.append_ledger(ledger, f"{folder}/ledger")
    kept = spark.read.parquet(f"{folder}/ledger")
    assert kept.count() == 8 and X.best_run(kept, "total").first()["run"] == "a-1"
    sinks.write_summary(kept, f"{folder}/summary")
    nested = spark.range(1).select(F.struct(F.lit(1.5).alias("loss"), F.struct(F.lit(2).alias("n"), F.lit("x").alias("s")).alias("in")).alias("m"))
    assert nested.select(X.numeric_metrics(X.flatten_numeric(nested)).alias("f")).first()["f"] == {"m.loss": 1.5, "m.in.n": 2.0}


def test_files_hold_a_bounded_number_of_records(spark, monkeypatch):
    from pulsegrid.plans import files
    from tests.compare import difference, spark_result

    def written(name):
        paths = []
        with monkeypatch.context() as m:
            m.setattr(files, "new_table_path", lambda *a: paths.append(new_table_path(*a)) or paths[-1])
            found = spark_result(getattr(files, name)(spark, "/root/testdata/sf0.001"))
        return found, [r.value for r in spark.read.option("wholetext", True).text(paths[0]).collect()]

    whole = {name: written(name) for name in ("log_json_envelopes", "session_intervals_scan")}
    monkeypatch.setattr(files, "FILE_RECORDS", 3)
    for name, (found, texts) in whole.items():
        again, parts = written(name)
        assert difference(again, found) is None
        assert len(parts) > len(texts)
        assert max(sum(len(x) for x in json.loads(p).values()) for p in parts) <= 3
