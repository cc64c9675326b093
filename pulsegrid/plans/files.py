"""Queries through files: a given table written in each source's format to the shared folder, and read back with its reader."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from pulsegrid.functions.logtext import iso_millis
from pulsegrid.functions.timeparse import parse_start, session_ranges
from pulsegrid.operators import logs as G
from pulsegrid.operators.experiments import ledger_rows
from pulsegrid.operators.metrics import MetricSpec, group_columns
from pulsegrid.operators.ordered import positions
from pulsegrid.plans.base import EV, INTERVALS, LINES, METRICS, PARSED, TEMPLATED, event_lines, events, intervals, query, r6, rows_in, sql, table
from pulsegrid.plans.logs import TRACE, _numbered, _trace
from pulsegrid.sources import readers as R
from pulsegrid.sources import sinks as K
from pulsegrid.storage import durable, new_table_path


#: Records of a file that is written as one row of text.
FILE_RECORDS = 10_000


def _files(df: DataFrame, keys: list[str], order: list[str], group_rows: int) -> GroupedData:
    """The rows of each key, grouped into files of at most ``FILE_RECORDS`` of them."""
    placed = positions(df, keys, order, "_pos", group_rows)
    return placed.groupBy(*keys, F.floor(F.col("_pos") / FILE_RECORDS).alias("part"))


def _micros(c):
    return F.unix_micros(F.col(c).cast("timestamp"))


def _narrowed(sums: DataFrame, name: str) -> DataFrame:
    """Whole-number sums as long if all of them fit, else as the decimals that they are: some thousand instants in microseconds pass a long."""
    fit = F.col(name).between(-(2**63), 2**63 - 1)
    return sums.withColumn(name, F.col(name).cast("long")) if sums.where(~fit).isEmpty() else sums


@query(
    "metric_csv_roundtrip",
    sql(EV, body="SELECT epoch_us(ts) // 1000 AS _time, metric AS _measurement, 'value' AS _field, value FROM ev"),
)
def metric_csv_roundtrip(spark, sf):
    """Metric files whose headers differ in column order, read by name."""
    path = new_table_path(spark, "metrics")
    rows = events(spark, sf).select(
        F.floor(_micros("ts") / 1000).alias("_time"), F.col("metric").alias("_measurement"), F.lit("value").alias("_field"),
        F.col("value").alias("_value"), "user_id", "k",
    )
    one, other = rows.where("k % 2 = 0").drop("k", "user_id"), rows.where("k % 2 = 1").select("_field", "user_id", "_value", "_measurement", "_time")
    for part in (one, other):
        part.write.mode("append").option("header", True).csv(path)
    return R.read_metrics_csv(spark, path).select("_time", "_measurement", "_field", F.col("_value").cast("double").alias("value"))


@query(
    "label_csv_units",
    sql(EV, body="""SELECT unit, label, count(*) AS n, CAST(sum(CASE unit WHEN 's' THEN t // 1000000 * 1000000 WHEN 'ms' THEN t // 1000 * 1000 ELSE t END) AS BIGINT) AS sum_us
FROM (SELECT epoch_us(ts) AS t, k % 2 AS label FROM ev) CROSS JOIN (VALUES ('s'), ('ms'), ('us'), ('ns'), ('iso')) u(unit) GROUP BY 1, 2"""),
)
def label_csv_units(spark, sf):
    """Label files in every unit of time."""
    micros, out = _micros("ts"), None
    text = {
        "s": F.expr("unix_seconds(cast(ts as timestamp))").cast("string"), "ms": F.unix_millis(F.col("ts").cast("timestamp")).cast("string"), "us": micros.cast("string"),
        "ns": F.concat(micros.cast("string"), F.lit("789")), "iso": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
    }
    for unit, time in text.items():
        path = new_table_path(spark, f"labels-{unit}")
        events(spark, sf).select(time.alias("_time"), (F.col("k") % 2).alias("anomaly_label")).write.option("header", True).csv(path)
        part = R.read_labels_csv(spark, path, unit=unit).withColumn("unit", F.lit(unit))
        out = part if out is None else out.unionByName(part)
    return _narrowed(durable(out.groupBy("unit", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.unix_micros("ts").cast("decimal(20,0)")).alias("sum_us")), "sums"), "sum_us")


@query(
    "label_export",
    sql(EV, body="SELECT epoch_us(ts) // 1000 AS _time, max(CASE WHEN k < 10 THEN 1 WHEN k < 50 THEN 0 ELSE -1 END) AS anomaly_label FROM ev GROUP BY 1"),
)
def label_export(spark, sf):
    """Labels per instant as the export writes them."""
    path = new_table_path(spark, "label-export")
    label = F.when(F.col("k") < 10, 1).when(F.col("k") < 50, 0).otherwise(-1)
    K.write_labels(events(spark, sf).select("ts", label.alias("label")), path)
    return spark.read.schema("_time bigint, anomaly_label int").option("header", True).csv(path)


@query(
    "log_files_scan",
    sql(EV, LINES, PARSED, body="SELECT log_level, thread, count(*) AS n, CAST(sum(length(message)) AS BIGINT) AS chars FROM parsed GROUP BY 1, 2"),
)
def log_files_scan(spark, sf):
    """Log text files written and read as records."""
    path = new_table_path(spark, "lines")
    K.write_log_lines(event_lines(spark, sf), path)
    return R.read_logs(spark, path).groupBy("log_level", "thread").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("message")).alias("chars"))


@query(
    "log_json_envelopes",
    sql(EV, body="""SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') || ' ' || CASE WHEN k % 4 = 0 THEN 'INFO' ELSE upper(metric) END || ' '
  || CASE WHEN k % 3 = 0 THEN '0' ELSE CAST(user_id AS VARCHAR) END || ' --- [0] ' || CASE WHEN k % 5 = 0 THEN 'logger' ELSE 'app' END || ' : m' || event_id AS value FROM ev"""),
)
def log_json_envelopes(spark, sf):
    """JSON log files of both envelopes, files of a bounded number of records of half a day and kind; the number 0 is no value, the text "0" is one."""
    path = new_table_path(spark, "envelopes")
    k = F.col("k")
    record = F.struct(
        iso_millis(F.col("ts")).alias("time"), F.when(k % 4 != 0, F.upper("metric")).alias("level"), F.when(k % 3 == 0, F.lit(0)).otherwise(F.col("user_id")).alias("pid"),
        F.lit("0").alias("thread"), F.when(k % 5 == 0, F.lit("")).otherwise("app").alias("logger"), F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("msg"),
    )
    span = F.window(F.col("ts"), "12 hours")["start"].alias("span")
    rows = events(spark, sf).select("event_id", span, (k % 2).alias("kind"), record.alias("record"))
    files = _files(rows, ["span", "kind"], ["event_id"], rows_in(spark, sf, "events")).agg(F.collect_list("record").alias("records"))
    text = F.when(F.col("kind") == 0, F.to_json(F.struct(F.col("records").alias("logs")))).otherwise(F.to_json(F.struct(F.col("records").alias("data"))))
    files.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return R.read_log_json(spark, path)


@query("session_intervals_scan", sql(EV, INTERVALS, body="SELECT label, count(*) AS n, min(start_ts) AS first_ts, max(end_ts) AS last_ts, CAST(sum(epoch_us(end_ts) - epoch_us(start_ts)) AS BIGINT) AS covered_us FROM intervals GROUP BY label"))
def session_intervals_scan(spark, sf):
    """Session records with the fault events and normal windows that begin on a day, in files of a bounded number of them."""
    path = new_table_path(spark, "sessions")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    part = F.struct(stamp("start_ts").alias("start_ts"), stamp("end_ts").alias("end_ts"), F.col("label").cast("string").alias("label"))
    begun = intervals(spark, sf).withColumn("day", F.to_date("start_ts"))
    days = _files(begun, ["day"], ["start_ts", "end_ts", "label"], rows_in(spark, sf, "events")).agg(
        F.collect_list(F.when(F.col("label") == 1, part)).alias("fault_events"), F.collect_list(F.when(F.col("label") == 0, part)).alias("normal_windows")
    )
    days.select(F.to_json(F.struct("fault_events", "normal_windows")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    found = R.session_intervals(R.read_session(spark, path))
    return found.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.min("start_ts").cast("timestamp_ntz").alias("first_ts"), F.max("end_ts").cast("timestamp_ntz").alias("last_ts"),
        F.sum(F.unix_micros("end_ts") - F.unix_micros("start_ts")).alias("covered_us"),
    )


@query("trace_scan", sql(EV, TRACE, body="SELECT system_call, count(*) AS n, CAST(sum(event_id) AS DOUBLE) AS total FROM trace GROUP BY 1"))
def trace_scan(spark, sf):
    """Traces as blank-separated text."""
    path = new_table_path(spark, "trace")
    line = F.concat_ws("  ", F.col("event_id").cast("string"), F.lit("pid"), "system_call", F.lit("rest"))
    _trace(spark, sf).select(line.alias("value")).write.text(path)
    return R.read_trace(spark, path).groupBy("system_call").agg(F.count(F.lit(1)).alias("n"), F.sum("timestamp").alias("total"))


@query("feature_matrix_scan", sql(EV, body="SELECT event_id, value, k % 2 AS label FROM ev"))
def feature_matrix_scan(spark, sf):
    """Feature matrices as blank-separated numbers with a header."""
    path = new_table_path(spark, "matrix")
    K.write_bags(events(spark, sf).select("event_id", "value", (F.col("k") % 2).alias("label")), path, "csv")
    return R.read_feature_matrix(spark, path).select(F.col("event_id").cast("bigint").alias("event_id"), "value", "label")


@query("wide_csv_scan", sql(EV, body="SELECT event_id, value, metric AS type FROM ev"))
def wide_csv_scan(spark, sf):
    """Wide feature tables without the columns that are dropped."""
    path = new_table_path(spark, "wide")
    rows = events(spark, sf).select(F.col("event_id").cast("double").alias("event_id"), "value", F.col("metric").alias("type"), F.col("user_id").alias("unused"))
    K.write_metrics(rows, path, "csv")
    return R.read_wide_csv(spark, path, ["unused"]).select(F.col("event_id").cast("bigint").alias("event_id"), "value", "type")


SLICE_START, SLICE_STOP = datetime(2024, 1, 3), datetime(2024, 1, 20)


@query(
    "slice_landing",
    sql(EV, body=f"""SELECT strftime(time_bucket(INTERVAL 10 MINUTE, ts), '%Y%m%d-%H%M') AS slice, count(*) AS n, round(sum(value), 6) AS total
FROM ev WHERE ts >= TIMESTAMP '{SLICE_START}' AND ts < TIMESTAMP '{SLICE_STOP}' GROUP BY 1"""),
)
def slice_landing(spark, sf):
    """Collected rows landed by slice, one range twice: repeated slices replace themselves."""
    path = new_table_path(spark, "slices")
    rows = events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    for start, stop in ((SLICE_START, SLICE_STOP), (datetime(2024, 1, 10), datetime(2024, 1, 12))):
        K.land_slices(rows.select("ts", "value"), path, start, stop)
    landed = spark.read.schema("ts timestamp, value double, slice string").parquet(path)
    return landed.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value")).alias("total"))


@query("result_json", sql(EV, body="SELECT event_id, CASE WHEN k % 10 < 2 THEN NULL ELSE value END AS value FROM ev"))
def result_json(spark, sf):
    """Results as JSON, numbers that are not finite as null."""
    path = new_table_path(spark, "result")
    odd = F.when(F.col("k") % 10 == 0, float("nan")).when(F.col("k") % 10 == 1, float("inf")).otherwise(F.col("value"))
    K.write_result(events(spark, sf).select("event_id", odd.alias("value")), path)
    return spark.read.schema("event_id bigint, value double").json(path)


@query(
    "processed_logs_export",
    sql(EV, LINES, PARSED, TEMPLATED, body=f"""SELECT ts, part, count(*) AS records, string_agg(number, ',' ORDER BY number) AS numbers
FROM (SELECT date_trunc('hour', ts) AS ts, number, (row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY number) - 1) // {G.LIST_NUMBERS} AS part
  FROM templated JOIN numbered USING (template)) GROUP BY 1, 2"""),
)
def processed_logs_export(spark, sf):
    """Templates, and the lists of template numbers of every hour, as JSON tables."""
    path = new_table_path(spark, "processed")
    numbered, counts = _numbered(spark, sf)
    lists = G.numbers_per_interval(numbered, "1 hour", group_rows=rows_in(spark, sf, "events"))
    K.write_processed_logs(counts, lists.withColumn("ts", F.col("ts").cast("timestamp")), path)
    found = spark.read.schema("ts timestamp, part bigint, numbers array<int>").json(f"{path}/intervals")
    return found.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "part", F.size("numbers").cast("bigint").alias("records"), F.array_join(F.col("numbers").cast("array<string>"), ",").alias("numbers"))


@query("metric_time_counts", sql(EV, body="SELECT date_trunc('hour', ts) AS ts, count(*) AS n FROM ev GROUP BY 1"))
def metric_time_counts(spark, sf):
    """Only the instants of metric files, per hour."""
    path = new_table_path(spark, "metrics")
    rows = events(spark, sf).select(F.floor(_micros("ts") / 1000).alias("_time"), F.col("metric").alias("_measurement"), F.lit("value").alias("_field"), F.col("value").alias("_value"))
    rows.write.option("header", True).csv(path)
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")
    return R.metric_times(spark, path).select(hour).groupBy("ts").agg(F.count(F.lit(1)).alias("n"))


@query(
    "log_directory_scan",
    sql(EV, LINES, PARSED, body="SELECT log_level, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM parsed GROUP BY 1"),
)
def log_directory_scan(spark, sf):
    """The log files of a folder by pattern of their names; files of other names are left alone."""
    path = new_table_path(spark, "folder")
    K.write_log_lines(event_lines(spark, sf), path)
    table_of_others = spark.range(3).select(F.lit("2025-01-01T00:01:00.002Z INFO 1 --- [t] app : x").alias("value"))
    table_of_others.write.mode("append").option("compression", "gzip").text(path)
    found = R.read_log_directory(spark, path, "part-*.txt").groupBy("log_level")
    return found.agg(F.count(F.lit(1)).alias("n"), *[f("ts").cast("timestamp_ntz").alias(n) for f, n in ((F.min, "first_ts"), (F.max, "last_ts"))])


FIRST_MINUTES = 30


@query(
    "session_time_ranges",
    sql(EV, f"""sessions AS (SELECT date_trunc('day', ts) AS day, min(ts) AS a, CASE WHEN day(min(ts)) % 5 <> 0 THEN max(ts) END AS b FROM ev GROUP BY 1),
now AS (SELECT max(ts) - INTERVAL 3600 SECOND AS t FROM ev),
whole AS (SELECT day, 'whole' AS part, CASE WHEN a <= t THEN a - INTERVAL 120 SECOND END AS lo, CASE WHEN a <= t THEN b + INTERVAL 120 SECOND END AS hi FROM sessions, now),
early AS (SELECT day, 'first' AS part, CASE WHEN a <= t THEN a - INTERVAL 120 SECOND END AS lo, CASE WHEN a <= t THEN least(a + INTERVAL {FIRST_MINUTES} MINUTE, t) + INTERVAL 120 SECOND END AS hi FROM sessions, now),
ranges AS (SELECT * FROM whole UNION ALL SELECT * FROM early)""",
        body="SELECT r.day, part, any_value(lo) AS range_start, any_value(hi) AS range_stop, count(e.event_id) AS rows FROM ranges r LEFT JOIN ev e ON e.ts >= lo AND e.ts < hi GROUP BY r.day, part"),
)
def session_time_ranges(spark, sf):
    """Collection ranges of sessions, one a day, every fifth without an end; seen an hour before the last row, whole or for the first minutes."""
    rows = durable(events(spark, sf).select("event_id", F.col("ts").cast("timestamp").alias("ts")), "rows")
    now = parse_start("-3600s", rows.agg(F.max("ts")).first()[0] or datetime(2024, 1, 1))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    day = F.date_trunc("day", "ts").alias("day")
    ended = F.when(F.dayofmonth(F.min("ts")) % 5 != 0, iso(F.max("ts")))
    sessions = durable(rows.groupBy(day).agg(iso(F.min("ts")).alias("session_start"), ended.alias("session_end")), "sessions")
    parts = [session_ranges(sessions, F.lit(now), m).select("day", F.lit(p).alias("part"), "range_start", "range_stop") for p, m in (("whole", 0), ("first", FIRST_MINUTES))]
    ranges = durable(parts[0].unionByName(parts[1]), "ranges")
    # A range starts on the evening before or on its day, so the days that it touches are few.
    touched = F.explode(F.sequence(F.date_trunc("day", "range_start"), F.date_trunc("day", "range_stop"), F.expr("interval 1 day")))
    spread = ranges.where("range_stop is not null").withColumn("on", touched)
    inside = rows.withColumn("on", F.date_trunc("day", "ts")).join(spread, "on").where("ts >= range_start and ts < range_stop")
    counts = durable(inside.groupBy("day", "part").agg(F.count(F.lit(1)).alias("rows")), "counts")
    plain = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("day", "range_start", "range_stop")]
    return ranges.join(counts, ["day", "part"], "left").select(*plain, "part", F.coalesce("rows", F.lit(0)).alias("rows"))


@query(
    "ledger_summary",
    """SELECT 'sources' AS experiment, source AS run, lang, round(avg(n_chars), 6) AS mean_chars, count(*)::DOUBLE AS documents FROM documents GROUP BY source, lang""",
)
def ledger_summary(spark, sf):
    """A ledger of one run per source and language as the summary file has it, and what is read from there."""
    path = new_table_path(spark, "summary")
    rated = table(spark, sf, "documents").groupBy("source", "lang").agg(F.avg("n_chars").alias("mean_chars"), F.count(F.lit(1)).alias("documents"))
    K.write_summary(ledger_rows(rated, "sources", F.col("source"), ["lang"], ["mean_chars", "documents"]), path)
    text = spark.read.option("header", True).csv(path)
    metrics = F.from_json("metrics", "map<string,double>")
    return text.select(
        "experiment", "run", F.get_json_object("params", "$.lang").alias("lang"), r6(F.element_at(metrics, "mean_chars")).alias("mean_chars"), F.element_at(metrics, "documents").alias("documents")
    )


GROUPS = {"load": ("error", "view"), "traffic": ("click", "refund", "purchase")}


@query(
    "grouped_columns",
    sql(EV, "wide AS (SELECT date_trunc('hour', ts) AS ts, " + ", ".join(f"avg(value) FILTER (WHERE metric = '{m}') AS {m}" for m in METRICS) + " FROM ev GROUP BY 1)",
        body=""" SELECT ts, 'load' AS "group", 2 AS columns, round(coalesce(error, 0) + coalesce("view", 0), 6) AS total FROM wide
UNION ALL SELECT ts, 'traffic', 2, round(coalesce(click, 0) + coalesce(purchase, 0), 6) FROM wide"""),
)
def grouped_columns(spark, sf):
    """The columns of each group of the catalogue that a wide frame has; one is missing."""
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts")
    wide = durable(events(spark, sf).groupBy(hour).pivot("metric", list(METRICS)).agg(F.avg("value")), "wide")
    specs = [MetricSpec(group, m, m, "value") for group, names in GROUPS.items() for m in names]
    found = group_columns(specs, wide.columns)
    parts = [F.struct(F.lit(g).alias("group"), F.lit(len(c)).alias("columns"), r6(sum(F.coalesce(n, F.lit(0.0)) for n in c)).alias("total")) for g, c in found.items()]
    return wide.select(F.col("ts").cast("timestamp_ntz").alias("ts"), F.inline(F.array(*parts)))
