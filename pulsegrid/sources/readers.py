"""Readers for metric, label, log, session and trace files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.functions.logtext import iso_millis, log_line, truthy
from pulsegrid.functions.timeparse import from_epoch, parse_iso
from pulsegrid.operators.logs import parse_logs
from pulsegrid.operators.metrics import MetricSpec

SEMI_WIDE_METRICS = T.StructType(
    [T.StructField("_time", T.LongType()), T.StructField("_measurement", T.StringType()), T.StructField("id", T.StringType()),
     T.StructField("host", T.StringType())]
    + [T.StructField(n, T.DoubleType()) for n in ("counter", "gauge", "cpu")]
    + [T.StructField("device", T.StringType()), T.StructField("major", T.DoubleType()), T.StructField("minor", T.DoubleType())]
    + [T.StructField(n, T.StringType()) for n in ("operation", "interface", "scope", "state")]
)

INTERVAL_STRUCT = T.StructType([T.StructField("start_ts", T.StringType()), T.StructField("end_ts", T.StringType()), T.StructField("label", T.StringType())])
FAULT_STRUCT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("event_id", "fault_type", "target_service", "start_ts", "end_ts")]
    + [T.StructField("duration_s", T.DoubleType()), T.StructField("params", T.MapType(T.StringType(), T.DoubleType())),
       T.StructField("label", T.StringType())]
)
SESSION_RECORD = T.StructType(
    [T.StructField("session_start", T.StringType()), T.StructField("session_end", T.StringType()), T.StructField("mode", T.StringType()),
     T.StructField("total_faults", T.IntegerType()), T.StructField("fault_events", T.ArrayType(FAULT_STRUCT)),
     T.StructField("normal_windows", T.ArrayType(INTERVAL_STRUCT))]
)

# Alternative names of the fields of a log record, most common first, with the default.
LOG_KEYS = {
    "timestamp": (("timestamp", "time", "_time"), ""),
    "level": (("level", "log_level", "severity"), "INFO"),
    "pid": (("pid", "process_id", "processId"), "0"),
    "thread": (("thread", "thread_name", "threadName"), ""),
    "logger": (("logger", "logger_name", "loggerName"), "logger"),
    "message": (("message", "msg", "text"), ""),
}


def read_metrics_csv(spark: SparkSession, path: str, catalogue: Sequence[MetricSpec] = ()) -> DataFrame:
    """Metric rows with only the columns that the catalogue needs, all as text but the time.

    The header of each file decides which columns it has and in which order; ``_time`` and ``_measurement`` must be among them.
    """
    parts = [_metric_files(spark, files, header, catalogue) for header, files in _headers(spark, path)]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows


def _headers(spark: SparkSession, path: str) -> list[tuple[list[str], str | list[str]]]:
    """The different headers of the files of a path, each with its files; they are few, whatever the rows."""
    first = spark.read.text(path).where("_metadata.file_block_start = 0").select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    lines = first.groupBy("file").agg(F.min_by("value", "at").alias("header"))
    groups = lines.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).collect()
    if len(groups) <= 1:
        return [(spark.read.option("header", True).csv(path).columns, path)]
    return [(spark.read.option("header", True).csv(group["files"]).columns, group["files"]) for group in groups]


def _metric_files(spark: SparkSession, path: str | list[str], header: list[str], catalogue: Sequence[MetricSpec]) -> DataFrame:
    missing = [c for c in ("_time", "_measurement") if c not in header]
    if missing:
        raise ValueError(f"metric file lacks {', '.join(missing)}")
    wanted = {"_time", "_measurement", "_field", "_value"}
    for spec in catalogue:
        wanted |= {spec.column, *spec.filters}
    schema = T.StructType([T.StructField(c, T.LongType() if c == "_time" else T.StringType()) for c in header])
    rows = spark.read.schema(schema).option("header", True).csv(path)
    return rows.select(*[c for c in header if c in wanted or not catalogue])


def read_semi_wide(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEMI_WIDE_METRICS).option("header", True).option("enforceSchema", False).csv(path)


def metric_times(spark: SparkSession, path: str, unit: str = "ms") -> DataFrame:
    """Only the instants of a metric file."""
    return read_metrics_csv(spark, path).select(from_epoch(F.col("_time"), unit).alias("ts"))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Parsed records of a log text file; lines in another form are dropped."""
    return parse_logs(spark.read.text(path)).withColumnRenamed("value", "raw")


def read_log_directory(spark: SparkSession, folder: str, pattern: str = "LOGS_*.txt") -> DataFrame:
    """Log files of a folder by name, without derived ``_structured.`` and ``_templates.`` files."""
    files = spark.read.option("pathGlobFilter", pattern).text(folder).withColumn("file", F.col("_metadata.file_name"))
    own = files.where(~F.col("file").contains("_structured.") & ~F.col("file").contains("_templates."))
    return parse_logs(own).withColumnRenamed("value", "raw")


def read_labels_csv(
    spark: SparkSession, path: str, time_column: str = "_time", label_column: str = "anomaly_label", unit: str = "ms"
) -> DataFrame:
    """(ts, label) rows; ``unit`` is s, ms, us, ns or iso."""
    rows = spark.read.option("header", True).csv(path)
    for name in (time_column, label_column):
        if name not in rows.columns:
            raise ValueError(f"label file lacks {name}")
    ts = parse_iso(F.col(time_column)) if unit == "iso" else from_epoch(F.col(time_column), unit)
    return rows.select(ts.alias("ts"), F.col(label_column).cast("double").cast("int").alias("label"))


def read_session(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SESSION_RECORD).option("multiLine", True).json(path)


def session_intervals(sessions: DataFrame) -> DataFrame:
    """(start_ts, end_ts, label) of all fault events (1) and normal windows (0) of the sessions.

    A session without a list of normal windows is an error; an interval without two valid ends is
    skipped.
    """
    checked = F.when(F.col("normal_windows").isNull(), F.raise_error(F.lit("session record without normal_windows")).cast(T.ArrayType(INTERVAL_STRUCT))).otherwise(F.col("normal_windows"))

    def part(items: Column, label: int) -> DataFrame:
        return sessions.select(F.explode(items).alias("i")).select(
            parse_iso(F.col("i.start_ts")).alias("start_ts"), parse_iso(F.col("i.end_ts")).alias("end_ts"), F.lit(label).alias("label")
        )

    both = part(F.col("fault_events"), 1).unionByName(part(checked, 0))
    return both.na.drop(subset=["start_ts", "end_ts"])


def session_faults(sessions: DataFrame) -> DataFrame:
    return sessions.select(F.explode("fault_events").alias("f")).select("f.*")


def read_log_json(spark: SparkSession, path: str) -> DataFrame:
    """Canonical log lines of a JSON file: a list of records, or an object with ``logs`` or ``data``, or one record."""
    names = sorted({k for keys, _ in LOG_KEYS.values() for k in keys})
    record = T.StructType([T.StructField(n, T.VariantType()) for n in names])
    envelope = T.StructType(record.fields + [T.StructField("logs", T.ArrayType(record)), T.StructField("data", T.ArrayType(record))])
    rows = spark.read.schema(envelope).option("multiLine", True).json(path)
    single = F.array(F.struct(*names))
    records = rows.select(F.explode(F.coalesce("logs", "data", single)).alias("r")).select("r.*")
    return canonical_lines(records)


def canonical_lines(records: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One canonical line (``value``) per record, whichever of the alternative names it uses; ``keep`` adds columns."""

    def pick(name: str) -> Column:
        keys, default = LOG_KEYS[name]
        present = [truthy(F.col(k), records.schema[k].dataType) for k in keys if k in records.columns]
        return F.coalesce(*present, F.lit(default))

    stamp = pick("timestamp")
    number = stamp.try_cast("double")
    moment = F.when(
        number.isNotNull(), F.timestamp_micros(F.when(number > 1e10, number * 1000).otherwise(number * 1_000_000).cast("long"))
    ).otherwise(parse_iso(stamp))
    text = F.coalesce(iso_millis(moment), stamp)
    return records.select(*keep, log_line(text, pick("level"), pick("pid"), pick("thread"), pick("logger"), pick("message")).alias("value"))


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """(timestamp, system_call) from columns 0 and 2 of a whitespace-separated trace."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).select(
        parts[0].try_cast("double").alias("timestamp"), F.get(parts, 2).alias("system_call")
    )


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    schema = "id int, system_call string"
    return spark.read.schema(schema).option("header", True).option("sep", " ").csv(path)


def read_feature_matrix(spark: SparkSession, path: str, label: str = "label") -> DataFrame:
    """Space-separated numbers with a header that has a label column."""
    header = spark.read.option("header", True).option("sep", " ").csv(path).columns
    if label not in header:
        raise ValueError(f"feature matrix lacks {label}")
    schema = T.StructType([T.StructField(c, T.IntegerType() if c == label else T.DoubleType()) for c in header])
    return spark.read.schema(schema).option("header", True).option("sep", " ").csv(path)


def read_wide_csv(spark: SparkSession, path: str, drop: Sequence[str], text_columns: Sequence[str] = ("type", "momentum")) -> DataFrame:
    """Wide feature table without the named columns; everything but ``text_columns`` is a number."""
    header = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType() if c in text_columns else T.DoubleType()) for c in header])
    return spark.read.schema(schema).option("header", True).csv(path).drop(*drop)
