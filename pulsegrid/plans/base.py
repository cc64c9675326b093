"""Shared inputs of the registered queries, in Spark and as SQL."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.logtext import LOG_LINE, VARIABLE_PARTS, iso_millis, log_line
from pulsegrid.operators.ordered import row_frames
from pulsegrid.operators.timegrid import floor_time, mean_per_instant, resample

METRICS = ("click", "error", "purchase", "signup", "view")
WINDOW = 10
TRAIN_DAYS, NORMAL_DAYS, HALF_DAYS = 20, 25, 15
FAULT_VALUE = 100
FIRST_DAY = "timestamp_ntz'2024-01-01 00:00:00'"


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a query with its SQL twin."""

    def add(fn):
        QUERIES[name] = Query(fn, sql)
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_in(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Rows of a table from its file footers: an upper bound for every group within it."""
    return table(spark, sf_dir, name).count()


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def day(n: int) -> Column:
    return F.expr(f"{FIRST_DAY} + interval {n} days")


# --- events as a metric stream ------------------------------------------------------------------

EV = r"""ev AS (
  SELECT event_id, ts, event_type AS metric, value, user_id,
         CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k
  FROM events)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", r'"k": *([0-9]+)', 1).cast("int")
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("event_type").alias("metric"), "value", "user_id", k.alias("k")
    )


HOURLY = """hourly AS (
  SELECT metric, date_trunc('hour', ts) AS ts, avg(value) AS value
  FROM (SELECT metric, ts, avg(value) AS value FROM ev GROUP BY metric, ts)
  GROUP BY metric, date_trunc('hour', ts))"""


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(mean_per_instant(events(spark, sf_dir)), "1 hour")


# --- fault and normal intervals -------------------------------------------------------------------

INTERVALS = f"""intervals AS (
  SELECT ts AS start_ts, ts + to_minutes(10 + k) AS end_ts, 1 AS label
  FROM ev WHERE metric = 'error' AND value > {FAULT_VALUE}
  UNION ALL
  SELECT DISTINCT date_trunc('day', ts), date_trunc('day', ts) + INTERVAL 1 DAY, 0
  FROM ev WHERE ts < TIMESTAMP '2024-01-01' + INTERVAL {NORMAL_DAYS} DAY)"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    faults = ev.where(f"metric = 'error' and value > {FAULT_VALUE}").select(
        F.col("ts").alias("start_ts"),
        (F.col("ts") + F.make_interval(mins=F.col("k") + 10)).alias("end_ts"),
        F.lit(1).alias("label"),
    )
    days = ev.where(F.col("ts") < day(NORMAL_DAYS)).select(floor_time(F.col("ts"), "1 day").alias("start_ts")).distinct()
    normal = days.select("start_ts", (F.col("start_ts") + F.expr("interval 1 day")).alias("end_ts"), F.lit(0).alias("label"))
    return faults.unionByName(normal)


MARKS = """marks AS (SELECT DISTINCT date_trunc('hour', ts) AS ts FROM ev),
marked AS (
  SELECT m.ts, coalesce(max(i.label), -1) AS label
  FROM marks m LEFT JOIN intervals i ON m.ts >= i.start_ts AND m.ts <= i.end_ts
  GROUP BY m.ts)"""


def hour_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(floor_time(F.col("ts"), "1 hour").alias("ts")).distinct()


# --- scores: distance of a value from the mean of the 9 before it ----------------------------------

SCORES = f"""scores AS (
  SELECT event_id, ts, metric, label_pos, round(abs(value - before), 6) AS score FROM (
    SELECT event_id, ts, metric, value,
           row_number() OVER (PARTITION BY metric ORDER BY ts, event_id) - 1 AS label_pos,
           avg(value) OVER w AS before, count(value) OVER w AS n_before
    FROM ev WINDOW w AS (PARTITION BY metric ORDER BY ts, event_id ROWS BETWEEN {WINDOW - 1} PRECEDING AND 1 PRECEDING))
  WHERE n_before = {WINDOW - 1})"""


def event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.operators.scoring import prediction_error, rolling_mean_prediction

    predicted = rolling_mean_prediction(
        events(spark, sf_dir), ["metric"], ["ts", "event_id"], ["value"], WINDOW, rows_in(spark, sf_dir, "events")
    )
    return predicted.select("event_id", "ts", "metric", r6(prediction_error([("value", "value_pred")])).alias("score"))


# --- events as log lines ----------------------------------------------------------------------------

MESSAGE_SQL = (
    "CASE WHEN k % 4 = 0 THEN 'cache miss for user ' || user_id "
    "WHEN k % 4 = 1 THEN 'handled ' || metric || ' in ' || value || ' ms' "
    "WHEN k % 4 = 2 THEN 'retry ' || k || ' of ' || metric || ' request from 10.0.' || (k % 7) || '.' || (user_id % 250) "
    "ELSE 'closed session 0x' || k || 'af after ' || value || ' s' END"
)

LINES = rf"""lines AS (
  SELECT event_id, ts, metric, k,
    CASE WHEN metric = 'purchase' AND value > 60 THEN '  at app.handler(line ' || k || ')'
         WHEN metric = 'signup' AND k = 3 THEN '   '
         ELSE CASE WHEN k % 13 = 0 THEN '  ' ELSE '' END || strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') || ' ' ||
              CASE metric WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END || ' ' || user_id ||
              ' --- [worker-' || (user_id % 8) || '] app.' || metric || ' : ' || {MESSAGE_SQL} || CASE WHEN k % 11 = 0 THEN '  ' ELSE '' END END AS line
  FROM ev)"""


PARSED = rf"""parsed AS (
  SELECT event_id, regexp_extract(trim(line), '{LOG_LINE}', 2) AS log_level, regexp_extract(trim(line), '{LOG_LINE}', 3) AS process_id,
         regexp_extract(trim(line), '{LOG_LINE}', 4) AS thread, regexp_extract(trim(line), '{LOG_LINE}', 5) AS logger,
         regexp_extract(trim(line), '{LOG_LINE}', 6) AS message, date_trunc('millisecond', ts) AS ts
  FROM lines WHERE regexp_matches(trim(line), '{LOG_LINE}'))"""

TEMPLATED = rf"""templated AS (
  SELECT *, regexp_replace(message, '{VARIABLE_PARTS}', '<*>', 'g') AS template FROM parsed),
counted AS (
  SELECT template, count(*) AS n, min(struct_pack(ts := ts, event_id := event_id)) AS first_seen FROM templated GROUP BY template),
numbered AS (
  SELECT template, n, row_number() OVER (ORDER BY n DESC, first_seen DESC) AS number FROM counted)"""


def event_message() -> Column:
    k, user, metric, value = F.col("k"), F.col("user_id").cast("string"), F.col("metric"), F.col("value").cast("string")
    text = k.cast("string")
    return (
        F.when(k % 4 == 0, F.concat(F.lit("cache miss for user "), user))
        .when(k % 4 == 1, F.concat(F.lit("handled "), metric, F.lit(" in "), value, F.lit(" ms")))
        .when(
            k % 4 == 2,
            F.concat(
                F.lit("retry "), text, F.lit(" of "), metric, F.lit(" request from 10.0."), (k % 7).cast("string"), F.lit("."),
                (F.col("user_id") % 250).cast("string"),
            ),
        )
        .otherwise(F.concat(F.lit("closed session 0x"), text, F.lit("af after "), value, F.lit(" s")))
    )


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events rendered as log text, with some lines that are no log record."""
    level = F.when(F.col("metric") == "error", "ERROR").when(F.col("metric") == "signup", "WARN").otherwise("INFO")
    record = log_line(
        iso_millis(F.col("ts")), level, F.col("user_id"), F.concat(F.lit("worker-"), (F.col("user_id") % 8).cast("string")),
        F.concat(F.lit("app."), F.col("metric")), event_message(),
    )
    line = (
        F.when((F.col("metric") == "purchase") & (F.col("value") > 60), F.concat(F.lit("  at app.handler(line "), F.col("k").cast("string"), F.lit(")")))
        .when((F.col("metric") == "signup") & (F.col("k") == 3), F.lit("   "))
        .otherwise(F.concat(F.when(F.col("k") % 13 == 0, "  ").otherwise(""), record, F.when(F.col("k") % 11 == 0, "  ").otherwise("")))
    )
    return events(spark, sf_dir).select("event_id", line.alias("value"))


def sql(*parts: str, body: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + body


def recursive_sql(*parts: str, body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body
