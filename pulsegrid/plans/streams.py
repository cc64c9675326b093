"""Queries that run a stream over the event files until nothing is left, and return what it wrote."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators import alerts as A
from pulsegrid.operators import spot
from pulsegrid.operators.labels import label_points
from pulsegrid.operators.metrics import apply_scaler, fit_scaler
from pulsegrid.operators.threshold import fit_thresholds
from pulsegrid.plans.base import EV, HALF_DAYS, INTERVALS, day, event_scores, events, intervals, query, r6, rows_in, sql, table
from pulsegrid.plans.detection import ALERT_SQL, DEPTH, DRIFT_SQL, GRID_SQL, QUANTILE, RISK, RULES, SPOT_SQL, alert_sql, fit_sql
from pulsegrid.plans.labels import LABELLED
from pulsegrid.storage import durable, new_table_path
from pulsegrid.streaming import align, detect, landing
from pulsegrid.streaming.alerts import alerts_stream
from pulsegrid.streaming.scoring import read_stream, score_stream

BATCHES, FILES, BATCH_ROWS, SMALL = 4, 8, 400_000, 1_000

#: Rows of a micro-batch whose rows meet by id only, so that no task holds what a series has of it.
ID_BATCH_ROWS = 2_000_000


def _drain(stream: DataFrame) -> DataFrame:
    """Run the stream over all that is available now; its sink as a table."""
    spark = stream.sparkSession
    path = new_table_path(spark, "stream")
    running = (
        stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint")
        .outputMode("append").trigger(availableNow=True).start()
    )
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def _stream_of(df: DataFrame, arrival: tuple[str, ...] = ("ts", "event_id"), batch_rows: int | None = None) -> DataFrame:
    """A stream in several micro-batches over a table that is laid out in order of ``arrival`` first, as a replay arrives.

    The table is cut in that order into spans of about ``batch_rows`` (``BATCH_ROWS``) rows, ``BATCHES`` of them at least, so a micro-batch and what it holds
    of a key stay as large as they are when the table grows. Each is written as some files after the one before, and a micro-batch takes that many.
    """
    spark, rows = df.sparkSession, df.count()
    placed, path = new_table_path(spark, "spans"), new_table_path(spark, "source")
    spans = max(BATCHES, math.ceil(rows / (batch_rows or BATCH_ROWS)))
    files = FILES if rows >= SMALL * spans else 1  # few rows may not fill every file
    df.repartitionByRange(spans, *arrival).withColumn("_span", F.spark_partition_id()).write.partitionBy("_span").parquet(placed)
    filled = spark.read.schema("_span int").parquet(placed).distinct().orderBy("_span").collect()
    for row in filled:
        part = spark.read.schema(df.schema).parquet(f"{placed}/_span={row['_span']}")
        part.repartition(files).write.mode("append").parquet(path)
    if not filled:
        df.limit(0).write.parquet(path)
    return read_stream(spark, path, df.schema, files_per_batch=files)


@query(
    "stream_resample",
    sql(EV, body="""SELECT metric, ts, round(avg(value), 6) AS value, count(*) AS points FROM (SELECT metric, date_trunc('hour', ts) AS ts, value FROM ev)
WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 30 SECOND FROM ev) GROUP BY metric, ts"""),
)
def stream_resample(spark, sf):
    """Hourly means of the event files as a stream; intervals that the watermark has passed."""
    raw = _stream_of(table(spark, sf, "events"))
    rows = raw.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("metric"), "value")
    grid = _drain(align.aligned(rows, "1 hour"))
    return grid.select("metric", F.col("ts").cast("timestamp_ntz").alias("ts"), r6("value").alias("value"), "points")


def _detected(spark, sf, depth):
    detect.use_rocksdb(spark)
    scores, rows = durable(event_scores(spark, sf), "scores"), rows_in(spark, sf, "events")
    keys, order, half = ["metric"], ["ts", "event_id"], day(HALF_DAYS)
    base, live = scores.where(F.col("ts") < half), scores.where(F.col("ts") >= half)
    states = durable(spot.start_states(base, keys, order, "score", QUANTILE, RISK, depth=depth, group_rows=rows), "states")
    found = _drain(detect.detect_stream(_stream_of(live), states, keys, order, depth=depth))
    rounded = {c: F.round(c, 4) for c in ("initial_threshold", "final_threshold", "mean_threshold")}
    return spot.trace_summary(found, keys, order).withColumns(rounded | {"alarm_rate": r6("alarm_rate")})


@query("stream_spot", SPOT_SQL)
def stream_spot(spark, sf):
    """The threshold detector on a stream of scores, from states calibrated on the first half."""
    return _detected(spark, sf, 0)


@query("stream_drift_spot", DRIFT_SQL)
def stream_drift_spot(spark, sf):
    """The drift detector on a stream of scores: the last accepted scores are part of the state."""
    return _detected(spark, sf, DEPTH)


@query("stream_alerts", ALERT_SQL)
def stream_alerts(spark, sf):
    """Alerts with persistence and cooldown on a stream of events."""
    detect.use_rocksdb(spark)
    rows = events(spark, sf).withColumn("service", F.col("user_id") % 10).select("event_id", "ts", "service", "metric", "value")
    fired = _drain(alerts_stream(A.crossings(_stream_of(rows), RULES), ["service", "metric"], ["ts", "event_id"], keep_ms=None))
    return fired.select("event_id", "service", "metric", "state", "level")


KEEP_SECONDS = 7200


@query("alerts_with_expiry", alert_sql(KEEP_SECONDS))
def alerts_with_expiry(spark, sf):
    """Alerts of series that start anew after two hours without a row."""
    rows = events(spark, sf).withColumn("service", F.col("user_id") % 10).select("event_id", "ts", "service", "metric", "value")
    fired = A.alerts(A.crossings(rows, RULES), ["service", "metric"], ["ts", "event_id"], 3 * rows_in(spark, sf, "events"), KEEP_SECONDS * 1000)
    return fired.select("event_id", "service", "metric", "state", "level")


@query("stream_alerts_expiring", alert_sql(KEEP_SECONDS))
def stream_alerts_expiring(spark, sf):
    """The same on a stream: event-time timers free the state of silent series."""
    detect.use_rocksdb(spark)
    rows = events(spark, sf).select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 10).alias("service"), "metric", "value")
    fired = _drain(alerts_stream(A.crossings(_stream_of(rows), RULES), ["service", "metric"], ["ts", "event_id"], KEEP_SECONDS * 1000))
    return fired.select("event_id", "service", "metric", "state", "level")


GAP_SECONDS = 1800


@query(
    "stream_periods",
    sql(EV, INTERVALS, LABELLED, f"""u AS (SELECT e.metric, e.ts, event_id FROM labelled JOIN ev e USING (event_id) WHERE label = -1),
o AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < {GAP_SECONDS * 1_000_000} THEN 0 ELSE 1 END AS opens FROM u WINDOW w AS (PARTITION BY metric ORDER BY ts, event_id)),
g AS (SELECT *, sum(opens) OVER (PARTITION BY metric ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS period FROM o)""",
        body=f"""SELECT metric, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS instants FROM g GROUP BY metric, period
HAVING max(ts) + INTERVAL {GAP_SECONDS} SECOND <= (SELECT max(ts) - INTERVAL 30 SECOND FROM u)"""),
)
def stream_periods(spark, sf):
    """Periods of unlabelled rows per metric as sessions that stay open over micro-batches; those that the watermark has passed."""
    marked = label_points(events(spark, sf).select("event_id", "metric", "ts"), intervals(spark, sf), group_rows=rows_in(spark, sf, "events"))
    rows = _stream_of(marked.select("event_id", "metric", F.col("ts").cast("timestamp").alias("ts"), "label"))
    found = _drain(align.unlabelled_periods(rows, ["metric"], f"{GAP_SECONDS} seconds"))
    return found.select("metric", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start_ts", "end_ts")], "instants")


@query("stream_dedup", sql(EV, body="SELECT event_id, ts, metric, value FROM ev"))
def stream_dedup(spark, sf):
    """Rows that are sent again: at once, a day later and, long after their state has gone, ten days later. Each is kept once."""
    rows = events(spark, sf).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "metric", "value", "k")
    days = F.when(F.col("k") % 3 == 0, F.array(F.lit(0), F.lit(1))).when(F.col("k") % 3 == 1, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0), F.lit(10)))
    sent = rows.withColumn("_days", F.explode(days)).withColumn("arrived", F.col("ts") + F.make_dt_interval(F.col("_days"))).drop("_days", "k")
    once = _drain(align.deduplicated(_stream_of(sent, ("arrived", "event_id"), ID_BATCH_ROWS), ["event_id"], watermark="2 days"))
    return once.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "metric", "value")


@query(
    "stream_slices",
    sql(EV, body="SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y%m%d-%H%M') AS slice, count(*) AS n, round(sum(value), 6) AS total FROM ev GROUP BY 1"),
)
def stream_slices(spark, sf):
    """Every row landed once by slice of six hours, batch by batch; the last batch comes twice."""
    path = new_table_path(spark, "slices")
    rows = _stream_of(events(spark, sf).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value"))
    landing.land_slices_once(rows, path, f"{path}/checkpoint", minutes=360).awaitTermination()
    last = landing.ledger(spark, path).agg(F.max(landing.BATCH)).first()[0]
    if last is not None:
        again = durable(landing.landed(spark, path, rows.schema).where(F.col(landing.BATCH) == last).select(*rows.columns), "again")
        landing.slice_writer(path, minutes=360)(again, last)
    return landing.landed(spark, path, rows.schema).groupBy("slice").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value")).alias("total"))


@query(
    "stream_monitor",
    sql(EV, GRID_SQL, f"""stats AS (SELECT metric, avg(value) AS mean, CASE WHEN stddev_samp(value) > 0 THEN stddev_samp(value) ELSE 1 END AS std FROM ev WHERE ts < TIMESTAMP '2024-01-01' + INTERVAL {HALF_DAYS} DAY GROUP BY 1),
z AS (SELECT event_id, ts, metric, abs((value - mean) / std) AS score FROM ev JOIN stats USING (metric)),
base AS (SELECT metric, score FROM z WHERE ts < TIMESTAMP '2024-01-01' + INTERVAL {HALF_DAYS} DAY)""", fit_sql("base"), f"""hits AS (SELECT z.* FROM z JOIN fit USING (metric) WHERE z.ts >= TIMESTAMP '2024-01-01' + INTERVAL {HALF_DAYS} DAY AND z.score > threshold)""",
        body="SELECT metric, count(*) AS alarms, max_by(event_id, struct_pack(ts, event_id)) AS event_id, max(ts) AS ts, round(max_by(score, struct_pack(ts, event_id)), 6) AS score FROM hits GROUP BY metric"),
)
def stream_monitor(spark, sf):
    """Scores of a stream by trained means and thresholds, and the status table that it keeps: the latest alarm of every metric."""
    rows, half, path = rows_in(spark, sf, "events"), day(HALF_DAYS), new_table_path(spark, "monitor")
    readings = events(spark, sf).select("event_id", "ts", "metric", "value")
    base = readings.where(F.col("ts") < half)
    stats = durable(fit_scaler(base), "stats")
    scored = apply_scaler(base, stats, ["metric"], "value", "z").select("metric", F.abs("z").alias("score"))
    limits = durable(fit_thresholds(scored, ["metric"], "score", QUANTILE, RISK, group_rows=rows), "limits")
    live = score_stream(_stream_of(readings.where(F.col("ts") >= half)), stats, limits)
    landing.keep_status(live, path, f"{path}-checkpoint", ["metric"], ["ts", "event_id"]).awaitTermination()
    found = landing.current_status(spark, path, ["metric"], ["ts", "event_id"], live.schema)
    return found.select("metric", "alarms", "event_id", "ts", r6("score").alias("score"))
