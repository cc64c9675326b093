"""Queries on metric selection, cleaning, alignment and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.operators import metrics as M
from pulsegrid.operators import quality as Q
from pulsegrid.operators import timegrid as G
from pulsegrid.operators.labels import collapse_labels
from pulsegrid.plans.base import (
    EV, HOURLY, METRICS, TRAIN_DAYS, day, events, hourly, query, r6, rows_in, sql,
)
from pulsegrid.storage import durable

CATALOGUE = (
    M.MetricSpec("load", "error_value", "error", "value"),
    M.MetricSpec("load", "view_k7", "view", "value", {"k": "7"}),
    M.MetricSpec("traffic", "click_value", "click", "value"),
    M.MetricSpec("traffic", "click_user", "click", "user_id", {"region": "eu"}),
    M.MetricSpec("traffic", "refund_value", "refund", "value"),
)


def _long_rows(spark, sf):
    """Events in long metric form: value under ``_field`` / ``_value``, k as a tag, user_id as a real column."""
    return events(spark, sf).select(
        "event_id", "ts", F.col("metric").alias("_measurement"), F.lit("value").alias("_field"), F.col("value").alias("_value"),
        "user_id", F.create_map(F.lit("k"), F.col("k").cast("string")).alias("tags"),
    )


@query(
    "metric_scan_filter",
    sql(EV, body="""
SELECT 'load' AS "group", 'error_value' AS metric, event_id, value FROM ev WHERE metric = 'error'
UNION ALL SELECT 'load', 'view_k7', event_id, value FROM ev WHERE metric = 'view' AND k = 7
UNION ALL SELECT 'traffic', 'click_value', event_id, value FROM ev WHERE metric = 'click'
UNION ALL SELECT 'traffic', 'click_user', event_id, CAST(user_id AS DOUBLE) FROM ev WHERE metric = 'click' AND FALSE"""),
)
def metric_scan_filter(spark, sf):
    # The tag "region" is in no row's tag map, so the metric filtered by it has no rows.
    return M.select_metrics(_long_rows(spark, sf), CATALOGUE).select("group", "metric", "event_id", "value")


@query(
    "missing_metrics",
    sql(EV, body="""
SELECT c."group", c.metric FROM (VALUES ('load','error_value','error'), ('load','view_k7','view'), ('traffic','click_value','click'),
  ('traffic','click_user','none'), ('traffic','refund_value','refund')) c("group", metric, measurement)
WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.metric = c.measurement)"""),
)
def missing_metrics(spark, sf):
    return M.missing_metrics(M.select_metrics(_long_rows(spark, sf), CATALOGUE), CATALOGUE)


@query(
    "value_coercion",
    sql(EV, body="""
SELECT event_id, metric, CAST(replace(replace(dirty, '"', ''), ',', '') AS DOUBLE) AS number FROM (
  SELECT event_id, metric, CASE WHEN k = 13 THEN 'n/a' WHEN k = 14 THEN NULL WHEN k % 5 = 0 THEN '"' || value || '"'
    WHEN k % 5 = 1 THEN substr(CAST(value AS VARCHAR), 1, 1) || ',' || substr(CAST(value AS VARCHAR), 2) ELSE CAST(value AS VARCHAR) END AS dirty
  FROM ev) WHERE dirty <> 'n/a'"""),
)
def value_coercion(spark, sf):
    k, text = F.col("k"), F.col("value").cast("string")
    dirty = (
        F.when(k == 13, F.lit("n/a"))
        .when(k == 14, None)
        .when(k % 5 == 0, F.concat(F.lit('"'), text, F.lit('"')))
        .when(k % 5 == 1, F.concat(F.substring(text, 1, 1), F.lit(","), F.substring(text, 2, 100)))
        .otherwise(text)
    )
    numbers = events(spark, sf).withColumn("number", M.to_number(dirty))
    return M.drop_null_points(numbers, "number").select("event_id", "metric", "number")


@query(
    "epoch_unit_normalise",
    sql(EV, body="""
SELECT unit, ms // 86400000 AS day, count(*) AS n, min(ms) AS first_ms, max(ms) AS last_ms, CAST(sum(ms) AS BIGINT) AS sum_ms FROM (
  SELECT 's' AS unit, (epoch_us(ts) // 1000000) * 1000 AS ms FROM ev
  UNION ALL SELECT 'ms', epoch_us(ts) // 1000 FROM ev
  UNION ALL SELECT 'us', epoch_us(ts) // 1000 FROM ev
  UNION ALL SELECT 'ns', epoch_us(ts) // 1000 FROM ev)
GROUP BY unit, ms // 86400000"""),
)
def epoch_unit_normalise(spark, sf):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    units = {"s": F.floor(micros / 1_000_000), "ms": F.floor(micros / 1000), "us": micros, "ns": micros * 1000 + 999}
    out = None
    for unit, value in units.items():
        part = M.normalise_epoch(events(spark, sf).select(value.cast("long").alias("_time"))).withColumn("unit", F.lit(unit))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("unit", F.floor(F.col("_time") / 86_400_000).alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.min("_time").alias("first_ms"), F.max("_time").alias("last_ms"), F.sum("_time").alias("sum_ms")
    )


@query("hourly_resample", sql(EV, HOURLY, body="SELECT metric, ts, round(value, 6) AS value FROM hourly"))
def hourly_resample(spark, sf):
    return hourly(spark, sf).select("metric", "ts", r6("value").alias("value"))


@query(
    "metric_ranges",
    sql(EV, body="SELECT metric, count(value) AS points, min(value) AS min_value, max(value) AS max_value FROM ev GROUP BY metric"),
)
def metric_ranges(spark, sf):
    return G.range_per_metric(events(spark, sf))


@query(
    "zscore_by_metric",
    sql(EV, f"""stats AS (
  SELECT metric, avg(value) AS mean, stddev_samp(value) AS std FROM ev
  WHERE metric <> 'signup' AND ts < TIMESTAMP '2024-01-01' + INTERVAL {TRAIN_DAYS} DAY GROUP BY metric)""",
        body="""SELECT event_id, metric, round(CASE WHEN std > 0 THEN (value - mean) / std ELSE value END, 6) AS z
FROM ev LEFT JOIN stats USING (metric)"""),
)
def zscore_by_metric(spark, sf):
    ev = events(spark, sf)
    stats = M.fit_scaler(ev.where((F.col("metric") != "signup") & (F.col("ts") < day(TRAIN_DAYS))))
    return M.apply_scaler(ev, durable(stats, "stats")).select("event_id", "metric", r6("z").alias("z"))


FILL_SQL = sql(
    EV,
    """grid AS (
  SELECT metric, time_bucket(INTERVAL 10 MINUTE, ts) AS ts, avg(value) AS value
  FROM (SELECT metric, ts, avg(value) AS value FROM ev GROUP BY metric, ts) GROUP BY 1, 2),
full_grid AS (
  SELECT m.metric, t.ts, g.value
  FROM (SELECT DISTINCT ts FROM grid) t CROSS JOIN (SELECT DISTINCT metric FROM grid) m
  LEFT JOIN grid g ON g.metric = m.metric AND g.ts = t.ts),
p AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY ts) - 1 AS p FROM full_grid),
ff AS (  -- forward fill, 3 rows
  SELECT metric, ts, p, coalesce(value, lag(value, 1) OVER w, lag(value, 2) OVER w, lag(value, 3) OVER w) AS v
  FROM p WINDOW w AS (PARTITION BY metric ORDER BY p)),
known AS (
  SELECT *, max(CASE WHEN v IS NOT NULL THEN p END) OVER (PARTITION BY metric ORDER BY p ROWS UNBOUNDED PRECEDING) AS ap,
         min(CASE WHEN v IS NOT NULL THEN p END) OVER (PARTITION BY metric ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bp FROM ff),
ip AS (  -- linear interpolation, 10 rows from either side
  SELECT k.metric, k.ts, k.p, CASE WHEN k.v IS NOT NULL THEN k.v
      WHEN k.p - k.ap <= 10 OR k.bp - k.p <= 10 THEN
        CASE WHEN k.ap IS NULL THEN b.v WHEN k.bp IS NULL THEN a.v ELSE a.v + (b.v - a.v) / (k.bp - k.ap) * (k.p - k.ap) END END AS v
  FROM known k LEFT JOIN ff a ON a.metric = k.metric AND a.p = k.ap LEFT JOIN ff b ON b.metric = k.metric AND b.p = k.bp),
bf AS (  -- backward fill, 3 rows
  SELECT metric, ts, p, coalesce(v, lead(v, 1) OVER w, lead(v, 2) OVER w, lead(v, 3) OVER w) AS v
  FROM ip WINDOW w AS (PARTITION BY metric ORDER BY p))""",
    body="""SELECT metric, ts, round(coalesce(
    last_value(v IGNORE NULLS) OVER (PARTITION BY metric ORDER BY p ROWS UNBOUNDED PRECEDING),
    first_value(v IGNORE NULLS) OVER (PARTITION BY metric ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS value
FROM bf""",
)


@query("metric_matrix_fill", FILL_SQL)
def metric_matrix_fill(spark, sf):
    grid = G.resample(G.mean_per_instant(events(spark, sf)), "10 minutes")
    complete = G.to_long(G.to_wide(grid, METRICS), METRICS)
    filled = G.fill_gaps(complete, group_rows=rows_in(spark, sf, "events"))
    return filled.select("metric", "ts", r6("value").alias("value"))


@query(
    "overlap_clip",
    sql(EV, HOURLY, """m AS (SELECT ts, avg(value) AS value FROM hourly GROUP BY ts),
l AS (SELECT date_trunc('hour', ts) AS ts, count(*) AS records FROM ev WHERE metric = 'error' AND ts >= TIMESTAMP '2024-01-04' GROUP BY 1),
span AS (SELECT greatest((SELECT min(ts) FROM m), (SELECT min(ts) FROM l)) AS lo, least((SELECT max(ts) FROM m), (SELECT max(ts) FROM l)) AS hi)""",
        body="""SELECT m.ts, round(m.value, 9) AS value, l.records
FROM m LEFT JOIN l USING (ts), span
WHERE m.ts BETWEEN lo AND least(hi, lo + INTERVAL 10 DAY)
ORDER BY m.ts LIMIT 200"""),
)
def overlap_clip(spark, sf):
    metrics = hourly(spark, sf).groupBy("ts").agg(F.avg("value").alias("value"))
    errors = events(spark, sf).where((F.col("metric") == "error") & (F.col("ts") >= day(3)))
    logs = errors.groupBy(G.floor_time(F.col("ts"), "1 hour").alias("ts")).agg(F.count(F.lit(1)).alias("records"))
    metrics, logs = G.clip_to_overlap(metrics, logs, first_minutes=10 * 24 * 60)
    capped = G.first_instants(metrics, 200)
    return G.align_left(capped, logs).select("ts", F.round("value", 9).alias("value"), "records")


@query(
    "duplicate_collapse",
    sql(EV, body="""
SELECT metric, date_trunc('hour', ts) AS ts, round(avg(value), 6) AS mean_value,
       max_by(CASE WHEN k % 3 > 0 THEN value END, struct_pack(o := ts, e := event_id)) FILTER (WHERE k % 3 > 0) AS last_value
FROM ev GROUP BY 1, 2"""),
)
def duplicate_collapse(spark, sf):
    rows = events(spark, sf).select(
        "metric", F.col("ts").alias("at"), "event_id", G.floor_time(F.col("ts"), "1 hour").alias("ts"),
        F.col("value").alias("mean_value"), F.when(F.col("k") % 3 > 0, F.col("value")).alias("last_value"),
    )
    mean = G.collapse_mean(rows, ["metric", "ts"], ["mean_value"])
    last = G.collapse_last(rows, ["metric", "ts"], ["last_value"], ["at", "event_id"])
    return mean.join(last, ["metric", "ts"]).select("metric", "ts", r6("mean_value").alias("mean_value"), "last_value")


@query(
    "label_collapse",
    sql(EV, body="""
SELECT date_trunc('minute', ts) AS ts, max(CASE WHEN k < 10 THEN 1 WHEN k < 50 THEN -1 ELSE 0 END) AS label FROM ev GROUP BY 1"""),
)
def label_collapse(spark, sf):
    label = F.when(F.col("k") < 10, 1).when(F.col("k") < 50, -1).otherwise(0)
    return collapse_labels(events(spark, sf).select(G.floor_time(F.col("ts"), "1 minute").alias("ts"), label.alias("label")))


@query(
    "metric_quality",
    sql(EV.replace("ev AS", "whole AS"), """ev AS (SELECT * REPLACE (CASE WHEN k % 7 > 1 OR metric = 'view' THEN value END AS value) FROM whole)""", """back AS (
  SELECT metric, count(*) FILTER (WHERE ts < before) AS backward_steps FROM (
    SELECT metric, ts, lag(ts) OVER (PARTITION BY metric ORDER BY event_id) AS before FROM ev) GROUP BY metric),
g AS (
  SELECT metric, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY metric ORDER BY ts) AS step FROM ev),
gaps AS (SELECT metric, count(*) FILTER (WHERE step > 3600000000) AS gap_count, max(step) FILTER (WHERE step > 3600000000) / 1e6 AS max_gap,
  coalesce(sum(step) FILTER (WHERE step > 3600000000), 0) / 1e6 AS total_gap FROM g GROUP BY metric),
stats AS (SELECT metric, count(*) AS points, count(*) FILTER (WHERE value IS NULL) AS nan_count, min(value) AS min_value, max(value) AS max_value,
  avg(value) AS mean_value, stddev_samp(value) AS std_value, skewness(value) AS skewness, kurtosis(value) AS kurtosis FROM ev GROUP BY metric),
o AS (SELECT ev.metric, count(*) FILTER (WHERE abs((value - mean_value) / std_value) > 3) AS outliers FROM ev JOIN stats USING (metric) GROUP BY ev.metric)""",
        body="""SELECT metric, points, nan_count, min_value, max_value, round(mean_value, 6) AS mean_value, round(std_value, 6) AS std_value,
  round(skewness, 6) AS skewness, round(kurtosis, 6) AS kurtosis, outliers, round(outliers / points * 100, 6) AS outlier_percentage,
  gap_count, round(max_gap, 3) AS max_gap, round(total_gap, 3) AS total_gap, backward_steps,
  nan_count = 0 AND gap_count = 0 AND points > 0 AND backward_steps = 0 AS valid
FROM stats JOIN o USING (metric) JOIN gaps USING (metric) JOIN back USING (metric)"""),
)
def metric_quality(spark, sf):
    missing = F.when(F.col("k") % 7 == 0, F.lit(float("nan"))).when(F.col("k") % 7 != 1, F.col("value"))
    rows = events(spark, sf).withColumn("value", F.when(F.col("metric") == "view", F.col("value")).otherwise(missing))
    report = Q.metric_quality(rows, gap_seconds=3600, group_rows=rows_in(spark, sf, "events"), arrival=["event_id"])
    rounded = {c: r6(c) for c in ("mean_value", "std_value", "skewness", "kurtosis", "outlier_percentage")}
    rounded |= {c: F.round(c, 3) for c in ("max_gap", "total_gap")}
    return report.withColumns(rounded)


@query(
    "timeline_order",
    sql(EV, body="""
SELECT metric, coalesce(CAST(sum(CASE WHEN ts < before THEN 1 ELSE 0 END) AS BIGINT), 0) AS backward_steps FROM (
  SELECT metric, ts, lag(ts) OVER (PARTITION BY metric ORDER BY k, event_id) AS before FROM ev) GROUP BY metric"""),
)
def timeline_order(spark, sf):
    return G.backward_steps(events(spark, sf), ["metric"], "ts", ["k", "event_id"], rows_in(spark, sf, "events"))


@query(
    "column_profile",
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS known, count(try_cast({c} AS DOUBLE)) AS numeric, "
        f"CASE WHEN count({c}) = 0 THEN 'empty' WHEN count(try_cast({c} AS DOUBLE)) >= count({c}) THEN 'continuous' ELSE 'categorical' END AS kind "
        f"FROM (SELECT user_id, event_type, value, props, NULL AS reserved FROM events)"
        for c in ("user_id", "event_type", "value", "props", "reserved")
    ) + ")",
)
def column_profile(spark, sf):
    from pulsegrid.plans.base import table

    rows = table(spark, sf, "events").drop("event_id", "ts").withColumn("reserved", F.lit(None).cast("string"))
    return Q.column_profile(rows)


@query(
    "nan_counts",
    sql(EV, body="""SELECT metric, count(*) FILTER (WHERE k % 11 = 0) AS ratio, count(*) FILTER (WHERE k % 7 = 0) AS value FROM ev GROUP BY metric"""),
)
def nan_counts(spark, sf):
    rows = events(spark, sf).select(
        "metric", F.when(F.col("k") % 11 != 0, F.col("value") / 2).otherwise(F.lit(float("nan"))).alias("ratio"),
        F.when(F.col("k") % 7 != 0, F.col("value")).alias("value"),
    )
    return Q.nan_counts(rows, ["ratio", "value"], ["metric"])


REPAIR_BASE = """raw AS (
  SELECT event_id, metric AS m, CASE WHEN k % 10 = 0 THEN 'memory_' || metric WHEN k % 10 = 1 THEN 'spare_' || metric ELSE metric END AS _measurement,
    CASE WHEN k % 10 IN (0, 1) OR metric IN ('click', 'view') OR k % 9 = 0 THEN value - 5 END AS counter0,
    CASE WHEN k % 10 IN (0, 1) OR metric IN ('error', 'signup') OR (k % 8 = 0 AND metric <> 'purchase') THEN value - 10 END AS gauge0 FROM ev),
clean AS (SELECT event_id, _measurement, CASE WHEN counter0 < 0 THEN 0.0 ELSE counter0 END AS counter, CASE WHEN gauge0 < 0 THEN 0.0 ELSE gauge0 END AS gauge FROM raw),
mapping AS (SELECT _measurement, CASE WHEN count(counter) > 0 THEN 'counter' WHEN count(gauge) > 0 THEN 'gauge' END AS value_column
  FROM clean WHERE _measurement IN ('click', 'error', 'purchase', 'signup', 'view') GROUP BY 1)"""


@query(
    "counter_gauge_repair",
    sql(EV, REPAIR_BASE, body="""
SELECT event_id, _measurement,
  CASE WHEN counter IS NOT NULL AND gauge IS NOT NULL AND use = 'gauge' THEN NULL
       WHEN counter IS NULL AND gauge IS NULL AND value_column = 'counter' THEN 0.0 ELSE round(counter, 6) END AS counter,
  CASE WHEN counter IS NOT NULL AND gauge IS NOT NULL AND use = 'counter' THEN NULL
       WHEN counter IS NULL AND gauge IS NULL AND value_column = 'gauge' THEN 0.0 ELSE round(gauge, 6) END AS gauge
FROM (SELECT c.*, value_column, coalesce(value_column, CASE WHEN regexp_matches(c._measurement, 'memory|spec|tasks_state|fs_io_current|fs_limit')
        THEN 'gauge' ELSE 'counter' END) AS use FROM clean c LEFT JOIN mapping m ON m._measurement = c._measurement)"""),
)
def counter_gauge_repair(spark, sf):
    k, metric, value = F.col("k"), F.col("metric"), F.col("value")
    renamed = k % 10
    raw = events(spark, sf).select(
        "event_id",
        F.when(renamed == 0, F.concat(F.lit("memory_"), metric)).when(renamed == 1, F.concat(F.lit("spare_"), metric)).otherwise(metric).alias("_measurement"),
        F.when(renamed.isin(0, 1) | metric.isin("click", "view") | (k % 9 == 0), value - 5).alias("counter"),
        F.when(renamed.isin(0, 1) | metric.isin("error", "signup") | ((k % 8 == 0) & (metric != "purchase")), value - 10).alias("gauge"),
    )
    clean = M.clip_negative(raw)
    mapping = M.value_column_map(clean.where(F.col("_measurement").isin(*METRICS)))
    return M.one_value_column(clean, durable(mapping, "mapping")).select(
        "event_id", "_measurement", r6("counter").alias("counter"), r6("gauge").alias("gauge")
    )
