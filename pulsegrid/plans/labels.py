"""Queries on interval labels, windows and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.operators import labels as L
from pulsegrid.operators import sessions as S
from pulsegrid.operators.timegrid import floor_time
from pulsegrid.operators.windows import sliding_windows, window_label
from pulsegrid.plans.base import (
    EV, FAULT_VALUE, HOURLY, INTERVALS, MARKS, WINDOW, day, events, hour_marks, hourly, intervals, query, r6, rows_in, sql,
)

LABELLED = """labelled AS (
  SELECT e.event_id, e.ts, coalesce(max(i.label), -1) AS label
  FROM ev e LEFT JOIN intervals i ON e.ts >= i.start_ts AND e.ts <= i.end_ts GROUP BY e.event_id, e.ts)"""


def _labelled(spark, sf):
    return L.label_points(
        events(spark, sf).select("event_id", "ts"), intervals(spark, sf), group_rows=rows_in(spark, sf, "events")
    )


def labelled_marks(spark, sf):
    return L.label_points(hour_marks(spark, sf), intervals(spark, sf), group_rows=rows_in(spark, sf, "events"))


@query("interval_labels", sql(EV, INTERVALS, LABELLED, body="SELECT event_id, label FROM labelled"))
def interval_labels(spark, sf):
    return _labelled(spark, sf).select("event_id", "label")


@query(
    "label_alignment_check",
    sql(EV, """m AS (SELECT DISTINCT date_trunc('second', ts) AS s FROM ev WHERE ts >= TIMESTAMP '2024-01-02'),
l AS (SELECT DISTINCT date_trunc('second', ts) AS s FROM ev WHERE k <> 50 OR k % 2 = 1),
b AS (SELECT coalesce(m.s, l.s) AS s, m.s IS NOT NULL AS in_m, l.s IS NOT NULL AS in_l FROM m FULL JOIN l ON m.s = l.s),
c AS (SELECT count(*) FILTER (WHERE in_m) AS metric_instants, count(*) FILTER (WHERE in_m AND NOT in_l) AS missing,
  count(*) FILTER (WHERE NOT in_m) AS label_only FROM b
  WHERE s BETWEEN greatest((SELECT min(s) FROM m), (SELECT min(s) FROM l)) AND least((SELECT max(s) FROM m), (SELECT max(s) FROM l)))""",
        body="SELECT *, metric_instants + label_only > 0 AND missing = 0 AS aligned FROM c"),
)
def label_alignment_check(spark, sf):
    ev = events(spark, sf)
    return L.alignment_check(ev.where(F.col("ts") >= day(1)), ev.where("k <> 50 or k % 2 = 1"))


@query(
    "unlabelled_periods",
    sql(EV, INTERVALS, LABELLED, """u AS (SELECT DISTINCT ts FROM labelled WHERE label = -1),
o AS (SELECT ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts) <= 600000000 THEN 0 ELSE 1 END AS opens FROM u),
g AS (SELECT ts, sum(opens) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS period FROM o)""",
        body="SELECT min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS instants FROM g GROUP BY period"),
)
def unlabelled_periods(spark, sf):
    return L.unlabelled_periods(_labelled(spark, sf), gap_seconds=600, group_rows=rows_in(spark, sf, "events"))


@query(
    "label_ratio",
    sql(EV, INTERVALS, LABELLED, body="""
SELECT count(*) FILTER (WHERE label = 0) AS normal, count(*) FILTER (WHERE label = 1) AS anomalous,
  count(*) FILTER (WHERE label = -1) AS unlabellable, round(avg(label) FILTER (WHERE label <> -1), 6) AS anomaly_ratio FROM labelled"""),
)
def label_ratio(spark, sf):
    return L.label_ratio(_labelled(spark, sf)).withColumn("anomaly_ratio", r6("anomaly_ratio"))


SLIDING_STRIDE = 5


@query(
    "sliding_windows",
    sql(EV, HOURLY, f"""p AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY ts) - 1 AS p FROM hourly),
w AS (SELECT metric, p, ts AS start_ts, last(ts) OVER f AS last_ts, last(value) OVER f AS target, count(*) OVER f AS n,
  list(CAST(round(value * 1000000) AS BIGINT)) OVER f AS steps
  FROM p WINDOW f AS (PARTITION BY metric ORDER BY p ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING))""",
        body=f"""SELECT metric, p // {SLIDING_STRIDE} AS win_id, start_ts, last_ts, round(target, 6) AS target, array_to_string(steps, ',') AS steps
FROM w WHERE n = {WINDOW} AND p % {SLIDING_STRIDE} = 0"""),
)
def sliding_windows_query(spark, sf):
    columns = {
        "start_ts": ("first", F.col("ts")), "last_ts": ("last", F.col("ts")), "target": ("last", F.col("value")),
        "steps": ("list", F.round(F.col("value") * 1_000_000).cast("long")),
    }
    windows = sliding_windows(
        hourly(spark, sf), ["metric"], ["ts"], columns, WINDOW, SLIDING_STRIDE, rows_in(spark, sf, "events")
    )
    steps = F.array_join(F.transform("steps", lambda x: x.cast("string")), ",")
    return windows.select("metric", "win_id", "start_ts", "last_ts", r6("target").alias("target"), steps.alias("steps"))


WINDOW_LABELS = f"""placed AS (SELECT ts, label, row_number() OVER (ORDER BY ts) - 1 AS win_id FROM marked),
framed AS (SELECT win_id, ts AS start_ts, max(label) OVER f AS hi, min(label) OVER f AS lo, count(*) OVER f AS n
  FROM placed WINDOW f AS (ORDER BY win_id ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
win AS (SELECT win_id, start_ts, CASE WHEN hi = 1 THEN 1 WHEN lo = -1 THEN -1 ELSE 0 END AS label FROM framed WHERE n = {WINDOW})"""


def labelled_windows(spark, sf):
    columns = {"start_ts": ("first", F.col("ts")), "_lo": ("min", F.col("label")), "_hi": ("max", F.col("label"))}
    marks = L.labels_on_timeline(hour_marks(spark, sf), labelled_marks(spark, sf))
    framed = sliding_windows(marks, [], ["ts"], columns, WINDOW, 1, rows_in(spark, sf, "events"))
    return framed.select("win_id", "start_ts", window_label(F.col("_lo"), F.col("_hi")).alias("label"))


@query("window_labels", sql(EV, INTERVALS, MARKS, WINDOW_LABELS, body="SELECT * FROM win"))
def window_labels(spark, sf):
    return labelled_windows(spark, sf)


PREDICTION_WINDOWS = """windows AS (
  SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 30 MINUTE AS window_end,
    count(*) FILTER (WHERE value > 90) AS flagged FROM ev GROUP BY 1, 2),
session AS (SELECT TIMESTAMP '2024-01-03' AS session_start, TIMESTAMP '2024-01-28' AS session_end)"""


def _prediction_windows(spark, sf):
    hour = floor_time(F.col("ts"), "1 hour")
    return (
        events(spark, sf).groupBy(hour.alias("window_start")).agg(F.count_if(F.col("value") > 90).alias("flagged"))
        .withColumn("window_end", F.col("window_start") + F.expr("interval 30 minutes"))
        .withColumn("window_id", F.unix_seconds(F.col("window_start").cast("timestamp")))
    )


@query(
    "window_overlap_truth",
    sql(EV, INTERVALS, PREDICTION_WINDOWS, """c AS (
  SELECT w.window_start, w.window_end, w.flagged, count(i.label) FILTER (WHERE i.label = 1) AS faults, count(i.label) FILTER (WHERE i.label = 0) AS normals
  FROM windows w LEFT JOIN intervals i ON i.start_ts <= w.window_end AND i.end_ts >= w.window_start GROUP BY ALL),
t AS (SELECT window_start, flagged, covered, CASE WHEN covered THEN faults ELSE 0 END AS faults, covered AND faults > 0 AS has_anomaly,
  covered AND normals > 0 AND faults = 0 AS is_normal
  FROM (SELECT c.*, session_start <= window_end AND session_end >= window_start AS covered FROM c, session))""",
        body="""SELECT *, CASE WHEN NOT covered THEN NULL WHEN flagged > 0 AND has_anomaly THEN 'TP' WHEN flagged > 0 THEN 'FP'
  WHEN has_anomaly THEN 'FN' ELSE 'TN' END AS verdict FROM t"""),
)
def window_overlap_truth(spark, sf):
    windows = _prediction_windows(spark, sf)
    bounds = events(spark, sf).agg(
        F.greatest(F.min("ts"), day(2)).alias("session_start"), F.lit(day(27)).alias("session_end")
    ).select(F.date_trunc("day", "session_start").cast("timestamp_ntz").alias("session_start"), "session_end")
    rows = 4 * rows_in(spark, sf, "events")
    truth = L.window_truth(windows, intervals(spark, sf), bounds, group_rows=rows)
    return L.verdicts(truth).select("window_start", "flagged", "covered", "faults", "has_anomaly", "is_normal", "verdict")


@query(
    "overlapping_faults",
    sql(EV, INTERVALS, PREDICTION_WINDOWS, body="""
SELECT w.window_start, i.start_ts, i.end_ts FROM windows w JOIN intervals i
  ON i.label = 1 AND i.start_ts <= w.window_end AND i.end_ts >= w.window_start"""),
)
def overlapping_faults(spark, sf):
    pairs = L.overlapping_faults(_prediction_windows(spark, sf), intervals(spark, sf), bin_seconds=3600)
    return pairs.select("window_start", "start_ts", "end_ts")


@query(
    "window_fault_details",
    sql(EV, PREDICTION_WINDOWS, body=f"""SELECT w.window_start, coalesce(CASE f.k % 4 WHEN 0 THEN 'cpu' WHEN 1 THEN 'memory' WHEN 2 THEN 'network' END, '?') AS fault_type, 'service-' || (f.user_id % 5) AS target_service,
  count(*) AS faults, min(f.ts) AS first_start, max(f.ts + to_minutes(10 + f.k)) AS last_end,
  round(sum(epoch_us(least(f.ts + to_minutes(10 + f.k), w.window_end)) - epoch_us(greatest(f.ts, w.window_start))) / 1000000, 6) AS seconds
FROM windows w JOIN ev f ON f.metric = 'error' AND f.value > {FAULT_VALUE} AND f.ts <= w.window_end AND f.ts + to_minutes(10 + f.k) >= w.window_start GROUP BY ALL"""),
)
def window_fault_details(spark, sf):
    """Kinds and targets of the faults of every prediction window."""
    k = F.col("k")
    kind = F.when(k % 4 == 0, "cpu").when(k % 4 == 1, "memory").when(k % 4 == 2, "network")
    faults = events(spark, sf).where((F.col("metric") == "error") & (F.col("value") > FAULT_VALUE)).select(
        F.col("ts").alias("start_ts"), (F.col("ts") + F.make_interval(mins=k + 10)).alias("end_ts"), kind.alias("fault_type"),
        F.concat(F.lit("service-"), (F.col("user_id") % 5).cast("string")).alias("target_service"),
    )
    found = L.fault_details(_prediction_windows(spark, sf), faults, bin_seconds=3600)
    return found.select("window_start", "fault_type", "target_service", "faults", "first_start", "last_end", r6("seconds").alias("seconds"))


FAULTS = """faults AS (SELECT CASE k % 4 WHEN 0 THEN 'cpu' WHEN 1 THEN 'memory' WHEN 2 THEN 'network' END AS fault_type,
  'service-' || (user_id % 40) AS target_service, CAST(10 + k AS DOUBLE) * 60 AS duration_s FROM ev WHERE metric = 'error')"""


def _faults(spark, sf):
    k = F.col("k")
    kind = F.when(k % 4 == 0, "cpu").when(k % 4 == 1, "memory").when(k % 4 == 2, "network")
    return events(spark, sf).where("metric = 'error'").select(
        kind.alias("fault_type"), F.concat(F.lit("service-"), (F.col("user_id") % 40).cast("string")).alias("target_service"),
        ((k + 10).cast("double") * 60).alias("duration_s"),
    )


@query(
    "session_fault_types",
    sql(EV, FAULTS, body="SELECT coalesce(fault_type, 'unknown') AS fault_type, count(*) AS n FROM faults GROUP BY 1"),
)
def session_fault_types(spark, sf):
    return S.faults_by_type(_faults(spark, sf))


@query(
    "session_top_targets",
    sql(EV, FAULTS, body="SELECT target_service, count(*) AS n FROM faults GROUP BY 1 ORDER BY n DESC, target_service LIMIT 8"),
)
def session_top_targets(spark, sf):
    return S.top_targets(_faults(spark, sf))


@query(
    "session_durations",
    sql(EV, FAULTS, body="""SELECT count(duration_s) AS n, min(duration_s) AS min_s, max(duration_s) AS max_s,
  (SELECT duration_s FROM faults ORDER BY duration_s LIMIT 1 OFFSET (SELECT count(*) // 2 FROM faults)) AS median_s FROM faults"""),
)
def session_durations(spark, sf):
    return S.duration_summary(_faults(spark, sf), group_rows=rows_in(spark, sf, "events"))
