"""Queries on scores, thresholds, alarms and their quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.operators import alerts as A
from pulsegrid.operators import evaluate as E
from pulsegrid.operators import scoring as S
from pulsegrid.operators import spot
from pulsegrid.operators import threshold as T
from pulsegrid.operators.ordered import order_statistic, positions
from pulsegrid.operators.timegrid import floor_time
from pulsegrid.plans.base import (
    EV, HALF_DAYS, HOURLY, INTERVALS, MARKS, SCORES, WINDOW, day, event_scores, events, hourly, query, r6, recursive_sql,
    rows_in, sql, table,
)
from pulsegrid.plans.labels import labelled_marks
from pulsegrid.storage import durable

DEPTH = 10

PREDICTED = f"""predicted AS (SELECT metric, ts, value, before AS value_pred, round(abs(value - before), 9) AS score FROM (
  SELECT metric, ts, value, avg(value) OVER w AS before, count(value) OVER w AS n
  FROM hourly WINDOW w AS (PARTITION BY metric ORDER BY ts ROWS BETWEEN {WINDOW - 1} PRECEDING AND 1 PRECEDING)) WHERE n = {WINDOW - 1})"""


def _predicted(spark, sf):
    rows = S.rolling_mean_prediction(hourly(spark, sf), ["metric"], ["ts"], ["value"], WINDOW, rows_in(spark, sf, "events"))
    return rows.withColumn("score", F.round(S.prediction_error([("value", "value_pred")]), 9))


@query(
    "detrended_scores",
    sql(EV, HOURLY, PREDICTED, body=f"""SELECT metric, ts, round(score, 6) AS score, round(score - m, 6) AS detrended FROM (
  SELECT *, avg(score) OVER w AS m, count(score) OVER w AS n FROM predicted
  WINDOW w AS (PARTITION BY metric ORDER BY ts ROWS BETWEEN {DEPTH} PRECEDING AND 1 PRECEDING)) WHERE n = {DEPTH}"""),
)
def detrended_scores(spark, sf):
    out = S.detrend(_predicted(spark, sf), ["metric"], ["ts"], "score", DEPTH, group_rows=rows_in(spark, sf, "events"))
    return out.select("metric", "ts", r6("score").alias("score"), r6("detrended").alias("detrended"))


@query(
    "window_prediction_error",
    sql(EV, HOURLY, PREDICTED, body="SELECT ts, round(avg(score), 6) AS score FROM predicted GROUP BY ts"),
)
def window_prediction_error(spark, sf):
    long = _predicted(spark, sf).select("ts", F.col("value").alias("actual"), F.col("value_pred").alias("predicted"))
    return S.window_error(long, ["ts"]).withColumn("score", r6("score"))


@query(
    "prediction_loss",
    sql(EV, HOURLY, PREDICTED, body="""SELECT round(sum(mse), 4) AS loss FROM (
  SELECT CASE WHEN metric IN ('error', 'view') THEN 'load' ELSE 'traffic' END AS g, avg(pow(value - value_pred, 2)) AS mse FROM predicted GROUP BY 1)"""),
)
def prediction_loss(spark, sf):
    group = F.when(F.col("metric").isin("error", "view"), "load").otherwise("traffic")
    loss = S.total_loss(_predicted(spark, sf).withColumn("group", group), "group", "value", "value_pred")
    return loss.withColumn("loss", F.round("loss", 4))


@query(
    "score_summary",
    sql(EV, SCORES, body="""SELECT count(score) AS n, round(avg(score), 6) AS mean_score, round(stddev_pop(score), 6) AS std_score,
  min(score) AS min_score, max(score) AS max_score FROM scores"""),
)
def score_summary(spark, sf):
    return S.score_summary(event_scores(spark, sf)).withColumns({c: r6(c) for c in ("mean_score", "std_score")})


@query(
    "error_summary",
    sql(EV, SCORES, body="""SELECT count(*) AS n, round(avg(score), 6) AS mean_error, round(stddev_pop(score), 6) AS std_error,
  round(any_value(t), 6) AS threshold, count(*) FILTER (WHERE score > t) AS anomalies
FROM scores, (SELECT avg(score) + 2 * stddev_pop(score) AS t FROM scores)"""),
)
def error_summary(spark, sf):
    rounded = {c: r6(c) for c in ("mean_error", "std_error", "threshold")}
    return S.error_summary(event_scores(spark, sf), "score").withColumns(rounded)


@query(
    "error_quantile",
    sql(EV, SCORES, body="SELECT metric, count(*) AS n, round(quantile_cont(score, 0.99), 6) AS threshold FROM scores GROUP BY metric"),
)
def error_quantile(spark, sf):
    out = order_statistic(
        event_scores(spark, sf), ["metric"], "score", 0.99, "threshold", interpolate=True, group_rows=rows_in(spark, sf, "events")
    )
    return out.withColumn("threshold", r6("threshold"))


# --- thresholds -------------------------------------------------------------------------------------

QUANTILE, RISK = 0.95, 2e-2

GRID_SQL = f"""grid AS (SELECT k, CASE WHEN k < {T.GRID_NEGATIVE} THEN -{T.GRID_START} * pow({T.GRID_STEP_NEGATIVE}::DOUBLE, {T.GRID_NEGATIVE - 1} - k)
  ELSE {T.GRID_START} * pow({T.GRID_STEP_POSITIVE}::DOUBLE, k - {T.GRID_NEGATIVE}) END::DOUBLE AS g FROM range({T.GRID_SIZE}) t(k))"""


def fit_sql(source: str, quantile: float = QUANTILE, risk: str = f"{RISK}::DOUBLE", sign: int = 1, keys: str = "metric", prefix: str = "") -> str:
    """CTEs ``<prefix>start`` .. ``<prefix>fit`` over ``source`` (keys, score)."""
    q = quantile if sign > 0 else 1 - quantile
    level = "least(init + offs, init + 0.5 * abs(init))" if sign > 0 else "init - offs"
    x = prefix
    return f"""{x}start AS (SELECT {keys}, count(*) AS n, list_sort(list(score))[CAST(floor({q!r}::DOUBLE * count(*)) AS BIGINT) + 1] AS init
  FROM {source} GROUP BY {keys}),
{x}peaks AS (SELECT {keys}, {sign} * (score - init) AS y FROM {source} JOIN {x}start USING ({keys}) WHERE {sign} * (score - init) > 0),
{x}basics AS (SELECT {keys}, count(*) AS peaks, sum(y) AS sum_excess, avg(y) AS scale FROM {x}peaks GROUP BY {keys}),
{x}sums AS (SELECT {keys}, k, count(*) AS peaks, CASE WHEN count(*) FILTER (WHERE s > 0) = count(*) THEN sum(CASE WHEN s > 0 THEN ln(s) END) END AS log_sum,
    CASE WHEN count(*) FILTER (WHERE s > 0) = count(*) THEN sum(CASE WHEN s > 0 THEN 1 / s END) END AS inv_sum
  FROM (SELECT {keys}, k, 1 + g / scale * y AS s FROM {x}peaks JOIN {x}basics USING ({keys}) CROSS JOIN grid) GROUP BY {keys}, k),
{x}means AS (SELECT {keys}, k, g / scale AS t0, log_sum / s.peaks AS l0, (1 + log_sum / s.peaks) * (inv_sum / s.peaks) - 1 AS w0
  FROM {x}sums s JOIN {x}basics USING ({keys}) JOIN grid USING (k)),
{x}paired AS (SELECT *, lead(t0) OVER o AS t1, lead(l0) OVER o AS l1, lead(w0) OVER o AS w1 FROM {x}means WINDOW o AS (PARTITION BY {keys} ORDER BY k)),
{x}roots AS (SELECT {keys}, l0 + w0 / (w0 - w1) * (l1 - l0) AS gamma, (l0 + w0 / (w0 - w1) * (l1 - l0)) / (t0 + w0 / (w0 - w1) * (t1 - t0)) AS sigma
  FROM {x}paired WHERE k <> {T.GRID_NEGATIVE - 1} AND (w0 < 0) <> (w1 < 0)),
{x}best AS (SELECT {keys}, max(struct_pack(fit := -ln(sigma) - gamma, gamma := gamma, sigma := sigma)) AS b FROM {x}roots GROUP BY {keys}),
{x}shape AS (SELECT {keys}, n, init, coalesce(peaks, 0) AS peaks, scale, sum_excess,
    CASE WHEN b.fit > -ln(scale) THEN greatest(-{T.SHAPE_LIMIT}, least({T.SHAPE_LIMIT}, b.gamma)) WHEN peaks > 0 THEN 0.0 END AS gamma,
    CASE WHEN b.fit > -ln(scale) THEN b.sigma ELSE scale END AS sigma
  FROM {x}start LEFT JOIN {x}basics USING ({keys}) LEFT JOIN {x}best USING ({keys})),
{x}fit AS (SELECT *, CASE WHEN peaks > 0 THEN {level} ELSE init END AS threshold FROM (
  SELECT *, CASE WHEN abs(gamma) > {T.NEAR_ZERO_SHAPE} THEN sigma / gamma * (pow(n * {risk} / peaks, -gamma) - 1) ELSE -sigma * ln(n * {risk} / peaks) END AS offs FROM {x}shape))"""


FIT_COLUMNS = "metric, n, round(init, 6) AS init, peaks, round(gamma, 5) AS gamma, round(sigma, 5) AS sigma, round(threshold, 5) AS threshold"


def _fit_columns(df):
    return df.select(
        "metric", "n", r6("init").alias("init"), "peaks", F.round("gamma", 5).alias("gamma"), F.round("sigma", 5).alias("sigma"),
        F.round("threshold", 5).alias("threshold"),
    )


@query("threshold_fit", sql(EV, SCORES, GRID_SQL, fit_sql("scores"), body=f"SELECT {FIT_COLUMNS} FROM fit"))
def threshold_fit(spark, sf):
    return _fit_columns(
        T.fit_thresholds(event_scores(spark, sf), ["metric"], "score", QUANTILE, RISK, group_rows=rows_in(spark, sf, "events"))
    )


@query("threshold_fit_lower", sql(EV, SCORES, GRID_SQL, fit_sql("scores", sign=-1), body=f"SELECT {FIT_COLUMNS} FROM fit"))
def threshold_fit_lower(spark, sf):
    return _fit_columns(
        T.fit_thresholds(event_scores(spark, sf), ["metric"], "score", QUANTILE, RISK, "lower", rows_in(spark, sf, "events"))
    )


@query(
    "static_alarms",
    sql(EV, SCORES, GRID_SQL, fit_sql("scores"), body="SELECT event_id, metric, CASE WHEN score > threshold THEN 1 ELSE 0 END AS alarm FROM scores JOIN fit USING (metric)"),
)
def static_alarms(spark, sf):
    scores = durable(event_scores(spark, sf), "scores")
    fitted = T.fit_thresholds(scores, ["metric"], "score", QUANTILE, RISK, group_rows=rows_in(spark, sf, "events"), written=True)
    return T.classify(scores, durable(fitted.select("metric", "threshold"), "thresholds"), ["metric"]).select("event_id", "metric", "alarm")


# --- sequential detection: calibrated on the first half, run over the second ---------------------------

HALVES = f"""baseline AS (SELECT * FROM scores WHERE ts < TIMESTAMP '2024-01-01' + INTERVAL {HALF_DAYS} DAY),
strm AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY ts, event_id) - 1 AS pos
  FROM scores WHERE ts >= TIMESTAMP '2024-01-01' + INTERVAL {HALF_DAYS} DAY)"""

STATE_SQL = f"""lists AS (SELECT metric, list(log_sum ORDER BY k) AS logs, list(inv_sum ORDER BY k) AS invs FROM sums GROUP BY metric),
gl AS (SELECT list(g ORDER BY k) AS gs FROM grid),
state AS (SELECT metric, init, n AS base, scale, threshold, peaks, sum_excess, logs, invs, gs FROM fit JOIN lists USING (metric), gl)"""


def _refit(inner: str, columns: str) -> str:
    """Threshold of the state (logs, invs, peaks, sum_excess, init, scale, gs, total, grew, threshold) in ``inner``."""
    n, cut = T.GRID_SIZE, T.GRID_NEGATIVE
    return f"""SELECT {columns}, CASE WHEN NOT grew THEN threshold ELSE least(init + CASE WHEN abs(gamma) > {T.NEAR_ZERO_SHAPE}
      THEN sigma / gamma * (pow(total * {RISK}::DOUBLE / peaks, -gamma) - 1) ELSE -sigma * ln(total * {RISK}::DOUBLE / peaks) END, init + 0.5 * abs(init)) END AS threshold
  FROM (SELECT *, CASE WHEN b.fit > -ln(sum_excess / peaks) THEN greatest(-{T.SHAPE_LIMIT}, least({T.SHAPE_LIMIT}, b.gamma)) ELSE 0.0 END AS gamma,
      CASE WHEN b.fit > -ln(sum_excess / peaks) THEN b.sigma ELSE sum_excess / peaks END AS sigma
  FROM (SELECT *, list_max(list_transform(roots, lambda r: struct_pack(fit := -ln(r.sigma) - r.gamma, gamma := r.gamma, sigma := r.sigma))) AS b
  FROM (SELECT *, list_transform(cross_at, lambda i: struct_pack(
        gamma := logs[i] / peaks + w[i] / (w[i] - w[i + 1]) * (logs[i + 1] / peaks - logs[i] / peaks),
        sigma := (logs[i] / peaks + w[i] / (w[i] - w[i + 1]) * (logs[i + 1] / peaks - logs[i] / peaks))
          / (gs[i] / scale + w[i] / (w[i] - w[i + 1]) * (gs[i + 1] / scale - gs[i] / scale)))) AS roots
  FROM (SELECT *, list_filter(range(1, {n}), lambda i: i <> {cut} AND w[i] IS NOT NULL AND w[i + 1] IS NOT NULL AND (w[i] < 0) <> (w[i + 1] < 0)) AS cross_at
  FROM (SELECT *, CASE WHEN grew THEN list_transform(range(1, {n + 1}), lambda i: (1 + logs[i] / peaks) * (invs[i] / peaks) - 1) ELSE [] END AS w
  FROM ({inner}))))))"""


def _grow(inner: str) -> str:
    """Adds the excess ``y`` to the sums of the state in ``inner`` where ``grew``."""
    n = T.GRID_SIZE
    return f"""SELECT * EXCLUDE (logs, invs, peaks, sum_excess), peaks + CASE WHEN grew THEN 1 ELSE 0 END AS peaks, sum_excess + CASE WHEN grew THEN y ELSE 0 END AS sum_excess,
    CASE WHEN grew THEN list_transform(range(1, {n + 1}), lambda i: logs[i] + CASE WHEN 1 + gs[i] / scale * y > 0 THEN ln(1 + gs[i] / scale * y) END) ELSE logs END AS logs,
    CASE WHEN grew THEN list_transform(range(1, {n + 1}), lambda i: invs[i] + CASE WHEN 1 + gs[i] / scale * y > 0 THEN 1 / (1 + gs[i] / scale * y) END) ELSE invs END AS invs
  FROM ({inner})"""


TRACE_COLUMNS = """metric, count(*) AS points, count(*) FILTER (WHERE status = 'ALARM') AS alarms, count(*) FILTER (WHERE status = 'ABNORMAL') AS abnormal,
  round(arg_min(threshold, pos), 4) AS initial_threshold, round(arg_max(threshold, pos), 4) AS final_threshold, round(avg(threshold), 4) AS mean_threshold,
  round(avg(CASE WHEN status = 'ALARM' THEN 1.0 ELSE 0.0 END), 6) AS alarm_rate"""

SPOT_SQL = recursive_sql(
    EV, SCORES, HALVES, GRID_SQL, fit_sql("baseline"), STATE_SQL,
    "cand AS (SELECT s.metric, s.pos, s.score, row_number() OVER (PARTITION BY s.metric ORDER BY pos) AS rn FROM strm s JOIN state t USING (metric) WHERE score > init)",
    "rec AS (SELECT metric, 0::BIGINT AS rn, 0::BIGINT AS alarms, '' AS status, peaks, sum_excess, logs, invs, threshold FROM state UNION ALL "
    + _refit(
        _grow(
            "SELECT r.metric, c.rn, r.alarms + CASE WHEN c.score > r.threshold THEN 1 ELSE 0 END AS alarms, "
            "CASE WHEN c.score > r.threshold THEN 'ALARM' ELSE 'ABNORMAL' END AS status, r.peaks, r.sum_excess, r.logs, r.invs, r.threshold, "
            "s.init, s.scale, s.gs, s.base + c.pos - r.alarms AS total, NOT (c.score > r.threshold) AS grew, c.score - s.init AS y "
            "FROM rec r JOIN cand c ON c.metric = r.metric AND c.rn = r.rn + 1 JOIN state s ON s.metric = r.metric"
        ),
        "metric, rn, alarms, status, peaks, sum_excess, logs, invs",
    )
    + ")",
    "placed AS (SELECT s.metric, s.pos, score > init AS beyond, count(*) FILTER (WHERE score > init) OVER (PARTITION BY s.metric ORDER BY pos) AS rn FROM strm s JOIN state USING (metric))",
    "judged AS (SELECT p.metric, p.pos, CASE WHEN beyond THEN r.status ELSE 'NORMAL' END AS status, r.threshold FROM placed p JOIN rec r ON r.metric = p.metric AND r.rn = p.rn)",
    body=f"SELECT {TRACE_COLUMNS} FROM judged GROUP BY metric",
)

DRIFT_BASE = f"""flat AS (SELECT metric, score - m AS score FROM (
  SELECT metric, score, avg(score) OVER w AS m, count(score) OVER w AS n FROM baseline
  WINDOW w AS (PARTITION BY metric ORDER BY ts, event_id ROWS BETWEEN {DEPTH} PRECEDING AND 1 PRECEDING)) WHERE n = {DEPTH}),
newest AS (SELECT metric, list(score ORDER BY ts, event_id) AS recent FROM (
  SELECT *, row_number() OVER (PARTITION BY metric ORDER BY ts DESC, event_id DESC) AS back FROM baseline) WHERE back <= {DEPTH} GROUP BY metric)"""

DRIFT_SQL = recursive_sql(
    EV, SCORES, HALVES, GRID_SQL, DRIFT_BASE, fit_sql("flat"), STATE_SQL,
    "rec AS (SELECT metric, -1::BIGINT AS pos, 0::BIGINT AS alarms, '' AS status, recent, 0.0::DOUBLE AS mean, peaks, sum_excess, logs, invs, threshold FROM state JOIN newest USING (metric) UNION ALL "
    + _refit(
        _grow(
            "SELECT metric, pos, alarms + CASE WHEN alarm THEN 1 ELSE 0 END AS alarms, CASE WHEN alarm THEN 'ALARM' WHEN beyond THEN 'ABNORMAL' ELSE 'NORMAL' END AS status, "
            "CASE WHEN alarm THEN recent ELSE list_append(recent[2:], score) END AS recent, mean, peaks, sum_excess, logs, invs, threshold, init, scale, gs, "
            "base + pos - alarms AS total, beyond AND NOT alarm AS grew, score - mean - init AS y FROM ("
            "SELECT *, score - mean - init > 0 AS beyond, score - mean - init > 0 AND score - mean - threshold > 0 AS alarm FROM ("
            f"SELECT r.metric, c.pos, r.alarms, r.recent, list_sum(r.recent) / {DEPTH} AS mean, r.peaks, r.sum_excess, r.logs, r.invs, r.threshold, "
            "s.init, s.scale, s.gs, s.base, c.score FROM rec r JOIN strm c ON c.metric = r.metric AND c.pos = r.pos + 1 JOIN state s ON s.metric = r.metric))"
        ),
        "metric, pos, alarms, status, recent, mean, peaks, sum_excess, logs, invs",
    )
    + ")",
    "judged AS (SELECT metric, pos, status, threshold + mean AS threshold FROM rec WHERE pos >= 0)",
    body=f"SELECT {TRACE_COLUMNS} FROM judged GROUP BY metric",
)


def _trace(spark, sf, depth):
    scores, rows = durable(event_scores(spark, sf), "scores"), rows_in(spark, sf, "events")
    half = day(HALF_DAYS)
    keys, order = ["metric"], ["ts", "event_id"]
    states = spot.start_states(scores.where(F.col("ts") < half), keys, order, "score", QUANTILE, RISK, depth=depth, group_rows=rows)
    found = spot.detect(scores.where(F.col("ts") >= half), states, keys, order, "score", depth, group_rows=rows)
    rounded = {c: F.round(c, 4) for c in ("initial_threshold", "final_threshold", "mean_threshold")}
    return spot.trace_summary(found, keys, order).withColumns(rounded | {"alarm_rate": r6("alarm_rate")})


@query("spot_stream", SPOT_SQL)
def spot_stream(spark, sf):
    return _trace(spark, sf, 0)


@query("drift_spot_stream", DRIFT_SQL)
def drift_spot_stream(spark, sf):
    return _trace(spark, sf, DEPTH)


# --- alerts with persistence and cooldown ------------------------------------------------------------

RULES = (
    A.AlertRule("error", "warn", "WARN", 10.0, 2, 3),
    A.AlertRule("error", "critical", "ERROR", 80.0, 1, 5),
    A.AlertRule("view", "low", "WARN", -15.0, 3, 4),
)

def alert_sql(keep_seconds: int | None = None) -> str:
    """Alerts per (service, metric, rule); with ``keep_seconds`` a longer gap ends a series, and the next row begins another."""
    part = "0" if keep_seconds is None else (
        f"count(*) FILTER (WHERE gap > {keep_seconds * 1_000_000}) OVER (PARTITION BY service, metric, state ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"
    )
    return recursive_sql(
        EV,
        "rules(metric, state, level, threshold, persistence, pause) AS (VALUES "
        + ", ".join(f"('{r.metric}', '{r.state}', '{r.level}', {r.threshold}, {r.persistence_steps}, {r.cooldown_steps})" for r in RULES) + ")",
        """g AS (SELECT event_id, ts, user_id % 10 AS service, e.metric, r.state, r.level, persistence, pause,
    CASE WHEN threshold < 0 THEN -value >= threshold ELSE value >= threshold END AS crossed,
    epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id % 10, e.metric, r.state ORDER BY ts, event_id) AS gap FROM ev e JOIN rules r USING (metric))""",
        f"p AS (SELECT *, {part} AS part FROM g)",
        "x AS (SELECT *, row_number() OVER (PARTITION BY service, metric, state, part ORDER BY ts, event_id) AS rn FROM p)",
        """rec AS (SELECT DISTINCT service, metric, state, part, 0::BIGINT AS rn, 0 AS active, 0 AS cooldown, FALSE AS fired, NULL::BIGINT AS event_id FROM x
  UNION ALL SELECT service, metric, state, part, rn, CASE WHEN NOT crossed OR fires THEN 0 WHEN cooldown > 0 THEN active ELSE active + 1 END,
    CASE WHEN NOT crossed THEN cooldown WHEN cooldown > 0 THEN cooldown - 1 WHEN fires THEN pause ELSE 0 END, fires, event_id
  FROM (SELECT x.*, r.active, r.cooldown, x.crossed AND r.cooldown = 0 AND r.active + 1 >= x.persistence AS fires
    FROM rec r JOIN x ON x.service = r.service AND x.metric = r.metric AND x.state = r.state AND x.part = r.part AND x.rn = r.rn + 1))""",
        body="SELECT r.event_id, r.service, r.metric, r.state, x.level FROM rec r JOIN x ON x.event_id = r.event_id AND x.state = r.state WHERE r.fired",
    )


ALERT_SQL = alert_sql()


@query("hysteresis_alerts", ALERT_SQL)
def hysteresis_alerts(spark, sf):
    rows = events(spark, sf).withColumn("service", F.col("user_id") % 10).select("event_id", "ts", "service", "metric", "value")
    crossed = A.crossings(rows, RULES)
    fired = A.alerts(crossed, ["service", "metric"], ["ts", "event_id"], 3 * rows_in(spark, sf, "events"))
    return fired.select("event_id", "service", "metric", "state", "level")


# --- quality of alarms --------------------------------------------------------------------------------

HOUR_ALARMS = """hour_scores AS (SELECT date_trunc('hour', ts) AS ts, max(score) AS score, 'all' AS metric FROM scores GROUP BY 1)"""
SEQUENCE = """seq AS (SELECT row_number() OVER (ORDER BY m.ts) - 1 AS idx, m.ts, m.label, CASE WHEN h.score > f.threshold THEN 1 ELSE 0 END AS alarm
  FROM marked m LEFT JOIN hour_scores h USING (ts), fit f)"""
SEGMENT_SQL = [
    EV, INTERVALS, MARKS, SCORES, GRID_SQL, HOUR_ALARMS, fit_sql("hour_scores", 0.7, "0.1::DOUBLE"), SEQUENCE,
]


def alarm_sequence(spark, sf):
    """Hour marks with label and alarm, numbered in time order."""
    rows = rows_in(spark, sf, "events")
    hour = floor_time(F.col("ts"), "1 hour").alias("ts")
    per_hour = durable(event_scores(spark, sf).groupBy(hour).agg(F.max("score").alias("score")), "scores")
    fitted = T.fit_thresholds(per_hour.withColumn("metric", F.lit("all")), ["metric"], "score", 0.7, 0.1, group_rows=rows)
    limit = fitted.select("threshold").scalar()
    marks = labelled_marks(spark, sf).join(per_hour, "ts", "left")
    judged = marks.withColumn("alarm", F.coalesce(F.col("score") > limit, F.lit(False)).cast("int"))
    return positions(judged, [], ["ts"], "idx", rows)


@query(
    "segment_metrics",
    sql(*SEGMENT_SQL, """usable AS (SELECT idx, label, lag(label, 1, 0) OVER (ORDER BY idx) AS before FROM seq WHERE label <> -1),
opens AS (SELECT idx AS start_idx FROM usable WHERE label = 1 AND before <> 1),
segs AS (SELECT start_idx, coalesce((SELECT min(idx) FROM usable u WHERE u.label = 0 AND u.idx > start_idx) - 1, (SELECT max(idx) FROM seq)) AS end_idx FROM opens),
c AS (SELECT (SELECT count(*) FROM segs) AS segments,
  (SELECT count(*) FROM segs WHERE EXISTS (SELECT 1 FROM seq WHERE alarm = 1 AND idx BETWEEN start_idx AND end_idx)) AS detected,
  (SELECT count(*) FROM seq WHERE alarm = 1) AS alarms,
  (SELECT count(*) FROM seq WHERE alarm = 1 AND EXISTS (SELECT 1 FROM segs WHERE idx BETWEEN start_idx AND end_idx)) AS valid_alarms),
d AS (SELECT *, CASE WHEN alarms > 0 THEN valid_alarms / alarms ELSE 0 END AS p, CASE WHEN segments > 0 THEN detected / segments ELSE 0 END AS r FROM c)""",
        body="""SELECT segments, detected, alarms, valid_alarms, round(p, 6) AS segment_precision, round(r, 6) AS segment_recall,
  round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS segment_f1, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END >= 0.8046 AS meets_target FROM d"""),
)
def segment_metrics(spark, sf):
    out = E.segment_metrics(alarm_sequence(spark, sf), group_rows=rows_in(spark, sf, "events"))
    return out.withColumns({c: r6(c) for c in ("segment_precision", "segment_recall", "segment_f1")})


@query(
    "alarm_confusion",
    sql(*SEGMENT_SQL, body="""SELECT *, round(CASE WHEN tp + fp + tn + fn > 0 THEN (tp + tn) / (tp + fp + tn + fn) ELSE 0 END, 6) AS accuracy FROM (
  SELECT count(*) FILTER (WHERE label = 1 AND alarm = 1) AS tp, count(*) FILTER (WHERE label = 0 AND alarm = 1) AS fp,
    count(*) FILTER (WHERE label = 0 AND alarm = 0) AS tn, count(*) FILTER (WHERE label = 1 AND alarm = 0) AS fn FROM seq)"""),
)
def alarm_confusion(spark, sf):
    return E.confusion(alarm_sequence(spark, sf).where("label <> -1")).withColumn("accuracy", r6("accuracy"))


@query(
    "ranking_metrics",
    """WITH s AS (SELECT quality AS label, n_chars AS score FROM labels JOIN documents USING (doc_id)),
g AS (SELECT score, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label <> 1) AS n FROM s GROUP BY score),
c AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp FROM g)
SELECT CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives,
  round(sum(n * (tp - p / 2)) / sum(p) / sum(n), 6) AS roc_auc, round(sum(p * tp / (tp + fp)) / sum(p), 6) AS average_precision FROM c""",
)
def ranking_metrics(spark, sf):
    scored = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    rows = rows_in(spark, sf, "labels")
    out = E.ranking_metrics(scored.select(F.col("quality").alias("label"), F.col("n_chars").alias("score")), group_rows=rows)
    return out.withColumns({c: r6(c) for c in ("roc_auc", "average_precision")})


REPORT = """pairs AS (SELECT quality AS actual, 1 - toxic AS predicted, doc_id % 5 AS fold FROM labels),
sides AS (SELECT fold, class, sum(support) AS support, sum(guessed) AS guessed, sum(hit) AS hit FROM (
  SELECT fold, actual AS class, 1 AS support, 0 AS guessed, CASE WHEN actual = predicted THEN 1 ELSE 0 END AS hit FROM pairs
  UNION ALL SELECT fold, predicted, 0, 1, 0 FROM pairs) GROUP BY fold, class)"""


def _pairs(spark, sf):
    return table(spark, sf, "labels").select(
        F.col("quality").alias("label"), (1 - F.col("toxic")).alias("prediction"), (F.col("doc_id") % 5).alias("fold")
    )


@query(
    "class_report",
    sql(REPORT, """r AS (SELECT class, sum(hit) / nullif(sum(guessed), 0) AS precision, sum(hit) / nullif(sum(support), 0) AS recall, sum(support) AS support FROM sides GROUP BY class)""",
        body="""SELECT class, round(coalesce(precision, 0), 6) AS precision, round(coalesce(recall, 0), 6) AS recall,
  round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1, CAST(support AS BIGINT) AS support FROM r"""),
)
def class_report(spark, sf):
    report = E.class_report(E.confusion_table(_pairs(spark, sf)))
    return report.withColumns({c: r6(c) for c in ("precision", "recall", "f1")})


@query(
    "class_report_averages",
    sql(REPORT, """r AS (SELECT class, coalesce(sum(hit) / nullif(sum(guessed), 0), 0) AS p, coalesce(sum(hit) / nullif(sum(support), 0), 0) AS r, sum(support) AS s FROM sides GROUP BY class),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM r)""",
        body="""SELECT CAST(sum(s) AS BIGINT) AS support, round(sum(r * s) / sum(s), 6) AS accuracy, round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall,
  round(avg(f1), 6) AS macro_f1, round(sum(p * s) / sum(s), 6) AS weighted_precision, round(sum(r * s) / sum(s), 6) AS weighted_recall, round(sum(f1 * s) / sum(s), 6) AS weighted_f1 FROM f"""),
)
def class_report_averages(spark, sf):
    averages = E.report_averages(E.class_report(E.confusion_table(_pairs(spark, sf))))
    return averages.withColumns({c: r6(c) for c in averages.columns if c != "support"})


@query(
    "fold_confusion_means",
    sql(REPORT, """f AS (SELECT fold, count(*) FILTER (WHERE actual = 1 AND predicted = 1) AS tp, count(*) FILTER (WHERE actual = 0 AND predicted = 1) AS fp,
  count(*) FILTER (WHERE actual = 0 AND predicted = 0) AS tn, count(*) FILTER (WHERE actual = 1 AND predicted = 0) AS fn FROM pairs GROUP BY fold)""",
        body="SELECT count(*) AS folds, round(avg(tp), 6) AS tp, round(avg(fp), 6) AS fp, round(avg(tn), 6) AS tn, round(avg(fn), 6) AS fn FROM f"),
)
def fold_confusion_means(spark, sf):
    per_fold = E.confusion(_pairs(spark, sf), ["fold"], "label", "prediction")
    means = E.fold_means(per_fold, ["tp", "fp", "tn", "fn"])
    return means.withColumns({c: r6(c) for c in ("tp", "fp", "tn", "fn")})
