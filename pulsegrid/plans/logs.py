"""Queries on log lines, templates and system-call traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions.logtext import LOG_LINE, VARIABLE_PARTS, iso_millis, mask_variables
from pulsegrid.operators import logs as G
from pulsegrid.operators import traces as T
from pulsegrid.operators.ordered import positions
from pulsegrid.operators.reconstruct import apply_standard, fit_standard, pivot_first
from pulsegrid.operators.templates import SIMILARITY, mine_templates
from pulsegrid.operators.timegrid import floor_time
from pulsegrid.plans.base import (
    EV, LINES, METRICS, PARSED, TEMPLATED, event_lines, events, query, r6, rows_in, sql, table,
)
from pulsegrid.sources.readers import canonical_lines
from pulsegrid.storage import durable


@query(
    "log_parse",
    sql(EV, LINES, PARSED, body="SELECT event_id, ts, log_level, process_id, thread, logger, message FROM parsed"),
)
def log_parse(spark, sf):
    parsed = G.parse_logs(event_lines(spark, sf))
    ts = F.col("ts").cast("timestamp_ntz")
    return parsed.select("event_id", ts.alias("ts"), "log_level", "process_id", "thread", "logger", "message")


@query(
    "log_conformance",
    sql(EV, LINES, body=f"""SELECT *, round(CASE WHEN lines > 0 THEN matched / lines ELSE 0 END, 6) AS share FROM (
  SELECT count(*) FILTER (WHERE length(trim(line)) > 0) AS lines, count(*) FILTER (WHERE regexp_matches(trim(line), '{LOG_LINE}')) AS matched FROM lines)"""),
)
def log_conformance(spark, sf):
    return G.conformance(event_lines(spark, sf)).withColumn("share", r6("share"))


@query(
    "collected_counts",
    sql(EV, LINES, body="SELECT (SELECT count(*) FROM ev) AS metric_rows, count(*) FILTER (WHERE length(trim(line)) > 0) AS log_lines FROM lines"),
)
def collected_counts(spark, sf):
    from pulsegrid.operators.quality import collected_counts as counts

    return counts(events(spark, sf), event_lines(spark, sf))


@query(
    "log_json_canonical",
    sql(EV, body="""
SELECT event_id, CASE k % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') WHEN 1 THEN strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S.000Z') ELSE 'soon' END
  || ' ' || CASE k % 3 WHEN 0 THEN upper(metric) ELSE 'INFO' END || ' ' || CASE k % 3 WHEN 1 THEN CAST(user_id AS VARCHAR) ELSE '0' END
  || ' --- [' || CASE k % 3 WHEN 2 THEN 't' || k ELSE '' END || '] ' || CASE k % 3 WHEN 0 THEN metric ELSE 'logger' END
  || ' : ' || CASE k % 3 WHEN 0 THEN 'm' || k WHEN 1 THEN 'x' || k ELSE '' END AS value FROM ev"""),
)
def log_json_canonical(spark, sf):
    k, metric, text = F.col("k"), F.col("metric"), F.col("k").cast("string")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    kind = k % 3
    records = events(spark, sf).select(
        "event_id",
        F.when(kind == 0, iso_millis(F.col("ts"))).alias("timestamp"),
        F.when(kind == 1, F.floor(micros / 1_000_000).cast("string")).when(kind == 0, "later").alias("time"),
        F.when(kind == 2, "soon").alias("_time"),
        F.when(kind == 0, F.upper(metric)).otherwise("").alias("log_level"),
        F.when(kind == 1, F.col("user_id").cast("string")).otherwise("0").alias("process_id"),
        F.when(kind == 2, F.concat(F.lit("t"), text)).alias("threadName"),
        F.when(kind == 0, metric).alias("logger_name"),
        F.when(kind == 0, F.concat(F.lit("m"), text)).alias("message"),
        F.when(kind == 1, F.concat(F.lit("x"), text)).alias("msg"),
    )
    return canonical_lines(records, keep=["event_id"])


@query(
    "log_template_counts",
    f"""SELECT template, count(*) AS n FROM (SELECT regexp_replace(url, '{VARIABLE_PARTS}', '<*>', 'g') AS template FROM pages)
GROUP BY template ORDER BY n DESC, template LIMIT 10""",
)
def log_template_counts(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", mask_variables(F.col("url")).alias("template"))
    counts = G.template_counts(pages, order=["page_id"])
    return G.top_templates(counts, 10).select("template", "n")


def _messages(spark, sf):
    return G.parse_logs(event_lines(spark, sf)).select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "message")


LEADERS = f"""formed AS (SELECT form, n, string_split_regex(form, '\\s+') AS words FROM (SELECT template AS form, count(*) AS n FROM templated WHERE length(message) > 0 GROUP BY 1)),
leaf AS (SELECT len(words) AS size, words[1] AS head, list([{{'form': form, 'words': words}}] ORDER BY n DESC, form DESC) AS listed FROM formed GROUP BY 1, 2),
lead AS (SELECT size, head, list_reduce(listed, lambda acc, x: CASE WHEN len(list_filter(acc, lambda l:
    list_sum(list_transform(list_zip(l.words, x[1].words), lambda p: CAST(p[1] = p[2] AS INT))) >= {SIMILARITY} * size)) = 0 THEN list_concat(acc, x) ELSE acc END) AS leaders FROM leaf),
joined AS (SELECT form, n, words, list_filter(leaders, lambda l: list_sum(list_transform(list_zip(l.words, f.words), lambda p: CAST(p[1] = p[2] AS INT))) >= {SIMILARITY} * size)[1].form AS leader
  FROM formed f JOIN lead ON len(words) = size AND words[1] = head),
spread AS (SELECT leader, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM joined),
merged AS (SELECT leader, string_agg(word, ' ' ORDER BY pos) AS template FROM (
  SELECT leader, pos, CASE WHEN min(word) = max(word) THEN min(word) ELSE '<*>' END AS word FROM spread GROUP BY 1, 2) GROUP BY 1)"""


@query(
    "log_template_merge",
    sql(EV, LINES, PARSED, TEMPLATED, LEADERS, body="SELECT template, count(*) AS forms, CAST(sum(n) AS BIGINT) AS n FROM joined JOIN merged USING (leader) GROUP BY template"),
)
def log_template_merge(spark, sf):
    mined = mine_templates(_messages(spark, sf))
    return mined.groupBy("template").agg(F.count(F.lit(1)).alias("forms"), F.sum("n").alias("n"))


def _numbered(spark, sf):
    """Messages with the rarity number of their template, and the numbers.

    Both are written first: parsing is not repeated, and the size of the number table is known, so the
    few templates do not become the keys of a shuffle of all messages.
    """
    masked = _messages(spark, sf).select("event_id", "ts", mask_variables(F.col("message")).alias("template"))
    masked = durable(masked, "messages")
    counts = G.template_counts(masked, order=["ts", "event_id"])
    numbers = G.rarity_numbers(counts, group_rows=rows_in(spark, sf, "events")).select("template", "n", "number")
    numbers = durable(numbers, "numbers")
    return masked.join(numbers, "template"), numbers


@query("log_rarity", sql(EV, LINES, PARSED, TEMPLATED, body="SELECT template, n, number FROM numbered"))
def log_rarity(spark, sf):
    return _numbered(spark, sf)[1]


@query(
    "log_rarity_by_hour",
    sql(EV, LINES, PARSED, TEMPLATED, body="""
SELECT date_trunc('hour', ts) AS ts, count(*) AS records, max(number) AS log_template FROM templated JOIN numbered USING (template) GROUP BY 1"""),
)
def log_rarity_by_hour(spark, sf):
    return G.templates_per_interval(_numbered(spark, sf)[0], "1 hour")


@query(
    "log_interval_sizes",
    sql(EV, LINES, PARSED, body="""SELECT count(*) AS intervals, round(avg(n), 6) AS mean_records, min(n) AS min_records, max(n) AS max_records
FROM (SELECT count(*) AS n FROM parsed GROUP BY date_trunc('hour', ts))"""),
)
def log_interval_sizes(spark, sf):
    per_hour = G.templates_per_interval(_numbered(spark, sf)[0], "1 hour")
    return G.interval_size_summary(per_hour).withColumn("mean_records", r6("mean_records"))


@query(
    "log_hour_crosstab",
    sql(EV, LINES, PARSED, TEMPLATED, body="""
SELECT h.hour, n.number, count(t.template) AS records FROM (SELECT DISTINCT hour(ts) AS hour FROM templated) h CROSS JOIN numbered n
LEFT JOIN templated t ON hour(t.ts) = h.hour AND t.template = n.template GROUP BY 1, 2"""),
)
def log_hour_crosstab(spark, sf):
    return G.hour_by_template(*_numbered(spark, sf))


@query(
    "log_summary",
    sql(EV, LINES, PARSED, TEMPLATED, body="""SELECT count(*) AS records, count(DISTINCT template) AS templates, min(ts) AS first_ts, max(ts) AS last_ts,
  round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000, 6) AS hours FROM templated"""),
)
def log_summary(spark, sf):
    masked = _messages(spark, sf).withColumn("template", mask_variables(F.col("message")))
    return G.log_summary(masked).withColumn("hours", r6("hours"))


LIST_LENGTH, LIST_WINDOW = 5, 3


@query(
    "template_list_windows",
    sql(EV, LINES, PARSED, TEMPLATED, f"""placed AS (
  SELECT date_trunc('hour', ts) AS slot, number, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id) AS nr
  FROM templated JOIN numbered USING (template)),
lists AS (SELECT slot, {" || ',' || ".join(f"coalesce(max(CASE WHEN nr = {i} THEN number END), 0)" for i in range(1, LIST_LENGTH + 1))} AS numbers
  FROM placed GROUP BY slot),
w AS (SELECT row_number() OVER (ORDER BY slot) - 1 AS win_id, last(slot) OVER f AS last_ts, count(*) OVER f AS n, string_agg(numbers, ';') OVER f AS numbers
  FROM lists WINDOW f AS (ORDER BY slot ROWS BETWEEN CURRENT ROW AND {LIST_WINDOW - 1} FOLLOWING))""",
        body=f"SELECT win_id, last_ts, numbers FROM w WHERE n = {LIST_WINDOW}"),
)
def template_list_windows(spark, sf):
    rows = rows_in(spark, sf, "events")
    lists = G.template_lists(_numbered(spark, sf)[0], "1 hour", LIST_LENGTH, ["ts", "event_id"], group_rows=rows)
    windows = G.template_windows(lists, LIST_WINDOW, group_rows=rows)
    text = F.array_join(
        F.transform("numbers", lambda inner: F.array_join(F.transform(inner, lambda x: x.cast("string")), ",")), ";"
    )
    return windows.select("win_id", "last_ts", text.alias("numbers"))


# --- system calls: an event is a call, named by its type and a few values of k ----------------------

TRACE = """trace AS (SELECT event_id, ts, metric || '_' || (k % 5) AS system_call,
  CASE WHEN ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12' THEN 1 ELSE 0 END AS label FROM ev),
base AS (SELECT system_call, row_number() OVER (ORDER BY system_call) AS id FROM (SELECT DISTINCT system_call FROM trace WHERE system_call < 'f')),
dict AS (SELECT id, system_call FROM base UNION ALL
  SELECT (SELECT max(id) FROM base) + row_number() OVER (ORDER BY first_ts, system_call), system_call FROM (
    SELECT system_call, min(struct_pack(a := ts, b := event_id)) AS first_ts FROM trace WHERE system_call NOT IN (SELECT system_call FROM base) GROUP BY 1)),
chunks AS (SELECT (row_number() OVER (ORDER BY ts, event_id) - 1) // 50 AS chunk, d.id, label FROM trace t JOIN dict d USING (system_call))"""
CALLS = len(METRICS) * 5


def _trace(spark, sf):
    start, stop = "timestamp_ntz'2024-01-10'", "timestamp_ntz'2024-01-12'"
    return events(spark, sf).select(
        "event_id", "ts", F.concat_ws("_", "metric", (F.col("k") % 5).cast("string")).alias("system_call"),
        T.attack_label(F.col("ts"), F.expr(start), F.expr(stop)).alias("label"),
    )


def _dictionary(spark, sf):
    rows = rows_in(spark, sf, "events")
    trace = _trace(spark, sf)
    known = trace.select("system_call").where("system_call < 'f'").distinct()
    base = positions(known, [], ["system_call"], "id", rows).withColumn("id", F.col("id") + 1)
    return durable(T.extend_dictionary(trace, base, ["ts", "event_id"], group_rows=rows), "dictionary")


@query("call_dictionary", sql(EV, TRACE, body="SELECT id, system_call FROM dict"))
def call_dictionary(spark, sf):
    return _dictionary(spark, sf).select("id", "system_call")


@query(
    "call_bags",
    sql(EV, TRACE, body="SELECT chunk, " + ", ".join(f"count(*) FILTER (WHERE id = {i}) AS call_{i}" for i in range(1, CALLS + 1))
        + ", max(label) AS label FROM chunks GROUP BY chunk"),
)
def call_bags(spark, sf):
    encoded = T.encode_calls(_trace(spark, sf), _dictionary(spark, sf))
    chunks = T.chunked(encoded, ["ts", "event_id"], group_rows=rows_in(spark, sf, "events"))
    return T.call_bags(chunks, range(1, CALLS + 1))


PIVOT_COLUMNS = [f"{m}_{k}" for m in METRICS for k in range(2)]


@query(
    "counter_pivot_scale",
    sql(EV, "wide AS (SELECT date_trunc('hour', ts) AS _time, "
        + ", ".join(
            f"coalesce(arg_min(value, struct_pack(a := ts, b := event_id)) FILTER (WHERE metric = '{c[:-2]}' AND k % 2 = {c[-1]}), 0) AS {c}"
            for c in PIVOT_COLUMNS
        ) + " FROM ev GROUP BY 1)",
        body="SELECT _time, " + ", ".join(
            f"round(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () > 0 THEN stddev_pop({c}) OVER () ELSE 1 END, 6) AS {c}" for c in PIVOT_COLUMNS
        ) + " FROM wide"),
)
def counter_pivot_scale(spark, sf):
    rows = events(spark, sf).select(
        floor_time(F.col("ts"), "1 hour").alias("_time"), "ts", "event_id", F.col("metric").alias("id"),
        (F.col("k") % 2).cast("string").alias("operation"), F.col("value").alias("counter"),
    )
    wide = pivot_first(rows, ["id", "operation"], PIVOT_COLUMNS, order=["ts", "event_id"])
    scaled = apply_standard(wide, fit_standard(wide, PIVOT_COLUMNS), PIVOT_COLUMNS)
    return scaled.withColumns({c: r6(c) for c in PIVOT_COLUMNS})
