"""Log lines, message templates and their place on the timeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.logtext import LOG_FIELDS, is_log_line, log_fields, mask_variables, stripped
from pulsegrid.operators.ordered import positions
from pulsegrid.operators.timegrid import floor_time
from pulsegrid.operators.windows import pad_list, sliding_windows
from pulsegrid.storage import durable


#: Numbers of an interval in one row of the export.
LIST_NUMBERS = 10_000


def parse_logs(lines: DataFrame, line: str = "value") -> DataFrame:
    """Fields of every line in log format, white space at its ends apart; other lines are dropped."""
    text = stripped(F.col(line))
    parsed = lines.where(is_log_line(text)).withColumn("_fields", log_fields(text))
    named = parsed.withColumns({name: F.col("_fields")[i] for i, name in enumerate(LOG_FIELDS)})
    return named.withColumn("ts", F.col("timestamp").try_cast("timestamp")).drop("_fields")


def conformance(lines: DataFrame, line: str = "value") -> DataFrame:
    """Non-blank lines, lines in log format, and their share."""
    text = stripped(F.col(line))
    return lines.agg(
        F.count_if(F.length(text) > 0).alias("lines"), F.count_if(is_log_line(text)).alias("matched")
    ).withColumn("share", F.when(F.col("lines") > 0, F.col("matched") / F.col("lines")).otherwise(0.0))


def with_template(messages: DataFrame, mined: DataFrame, message: str = "message") -> DataFrame:
    """Messages with the template that their form belongs to."""
    mined = durable(mined.select("form", "template"), "templates")
    return messages.withColumn("form", mask_variables(F.col(message))).join(mined, "form", "left")


def template_counts(df: DataFrame, template: str = "template", order: Sequence[str] = ("ts",)) -> DataFrame:
    """Count per template and the place of its first record."""
    return df.groupBy(template).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("first_seen"))


def rarity_numbers(counts: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Number templates from 1 (most frequent) up (rarest); of equally frequent ones the later seen gets the smaller."""
    ranked = positions(counts, [], [F.col("n").desc(), F.col("first_seen").desc()], "number", group_rows)
    return ranked.withColumn("number", (F.col("number") + 1).cast("int"))


def top_templates(counts: DataFrame, k: int = 10, template: str = "template") -> DataFrame:
    return counts.orderBy(F.col("n").desc(), F.col(template)).limit(k)


def templates_per_interval(numbered: DataFrame, every: str = "1 second", ts: str = "ts") -> DataFrame:
    """Records and rarest template number of every interval with records."""
    return numbered.groupBy(floor_time(F.col(ts), every).alias(ts)).agg(
        F.count("number").alias("records"), F.max("number").alias("log_template")
    )


def numbers_per_interval(numbered: DataFrame, every: str = "1 second", ts: str = "ts", limit: int = LIST_NUMBERS, group_rows: int | None = None) -> DataFrame:
    """Sorted template numbers of every interval, as the export lists them: lists of at most ``limit`` numbers, ``part`` after part."""
    rows = numbered.select(floor_time(F.col(ts), every).alias(ts), "number").withColumn("_tie", F.monotonically_increasing_id())
    placed = positions(rows, [ts], ["number", "_tie"], "_at", group_rows)
    part = F.floor(F.col("_at") / limit).alias("part")
    return placed.groupBy(ts, part).agg(F.sort_array(F.collect_list("number")).alias("numbers"))


def interval_size_summary(per_interval: DataFrame) -> DataFrame:
    return per_interval.agg(
        F.count(F.lit(1)).alias("intervals"),
        F.avg("records").alias("mean_records"),
        F.min("records").alias("min_records"),
        F.max("records").alias("max_records"),
    )


def template_lists(
    numbered: DataFrame, every: str, length: int, order: Sequence[str], ts: str = "ts", group_rows: int | None = None
) -> DataFrame:
    """First ``length`` template numbers of every interval in record order, padded with 0."""
    placed = positions(numbered.withColumn("slot", floor_time(F.col(ts), every)), ["slot"], list(order), "at", group_rows)
    kept = placed.where(F.col("at") < length)
    lists = kept.groupBy("slot").agg(F.array_sort(F.collect_list(F.struct("at", "number"))).alias("listed"))
    numbers = F.transform("listed", lambda x: x["number"])
    return lists.select(F.col("slot").alias(ts), pad_list(numbers, length).alias("numbers"))


def template_windows(lists: DataFrame, size: int, ts: str = "ts", group_rows: int | None = None) -> DataFrame:
    """Sequences of ``size`` padded lists, with the last interval of each."""
    columns = {"last_ts": ("last", F.col(ts)), "numbers": ("list", F.col("numbers"))}
    return sliding_windows(lists, [], [ts], columns, size, 1, group_rows)


def hour_by_template(df: DataFrame, numbers: DataFrame, template: str = "number", ts: str = "ts") -> DataFrame:
    """Records per hour of day and template, zero-filled over the hours that occur and all of ``numbers``; one row per cell."""
    counts = durable(df.groupBy(F.hour(ts).alias("hour"), template).agg(F.count(F.lit(1)).alias("records")), "cells")
    cells = numbers.select(template, F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    cells = cells.join(counts.select("hour").distinct(), "hour", "left_semi")
    return cells.join(counts, ["hour", template], "left").select("hour", template, F.coalesce("records", F.lit(0)).alias("records"))


def log_summary(df: DataFrame, template: str = "template", ts: str = "ts") -> DataFrame:
    t = F.col(ts)
    return df.agg(
        F.count(F.lit(1)).alias("records"),
        F.countDistinct(template).alias("templates"),
        F.min(t).alias("first_ts"),
        F.max(t).alias("last_ts"),
    ).withColumn(
        "hours", (F.col("last_ts").cast("timestamp").cast("double") - F.col("first_ts").cast("timestamp").cast("double")) / 3600
    )
