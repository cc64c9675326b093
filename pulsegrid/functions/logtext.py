"""Expressions on log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: one log record per line, `<ISO ms Z> <LEVEL> <pid> --- [<thread>] <logger> : <message>`.
LOG_LINE = r"(?s)^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z)\s+(\w+)\s+(\d+)\s+---\s+\[(.*?)\]\s+(.*?)\s+:\s+(.*)"
LOG_FIELDS = ("timestamp", "log_level", "process_id", "thread", "logger", "message")
ISO_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"

# Parts of a message that vary between records of one kind: addresses, hex words, numbers.
VARIABLE_PARTS = r"\b\d{1,3}(?:\.\d{1,3}){3}\b|\b0x[0-9a-fA-F]+\b|\b\d+(?:\.\d+)?\b"
WILDCARD = "<*>"


_MARK = "\u0001"


def stripped(line: Column) -> Column:
    """The line without white space at either end, as records are compared."""
    return F.btrim(line, F.lit(" \t\n\u000b\f\r"))


def is_log_line(line: Column) -> Column:
    return line.rlike(LOG_LINE)


def log_fields(line: Column) -> Column:
    """All fields of a log line as an array, in the order of ``LOG_FIELDS``.

    One match puts a mark between the fields, and the line is split there. Lines that contain the
    mark themselves are matched field by field.
    """
    count = len(LOG_FIELDS)
    marked = F.regexp_replace(line, LOG_LINE, _MARK.join(f"${i + 1}" for i in range(count)))
    one_by_one = F.array(*[F.regexp_extract(line, LOG_LINE, i + 1) for i in range(count)])
    return F.when(line.contains(_MARK), one_by_one).otherwise(F.split(marked, _MARK, count))


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts, ISO_MILLIS)


def log_line(ts: Column, level: Column, pid: Column, thread: Column, logger: Column, message: Column) -> Column:
    """Canonical line; ``ts`` is text already in ISO form."""
    return F.format_string("%s %s %s --- [%s] %s : %s", ts, level, pid.cast("string"), thread, logger, message)


def mask_variables(message: Column, pattern: str = VARIABLE_PARTS) -> Column:
    return F.regexp_replace(message, pattern, WILDCARD)


def truthy(value: Column, kind: T.DataType) -> Column:
    """The value as text, null if it is empty text or a number or truth value of zero; the text "0" stands."""
    if isinstance(kind, T.VariantType):
        text, is_text = F.try_variant_get(value, "$", "string"), F.schema_of_variant(value) == "STRING"
        return F.when(is_text & (text != ""), text).when(~is_text & ~text.isin("0", "0.0", "-0.0", "0E0", "false"), text)
    text = value.cast("string")
    return F.when(~text.isin(*([""] if isinstance(kind, T.StringType) else ["0", "0.0", "-0.0", "false"])), text)
