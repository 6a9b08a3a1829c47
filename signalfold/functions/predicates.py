"""Predicates of reads and rules; an absent parameter adds none."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Severity from which a log is an error, and the status of a failed span (fixed values).
ERROR_SEVERITY, ERROR_STATUS = 17, 2

TIME_COLUMN = {"logs": "log_time", "events": "timestamp_client", "spans": "start_time", "metrics": "time"}
GROUP_COLUMNS = ("body", "service_name", "severity_text", "trace_id")


def all_of(parts: list[Column]) -> Column:
    return reduce(and_, parts, F.lit(True))


def equals(**values: str | None) -> list[Column]:
    return [F.col(c) == F.lit(v) for c, v in values.items() if v is not None]


def contains(column: str, q: str | None) -> list[Column]:
    """Substring without regard to case; % and _ in q are wildcards, a backslash is an ordinary character."""
    return [] if q is None else [F.col(column).ilike("%" + q.replace("\\", "\\\\") + "%")]


def instant(df: DataFrame, column: str, at: datetime) -> Column:
    """A literal of the column's own type, so that the comparison reaches the scan."""
    return F.lit(at).cast(df.schema[column].dataType)


def between(df: DataFrame, column: str, start: datetime | None, end: datetime | None) -> list[Column]:
    """Both ends belong to the range. Where the table has a `date` partition column, its range follows."""
    parts = []
    if start is not None:
        parts.append(F.col(column) >= instant(df, column, start))
    if end is not None:
        parts.append(F.col(column) <= instant(df, column, end))
    if "date" in df.columns:
        parts += [F.col("date") >= F.lit(start.date())] if start is not None else []
        parts += [F.col("date") <= F.lit(end.date())] if end is not None else []
    return parts


def on_day(df: DataFrame, column: str, day: date) -> Column:
    """Half-open [day, day + 1) in UTC."""
    start = datetime(day.year, day.month, day.day)
    return (F.col(column) >= instant(df, column, start)) & (F.col(column) < instant(df, column, start + timedelta(days=1)))


def within_skew(column: str | Column, received: str = "received_at", past: str = "31 days", future: str = "24 hours") -> Column:
    """Accepted lateness and earliness, both ends included."""
    t, r = F.col(column) if isinstance(column, str) else column, F.col(received)
    return t.between(r - F.expr(f"interval {past}"), r + F.expr(f"interval {future}"))


def group_expr_key(group_by: str | None) -> str:
    """The grouping key of a log rule, or ValueError: only these columns and attributes are allowed."""
    key = group_by or "body"
    if key in GROUP_COLUMNS or (key.startswith("attr:") and len(key) > 5):
        return key
    raise ValueError(f"unsupported group_by {key!r}: one of {', '.join(GROUP_COLUMNS)} or attr:<key>")


def group_expr(group_by: str | None) -> Column:
    key = group_expr_key(group_by)
    return attribute("log_attributes", key[5:]) if key.startswith("attr:") else F.col(key)


def attribute(column: str, key: str) -> Column:
    """Text of a key of a JSON object; the bracket form takes keys with dots."""
    if "'" in key or "\\" in key:
        raise ValueError(f"unsupported attribute key {key!r}")
    return F.get_json_object(F.col(column), f"$['{key}']")
