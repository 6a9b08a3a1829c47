"""Joins across signals on their shared keys; Spark picks broadcast or sort-merge from the sizes it sees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalfold.functions.predicates import ERROR_SEVERITY


def events_with_logs(events: DataFrame, logs: DataFrame) -> DataFrame:
    left = events.select("session_id", "event_id", "event_name", "timestamp_client")
    right = logs.select("session_id", "log_id", "log_time", "severity_number", "body")
    return left.join(right, "session_id")


def spans_with_logs(spans: DataFrame, logs: DataFrame) -> DataFrame:
    left = spans.select("trace_id", "span_id", "name", "duration_ms")
    return left.join(logs.select("trace_id", "log_id", "severity_number", "body"), "trace_id")


def events_of_failing_sessions(events: DataFrame, logs: DataFrame, severity: int = ERROR_SEVERITY) -> DataFrame:
    """Events of sessions that have a log of that severity (semi join: no row is repeated)."""
    failing = logs.where(F.col("severity_number") >= severity).select("session_id")
    return events.join(failing, "session_id", "left_semi")


# -- over bucketed tables ------------------------------------------------------------------------------
#: Rows of a key on one side from which it is dealt over several tasks; the second figure bounds how many such keys there can be.
HEAVY_ROWS, HEAVY_KEYS = 10_000, 10_000
BUCKETS = 64


def write_bucketed(df: DataFrame, name: str, key: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """df as a catalog table under `path`, bucketed by the key that it is joined on; returns the table."""
    df.write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return df.sparkSession.table(name)


def heavy_keys(df: DataFrame, key: str, least: int = HEAVY_ROWS) -> DataFrame:
    """(key, n) of the keys with at least `least` rows, and with at least one row in HEAVY_KEYS of all, so that there are at most HEAVY_KEYS."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = df.count()
    return counts.where(F.col(key).isNotNull() & (F.col("n") >= max(least, -(-total // HEAVY_KEYS))))


def join_bucketed(left: DataFrame, right: DataFrame, key: str, least: int = HEAVY_ROWS) -> DataFrame:
    """The inner join of two tables that are bucketed alike by `key`, without moving them: only rows of heavy keys of the left table
    shuffle, in so many salted parts of about `least` rows, which the right rows of the key are copied to."""
    hot = heavy_keys(left, key, least).select(key, F.ceil(F.col("n") / least).cast("int").alias("__parts"))
    hot = F.broadcast(hot)
    light = left.join(hot, key, "left_anti").join(right.join(hot, key, "left_anti"), key)
    salted = left.join(hot, key).withColumn("__part", F.pmod(F.xxhash64(*(F.col(c) for c in left.columns)), F.col("__parts")).cast("int")).drop("__parts")
    copied = right.join(hot, key).withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    return light.unionByName(salted.join(copied, [key, "__part"]).drop("__part"))
