"""Liveness of expected senders, and runs of failures."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Failures in a row from which an agent reports (fixed value).
FAILURES = 3


def registry(heartbeats: DataFrame) -> DataFrame:
    """(id, last_seen) from heartbeats (id, ts)."""
    return heartbeats.groupBy("id").agg(F.max("ts").alias("last_seen"))


def liveness(heartbeats: DataFrame, expected: DataFrame, now: datetime) -> DataFrame:
    """expected (id, timeout_secs) with last_seen, silent_secs and down: never seen, or silent for longer than the timeout."""
    seen = expected.join(registry(heartbeats), "id", "left")
    at = F.lit(now).cast(heartbeats.schema["ts"].dataType)
    micros = F.unix_micros(at.cast("timestamp")) - F.unix_micros(F.col("last_seen").cast("timestamp"))
    silent = F.when(micros.isNotNull(), F.greatest(micros, F.lit(0)) / F.lit(1e6))
    return seen.withColumn("silent_secs", silent).withColumn("down", F.coalesce(F.col("silent_secs") > F.col("timeout_secs"), F.lit(True)))


def describe(id: str, silent_secs: float | None, timeout_secs: int) -> str:
    return f"companion '{id}' never seen" if silent_secs is None else f"companion '{id}' silent for {int(silent_secs)}s (timeout {timeout_secs}s)"


def transitions(heartbeats: DataFrame, expected: DataFrame, start: datetime, ticks: int, period_secs: int) -> DataFrame:
    """What an evaluation every period_secs from `start` on (`ticks` times) reports: one row (id, at, state, value, threshold, description) for
    each change between up and down. All are up before the first; value is the silence in whole seconds (0 if never seen).

    A heartbeat covers the ticks up to its timeout, so an agent's history is the union of such intervals and no tick is
    evaluated for each agent. Heartbeats meet by (id, first tick) before, so an agent has as many rows as there are ticks at most.
    """
    period, first = period_secs * 1_000_000, F.unix_micros(F.lit(start).cast("timestamp"))
    seen = heartbeats.select("id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).where(F.col("us").isNotNull())
    # The first tick at or after the heartbeat.
    tick = F.greatest(F.lit(0), F.ceil((F.col("us") - first) / F.lit(period))).cast("bigint")
    seen = seen.groupBy("id", tick.alias("a")).agg(F.max("us").alias("us")).where(F.col("a") < ticks)
    mine = expected.select("id", F.col("timeout_secs").cast("bigint").alias("timeout_secs"))
    last = F.floor((F.col("us") + F.col("timeout_secs") * 1_000_000 - first) / F.lit(period)).cast("bigint")
    up = seen.join(mine, "id").withColumn("b", F.least(last, F.lit(ticks - 1))).where("b >= a")
    order = Window.partitionBy("id").orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = up.withColumn("new", (F.coalesce(reach, F.lit(-2)) + 1 < F.col("a")).cast("int")).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = island.groupBy("id", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    changes = spans.select("id", F.explode(F.filter(F.array(
        F.struct(F.col("a").alias("k"), F.lit("resolved").alias("state")), F.struct((F.col("b") + 1).alias("k"), F.lit("firing").alias("state"))),
        lambda c: (c["k"] > 0) & (c["k"] < ticks))).alias("c")).select("id", "c.*")
    up_at_first = spans.where("a = 0").select("id")
    changes = changes.unionByName(mine.join(up_at_first, "id", "left_anti").select("id", F.lit(0).cast("bigint").alias("k"), F.lit("firing").alias("state")))
    dated = changes.join(mine, "id").join(seen.withColumnRenamed("us", "seen"), "id", "left").groupBy("id", "k", "state", "timeout_secs").agg(F.max(F.when(F.col("a") <= F.col("k"), F.col("seen"))).alias("seen"))
    at = first + F.col("k") * F.lit(period)
    silent = F.floor(F.greatest(F.lit(0), at - F.col("seen")) / F.lit(1_000_000))
    said = F.when(F.col("seen").isNull(), F.concat(F.lit("companion '"), "id", F.lit("' never seen"))).otherwise(
        F.concat(F.lit("companion '"), "id", F.lit("' silent for "), silent.cast("string"), F.lit("s (timeout "), F.col("timeout_secs").cast("string"), F.lit("s)")))
    return dated.select("id", F.timestamp_micros(at).alias("at"), "state", F.coalesce(silent, F.lit(0)).cast("double").alias("value"), F.col("timeout_secs").cast("double").alias("threshold"), said.alias("description"))


def failure_runs(probes: DataFrame, threshold: int = FAILURES) -> DataFrame:
    """probes (id, ts, ok) with the failures in a row so far, and `change`: firing at the threshold, resolved at the first success after it.
    Of probes at the same time failures come first."""
    order = Window.partitionBy("id").orderBy("ts", "ok")
    run = F.sum(F.col("ok").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    df = probes.withColumn("__run", run)
    # A run starts with the success before it, which counts 0 failures.
    failures = F.sum((~F.col("ok")).cast("int")).over(Window.partitionBy("id", "__run").orderBy("ts", "ok").rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("failures", failures.cast("long"))
    before = F.lag("failures", 1, 0).over(order)
    change = F.when(F.col("failures") == threshold, "firing").when(F.col("ok") & (before >= threshold), "resolved")
    return df.withColumn("change", change).drop("__run")
