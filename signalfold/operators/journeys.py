"""Frequent journeys: sequences of event names, counted without holding a session in one array.

A row's place in its session (by time, then id) and its name give two 64-bit hashes; their XOR over a session, with its length, is
the sequence's fingerprint: an aggregate that merges, whatever tasks the rows were in. Places come from a window by session; sessions
over HEAVY rows are dealt into ranges of (session, time, id) first, and a row's place is its place in its range plus the rows of the
ranges before. Sessions are counted by fingerprint, and paths are rebuilt for the winners alone, from one session each.

Ties at the limit go to the paths that sort first: these are found name by name, among one session of each fingerprint, until few
are left to compare. Two sequences of the same length share a fingerprint by chance with a probability of 2^-128 a pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalfold.session import scratch_path

#: Rows of a session from which it is dealt into ranges, and fingerprints whose paths are rebuilt to be compared.
HEAVY, FEW = 100_000, 1_000
_ORDER = ("timestamp_client", "event_id")


def _kept(df: DataFrame, tag: str) -> DataFrame:
    """df written into the shared folder and read again: read by several plans, it is the same rows for all of them."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(events: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """session, name and `place` (from 0) of each event."""
    rows = events.select(F.col("session_id").alias("session"), *_ORDER, F.col("event_name").alias("name"))
    # At most one session in `heavy` rows.
    large = _kept(rows.groupBy("session").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > heavy).select("session"), "heavy-sessions")
    order = Window.partitionBy("session").orderBy(*_ORDER, "name")
    if large.isEmpty():
        return rows.select("session", "name", (F.row_number().over(order) - 1).cast("long").alias("place"))
    same = F.col("session").eqNullSafe(F.col("large"))
    named = large.select(F.col("session").alias("large"))
    light = rows.join(named, same, "left_anti").select("session", "name", (F.row_number().over(order) - 1).cast("long").alias("place"))
    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.join(named, same, "left_semi").repartitionByRange(parts, "session", *_ORDER, "name")
    dealt = _kept(dealt.select("*", F.spark_partition_id().alias("part")), "session-ranges")
    before = Window.partitionBy("session").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("session", "part").agg(F.count(F.lit(1)).alias("n")).select(F.col("session").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("session", "part").orderBy(*_ORDER, "name")
    ranked = dealt.select("session", "part", "name", (F.row_number().over(inside) - 1).cast("long").alias("at"))
    whole = ranked.join(F.broadcast(sizes), F.col("session").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    return light.unionByName(whole.select("session", "name", (F.col("at") + F.col("before")).alias("place")))


def fingerprints(rows: DataFrame) -> DataFrame:
    """session, steps, f1 and f2 of placed rows."""
    f = [F.bit_xor(F.xxhash64(F.lit(seed), "place", F.col("name").isNull(), "name")).alias(f"f{seed}") for seed in (1, 2)]
    return rows.groupBy("session").agg(F.count(F.lit(1)).alias("steps"), *f)


def _first_paths(rows: DataFrame, sessions: DataFrame, wanted: int, few: int) -> DataFrame:
    """Of the sessions (their paths differ) those that may be among the `wanted` whose paths sort first; at most wanted + few."""
    ahead, depth = None, 0
    while wanted > 0 and sessions.count() > few:
        names = rows.where(F.col("place") == depth).select("session", F.struct(F.lit(1).alias("on"), "name").alias("step"))
        step = F.coalesce("step", F.struct(F.lit(0).alias("on"), F.lit(None).cast("string").alias("name")))  # an ended path sorts first
        at = _kept(sessions.join(names, "session", "left").select("session", step.alias("step")), "paths-at")
        counts = at.groupBy("step").agg(F.count(F.lit(1)).alias("n")).orderBy("step")
        # As many names as are needed to fill the limit.
        below, total, edge = 0, 0, None
        for r in counts.limit(wanted + 1).collect():
            below, total, edge = total, total + r.n, r.step
            if total >= wanted:
                break
        limit = F.struct(F.lit(edge["on"]).alias("on"), F.lit(edge["name"]).cast("string").alias("name"))
        whole = at.where(F.col("step") < limit).select("session")
        ahead = whole if ahead is None else ahead.unionByName(whole)
        sessions, wanted, depth = at.where(F.col("step").eqNullSafe(limit)).select("session"), wanted - below, depth + 1
        if total < wanted + below:
            break
    return sessions if ahead is None else ahead.unionByName(sessions)


def frequent(events: DataFrame, limit: int, heavy: int = HEAVY, few: int = FEW) -> DataFrame:
    """(path, occurrences) of the `limit` most frequent sequences, of equal counts those that sort first."""
    rows = placed(events, heavy)
    keys = ["steps", "f1", "f2"]
    seen = _kept(fingerprints(rows).groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences"), F.min(F.struct(F.col("session").isNull().alias("nameless"), "session"))["session"].alias("session")), "journeys")
    top = [r.occurrences for r in seen.orderBy(F.desc("occurrences")).limit(limit).select("occurrences").collect()]
    least = top[-1] if top else 0
    sure, tied = seen.where(F.col("occurrences") > least), seen.where(F.col("occurrences") == least)
    room = sum(n == least for n in top)
    if tied.count() > few:
        tied = tied.join(_first_paths(rows.where("session is not null"), tied.where("session is not null").select("session"), room, few), "session", "left_semi").unionByName(tied.where("session is null"))
    winners = sure.unionByName(tied).select("session", "occurrences")
    chosen = _kept(winners, "winners").select(F.col("session").alias("s"), "occurrences")
    steps = rows.join(F.broadcast(chosen), F.col("session").eqNullSafe(F.col("s")))
    path = F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"])
    return steps.groupBy("session").agg(path.alias("path"), F.first("occurrences").alias("occurrences")).select("path", "occurrences").orderBy(F.desc("occurrences"), "path").limit(limit)

