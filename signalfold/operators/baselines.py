"""Rules over long baselines from counts that ingest keeps up, instead of the rows themselves.

A day table's rollups hold counts for each minute (see sources/daytable.py). Where `now` and a rule's spans are whole minutes, a
bucket of the baseline is a sum of whole minutes, so a tick reads counts; the one instant at the closed end of a window, `now`
itself, is counted from the rows of that instant. The results equal those of the full scan (operators/evaluate.py), which is also
what rules at other times or of other columns fall back to.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalfold.functions import predicates as P
from signalfold.operators import evaluate
from signalfold.operators.rules import Rule
from signalfold.sources.daytable import DayTable

CELL_SECS = 60
#: Stored tables by the rules' sources, and the rollup that knows the groups of a grouped rule.
TABLES = {"logs": "logs", "events": "events", "spans": "spans"}


def _days(start: datetime, end: datetime) -> list:
    return [(start + timedelta(days=k)).date() for k in range((end.date() - start.date()).days + 1)]


def whole_minutes(rule: Rule, now: datetime) -> bool:
    """Whether all ends of the rule's windows fall between minutes."""
    return now.second == now.microsecond == 0 and rule.window_secs % CELL_SECS == 0 and rule.baseline % CELL_SECS == 0


def _between(df: DataFrame, time: str, start: datetime, end: datetime) -> Column:
    """start <= time < end, and the same of `date`."""
    at = F.col(time)
    return (at >= P.instant(df, time, start)) & (at < P.instant(df, time, end)) & F.col("date").between(F.lit(start.date()), F.lit(end.date()))


def _counts(store: DayTable, rollup: str, cond: list[Column], start: datetime, end: datetime) -> DataFrame:
    """The rollup's rows from start to before end."""
    cells = store.read(_days(start, end), rollup=rollup)
    return cells.where(P.all_of([_between(cells, store.time, start, end), *cond]))


def _at_now(store: DayTable, cond: list[Column], now: datetime) -> DataFrame:
    """The rows of the instant `now`."""
    rows = store.read([now.date()])
    return rows.where(P.all_of([F.col(store.time) == P.instant(rows, store.time, now), *cond]))


def anomaly(store: DayTable, rule: Rule, now: datetime) -> DataFrame:
    """(value) of an anomaly rule, as evaluate.anomaly gives it."""
    if not whole_minutes(rule, now):
        return evaluate.anomaly(store.read(), rule, now)
    w, start = rule.window_secs, now - timedelta(seconds=rule.baseline)
    cond, steps = evaluate.count_filter(rule, rule.source), int((rule.baseline - 2 * rule.window_secs) // rule.window_secs) + 1
    cells = _counts(store, "counts", cond, min(start, now - timedelta(seconds=w)), now)
    since = (F.unix_micros(store.time) - F.unix_micros(F.lit(start).cast("timestamp"))) / F.lit(1_000_000)
    per = cells.select(F.floor(since / w).cast("bigint").alias("no"), (F.col(store.time) >= P.instant(cells, store.time, now - timedelta(seconds=w))).alias("current"), "n")
    # One row a bucket; a minute may belong to the last buckets and to the window.
    sums = per.groupBy("no", "current").agg(F.sum("n").alias("n"))
    buckets = sums.where((F.col("no") >= 0) & (F.col("no") < max(steps, 0))).groupBy("no").agg(F.sum("n").alias("n"))
    series = store.spark.range(max(steps, 0)).select(F.col("id").alias("no")).join(buckets, "no", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    stats = series.agg(F.count(F.lit(1)).alias("k"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"))
    window = sums.where("current").select("n").unionByName(_at_now(store, cond, now).select(F.lit(1).cast("bigint").alias("n")))
    current = window.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("c"))
    flat = (F.col("k") < 3) | (F.col("mean") < rule.min_count) | (F.col("sd") < 1e-9)
    return current.crossJoin(stats).select(F.when(flat, F.lit(0.0)).otherwise((F.col("c") - F.col("mean")) / F.col("sd")).alias("value"))


def new_groups(store: DayTable, rule: Rule, now: datetime) -> DataFrame:
    """(group_key, n): groups of the window that the baseline doesn't have, as evaluate.new_groups gives them."""
    key = P.group_expr_key(rule.group_by)
    if not whole_minutes(rule, now) or key not in store._fields("signatures").names:
        return evaluate.new_groups(store.read(), rule, now)
    cond = P.equals(service_name=rule.service, tenant_id=rule.tenant) + ([F.col("severity_number") >= rule.severity_min] if rule.severity_min is not None else [])
    begin = now - timedelta(seconds=rule.window_secs)
    window = _counts(store, "signatures", cond, begin, now).select(F.col(key).alias("group_key"), "n")
    window = window.unionByName(_at_now(store, cond, now).select(F.col(key).alias("group_key"), F.lit(1).cast("bigint").alias("n")))
    found = window.where("group_key is not null").groupBy("group_key").agg(F.sum("n").alias("n"))
    known = _counts(store, "signatures", cond, now - timedelta(seconds=rule.baseline), begin).select(F.col(key).alias("group_key")).where("group_key is not null").distinct()
    return found.join(known, "group_key", "left_anti")
