"""What rules compute over their windows, relative to an injected `now`.

All scalar rules of one source share one scan: each rule becomes conditional aggregates of one global
aggregation, whose scan is limited to the longest window; the finishing arithmetic stays in the plan. Both ends of a
window belong to it. Quantiles need more than one pass and are computed first.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalfold.functions import predicates as P
from signalfold.operators.quantiles import exact_quantiles
from signalfold.operators.rules import COMPARATORS, QUANTILES, Rule

Tables = Mapping[str, DataFrame]
TIE = {"logs": "log_id", "events": "event_id", "spans": "span_id", "metrics": "point_id"}


def source_of(rule: Rule) -> str:
    return {"metric_threshold": "metrics", "span_duration": "spans"}.get(rule.kind, rule.source)


def base_filter(rule: Rule, source: str) -> list[Column]:
    """The filters each source knows; the tenant holds for all."""
    own = {
        "logs": {"service_name": rule.service}, "spans": {"service_name": rule.service, "name": rule.operation},
        "events": {"event_name": rule.event_name}, "metrics": {"service_name": rule.service, "metric_name": rule.metric_name},
    }[source]
    return P.equals(**own, tenant_id=rule.tenant)


def error_filter(rule: Rule, source: str) -> list[Column]:
    if source == "logs":
        return [F.col("severity_number") >= (P.ERROR_SEVERITY if rule.severity_min is None else rule.severity_min)]
    return [F.col("status_code") == P.ERROR_STATUS] if source == "spans" else []


def count_filter(rule: Rule, source: str) -> list[Column]:
    parts = base_filter(rule, source)
    if source == "logs" and rule.severity_min is not None:
        parts.append(F.col("severity_number") >= rule.severity_min)
    return parts + (error_filter(rule, source) if rule.error_only else [])


def _window(df: DataFrame, source: str, start: datetime, end: datetime) -> list[Column]:
    return P.between(df, P.TIME_COLUMN[source], start, end)


def _back(now: datetime, secs: float) -> datetime:
    return now - timedelta(seconds=secs)


def _measure(agg: str, value: Column, cond: Column, source: str) -> Column:
    v = F.when(cond, value)
    if agg == "last":
        return F.max_by(v, F.when(cond, F.struct(P.TIME_COLUMN[source], TIE[source])))
    return {"avg": F.avg, "max": F.max, "min": F.min, "sum": F.sum, "count": F.count}[agg](v)


def _plan(rule: Rule, df: DataFrame, now: datetime) -> tuple[list[Column], callable, float]:
    """(aggregates, value from their columns, seconds that the rule looks back)."""
    source, w = source_of(rule), rule.window_secs
    inside = _window(df, source, _back(now, w), now)
    if rule.kind in ("log_count", "telemetry_count"):
        return [F.count_if(P.all_of(inside + count_filter(rule, source)))], lambda a: a.cast("double"), w
    if rule.kind in ("metric_threshold", "span_duration"):
        value, parts = _measured(rule, source)
        return [_measure(rule.agg, value, P.all_of(inside + parts), source)], lambda a: F.coalesce(a.cast("double"), F.lit(0.0)), w
    if rule.kind == "error_ratio":
        base = inside + base_filter(rule, source)
        least = max(rule.min_count, 1)
        return (
            [F.count_if(P.all_of(base + error_filter(rule, source))), F.count_if(P.all_of(base))],
            lambda e, n: F.when(n < least, F.lit(0.0)).otherwise(e.cast("double") / F.greatest(n, F.lit(1)).cast("double")), w)
    if rule.kind == "relative_change":
        parts, before = count_filter(rule, source), _window(df, source, _back(now, 2 * w), _back(now, w))
        return (
            [F.count_if(P.all_of(inside + parts)), F.count_if(P.all_of(before + parts))],
            lambda a, b: a.cast("double") / F.greatest(b, F.lit(max(rule.min_count, 1))).cast("double"), 2 * w)
    raise ValueError(f"{rule.kind} has no single value")


def _quantile(rule: Rule) -> str | None:
    """The quantile that a rule asks for."""
    agg = {"metric_threshold": rule.agg, "span_duration": rule.agg or "p95"}.get(rule.kind)
    return agg if agg in QUANTILES else None


def quantiles(df: DataFrame, rules: list[Rule], now: datetime) -> dict[str, float | None]:
    """Quantiles of rules over one source, by the rule's number as text; they are computed at once (see quantiles.py)."""
    source = source_of(rules[0])
    asked = {}
    for i, r in enumerate(rules):
        value, parts = _measured(r, source)
        asked[str(i)] = F.when(P.all_of(_window(df, source, _back(now, r.window_secs), now) + parts), value), QUANTILES[_quantile(r)]
    rows = df.where(P.all_of(_window(df, source, _back(now, max(r.window_secs for r in rules)), now)))
    return exact_quantiles(rows, asked)


def _measured(rule: Rule, source: str) -> tuple[Column, list[Column]]:
    """What a rule measures, and in which rows of its window."""
    if rule.kind == "metric_threshold":
        return F.coalesce("value_double", F.col("value_int").cast("double")), base_filter(rule, source)
    return F.col("duration_ms"), base_filter(rule, source) + [F.col("duration_ms").isNotNull()] + (error_filter(rule, source) if rule.error_only else [])


def bucket_counts(df: DataFrame, rule: Rule, now: datetime) -> DataFrame:
    """(bucket, n) for each step of window_secs from now - baseline on that ends by now - window; empty ones count 0.

    A row's bucket is computed, so the zero fill is an equi-join on the bucket number and no range join.
    """
    source, w = rule.source, rule.window_secs
    start, steps = _back(now, rule.baseline), int((rule.baseline - 2 * w) // w) + 1
    time = P.TIME_COLUMN[source]
    spark = df.sparkSession
    first = P.instant(df, time, start)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    number = F.floor((micros(F.col(time)) - micros(first)) / F.lit(w * 1_000_000)).cast("bigint")
    rows = df.where(P.all_of(count_filter(rule, source) + _window(df, source, start, now)))
    counted = rows.select(number.alias("no")).where((F.col("no") >= 0) & (F.col("no") < max(steps, 0))).groupBy("no").agg(F.count(F.lit(1)).alias("n"))
    series = spark.range(max(steps, 0)).select(F.col("id").alias("no"))
    at = F.timestamp_micros(micros(F.lit(start)) + F.col("no") * F.lit(w * 1_000_000)).cast(df.schema[time].dataType)
    return series.join(counted, "no", "left").select(at.alias("bucket"), F.coalesce("n", F.lit(0)).alias("n"))


def anomaly(df: DataFrame, rule: Rule, now: datetime) -> DataFrame:
    """(value): how many population deviations the current count is above the buckets' mean."""
    source = rule.source
    stats = bucket_counts(df, rule, now).agg(F.count(F.lit(1)).alias("k"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"))
    current = df.where(P.all_of(_window(df, source, _back(now, rule.window_secs), now) + count_filter(rule, source))).agg(F.count(F.lit(1)).alias("c"))
    flat = (F.col("k") < 3) | (F.col("mean") < rule.min_count) | (F.col("sd") < 1e-9)
    return current.crossJoin(stats).select(F.when(flat, F.lit(0.0)).otherwise((F.col("c") - F.col("mean")) / F.col("sd")).alias("value"))


def values(tables: Tables, rules: Iterable[Rule], now: datetime) -> DataFrame:
    """(rule, value) for each scalar rule, in one aggregation for each source."""
    rules = list(rules)
    out: list[DataFrame] = []
    apart = [r for r in rules if r.kind in ("anomaly", "composite") or _quantile(r)]
    for source in dict.fromkeys(source_of(r) for r in rules if _quantile(r)):
        asked = [r for r in rules if _quantile(r) and source_of(r) == source]
        found = quantiles(tables[source], asked, now)
        entries = [F.struct(F.lit(r.name).alias("rule"), F.lit(found[str(i)] or 0.0).cast("double").alias("value")) for i, r in enumerate(asked)]
        out.append(tables[source].sparkSession.range(1).select(F.inline(F.array(*entries))))
    for source in dict.fromkeys(source_of(r) for r in rules if r not in apart):
        df = tables[source]
        mine = [(r, *_plan(r, df, now)) for r in rules if r not in apart and source_of(r) == source]
        rows = df.where(P.all_of(_window(df, source, _back(now, max(back for *_, back in mine)), now)))
        aggs, entries = [], []
        for r, cols, finish, _ in mine:
            names = [f"a{len(aggs) + i}" for i in range(len(cols))]
            aggs += [c.alias(n) for c, n in zip(cols, names, strict=True)]
            entries.append(F.struct(F.lit(r.name).alias("rule"), finish(*map(F.col, names)).cast("double").alias("value")))
        out.append(rows.agg(*aggs).select(F.inline(F.array(*entries))))
    for r in rules:
        if r.kind == "anomaly":
            out.append(anomaly(tables[r.source], r, now).select(F.lit(r.name).alias("rule"), "value"))
        elif r.kind == "composite":
            out.append(composite(tables, r, now).select(F.lit(r.name).alias("rule"), "value"))
    return reduce(DataFrame.unionByName, out)


def value(tables: Tables, rule: Rule, now: datetime) -> DataFrame:
    return values(tables, [rule], now).select("value")


def composite(tables: Tables, rule: Rule, now: datetime) -> DataFrame:
    """(value, breaching): how many conditions are met, and whether that suffices."""
    from dataclasses import replace

    named = [replace(c, name=str(i)) for i, c in enumerate(rule.conditions)]
    sub = values(tables, named, now)
    met = F.lit(False)
    for c in named:
        symbol = COMPARATORS[c.comparator][0]
        met = met | ((F.col("rule") == c.name) & F.expr(f"value {symbol} {c.threshold!r}D"))
    need = len(named) if (rule.op or "all") == "all" else 1
    return sub.agg(F.count_if(met).cast("double").alias("value")).withColumn("breaching", F.col("value") >= need)


def _group_rows(logs: DataFrame, rule: Rule, start: datetime, end: datetime, closed: bool = True) -> DataFrame:
    """Log rows of a grouped rule as `group_key`: its filters are the service, the severity and the tenant alone."""
    parts = P.equals(service_name=rule.service, tenant_id=rule.tenant)
    if rule.severity_min is not None:
        parts.append(F.col("severity_number") >= rule.severity_min)
    parts += P.between(logs, "log_time", start, end if closed else None)
    if not closed:
        parts.append(F.col("log_time") < P.instant(logs, "log_time", end))
    return logs.where(P.all_of(parts)).select(P.group_expr(rule.group_by).alias("group_key"))


def group_counts(logs: DataFrame, rule: Rule, now: datetime) -> DataFrame:
    """(group_key, n) over the window; rows without a key belong to no group."""
    rows = _group_rows(logs, rule, _back(now, rule.window_secs), now).where("group_key is not null")
    return rows.groupBy("group_key").agg(F.count(F.lit(1)).alias("n"))


def new_groups(logs: DataFrame, rule: Rule, now: datetime, sql_null_semantics: bool = False) -> DataFrame:
    """Groups of the window that the baseline before it doesn't have.

    With sql_null_semantics one row without a key in the baseline hides every new group, as NOT IN does.
    """
    start = _back(now, rule.window_secs)
    known = _group_rows(logs, rule, _back(now, rule.baseline), start, closed=False).distinct()
    found = group_counts(logs, rule, now)
    new = found.join(known.where("group_key is not null"), "group_key", "left_anti")
    if not sql_null_semantics:
        return new
    nothing = known.where("group_key is null").limit(1).select(F.lit(True).alias("__null"))
    return new.join(F.broadcast(nothing), F.lit(True), "left_anti")
