"""The read queries: filtered searches, one trace, frequent journeys."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalfold.functions import predicates as P
from signalfold.functions.params import JOURNEY_LIMIT, JOURNEY_LIMIT_MAX, clamp_limit, parse_instant
from signalfold.operators import journeys

LOG_COLUMNS = ("log_time", "severity_number", "severity_text", "body", "service_name", "trace_id", "tenant_id", "actor_id", "session_id", "log_attributes")
EVENT_COLUMNS = ("event_id", "event_name", "tenant_id", "actor_id", "session_id", "timestamp_client", "properties")
METRIC_COLUMNS = ("time", "metric_name", "metric_type", "unit", "value_double", "value_int", "count", "sum", "buckets", "service_name", "tenant_id", "attributes")

Instant = datetime | str | None


def _at(value: Instant, name: str) -> datetime | None:
    return parse_instant(value, name) if isinstance(value, str) else value


def _latest(df: DataFrame, columns: tuple[str, ...], time: str, tie: str, limit: int) -> DataFrame:
    """Newest first; equal times by id."""
    have = [c for c in columns if c in df.columns]
    return df.orderBy(F.desc(time), tie).limit(limit).select(*dict.fromkeys([*have, tie]))


def search_logs(logs: DataFrame, service: str | None = None, session: str | None = None, trace_id: str | None = None, severity_min: int | None = None, q: str | None = None, start: Instant = None, end: Instant = None, limit: int | None = None) -> DataFrame:
    parts = P.equals(service_name=service, session_id=session, trace_id=trace_id) + P.contains("body", q)
    if severity_min is not None:
        parts.append(F.col("severity_number") >= severity_min)
    parts += P.between(logs, "log_time", _at(start, "from"), _at(end, "to"))
    return _latest(logs.where(P.all_of(parts)), LOG_COLUMNS, "log_time", "log_id", clamp_limit(limit))


def search_events(events: DataFrame, actor: str | None = None, session: str | None = None, tenant: str | None = None, name: str | None = None, start: Instant = None, end: Instant = None, limit: int | None = None) -> DataFrame:
    parts = P.equals(actor_id=actor, session_id=session, tenant_id=tenant, event_name=name)
    parts += P.between(events, "timestamp_client", _at(start, "from"), _at(end, "to"))
    return _latest(events.where(P.all_of(parts)), EVENT_COLUMNS, "timestamp_client", "event_id", clamp_limit(limit))


def search_metrics(points: DataFrame, name: str | None = None, service: str | None = None, start: Instant = None, end: Instant = None, limit: int | None = None) -> DataFrame:
    parts = P.equals(metric_name=name, service_name=service) + P.between(points, "time", _at(start, "from"), _at(end, "to"))
    return _latest(points.where(P.all_of(parts)), METRIC_COLUMNS, "time", "point_id", clamp_limit(limit))


def get_trace(spans: DataFrame, trace_id: str) -> DataFrame:
    """All spans of a trace in order of their start; none for an unknown id."""
    return spans.where(F.col("trace_id") == trace_id).orderBy("start_time", "span_id")


def trace_document(spans: DataFrame, trace_id: str) -> dict:
    rows = [r.asDict() for r in get_trace(spans, trace_id).collect()]
    return {"trace_id": trace_id, "span_count": len(rows), "spans": rows}


def frequent_journeys(events: DataFrame, actor: str | None = None, tenant: str | None = None, limit: int | None = None) -> DataFrame:
    """Sequences of event names and how many sessions have them; filters act before sequencing."""
    mine = events.where(P.all_of(P.equals(actor_id=actor, tenant_id=tenant)))
    return journeys.frequent(mine, clamp_limit(limit, JOURNEY_LIMIT, JOURNEY_LIMIT_MAX))


def ingest_stats(received: int, inserted: int, **others: int) -> dict[str, int]:
    return {"received": received, "inserted": inserted, "deduplicated": max(0, received - inserted)} | {
        k: others.get(k, 0) for k in ("dropped_skew", "dropped_oversized", "dropped_channel_full", "flush_failures", "flushes")}


#: The tool surface: name -> callable over the table it reads.
TOOLS = {
    "search_logs": search_logs, "get_trace": get_trace, "search_events": search_events,
    "frequent_journeys": frequent_journeys, "search_metrics": search_metrics, "ingest_stats": ingest_stats,
}
