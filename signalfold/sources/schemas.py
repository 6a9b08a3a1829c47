"""Schemas of the stored tables and of the wire formats; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import StructType

EVENTS = "event_id string, event_name string, tenant_id string, actor_id string, session_id string, timestamp_client timestamp, received_at timestamp, properties string"
LOGS = (
    "log_id string, log_time timestamp, observed_time timestamp, received_at timestamp, severity_number short, severity_text string, body string, service_name string, "
    "scope_name string, trace_id string, span_id string, tenant_id string, actor_id string, session_id string, resource_attributes string, log_attributes string"
)
SPANS = (
    "trace_id string, span_id string, parent_span_id string, start_time timestamp, end_time timestamp, duration_ms double, name string, kind short, service_name string, "
    "scope_name string, status_code short, status_message string, tenant_id string, actor_id string, session_id string, received_at timestamp, resource_attributes string, "
    "span_attributes string, events string, links string"
)
METRIC_POINTS = (
    "point_id string, time timestamp, metric_name string, metric_type string, unit string, value_double double, value_int long, count long, sum double, buckets string, "
    "service_name string, scope_name string, tenant_id string, actor_id string, session_id string, received_at timestamp, resource_attributes string, attributes string"
)
TABLES = {"events": EVENTS, "logs": LOGS, "spans": SPANS, "metric_points": METRIC_POINTS}

#: Time column and key of each table.
KEYS = {
    "events": ("timestamp_client", ["timestamp_client", "event_id"]),
    "logs": ("log_time", ["log_time", "log_id"]),
    "spans": ("start_time", ["start_time", "trace_id", "span_id"]),
    "metric_points": ("time", ["time", "point_id"]),
}

EVENT_BATCH = "token string, events array<struct<event_id string, event_name string, tenant_id string, actor_id string, session_id string, timestamp_client string, properties string>>"
# Attribute lists, bodies and integers that come as text or number stay text until they are normalised.
_RESOURCE, _SCOPE = "resource struct<attributes string>", "scope struct<name string>"
OTLP_LOGS = (
    f"resourceLogs array<struct<{_RESOURCE}, scopeLogs array<struct<{_SCOPE}, logRecords array<struct<timeUnixNano string, observedTimeUnixNano string, "
    "severityNumber long, severityText string, body string, attributes string, traceId string, spanId string>>>>>>"
)
OTLP_TRACES = (
    f"resourceSpans array<struct<{_RESOURCE}, scopeSpans array<struct<{_SCOPE}, spans array<struct<traceId string, spanId string, parentSpanId string, name string, "
    "kind long, startTimeUnixNano string, endTimeUnixNano string, attributes string, events array<struct<timeUnixNano string, name string, attributes string>>, "
    "links array<struct<traceId string, spanId string, attributes string>>, status struct<code long, message string>>>>>>>"
)
_POINT = "dataPoints array<struct<timeUnixNano string, asDouble double, asInt string, attributes string>>"
OTLP_METRICS = (
    f"resourceMetrics array<struct<{_RESOURCE}, scopeMetrics array<struct<{_SCOPE}, metrics array<struct<name string, unit string, gauge struct<{_POINT}>, sum struct<{_POINT}>, "
    "histogram struct<dataPoints array<struct<timeUnixNano string, count string, sum double, bucketCounts array<string>, explicitBounds array<double>, attributes string>>>>>>>>>"
)
HEARTBEAT = "id string"


def schema(name: str) -> StructType:
    """The stored table's schema; other names are an error."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}: one of {', '.join(TABLES)}")
    return StructType.fromDDL(TABLES[name])
