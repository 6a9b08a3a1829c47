"""Shapes of the OTLP/JSON requests: what a document must look like to be taken at all.

A field may be missing, and null where it holds one thing; lists hold no nulls, a key is a string, and numbers and
strings are not taken for each other but where a 64-bit integer may come as either. The walk keeps its own stack, so
nesting costs no recursion; documents nested deeper than MAX_NESTING are refused.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Levels of nesting that a request may have (fixed value).
MAX_NESTING = 128

TEXT, NUMERIC, INTEGER, FLOAT, FLAG, KEY = "text", "text or number", "integer", "float", "flag", "key"
#: Shapes by name, for those that hold themselves.
NAMED: dict[str, dict] = {
    "value": {
        "stringValue": TEXT, "intValue": NUMERIC, "doubleValue": FLOAT, "boolValue": FLAG, "bytesValue": TEXT,
        "arrayValue": {"values": ["@value"]}, "kvlistValue": {"values": ["@attribute"]},
    },
    "attribute": {"key": KEY, "value": "@value"},
}
_ATTRIBUTES = ["@attribute"]
_RESOURCE, _SCOPE = {"attributes": _ATTRIBUTES}, {"name": TEXT}
_NUMBERS = {"dataPoints": [{"timeUnixNano": NUMERIC, "asDouble": FLOAT, "asInt": NUMERIC, "attributes": _ATTRIBUTES}]}
_HISTOGRAM = {"dataPoints": [{"timeUnixNano": NUMERIC, "count": NUMERIC, "sum": FLOAT, "bucketCounts": [NUMERIC], "explicitBounds": [FLOAT], "attributes": _ATTRIBUTES}]}
_RECORD = {
    "timeUnixNano": NUMERIC, "observedTimeUnixNano": NUMERIC, "severityNumber": INTEGER, "severityText": TEXT,
    "body": "@value", "attributes": _ATTRIBUTES, "traceId": TEXT, "spanId": TEXT,
}
_SPAN = {
    "traceId": TEXT, "spanId": TEXT, "parentSpanId": TEXT, "name": TEXT, "kind": INTEGER, "startTimeUnixNano": NUMERIC, "endTimeUnixNano": NUMERIC, "attributes": _ATTRIBUTES,
    "events": [{"timeUnixNano": NUMERIC, "name": TEXT, "attributes": _ATTRIBUTES}], "links": [{"traceId": TEXT, "spanId": TEXT, "attributes": _ATTRIBUTES}],
    "status": {"code": INTEGER, "message": TEXT},
}
_METRIC = {"name": TEXT, "unit": TEXT, "gauge": _NUMBERS, "sum": _NUMBERS, "histogram": _HISTOGRAM}
SHAPES = {
    "logs": {"resourceLogs": [{"resource": _RESOURCE, "scopeLogs": [{"scope": _SCOPE, "logRecords": [_RECORD]}]}]},
    "spans": {"resourceSpans": [{"resource": _RESOURCE, "scopeSpans": [{"scope": _SCOPE, "spans": [_SPAN]}]}]},
    "metric_points": {"resourceMetrics": [{"resource": _RESOURCE, "scopeMetrics": [{"scope": _SCOPE, "metrics": [_METRIC]}]}]},
}


def _number(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


_LEAVES = {
    TEXT: lambda v: v is None or isinstance(v, str),
    KEY: lambda v: isinstance(v, str),
    NUMERIC: lambda v: v is None or isinstance(v, str) or _number(v),
    INTEGER: lambda v: v is None or (isinstance(v, int) and not isinstance(v, bool) and -(1 << 63) <= v < 1 << 63),
    FLOAT: lambda v: v is None or _number(v),
    FLAG: lambda v: v is None or isinstance(v, bool),
}


def fits(document, shape: dict) -> bool:
    """Whether a parsed document has the shape."""
    stack = [(document, shape, 1)] if isinstance(document, dict) else []
    if not stack:
        return False
    while stack:
        value, shape, level = stack.pop()
        if level > MAX_NESTING:
            return False
        for name, inner in shape.items():
            if name not in value:
                if inner is KEY:
                    return False
                continue
            found, many = value[name], isinstance(inner, list)
            if many and not isinstance(found, list):
                return False
            inner = inner[0] if many else inner
            inner = NAMED[inner[1:]] if isinstance(inner, str) and inner[0] == "@" else inner
            for v in found if many else (found,):
                if isinstance(inner, str):
                    if not _LEAVES[inner](v) or (many and v is None):
                        return False
                elif isinstance(v, dict):
                    stack.append((v, inner, level + 1 + many))
                elif v is not None or many:
                    return False
    return True


def well_formed_text(raw: str | None, table: str) -> bool:
    try:
        return fits(json.loads(raw), SHAPES[table])
    except (ValueError, TypeError, RecursionError):
        return False


def well_formed(column: Column | str, table: str) -> Column:
    """Whether each request's text is a document of the table's shape."""

    def batch(raw: pd.Series) -> pd.Series:
        return pd.Series([well_formed_text(r, table) for r in raw], dtype="bool")

    return F.pandas_udf(batch, "boolean")(column)
