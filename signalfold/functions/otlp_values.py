"""Typed OTLP values as JSON text: the recursive part that no StructType can express."""

from __future__ import annotations

import json
import math
import struct
import sys

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Candidate keys for each correlation column, in order (fixed values).
CORRELATION = {
    "tenant_id": ("tenant_id", "tenant.id", "tenant"),
    "actor_id": ("actor_id", "actor.id", "user.id", "enduser.id", "user_id"),
    "session_id": ("session_id", "session.id", "session"),
    "service_name": ("service.name",),
}
#: Values nested deeper become null.
MAX_DEPTH = 64
MAX_DOUBLE = sys.float_info.max


def _integer(v):
    try:
        return int(v.strip()) if isinstance(v, str) else int(v)
    except (ValueError, TypeError, OverflowError):
        return None


def _inner(v) -> list:
    """The `values` of an array or a key-value list; what is not such a thing is empty."""
    found = v.get("values") if isinstance(v, dict) else None
    return found if isinstance(found, list) else []


def any_value(v, depth: int = 0):
    """A Python value of an AnyValue object; the first kind present wins, in the protocol's order. Total: what has
    another type than its kind becomes null (ingest refuses such requests; see sources/wire.py)."""
    if not isinstance(v, dict) or depth > MAX_DEPTH:
        return None
    if v.get("stringValue") is not None:
        return str(v["stringValue"])
    if v.get("intValue") is not None:
        return _integer(v["intValue"])
    if v.get("doubleValue") is not None:
        d = v["doubleValue"]
        return float(d) if isinstance(d, (int, float)) and abs(d) <= MAX_DOUBLE and math.isfinite(d) else None
    if v.get("boolValue") is not None:
        return bool(v["boolValue"])
    if v.get("arrayValue") is not None:
        return [any_value(x, depth + 1) for x in _inner(v["arrayValue"])]
    if v.get("kvlistValue") is not None:
        return key_values(_inner(v["kvlistValue"]), depth + 1)
    return v["bytesValue"] if isinstance(v.get("bytesValue"), str) else None


def key_values(items, depth: int = 0) -> dict:
    """The last of equal keys wins."""
    return {str(kv.get("key", "")): any_value(kv.get("value"), depth) for kv in (items if isinstance(items, list) else ()) if isinstance(kv, dict)}


def compact(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def _load(raw):
    try:
        return json.loads(raw) if isinstance(raw, str) else None
    except (ValueError, RecursionError):
        return None


def attributes_row(raw: str | None) -> tuple:
    """(JSON object text, then the first non-empty string among each correlation column's keys)."""
    found = key_values(_load(raw))
    return compact(found), *(next((found[k] for k in keys if isinstance(found.get(k), str) and found[k]), None) for keys in CORRELATION.values())


def body_text(raw: str | None) -> str | None:
    """A string as it is, anything else as compact JSON; null without a body."""
    v = _load(raw)
    if v is None:
        return None
    out = any_value(v)
    return out if isinstance(out, str) else compact(out)


def json_depth(value) -> int:
    """Levels of objects and lists."""
    level, here = 0, [value]
    while here := [x for x in here if isinstance(x, (dict, list))]:
        level, here = level + 1, [y for x in here for y in (x.values() if isinstance(x, dict) else x)]
    return level


def text_depth(raw: str | None) -> int | None:
    """Levels of a JSON text; null for a text that is nested beyond what a parser takes."""
    try:
        return json_depth(json.loads(raw)) if isinstance(raw, str) else 0
    except RecursionError:
        return None
    except ValueError:
        return 0


def notes(items, keys: tuple[str, ...]) -> str:
    """JSON of a list of span events or links: their fields as they are, and their attributes as an object."""
    found = _load(items)
    rows = [x for x in found if isinstance(x, dict)] if isinstance(found, list) else []
    return compact([{k: key_values(_load(x.get(k))) if k == "attributes" else x.get(k) for k in keys} for x in rows])


_ATTRIBUTES = T.StructType([T.StructField("json", T.StringType()), *(T.StructField(c, T.StringType()) for c in CORRELATION)])


def attributes(column):
    """struct(json, tenant_id, actor_id, session_id, service_name) of a KeyValue list's JSON text."""

    def batch(raw: pd.Series) -> pd.DataFrame:
        # Lists of a resource come with each of its records: each distinct text is read once.
        place, texts = pd.factorize(raw)
        rows = [*(attributes_row(r) for r in texts), attributes_row(None)]
        return pd.DataFrame([rows[i] for i in place], columns=_ATTRIBUTES.names, dtype=object)

    return F.pandas_udf(batch, _ATTRIBUTES)(column)


def body(column):
    def batch(raw: pd.Series) -> pd.Series:
        return pd.Series([body_text(r) for r in raw], dtype=object)

    return F.pandas_udf(batch, T.StringType())(column)


def depths(column):
    """The greatest depth among a list of JSON texts; null if one is nested beyond what a parser takes."""

    def batch(raw: pd.Series) -> pd.Series:
        found = [[text_depth(t) for t in r] if r is not None else [] for r in raw]
        return pd.Series([None if None in d else max(d, default=0) for d in found], dtype="Int32")

    return F.pandas_udf(batch, T.IntegerType())(column)


def double_bytes(column):
    """Little-endian IEEE bytes of a double; null counts as 0."""

    def batch(values: pd.Series) -> pd.Series:
        return pd.Series([struct.pack("<d", 0.0 if v is None or v != v else v) for v in values], dtype=object)

    return F.pandas_udf(batch, T.BinaryType())(column)


def with_attributes(column, *keys: str):
    """JSON text of a list of objects with these keys, whose `attributes` become objects."""

    def batch(raw: pd.Series) -> pd.Series:
        return pd.Series([notes(r, keys) for r in raw], dtype=object)

    return F.pandas_udf(batch, T.StringType())(column)
