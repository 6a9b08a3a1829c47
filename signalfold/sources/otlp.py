"""OTLP/JSON requests (one JSON document a row, in `value`) to stored rows.

`admit` decides on whole requests: those of another shape than the protocol's and those with too many records are
refused. Each level of nesting is an inner explode, so empty lists give nothing. A flatten takes any text without an
error: what can't be read is null or gives no row. `accept` and `invalid_spans` count what single records were left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from signalfold.functions import otlp_values as V
from signalfold.functions.predicates import within_skew
from signalfold.session import ship
from signalfold.sources import schemas as S
from signalfold.sources.wire import well_formed

#: Records a request may hold, and bytes of variable content a record may (fixed values).
MAX_RECORDS, MAX_RECORD_BYTES = 2048, 65_536
_CORRELATED = ("tenant_id", "actor_id", "session_id")


def parse(requests: DataFrame, ddl: str) -> DataFrame:
    """requests (value, received_at) parsed as `r`; unparsable documents have a null `r`."""
    ship(requests.sparkSession)
    return requests.select(F.from_json("value", StructType.fromDDL(ddl)).alias("r"), "received_at")


def integer(text: Column) -> Column:
    """An integer that came as text or number; fractions are cut, anything else is null."""
    trimmed = F.trim(text)
    return F.coalesce(trimmed.try_cast("bigint"), F.when(trimmed.rlike(r"^[+-]?[0-9.]+([eE][+-]?[0-9]+)?$"), trimmed.try_cast("double").try_cast("bigint")))


def nanos(text: Column) -> Column:
    """The instant of positive nanoseconds, cut to microseconds; else null."""
    n = integer(text)
    return F.when(n > 0, F.timestamp_micros(((n - F.pmod(n, F.lit(1000))).cast("decimal(20,0)") / F.lit(1000)).cast("bigint")))


def blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _clamped(c: Column, most: int) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(0), F.least(c, F.lit(most)))).cast("short")


def _correlated(df: DataFrame) -> DataFrame:
    """From the raw attribute lists `own` and `outer`: their JSON, the service and the correlation columns."""
    df = df.withColumn("own", V.attributes(F.col("own"))).withColumn("outer", V.attributes(F.col("outer")))
    return df.withColumns({c: F.coalesce(f"own.{c}", f"outer.{c}") for c in _CORRELATED} | {"service_name": F.col("outer.service_name")})


def le_bytes(value: Column, size: int) -> Column:
    """Little-endian bytes of an integer column (null counts as 0)."""
    digits = F.lpad(F.hex(F.coalesce(value, F.lit(0)).cast("bigint")), 16, "0")
    digits = F.when(value < 0, F.hex(value.cast("bigint"))).otherwise(digits)
    pairs = F.regexp_extract_all(F.right(digits, F.lit(2 * size)), F.lit("(..)"), F.lit(1))
    return F.unhex(F.array_join(F.reverse(pairs), ""))


def _text_bytes(c: Column) -> Column:
    return F.encode(F.coalesce(c, F.lit("")), "UTF-8")


def content_id(*parts: Column) -> Column:
    """The first 16 bytes of the parts' SHA-256, written as a UUID."""
    h = F.substring(F.sha2(F.concat(*parts), 256), 1, 32)
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in cuts))


def _zero() -> Column:
    return F.unhex(F.lit("00"))


def flatten_logs(requests: DataFrame) -> DataFrame:
    """Rows of the logs table, with raw time order of candidates: own time, observed time, arrival."""
    df = parse(requests, S.OTLP_LOGS).select("received_at", F.explode("r.resourceLogs").alias("rl"))
    df = df.select("received_at", F.col("rl.resource.attributes").alias("outer"), F.explode("rl.scopeLogs").alias("sl"))
    df = df.select("received_at", "outer", F.col("sl.scope.name").alias("scope_name"), F.explode("sl.logRecords").alias("x"))
    own, seen = integer(F.col("x.timeUnixNano")), integer(F.col("x.observedTimeUnixNano"))
    df = df.withColumns({
        "own": F.col("x.attributes"), "ns": F.coalesce(F.when(own > 0, own), F.when(seen > 0, seen), F.unix_micros("received_at") * 1000),
        "log_time": F.coalesce(nanos(F.col("x.timeUnixNano")), nanos(F.col("x.observedTimeUnixNano")), F.col("received_at")),
        "observed_time": nanos(F.col("x.observedTimeUnixNano")), "severity_number": _clamped(F.col("x.severityNumber"), 24),
        "severity_text": F.col("x.severityText"), "body": V.body(F.col("x.body")),
        "trace_id": blank(F.col("x.traceId")), "span_id": blank(F.col("x.spanId")),
    })
    df = _correlated(df)
    log_id = content_id(
        le_bytes(F.col("ns"), 8), _text_bytes(F.col("service_name")), _zero(), _text_bytes(F.col("body")), _zero(), _text_bytes(F.col("trace_id")), _text_bytes(F.col("span_id")),
        le_bytes(F.col("severity_number"), 2), _text_bytes(F.col("own.json")))
    return df.withColumns({"log_id": log_id, "resource_attributes": F.col("outer.json"), "log_attributes": F.col("own.json")}).select(*S.schema("logs").names)


def _notes(c: str, **fields: Column) -> Column:
    """JSON text of a list of span events or links, with their attributes as objects."""
    rows = F.to_json(F.transform(c, lambda e: F.struct(*(v(e).alias(k) for k, v in fields.items()))), {"ignoreNullFields": "false"})
    # Most spans have none, and these take no part in the Python batch.
    return F.when(F.coalesce(F.size(c), F.lit(0)) > 0, V.with_attributes(F.when(F.size(c) > 0, rows), *fields)).otherwise("[]")


def _usable_span(x: Column | str = "x") -> Column:
    at = F.col(x) if isinstance(x, str) else x
    return (F.coalesce(at["traceId"], F.lit("")) != "") & (F.coalesce(at["spanId"], F.lit("")) != "")


def flatten_spans(requests: DataFrame) -> DataFrame:
    """Rows of the spans table; spans without a trace id or span id are left out."""
    df = parse(requests, S.OTLP_TRACES).select("received_at", F.explode("r.resourceSpans").alias("rs"))
    df = df.select("received_at", F.col("rs.resource.attributes").alias("outer"), F.explode("rs.scopeSpans").alias("ss"))
    df = df.select("received_at", "outer", F.col("ss.scope.name").alias("scope_name"), F.explode("ss.spans").alias("x"))
    df = df.where(_usable_span())
    df = df.withColumns({
        "own": F.col("x.attributes"), "trace_id": F.col("x.traceId"), "span_id": F.col("x.spanId"), "parent_span_id": blank(F.col("x.parentSpanId")),
        "start_time": F.coalesce(nanos(F.col("x.startTimeUnixNano")), F.col("received_at")), "end_time": nanos(F.col("x.endTimeUnixNano")),
        "name": F.coalesce("x.name", F.lit("")), "kind": _clamped(F.col("x.kind"), 5), "status_code": _clamped(F.col("x.status.code"), 2),
        "status_message": blank(F.col("x.status.message")),
        "events": _notes("x.events", time=lambda e: nanos(e["timeUnixNano"]), name=lambda e: F.coalesce(e["name"], F.lit("")), attributes=lambda e: F.coalesce(e["attributes"], F.lit("[]"))),
        "links": _notes("x.links", trace_id=lambda e: F.coalesce(e["traceId"], F.lit("")), span_id=lambda e: F.coalesce(e["spanId"], F.lit("")), attributes=lambda e: F.coalesce(e["attributes"], F.lit("[]"))),
    })
    df = _correlated(df)
    spent = (F.unix_micros("end_time") - F.unix_micros("start_time")) / F.lit(1000.0)
    return df.withColumns({"duration_ms": spent, "resource_attributes": F.col("outer.json"), "span_attributes": F.col("own.json")}).select(*S.schema("spans").names)


def flatten_metrics(requests: DataFrame) -> DataFrame:
    """Rows of the metric_points table: gauges, sums and histograms; nameless metrics and other kinds are left out."""
    df = parse(requests, S.OTLP_METRICS).select("received_at", F.explode("r.resourceMetrics").alias("rm"))
    df = df.select("received_at", F.col("rm.resource.attributes").alias("outer"), F.explode("rm.scopeMetrics").alias("sm"))
    df = df.select("received_at", "outer", F.col("sm.scope.name").alias("scope_name"), F.explode("sm.metrics").alias("m")).where(F.coalesce("m.name", F.lit("")) != "")
    df = df.withColumns({"metric_name": F.col("m.name"), "unit": blank(F.col("m.unit"))})
    # One array of points of all kinds, so that a request is scanned and parsed once.
    none = {"value_double": F.lit(None).cast("double"), "value_int": F.lit(None).cast("bigint"), "count": F.lit(None).cast("bigint"), "sum": F.lit(None).cast("double"), "buckets": F.lit(None).cast("string")}

    def points_of(kind: str, own: Callable[[Column], dict[str, Column]]) -> Column:
        def point(x: Column) -> Column:
            return F.struct(F.lit(kind).alias("metric_type"), x["timeUnixNano"].alias("timeUnixNano"), x["attributes"].alias("attributes"), *(c.alias(n) for n, c in (none | own(x)).items()))

        return F.transform(F.coalesce(F.col(f"m.{kind}.dataPoints"), F.array()), point)

    def number(x: Column) -> dict[str, Column]:
        return {"value_double": x["asDouble"], "value_int": integer(x["asInt"])}

    def histogram(x: Column) -> dict[str, Column]:
        counts = F.filter(F.transform(x["bucketCounts"], integer), lambda c: c.isNotNull())
        buckets = F.struct(F.coalesce(x["explicitBounds"], F.array().cast("array<double>")).alias("bounds"), F.coalesce(counts, F.array().cast("array<bigint>")).alias("counts"))
        return {"count": integer(x["count"]), "sum": x["sum"], "buckets": F.to_json(buckets)}

    points = df.select("received_at", "outer", "scope_name", "metric_name", "unit", F.explode(F.concat(points_of("gauge", number), points_of("sum", number), points_of("histogram", histogram))).alias("p"))
    points = points.select("received_at", "outer", "scope_name", "metric_name", "unit", "p.*")
    points = points.withColumn("time", F.coalesce(nanos(F.col("timeUnixNano")), F.col("received_at"))).withColumn("own", F.col("attributes"))
    points = _correlated(points)
    own = integer(F.col("timeUnixNano"))
    point_id = content_id(
        le_bytes(F.coalesce(F.when(own > 0, own), F.unix_micros("received_at") * 1000), 8), _text_bytes(F.col("metric_name")), _zero(), _text_bytes(F.col("metric_type")), _zero(),
        _text_bytes(F.col("service_name")), _zero(), V.double_bytes(F.col("value_double")), le_bytes(F.col("value_int"), 8), le_bytes(F.col("count"), 8), V.double_bytes(F.col("sum")),
        _text_bytes(F.col("buckets")), _zero(), _text_bytes(F.col("own.json")))
    return points.withColumns({"point_id": point_id, "resource_attributes": F.col("outer.json"), "attributes": F.col("own.json")}).select(*S.schema("metric_points").names)


FLATTEN = {"logs": flatten_logs, "spans": flatten_spans, "metric_points": flatten_metrics}
_CONTENT = {
    "logs": ("body", "service_name", "scope_name", "severity_text", "trace_id", "span_id", "resource_attributes", "log_attributes"),
    "spans": ("name", "service_name", "scope_name", "status_message", "resource_attributes", "span_attributes", "events", "links"),
    "metric_points": ("metric_name", "unit", "service_name", "scope_name", "buckets", "resource_attributes", "attributes"),
}


def content_bytes(table: str) -> Column:
    """Bytes of a record's variable content."""
    return sum((F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c in _CONTENT[table]), F.lit(0))


def accept(rows: DataFrame, table: str, max_bytes: int = MAX_RECORD_BYTES) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, one row of counts: received, dropped_skew, dropped_oversized). Both read `rows`: persist it if it is costly."""
    time = S.KEYS[table][0]
    timely, small = within_skew(time), content_bytes(table) <= max_bytes
    counts = rows.agg(
        F.count_if(timely).alias("received"), F.count_if(~timely).alias("dropped_skew"), F.count_if(timely & ~small).alias("dropped_oversized"))
    return rows.where(timely & small), counts


#: Each table's type of request, and the name of its list of resources.
REQUESTS = {"logs": (S.OTLP_LOGS, "resourceLogs"), "spans": (S.OTLP_TRACES, "resourceSpans"), "metric_points": (S.OTLP_METRICS, "resourceMetrics")}


def _times(table: str, resource: Column) -> Column:
    """The times of a resource's usable records (before the bound on their size)."""

    def inner(c: Column, name: str) -> Column:
        return F.flatten(F.transform(c, lambda a: F.coalesce(a[name], F.array())))

    arrival = F.col("received_at")
    if table == "logs":
        rows = inner(F.coalesce(resource["scopeLogs"], F.array()), "logRecords")
        return F.transform(rows, lambda x: F.coalesce(nanos(x["timeUnixNano"]), nanos(x["observedTimeUnixNano"]), arrival))
    if table == "spans":
        rows = F.filter(inner(F.coalesce(resource["scopeSpans"], F.array()), "spans"), _usable_span)
        return F.transform(rows, lambda x: F.coalesce(nanos(x["startTimeUnixNano"]), arrival))
    metrics = F.filter(inner(F.coalesce(resource["scopeMetrics"], F.array()), "metrics"), lambda m: F.coalesce(m["name"], F.lit("")) != "")

    def times(kind: str) -> Column:
        points = inner(F.transform(metrics, lambda m: m[kind]), "dataPoints")
        return F.transform(points, lambda p: F.coalesce(nanos(p["timeUnixNano"]), arrival))

    return F.concat(*map(times, ("gauge", "sum", "histogram")))


def over_limit(requests: DataFrame, table: str, most: int = MAX_RECORDS) -> DataFrame:
    """requests with n_records (usable and within the skew), too_many (those are to be refused whole) and first_resource: the raw
    attributes of the first resource that has such a record."""
    ddl, name = REQUESTS[table]
    resources = F.coalesce(F.from_json("value", StructType.fromDDL(ddl))[name], F.array())
    kept = F.transform(resources, lambda r: F.struct(F.size(F.filter(_times(table, r), lambda t: within_skew(t))).alias("n"), r["resource"]["attributes"].alias("attributes")))
    parsed = requests.withColumn("__kept", F.filter(kept, lambda r: r["n"] > 0))
    n = F.aggregate("__kept", F.lit(0), lambda total, r: total + r["n"])
    return parsed.withColumns({"n_records": n, "first_resource": F.get("__kept", F.lit(0))["attributes"]}).drop("__kept").withColumn("too_many", F.col("n_records") > most)


def invalid_spans(requests: DataFrame) -> DataFrame:
    """One row (dropped_invalid): spans of the requests that have no trace id or no span id."""
    rows = parse(requests, S.OTLP_TRACES).select(F.explode("r.resourceSpans").alias("a")).select(F.explode("a.scopeSpans").alias("b")).select(F.explode("b.spans").alias("x"))
    return rows.agg(F.count_if(~_usable_span()).alias("dropped_invalid"))


def admit(requests: DataFrame, table: str, most: int = MAX_RECORDS) -> DataFrame:
    """requests (value, received_at) with n_records, first_resource and `outcome`: ok, or invalid or too_many, which are refused whole."""
    ship(requests.sparkSession)
    sized = over_limit(requests.withColumn("__fine", well_formed("value", table)), table, most)
    outcome = F.when(~F.col("__fine"), "invalid").when(F.col("too_many"), "too_many").otherwise("ok")
    return sized.withColumn("outcome", outcome).drop("__fine", "too_many")
