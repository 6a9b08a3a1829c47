"""Flattening, validation, storage, and streaming into it."""

import hashlib
import json
import os
import struct
from datetime import UTC, date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from signalfold.functions import otlp_values as V
from signalfold.functions.params import clamp_limit, parse_duration, parse_instant
from signalfold.operators import merge, reads
from signalfold.sources import cold, events, otlp, schemas
from signalfold.sources.daytable import DayTable
from signalfold.streaming import ingest

NOW = datetime(2024, 6, 20, 18)
NANOS = 1718900000000000000  # 2024-06-20 16:13:20 UTC


def attrs(**kv):
    return [{"key": k.replace("__", "."), "value": v} for k, v in kv.items()]


def requests(spark, *docs, received=NOW):
    return spark.createDataFrame([(d if isinstance(d, str) else json.dumps(d), received) for d in docs], "value string, received_at timestamp")


def log_request(*records, resource=None):
    resource = attrs(service__name={"stringValue": "demo-backend"}, tenant_id={"stringValue": "clinic-7"}) if resource is None else resource
    return {"resourceLogs": [{"resource": {"attributes": resource}, "scopeLogs": [{"scope": {"name": "demo.http"}, "logRecords": list(records)}]}]}


RECORD = {
    "timeUnixNano": str(NANOS), "severityNumber": 9, "severityText": "INFO", "body": {"stringValue": "user validated planning"}, "traceId": "5b8e", "spanId": "",
    "attributes": attrs(session_id={"stringValue": "sess-xyz"}, actor_id={"stringValue": "user-123"}, http__status_code={"intValue": "200"}),
}


def test_log_row(spark):
    r = otlp.flatten_logs(requests(spark, log_request(RECORD))).first()
    assert (r.service_name, r.session_id, r.severity_number, r.tenant_id, r.actor_id, r.scope_name) == ("demo-backend", "sess-xyz", 9, "clinic-7", "user-123", "demo.http")
    assert r.trace_id == "5b8e" and r.span_id is None and r.log_time == datetime(2024, 6, 20, 16, 13, 20)
    assert json.loads(r.log_attributes) == {"session_id": "sess-xyz", "actor_id": "user-123", "http.status_code": 200}
    raw = struct.pack("<q", NANOS) + b"demo-backend\0user validated planning\0" + b"5b8e" + struct.pack("<h", 9) + r.log_attributes.encode()
    assert r.log_id.replace("-", "") == hashlib.sha256(raw).hexdigest()[:32]


def test_log_times_clamps_and_odd_values(spark):
    rows = otlp.flatten_logs(requests(spark, log_request(
        {"observedTimeUnixNano": NANOS, "severityNumber": 99, "body": {"kvlistValue": {"values": attrs(b={"boolValue": True}, a={"arrayValue": {"values": [{"intValue": -5}, {"doubleValue": 0.5}]}})}}},
        {"severityNumber": -3, "attributes": attrs(tenant_id={"intValue": "7"}) + [{"key": "k", "value": {"stringValue": "1"}}, {"key": "k", "value": {"stringValue": "2"}}, {"key": "n"}]},
        {"timeUnixNano": "0", "body": {"stringValue": ""}},
    ), "not json", {"resourceLogs": []}, {"resourceLogs": [{"scopeLogs": []}]})).collect()
    assert len(rows) == 3
    assert rows[0].severity_number == 24 and rows[0].log_time == datetime(2024, 6, 20, 16, 13, 20) and rows[0].body == '{"a":[-5,0.5],"b":true}'
    assert rows[1].severity_number == 0 and rows[1].log_time == NOW and rows[1].body is None and rows[1].tenant_id == "clinic-7"  # a number is no tenant
    assert json.loads(rows[1].log_attributes) == {"tenant_id": 7, "k": "2", "n": None}
    assert rows[2].body == "" and rows[2].log_time == NOW


def test_log_ids_are_stable_and_skew_and_size_drop_rows(spark):
    old = RECORD | {"timeUnixNano": str(NANOS - 40 * 86_400 * 10**9)}
    big = RECORD | {"body": {"stringValue": "x" * 70_000}}
    rows = otlp.flatten_logs(requests(spark, log_request(RECORD), log_request(RECORD, old, big)))
    kept, counts = otlp.accept(rows, "logs")
    assert kept.count() == 2 and kept.select("log_id").distinct().count() == 1
    assert counts.first().asDict() == {"received": 3, "dropped_skew": 1, "dropped_oversized": 1}


def test_spans(spark):
    def span(i, **more):
        return {"traceId": "t", "spanId": str(i), "name": f"n{i}", "kind": 9, "startTimeUnixNano": str(NANOS), "endTimeUnixNano": str(NANOS + 3_000_000)} | more

    doc = {"resourceSpans": [{"resource": {"attributes": attrs(service__name={"stringValue": "api"})}, "scopeSpans": [{"spans": [
        span(1, status={"code": 2, "message": ""}, events=[{"timeUnixNano": str(NANOS), "name": "e"}]), span(2, parentSpanId="1", endTimeUnixNano=str(NANOS - 1_000_000)),
        span(3, endTimeUnixNano=None), span(4, traceId=""), {"spanId": "5"}]}]}]}
    rows = {r.span_id: r for r in otlp.flatten_spans(requests(spark, doc)).collect()}
    assert sorted(rows) == ["1", "2", "3"]
    assert (rows["1"].duration_ms, rows["1"].kind, rows["1"].status_code, rows["1"].status_message, rows["1"].service_name) == (3.0, 5, 2, None, "api")
    assert rows["2"].duration_ms == -1.0 and rows["2"].parent_span_id == "1" and rows["3"].duration_ms is None and rows["3"].end_time is None
    assert json.loads(rows["1"].events)[0]["name"] == "e" and rows["2"].links == "[]"


def test_metrics(spark):
    doc = {"resourceMetrics": [{"scopeMetrics": [{"metrics": [
        {"name": "cpu", "unit": "1", "gauge": {"dataPoints": [{"timeUnixNano": str(NANOS), "asDouble": 0.42}]}, "sum": {"dataPoints": [{"timeUnixNano": str(NANOS), "asInt": "17"}]}},
        {"name": "lat", "unit": "", "histogram": {"dataPoints": [{"timeUnixNano": str(NANOS), "count": "3", "sum": 600.0, "bucketCounts": ["1", "2", "x", "0"], "explicitBounds": [100, 500]}]}},
        {"name": "", "gauge": {"dataPoints": [{"asDouble": 1}]}}, {"name": "other", "summary": {"dataPoints": [{}]}}]}]}]}
    rows = {(r.metric_name, r.metric_type): r for r in otlp.flatten_metrics(requests(spark, doc, doc)).collect()}
    assert sorted(rows) == [("cpu", "gauge"), ("cpu", "sum"), ("lat", "histogram")]
    assert rows["cpu", "gauge"].value_double == 0.42 and rows["cpu", "sum"].value_int == 17 and rows["lat", "histogram"].unit is None
    h = rows["lat", "histogram"]
    assert (h["count"], h["sum"], json.loads(h.buckets)) == (3, 600.0, {"bounds": [100.0, 500.0], "counts": [1, 2, 0]})
    assert otlp.flatten_metrics(requests(spark, doc, doc)).select("point_id").distinct().count() == 3
    raw = struct.pack("<q", NANOS) + b"cpu\0gauge\0\0" + struct.pack("<dqqd", 0.42, 0, 0, 0.0) + b"\0{}"
    assert rows["cpu", "gauge"].point_id.replace("-", "") == hashlib.sha256(raw).hexdigest()[:32]


def test_requests_over_the_limit(spark):
    point = {"timeUnixNano": str(NANOS), "asDouble": 1}
    doc = {"resourceMetrics": [{"scopeMetrics": [{"metrics": [{"name": "m", "gauge": {"dataPoints": [point] * 3}}]}, {}]}, {}]}
    assert [(r.n_records, r.too_many) for r in otlp.over_limit(requests(spark, doc), "metric_points", 2).collect()] == [(3, True)]
    assert [(r.n_records, r.too_many) for r in otlp.over_limit(requests(spark, log_request(RECORD, RECORD), "broken"), "logs", 2).collect()] == [(2, False), (0, False)]


def event(i=0, **more):
    return {"event_id": f"00000000-0000-0000-0000-{i:012}", "event_name": "open", "actor_id": "u", "session_id": "s", "timestamp_client": "2024-06-20T10:15:30.123Z", "properties": {"k": "v"}} | more


def test_event_batches(spark):
    deep = {"a": 1}
    for _ in range(16):
        deep = {"a": deep}
    docs = [
        {"events": [event(1), event(2, properties=None), event(3, timestamp_client="2024-05-01T00:00:00Z")]}, {"events": []}, {"events": [event(4, actor_id="  ")]},
        {"events": [event(5, properties=[1])]}, {"events": [event(6, properties=deep)]}, {"events": [event(7, event_name="x" * 201)]}, {"events": [event(8, event_id="nope")]},
        {"events": [event(i) for i in range(501)]}, {"events": [event(9, tenant_id="é" * 200)]}, {"events": [event(10, properties={"k": "x" * 17_000})]}, "broken",
    ]
    rows, verdicts = events.read_batches(requests(spark, *docs))
    got = {r.event_id[-2:]: r for r in rows.collect()}
    assert sorted(got) == ["01", "02", "09"] and got["02"].properties == "{}" and got["01"].timestamp_client == datetime(2024, 6, 20, 10, 15, 30, 123000)
    out = sorted((r.outcome, r.n_events, r.dropped_skew) for r in verdicts.collect())
    assert out.count(("ok", 3, 1)) == 1 and out.count(("ok", 1, 0)) == 1 and [o for o, *_ in out].count("invalid") == 7 and ("empty", 0, 0) in out and ("too_many", 501, 0) in out


def stored_events(spark, *rows):
    """rows: (id, name, time[, received])."""
    full = [(i, n, None, "u", "s", t, r[0] if r else t, "{}") for i, n, t, *r in rows]
    return spark.createDataFrame(full, schemas.EVENTS)


def test_merge_is_idempotent_and_first_arrival_wins(spark, tmp_path):
    t = datetime(2024, 6, 20, 10)
    batch = stored_events(spark, ("a", "late", t, t + timedelta(seconds=9)), ("a", "first", t, t), ("b", "x", t + timedelta(days=1), t))
    root = str(tmp_path)
    assert [merge.merge(batch, root, "events") for _ in range(3)] == [2, 0, 0]
    assert merge.merge(stored_events(spark, ("a", "other", t), ("c", "new", t)), root, "events") == 1
    got = {r.event_id: r.event_name for r in DayTable(spark, root, "events").read().collect()}
    assert got == {"a": "first", "b": "x", "c": "new"}


def test_scan_prunes_days_and_refuses_unknown_tables(spark, tmp_path):
    root = str(tmp_path)
    cold.write_days(stored_events(spark, *((str(i), "x", datetime(2024, 6, 1) + timedelta(days=10 * i)) for i in range(5))), root, "events")
    assert [cold.scan(spark, root, "events", d).count() for d in ("2024-06-11", "2024-06", "2024", "2023")] == [1, 3, 5, 0]
    assert "PartitionFilters: [isnotnull(date" in cold.scan(spark, root, "events", "2024-06")._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        cold.scan(spark, root, "secrets")
    for bad in ("/abs", "a\\b", "../up", "a\x00"):
        with pytest.raises(ValueError):
            cold.valid_prefix(bad)


def test_export_reads_back_and_repeats(spark, tmp_path):
    start = datetime(2024, 6, 15, 8)
    rows = stored_events(spark, *((f"{i:04}", f"e{i % 10}", start + timedelta(seconds=i, microseconds=700_000)) for i in range(1000)), ("x", "next", datetime(2024, 6, 16)))
    for _ in range(2):
        folder = cold.export_day(rows, str(tmp_path), "events", date(2024, 6, 15))
    back = spark.read.parquet(folder)
    assert back.count() == 1000 and back.select("event_name").distinct().count() == 10
    assert [r.event_id for r in back.limit(3).collect()] == ["0000", "0001", "0002"] and back.first().timestamp_client == start + timedelta(microseconds=700_000)
    empty = cold.export_day(rows, str(tmp_path), "events", date(2024, 6, 1))
    assert [f for f in os.listdir(empty) if f.endswith(".parquet")] and spark.read.schema(schemas.EVENTS).parquet(empty).count() == 0


def test_purge_drops_days_before_the_cutoff(spark, tmp_path):
    root, today = str(tmp_path), date(2024, 6, 30)
    cold.write_days(stored_events(spark, *((str(d), "x", datetime(2024, 6, 30) - timedelta(days=d)) for d in (10, 6, 5, 0))), root, "events")
    assert cold.purge(spark, f"{root}/events", today, 5) == 2
    assert sorted(r.event_id for r in cold.scan(spark, root, "events").collect()) == ["0", "5"]
    assert cold.touched_days(stored_events(spark, ("a", "x", datetime(2024, 1, 1))), "events") == [date(2024, 1, 1)]


def test_stream_ingest_of_repeated_batches(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    today = datetime.now().strftime("%Y-%m-%dT%H:%M:%SZ")
    for k in range(8):
        line = json.dumps({"events": [event(i, timestamp_client=today) for i in range(50 * (k // 2), 50 * (k // 2) + 50)]})
        (inbox / f"{k}.json").write_text(line + "\n")
    stats = ingest.Stats()
    q = ingest.start(ingest.requests(spark, str(inbox), 3), str(tmp_path / "store"), "events", str(tmp_path / "ckpt"), stats)
    q.awaitTermination()
    got = DayTable(spark, str(tmp_path / "store"), "events").read()
    assert got.count() == 200 and got.select("event_id").distinct().count() == 200
    s = stats.summary()
    assert (s["received"], s["inserted"], s["deduplicated"], s["flushes"]) == (400, 200, 200, 3)


def test_stream_ingest_of_logs(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    fresh = {k: v for k, v in RECORD.items() if k != "timeUnixNano"}
    (inbox / "a.json").write_text(json.dumps(log_request(fresh)) + "\n")
    stats = ingest.Stats()
    ingest.start(ingest.requests(spark, str(inbox)), str(tmp_path / "store"), "logs", str(tmp_path / "ckpt"), stats).awaitTermination()
    assert stats["inserted"] == 1 and DayTable(spark, str(tmp_path / "store"), "logs").read().first().service_name == "demo-backend"


def test_reads(spark):
    t = datetime(2024, 6, 1)
    ev = spark.createDataFrame([(str(i), n, None, "u", s, t + timedelta(seconds=i), t, "{}") for i, (s, n) in enumerate([("s1", "open"), ("s2", "open"), ("s1", "validate"), ("s3", "open"), ("s2", "validate")])], schemas.EVENTS)
    assert [(r.path, r.occurrences) for r in reads.frequent_journeys(ev).collect()] == [(["open", "validate"], 2), (["open"], 1)]
    rows = [("1", t, 17, "Timeout at 100%_ C:\\x", "billing", "sess-pay"), ("2", t, 9, "timeout", "billing", "s"), ("3", t, 17, None, "billing", "s"), ("4", t, None, "timeout", "billing", "s")]
    logs = spark.createDataFrame(rows, "log_id string, log_time timestamp, severity_number short, body string, service_name string, session_id string")
    assert [r.session_id for r in reads.search_logs(logs, service="billing", q="timeout", severity_min=17).collect()] == ["sess-pay"]
    assert reads.search_logs(logs, q="c:\\x").count() == 1 and reads.search_logs(logs, q="t_m%t").count() == 3
    assert reads.search_logs(logs, start="2024-06-01T00:00:00Z", end="2024-06-01T00:00:00Z").count() == 4 and reads.search_logs(logs, start="2024-06-01T00:00:00.000001Z").count() == 0
    spans = spark.createDataFrame([("t", "b", t + timedelta(milliseconds=1)), ("t", "a", t), ("u", "c", t)], "trace_id string, span_id string, start_time timestamp")
    doc = reads.trace_document(spans, "t")
    assert doc["span_count"] == 2 and [s["span_id"] for s in doc["spans"]] == ["a", "b"] and reads.trace_document(spans, "none") == {"trace_id": "none", "span_count": 0, "spans": []}
    assert len(reads.TOOLS) == 6


def test_params():
    assert [clamp_limit(n) for n in (None, 0, -5, 50, 5000)] == [100, 1, 1, 50, 1000]
    assert parse_instant(" ") is None and parse_instant("2024-06-01T02:00:00+02:00").isoformat() == "2024-06-01T00:00:00+00:00"
    for bad in ("2024-06-01", "2024-06-01T00:00:00", "soon"):
        with pytest.raises(ValueError, match="from"):
            parse_instant(bad, "from")
    assert [parse_duration(d) for d in ("200ms", "15s", "30m", "24h", "31d")] == [0.2, 15, 1800, 86_400, 2_678_400]
    assert V.json_depth({"a": [{"b": 1}]}) == 3


def test_documents_of_another_shape_are_refused(spark, tmp_path):
    from signalfold.sources import wire

    def log(**fields):
        return json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": [fields]}]}]})

    good = [log(), log(body=None, attributes=[]), log(body={"intValue": 5, "unknown": [1]}, severityNumber=3, timeUnixNano="x"), "{}", log(attributes=[{"key": "a"}, {"key": "b", "value": {"kvlistValue": {"values": []}}}])]
    bad = [
        None, "", "[]", "null", "{", log(body={"doubleValue": "abc"}), log(body={"arrayValue": [1]}), log(body={"kvlistValue": "x"}), log(attributes=5), log(attributes=None), log(attributes=[{"value": {}}]), log(body={"intValue": [1]}),
        log(severityNumber="9"), log(severityNumber=True), log(body={"arrayValue": {"values": [None]}}), '{"resourceLogs": ' + "[" * 5000 + "]" * 5000 + "}", '{"resourceLogs": null}']
    deep = {"stringValue": "x"}
    for _ in range(70):
        deep = {"arrayValue": {"values": [deep]}}
    bad.append(log(body=deep))
    assert [wire.well_formed_text(d, "logs") for d in [*good, *bad]] == [True] * len(good) + [False] * len(bad)
    requests = spark.createDataFrame([(d,) for d in [*good, *bad]], "value string").withColumn("received_at", F.current_timestamp())
    assert {r.outcome: r["count"] for r in otlp.admit(requests, "logs").groupBy("outcome").count().collect()} == {"ok": len(good), "invalid": len(bad)}
    assert otlp.flatten_logs(requests).count() >= 4  # takes any text without an error


def test_a_bad_request_does_not_stop_a_stream(spark, tmp_path):
    from signalfold.streaming import ingest

    now = datetime.now(UTC)
    fine = json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [{"traceId": "t", "spanId": "s", "startTimeUnixNano": str(int(now.timestamp()) * 10**9)}, {"traceId": "t"}]}]}]})
    bad = json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [{"traceId": "t", "spanId": "p", "attributes": 5}]}]}]})
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join([fine, bad, "no json", '{"a": ' + "[" * 3000]))
    stats = ingest.Stats()
    ingest.start(ingest.requests(spark, str(tmp_path / "in")), str(tmp_path / "out"), "spans", str(tmp_path / "c"), stats).awaitTermination()
    assert (stats["refused"], stats["inserted"], stats["dropped_invalid"], stats["received"]) == (3, 1, 1, 1)


def test_rendering_shows_all_rows(spark):
    text, n = cold.render(spark.range(1500))
    assert n == 1500 and "1499" in text
    text, n = cold.render(spark.range(1500), "json")
    assert (n, len(json.loads(text))) == (1500, 1500) and cold.render(spark.range(5), "json", 2)[1] == 2


def test_heartbeats(spark):
    from signalfold.sources.heartbeats import read_heartbeats

    rows = spark.createDataFrame([(v,) for v in ['{"id": " a "}', '{"id": "  "}', '{"id": 5}', "{}", "x", None]], "value string").withColumn("received_at", F.current_timestamp())
    beats, refused = read_heartbeats(rows)
    assert [r.id for r in beats.collect()] == ["a"] and refused.first().refused == 5


def test_metric_requests_are_scanned_once(spark, tmp_path):
    number = {"dataPoints": [{"timeUnixNano": str(NANOS), "asDouble": 1.5, "attributes": attrs(k={"stringValue": "v"})}, {"asInt": "7"}]}
    bins = {"dataPoints": [{"timeUnixNano": str(NANOS), "count": "3", "sum": 6.0, "bucketCounts": ["1", 2, None], "explicitBounds": [1.0]}, {"count": 1}]}
    metrics = [{"name": "a", "gauge": number}, {"name": "b", "sum": number, "histogram": bins}, {"name": "", "gauge": number}, {"name": "c", "summary": number}, {"name": "d", "gauge": {}}]
    doc = json.dumps({"resourceMetrics": [{"scopeMetrics": [{"metrics": metrics}, {}]}, {}]})
    path = str(tmp_path / "r")
    requests(spark, doc, "{}", "x").write.parquet(path)
    points = otlp.flatten_metrics(spark.read.parquet(path))
    got = [(r.metric_name, r.metric_type, r.value_double, r.value_int, r["count"], r["sum"], r.buckets, r.attributes) for r in points.collect()]
    two = [(1.5, None, None, None, None, '{"k":"v"}'), (None, 7, None, None, None, "{}")]
    want = [(n, k, *x) for n, k in (("a", "gauge"), ("b", "sum")) for x in two] + [("b", "histogram", None, None, 3, 6.0, '{"bounds":[1.0],"counts":[1,2]}', "{}"), ("b", "histogram", None, None, 1, None, '{"bounds":[],"counts":[]}', "{}")]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert points._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
