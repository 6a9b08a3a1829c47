"""Rules: values on seeded rows with known results, validation, texts, and the state machine."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalfold.operators import evaluate
from signalfold.operators.alert_state import Sink, evaluate_once
from signalfold.operators.rules import Rule, RuleError, describe, parse_rules, rule_of, validate, with_defaults

NOW = datetime(2024, 6, 1, 12)
LOGS = "log_id string, log_time timestamp, severity_number short, severity_text string, body string, service_name string, trace_id string, tenant_id string, log_attributes string"
SPANS = "span_id string, start_time timestamp, duration_ms double, name string, service_name string, status_code short, tenant_id string"
METRICS = "point_id string, time timestamp, metric_name string, value_double double, value_int long, service_name string, tenant_id string"
EVENTS = "event_id string, timestamp_client timestamp, event_name string, tenant_id string"


def logs(spark, *rows):
    """rows: (body, severity, seconds ago[, service[, tenant]])."""
    full = [(str(i), NOW - timedelta(seconds=r[2]), r[1], None, r[0], r[3] if len(r) > 3 else "svc", None, r[4] if len(r) > 4 else None, '{"k": "v"}') for i, r in enumerate(rows)]
    return spark.createDataFrame(full, LOGS)


def spans(spark, *rows):
    """rows: (duration, status)."""
    return spark.createDataFrame([(str(i), NOW - timedelta(seconds=5 + i), float(d) if d is not None else None, "op", "svc", s, None) for i, (d, s) in enumerate(rows)], SPANS)


def metrics(spark, *rows):
    """rows: (name, value, tenant)."""
    return spark.createDataFrame([(f"{i:03}", NOW - timedelta(seconds=5 + i), n, float(v) if v is not None else None, None, "svc", t) for i, (n, v, t) in enumerate(rows)], METRICS)


def one(df):
    return df.first()["value"]


def test_cooldown_keeps_the_second_firing_silent(spark):
    rule = Rule("log_count", "r", severity_min=17, window_secs=300, threshold=2, cooldown_secs=600)
    sent, state, sink = [], {}, Sink()
    sink.defaults.append(lambda a: sent.append(a))
    full = {"logs": logs(spark, *[("boom", 17, 10)] * 3)}
    none = {"logs": logs(spark, ("fine", 9, 10))}
    assert [a.value for a in evaluate_once(full, [rule], state, NOW, sink)] == [3.0]
    assert evaluate_once(full, [rule], state, NOW, sink) == []
    assert evaluate_once(none, [rule], state, NOW, sink) == []  # resolved within the cooldown: silent, but the flag moved
    assert [a.state for a in evaluate_once(full, [rule], state, NOW + timedelta(seconds=0), sink)] == []


def test_fires_then_resolves(spark):
    rule = Rule("log_count", "r", severity_min=17, window_secs=300, threshold=2)
    sent, state = [], {}
    sink = Sink([lambda a: sent.append(a)])
    evaluate_once({"logs": logs(spark, *[("boom", 17, 10)] * 3)}, [rule], state, NOW, sink)
    evaluate_once({"logs": logs(spark, ("fine", 9, 10))}, [rule], state, NOW, sink)
    assert [a.state for a in sent] == ["firing", "resolved"]


def test_groups_fire_and_vanished_ones_resolve(spark):
    rule = Rule("log_group_count", "g", window_secs=300, comparator="gte", threshold=5)
    sent, state = [], {}
    sink = Sink([lambda a: sent.append(a)])
    evaluate_once({"logs": logs(spark, *[("boom", 17, 10)] * 5, *[("kaboom", 17, 10)] * 5, ("blip", 17, 1))}, [rule], state, NOW, sink)
    assert sorted(a.group_key for a in sent) == ["boom", "kaboom"]
    evaluate_once({"logs": logs(spark, *[("boom", 17, 10)] * 5)}, [rule], state, NOW, sink)
    assert [(a.group_key, a.state, a.value) for a in sent[2:]] == [("kaboom", "resolved", 0.0)]


def test_error_ratio_and_its_floor(spark):
    t = {"logs": logs(spark, *[("x", 17, 5)] * 2, *[("x", 9, 5)] * 8)}
    assert one(evaluate.value(t, Rule("error_ratio", "r", window_secs=60), NOW)) == 0.2
    assert one(evaluate.value(t, Rule("error_ratio", "r", window_secs=60, min_count=100), NOW)) == 0.0


def test_percentiles_are_exact(spark):
    t = {"spans": spans(spark, *[(100, 1)] * 18, *[(5000, 2)] * 2), "metrics": metrics(spark, *[("m", 100, None)] * 18, *[("m", 4000, None)] * 2)}
    assert one(evaluate.value(t, Rule("span_duration", "r", window_secs=300), NOW)) == 5000.0
    assert one(evaluate.value(t, Rule("metric_threshold", "r", metric_name="m", agg="p95", window_secs=300), NOW)) == 4000.0


@pytest.mark.parametrize("agg", ["avg", "max", "min", "sum", "count", "last", "p50"])
def test_empty_windows_give_zero(spark, agg):
    t = {"metrics": metrics(spark, ("other", 1, None))}
    assert one(evaluate.value(t, Rule("metric_threshold", "r", metric_name="m", agg=agg, window_secs=300), NOW)) == 0.0


def test_count_and_last(spark):
    t = {"metrics": metrics(spark, ("m", 3, None), ("m", 1, None), ("m", None, None))}
    assert one(evaluate.value(t, Rule("metric_threshold", "r", metric_name="m", agg="count", window_secs=300), NOW)) == 2.0
    assert one(evaluate.value(t, Rule("metric_threshold", "r", metric_name="m", agg="last", window_secs=300), NOW)) == 3.0


def test_tenants_are_apart(spark):
    t = {"metrics": metrics(spark, ("m", 100, "a"), ("m", 10_000, "b"))}
    assert one(evaluate.value(t, Rule("metric_threshold", "r", metric_name="m", agg="avg", tenant="a", window_secs=300), NOW)) == 100.0


def test_relative_change_counts_the_boundary_twice(spark):
    rows = [("x", 9, 30)] * 10 + [("x", 9, 90)] * 2
    rule = Rule("relative_change", "r", window_secs=60)
    assert one(evaluate.value({"logs": logs(spark, *rows)}, rule, NOW)) == 5.0
    assert one(evaluate.value({"logs": logs(spark, *rows, ("x", 9, 60))}, rule, NOW)) == 11 / 3


def test_anomaly_of_the_known_series(spark):
    # Steps start at now - 3000 s; two rows in each but one step, 40 in the current window.
    rows = [("x", 9, 3000 - 60 * i - 30) for i in range(49) for _ in range(2) if i != 20] + [("x", 9, 30)] * 40
    rule = Rule("anomaly", "r", window_secs=60, baseline_secs=3000)
    t = {"logs": logs(spark, *rows)}
    buckets = evaluate.bucket_counts(t["logs"], rule, NOW)
    assert buckets.count() == 49 and buckets.where("n = 0").count() == 1
    assert one(evaluate.value(t, rule, NOW)) == pytest.approx(134.5226127211828)
    assert one(evaluate.value(t, Rule("anomaly", "r", window_secs=60, baseline_secs=100), NOW)) == 0.0  # too few steps


def test_new_signatures(spark):
    t = logs(spark, ("known", 17, 1000), ("known", 17, 5), ("brand new error", 17, 5))
    rule = Rule("log_new_signature", "n", window_secs=60, baseline_secs=3600)
    assert [(r.group_key, r.n) for r in evaluate.new_groups(t, rule, NOW).collect()] == [("brand new error", 1)]
    nulls = t.unionByName(logs(spark, (None, 17, 900)))
    assert evaluate.new_groups(nulls, rule, NOW).count() == 1
    assert evaluate.new_groups(nulls, rule, NOW, sql_null_semantics=True).count() == 0


def test_composites(spark):
    t = {"logs": logs(spark, *[("x", 17, 5)] * 5, *[("x", 9, 5)] * 5), "spans": spans(spark, *[(10, 1)] * 5)}
    parts = (Rule("error_ratio", window_secs=60, threshold=0.2), Rule("span_duration", window_secs=60, threshold=1000.0))
    r = evaluate.composite(t, Rule("composite", "c", conditions=parts), NOW).first()
    assert (r.value, r.breaching) == (1.0, False)
    assert evaluate.composite(t, Rule("composite", "c", op="any", conditions=parts), NOW).first().breaching
    t["spans"] = spans(spark, *[(5000, 1)] * 5)
    r = evaluate.composite(t, Rule("composite", "c", conditions=parts), NOW).first()
    assert (r.value, r.breaching) == (2.0, True)


def test_scalar_rules_of_a_source_share_one_scan(spark):
    t = {"logs": logs(spark, ("x", 17, 5))}
    rules = [Rule("log_count", f"r{i}", severity_min=i, window_secs=60 * (i + 1)) for i in range(5)]
    plan = evaluate.values(t, rules, NOW)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1


@pytest.mark.parametrize("bad", [
    {"kind": "log_count", "window_secs": 60}, {"name": "x", "kind": "log_count"}, {"name": "x", "kind": "metric_threshold", "window_secs": 60, "agg": "avg"},
    {"name": "x", "kind": "metric_threshold", "window_secs": 60, "metric_name": "m"}, {"name": "x", "kind": "error_ratio", "source": "events", "window_secs": 60},
    {"name": "x", "kind": "composite"}, {"name": "x", "kind": "composite", "conditions": [{"kind": "composite", "conditions": [{"kind": "log_count", "window_secs": 1}]}]},
    {"name": "x", "kind": "composite", "conditions": [{"kind": "log_group_count", "window_secs": 1}]}, {"name": "x", "kind": "log_count", "window_secs": 60, "treshold": 1},
    {"name": "x", "kind": "log_group_count", "window_secs": 60, "group_by": "body; drop table logs"}, {"name": "x", "kind": "log_group_count", "window_secs": 60, "group_by": "attr:"},
    {"name": "x", "kind": "log_count", "window_secs": 60, "actions": [{"type": "webhook", "url": " "}]}, {"name": "x", "kind": "nope", "window_secs": 60},
])
def test_bad_rules_are_refused(bad):
    with pytest.raises(RuleError):
        validate(rule_of(bad))


def test_parse_defaults_and_texts():
    rules = parse_rules('{"rules": [{"name": "a", "kind": "log_count", "window_secs": 300, "threshold": 5, "severity_min": 17}, {"name": "b", "kind": "composite", "op": "any", "conditions": ['
                        '{"kind": "error_ratio", "window_secs": 60, "threshold": 0.5}, {"kind": "span_duration", "window_secs": 60, "threshold": 900, "service": "api"}]}]}')
    assert describe(rules[0]) == "count(logs service=*, severity>=17) > 5 over 300s"
    assert describe(rules[1]) == "ANY of [error_ratio(logs) > 0.5 over 60s OR p95(span.duration_ms service=api) > 900ms over 60s]"
    mine = with_defaults(rules[1], service="web", tenant="t")
    assert [(c.service, c.tenant) for c in mine.conditions] == [("web", "t"), ("api", "t")]
    assert describe(Rule("anomaly", "z", window_secs=60, threshold=3.0)) == "anomaly(count logs) z > 3 over 60s baseline 1800s"
    assert describe(Rule("log_new_signature", "n", window_secs=60, group_by="attr:code")) == "new signature(logs by attr:code, baseline 86400s) > 0 over 60s"
    assert describe(Rule("relative_change", "n", window_secs=60, threshold=2.0, source="events", event_name="open")) == "change(events event=open) > 2x vs previous 60s"


def test_quantiles_are_exact_at_any_size(spark):
    import random

    from signalfold.operators.quantiles import exact_quantiles

    rng = random.Random(8)
    values = [rng.choice([rng.gauss(0, 1), rng.lognormvariate(5, 4), 7.0, 7.0, -1e300, 1e300 * rng.random(), 0.0]) for _ in range(4000)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)] + [(None, -1)], "v double, i int")
    asked = {f"q{q}": (F.col("v"), q) for q in (0.0, 0.1, 0.5, 0.9, 0.95, 0.99, 1.0)} | {"half": (F.when(F.col("i") < 2001, F.col("v")), 0.5), "none": (F.when(F.col("i") > 9000, F.col("v")), 0.5)}
    for few in (10, 10_000):
        got = exact_quantiles(df, asked, few=few, passes=(passes := []))
        assert all(np.isclose(got[f"q{q}"], np.quantile(values, q), rtol=1e-12, atol=1e-300) for q in (0.0, 0.1, 0.5, 0.9, 0.95, 0.99, 1.0))
        assert np.isclose(got["half"], np.quantile(values[:2001], 0.5)) and got["none"] is None
        assert len(passes) <= 5
    odd = spark.createDataFrame([(float(x),) for x in ["inf", "-inf", "nan", "nan", 1, 2, 3]], "v double")
    got = exact_quantiles(odd, {str(q): (F.col("v"), q) for q in (0.0, 0.5, 1.0)}, few=2)
    assert got["0.0"] == float("-inf") and got["0.5"] == 3.0 and np.isnan(got["1.0"])


def test_channels():
    import json

    from signalfold.operators import channels
    from signalfold.operators.alert_state import Alert

    sent = []

    def post(url, headers, body):
        sent.append((url, dict(headers), json.loads(body)))
        return json.dumps({"ok": len(sent) < 3})

    alert = Alert("r", "critical", "firing", 2.5, 1.0, "count(logs) > 1 over 60s", "boom")
    assert channels.summary(alert) == "[FIRING] r (critical) [boom] — count(logs) > 1 over 60s (valeur=2.5000, seuil=1.0000)"
    assert channels.webhook({"type": "webhook", "url": "http://x", "headers": {"A": "b"}}, post)(alert)
    chat = channels.chat({"type": "slack"}, "t", "#ops", post)
    assert chat(alert) and not chat(alert)
    assert sent[0][2] == channels.payload(alert) and sent[0][1]["A"] == "b" and sent[1][2] == {"channel": "#ops", "text": channels.summary(alert)}
    mails = []
    assert channels.mail({"type": "email", "to": ["a@b.c"]}, "x@y.z", ["d@e.f"], mails.append)(alert) and mails[0]["To"] == "a@b.c" and "FIRING" in mails[0]["Subject"]


def test_images_sort_as_their_doubles(spark):
    import struct

    from signalfold.operators.quantiles import image, value

    rng = np.random.default_rng(4)
    bits = [struct.unpack("<d", struct.pack("<Q", int(x)))[0] for x in rng.integers(0, 1 << 64, 4000, dtype=np.uint64)]
    edges = [y for k in range(-1074, 1024) for x in [math.ldexp(1.0, k)] for y in (x, -x, math.nextafter(x, 0), math.nextafter(x, math.inf))]
    values = [x for x in [*bits, *edges, 0.0, -0.0, math.inf, -math.inf, 1.7976931348623157e308, 5e-324, -5e-324] if not math.isnan(x)]
    got = [r.x for r in spark.createDataFrame([(float(v),) for v in values], "v double").select(image(F.col("v")).alias("x")).collect()]
    assert [value(x) for x in got] == values
    assert spark.sql("select double('nan') as v").select(image(F.col("v")).alias("x")).first().x > max(got) and math.isnan(value(0x7FF8 << 48))


def test_quantiles_take_five_passes_at_most(spark):
    """Values spread over all magnitudes, and a tail of infinities and NaN."""
    from signalfold.operators.quantiles import exact_quantiles

    df = spark.range(20_000).select(F.pow(F.lit(10.0), (F.col("id") * 599 / 19_999) - 300).alias("v"), (F.col("id") % 2 == 0).alias("even"))
    asked = {str(q): (F.col("v"), q) for q in (0.0, 0.25, 0.5, 0.99, 1.0)} | {"even": (F.when(F.col("even"), F.col("v")), 0.5), "none": (F.lit(None).cast("double"), 0.5)}
    passes = []
    got = exact_quantiles(df, asked, few=0, passes=passes)
    values = np.sort([r.v for r in df.collect()])
    assert passes == ["count"] * 5 and got["none"] is None
    assert all(got[str(q)] == pytest.approx(float(np.quantile(values, q)), rel=1e-12) for q in (0.0, 0.25, 0.5, 0.99, 1.0))
    tail = spark.createDataFrame([(x,) for x in [-math.inf, -0.0, 0.0, 1.0, math.inf, math.nan, math.nan]], "v double")
    for few in (0, 2, 50):
        odd = exact_quantiles(tail, {str(k): (F.col("v"), k / 6) for k in range(7)}, few=few, passes=(passes := []))
        assert [odd[str(k)] for k in range(5)] == [-math.inf, 0.0, 0.0, 1.0, math.inf] and all(math.isnan(odd[str(k)]) for k in (5, 6)) and len(passes) <= 5


def test_ticker_evaluates_on_a_timer(spark, tmp_path):
    import time

    from signalfold.streaming.alerts import ticker

    def tables():
        row = spark.range(3).selectExpr("cast(id as string) as log_id", "cast(current_timestamp() as timestamp) - interval 5 seconds as log_time", "cast(17 as short) as severity_number", "cast(null as string) as severity_text",
                                        "'b' as body", "'svc' as service_name", "cast(null as string) as trace_id", "cast(null as string) as tenant_id", "'{}' as log_attributes")
        return {"logs": row}

    sent, out = [], []
    rule = Rule("log_count", "errors", severity_min=17, window_secs=600, threshold=2.0, severity="critical")
    q = ticker(spark, tables, [rule], {}, Sink([lambda a: sent.append(a) or True]), out, str(tmp_path / "c"), period=1)
    until = time.time() + 90
    while not out and time.time() < until:
        time.sleep(0.2)
    q.stop()
    assert [(a.rule_name, a.state, a.value) for a in out[:1]] == [("errors", "firing", 3.0)] and sent[:1] == out[:1]
