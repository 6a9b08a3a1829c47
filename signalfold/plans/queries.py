"""The registered queries over the driver's tables, each with SQL that the oracle runs on the same files."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalfold.functions import predicates as P
from signalfold.operators import baselines, correlate, evaluate, liveness, merge, reads
from signalfold.operators.rules import Rule
from signalfold.plans import gate
from signalfold.plans.fixtures import raw, raw_stream, view, views, with_views
from signalfold.session import scanned_rows, scratch_path
from signalfold.sources import cold, heartbeats, otlp
from signalfold.sources import events as event_source
from signalfold.sources.daytable import DayTable
from signalfold.sources.schemas import schema
from signalfold.streaming import admission

Query = Callable[[SparkSession, str], DataFrame]

#: What the rules of these queries look back from.
NOW = datetime(2024, 1, 30)
_W = "timestamp '2024-01-29 00:00:00' and timestamp '2024-01-30 00:00:00'"
DAY = 86_400

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(oracle: str, *over: str):
    """Register a query; its SQL may name the views in `over` as events_v, logs_v, spans_v and metrics_v."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = with_views(oracle, *over) if over else oracle
        return f

    return add


# -- reads ---------------------------------------------------------------------------------------------
_LOG = "log_time, severity_number, severity_text, body, service_name, trace_id, tenant_id, actor_id, session_id, log_attributes, log_id"
_EVENT = "event_id, event_name, tenant_id, actor_id, session_id, timestamp_client, properties"


@_query(f"select {_LOG} from logs_v where service_name = 'svc-1' and severity_number >= 13 order by log_time desc, log_id limit 100", "logs")
def search_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.search_logs(view(spark, sf_dir, "logs"), service="svc-1", severity_min=13)


@_query(f"""select {_LOG} from logs_v where body ilike '%ERR_r k=1%' and log_time >= timestamp '2024-01-05 00:00:00' and log_time <= timestamp '2024-01-25 12:00:00'
    order by log_time desc, log_id limit 50""", "logs")
def search_logs_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.search_logs(view(spark, sf_dir, "logs"), q="ERR_r k=1", start="2024-01-05T00:00:00Z", end="2024-01-25T12:00:00+00:00", limit=50)


@_query("select * from spans_v where trace_id = 'user-7/2024-01-10'", "spans")
def get_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.get_trace(view(spark, sf_dir, "spans"), "user-7/2024-01-10")


@_query(f"select {_EVENT} from events_v where event_name = 'purchase' and tenant_id = 'tenant-1' order by timestamp_client desc, event_id limit 200", "events")
def search_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.search_events(view(spark, sf_dir, "events"), name="purchase", tenant="tenant-1", limit=200)


@_query(f"""select {_EVENT} from events_v where timestamp_client >= timestamp '2024-01-10 00:00:00' and timestamp_client <= timestamp '2024-01-10 23:59:59'
    order by timestamp_client desc, event_id limit 1000""", "events")
def search_events_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.search_events(view(spark, sf_dir, "events"), start=datetime(2024, 1, 10), end=datetime(2024, 1, 10, 23, 59, 59), limit=5000)


@_query("""select time, metric_name, metric_type, value_double, cast(value_int as varchar) as value_int, service_name, tenant_id, point_id from metrics_v
    where metric_name = 'app.view.value' and service_name = 'svc-2' order by time desc, point_id limit 100""", "metrics")
def search_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.search_metrics(view(spark, sf_dir, "metrics"), name="app.view.value", service="svc-2").withColumn("value_int", F.col("value_int").cast("string"))


_JOURNEYS = """, paths as (select session_id, list(event_name order by timestamp_client, event_id) as p from events_v {where} group by session_id)
    select array_to_string(p, '>') as path, cast(len(p) as integer) as steps, count(*) as occurrences from paths group by p order by count(*) desc, p limit {n}"""


def _journeys(df: DataFrame) -> DataFrame:
    return df.select(F.array_join("path", ">").alias("path"), F.size("path").alias("steps"), "occurrences")


@_query("select * from (select 1)")
def frequent_journeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _journeys(reads.frequent_journeys(view(spark, sf_dir, "events")))


@_query("select * from (select 1)")
def frequent_journeys_by_tenant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _journeys(reads.frequent_journeys(view(spark, sf_dir, "events"), tenant="tenant-2", limit=200))


ORACLES["frequent_journeys"] = with_views("", "events").rstrip() + _JOURNEYS.format(where="", n=20)
ORACLES["frequent_journeys_by_tenant"] = with_views("", "events").rstrip() + _JOURNEYS.format(where="where tenant_id = 'tenant-2'", n=200)


# -- rules with one value ------------------------------------------------------------------------------
def _values(spark: SparkSession, sf_dir: str, *rules: Rule) -> DataFrame:
    return evaluate.values(views(spark, sf_dir), rules, NOW)


@_query(f"select 'errors' as rule, cast(count(*) as double) as value from logs_v where log_time between {_W} and severity_number >= 17", "logs")
def log_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir, Rule("log_count", "errors", severity_min=17, window_secs=DAY))


@_query(f"select 'signups' as rule, cast(count(*) as double) as value from events_v where timestamp_client between {_W} and event_name = 'signup'", "events")
def telemetry_count_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir, Rule("telemetry_count", "signups", source="events", event_name="signup", window_secs=DAY))


@_query(f"select 'silent' as rule, cast(count(*) as double) as value, count(*) <= 0 as breaching from metrics_v where time between {_W} and service_name = 'svc-9'", "metrics")
def heartbeat_no_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = Rule("telemetry_count", "silent", source="metrics", service="svc-9", window_secs=DAY, comparator="lte")
    return _values(spark, sf_dir, rule).withColumn("breaching", F.col("value") <= rule.threshold)


def _metric(agg: str) -> Rule:
    return Rule("metric_threshold", agg, metric_name="app.purchase.value", agg=agg, window_secs=DAY)


def _metric_sql(**aggs: str) -> str:
    return " union all ".join(
        f"select '{k}' as rule, cast(coalesce({v}, 0) as double) as value from (select *, coalesce(value_double, cast(value_int as double)) as v from metrics_v) as x "
        f"where metric_name = 'app.purchase.value' and time between {_W}" for k, v in aggs.items())


@_query(_metric_sql(avg="round(avg(v), 9)"), "metrics")
def metric_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir, _metric("avg")).withColumn("value", F.round("value", 9))


@_query(_metric_sql(min="min(v)", max="max(v)", sum="round(sum(v), 6)", count="count(v)"), "metrics")
def metric_min_max_sum_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir, *map(_metric, ("min", "max", "sum", "count"))).withColumn("value", F.when(F.col("rule") == "sum", F.round("value", 6)).otherwise(F.col("value")))


@_query(_metric_sql(p50="round(quantile_cont(v, 0.5), 9)", p90="round(quantile_cont(v, 0.9), 9)", p95="round(quantile_cont(v, 0.95), 9)", p99="round(quantile_cont(v, 0.99), 9)"), "metrics")
def metric_p50_p90_p95_p99(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir, *map(_metric, ("p50", "p90", "p95", "p99"))).withColumn("value", F.round("value", 9))


@_query(_metric_sql(last="arg_max(v, time)"), "metrics")
def metric_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir, _metric("last"))


def _ratio(view_: str, time: str, error: str, where: str = "true") -> str:
    return f"""select 'ratio' as rule, case when count(*) < 1 then 0.0e0 else cast(count(*) filter ({error}) as double) / count(*) end as value
        from {view_} where {time} between {_W} and {where}"""


@_query(_ratio("logs_v", "log_time", "severity_number >= 17"), "logs")
def error_ratio_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir, Rule("error_ratio", "ratio", window_secs=DAY))


@_query(_ratio("spans_v", "start_time", "status_code = 2", "service_name = 'svc-3'"), "spans")
def error_ratio_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir, Rule("error_ratio", "ratio", source="spans", service="svc-3", window_secs=DAY))


@_query(f"select 'slow' as rule, round(coalesce(quantile_cont(duration_ms, 0.95), 0), 9) as value from spans_v where start_time between {_W} and service_name = 'svc-0'", "spans")
def span_duration_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir, Rule("span_duration", "slow", service="svc-0", window_secs=DAY)).withColumn("value", F.round("value", 9))


@_query(f"select 'slow' as rule, coalesce(max(duration_ms), 0) as value from spans_v where start_time between {_W} and name = 'error' and status_code = 2", "spans")
def span_duration_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir, Rule("span_duration", "slow", operation="error", error_only=True, agg="max", window_secs=DAY))


@_query(f"""select 'change' as rule, cast(count(*) filter (timestamp_client between {_W}) as double)
        / greatest(count(*) filter (timestamp_client between timestamp '2024-01-28 00:00:00' and timestamp '2024-01-29 00:00:00'), 1) as value
    from events_v where event_name = 'click'""", "events")
def relative_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir, Rule("relative_change", "change", source="events", event_name="click", window_secs=DAY))


_ANOMALY = Rule("anomaly", "odd", source="logs", severity_min=17, window_secs=DAY, baseline_secs=28 * DAY)
_BUCKETS = """series as (select unnest(generate_series(timestamp '2024-01-02 00:00:00', timestamp '2024-01-28 00:00:00', interval 1 day)) as bucket),
    b as (select bucket, count(log_id) as n from series left join logs_v on log_time >= bucket and log_time < bucket + interval 1 day and severity_number >= 17 group by bucket)"""


@_query("select 1", "logs")
def bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.bucket_counts(view(spark, sf_dir, "logs"), _ANOMALY, NOW)


@_query("select 1", "logs")
def anomaly_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir, _ANOMALY).withColumn("value", F.round("value", 6))


ORACLES["bucket_counts"] = with_views("", "logs").rstrip() + ", " + _BUCKETS + " select bucket, n from b"
ORACLES["anomaly_zscore"] = with_views("", "logs").rstrip() + ", " + _BUCKETS + f""" select 'odd' as rule, round(((select count(*) from logs_v where log_time between {_W} and severity_number >= 17) - avg(n)) / stddev_pop(n), 6) as value from b"""


def _kept_logs(spark: SparkSession, sf_dir: str, tag: str) -> DayTable:
    """All logs merged in three batches, the oldest rows last, into a table that keeps counts and signatures."""
    root, v = scratch_path(spark, tag), view(spark, sf_dir, "logs")
    rows = v.withColumn("log_time", F.col("log_time").cast("timestamp")).withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema("logs") if f.name not in v.columns}).select(*schema("logs").names)
    for day in (datetime(2024, 1, 29), datetime(2024, 1, 15), datetime(1970, 1, 1)):
        end = {29: datetime(2200, 1, 1), 15: datetime(2024, 1, 29)}.get(day.day, datetime(2024, 1, 15))
        merge.merge(rows.where((F.col("log_time") >= F.lit(day)) & (F.col("log_time") < F.lit(end))), root, "logs", rollups=("counts", "signatures"))
    return DayTable(spark, root, "logs", rollups=("counts", "signatures"))


@_query("select 1", "logs")
def kept_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The anomaly and the new signatures of a day against four weeks, from counts that merges kept up."""
    store = _kept_logs(spark, sf_dir, "baselines")
    odd = baselines.anomaly(store, _ANOMALY, NOW).select(F.lit("anomaly").alias("group_key"), F.round("value", 6).alias("value"))
    return odd.unionByName(baselines.new_groups(store, _NEW, NOW).select("group_key", F.col("n").cast("double").alias("value")))


_CONDITIONS = (Rule("error_ratio", window_secs=DAY, threshold=0.1), Rule("span_duration", window_secs=DAY, threshold=10_000.0, agg="max"), Rule("telemetry_count", source="events", window_secs=DAY, threshold=5.0))


def _composite_sql(op: str) -> str:
    return f"""select cast(m as double) as value, m >= {3 if op == 'all' else 1} as breaching from (select
        (select cast(case when count(*) filter (severity_number >= 17) * 1.0 / greatest(count(*), 1) > 0.1 then 1 else 0 end as integer) from logs_v where log_time between {_W})
        + (select cast(case when coalesce(max(duration_ms), 0) > 10000 then 1 else 0 end as integer) from spans_v where start_time between {_W})
        + (select cast(case when count(*) > 5 then 1 else 0 end as integer) from events_v where timestamp_client between {_W}) as m) as x"""


@_query(_composite_sql("all"), "logs", "spans", "events")
def composite_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.composite(views(spark, sf_dir), Rule("composite", "both", op="all", conditions=_CONDITIONS), NOW)


@_query(_composite_sql("any"), "logs", "spans", "events")
def composite_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.composite(views(spark, sf_dir), Rule("composite", "either", op="any", conditions=_CONDITIONS), NOW)


# -- rules by group ------------------------------------------------------------------------------------
@_query(f"select body as group_key, count(*) as n from logs_v where log_time between {_W} and severity_number >= 13 and body is not null group by body", "logs")
def log_group_count_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.group_counts(view(spark, sf_dir, "logs"), Rule("log_group_count", "g", severity_min=13, window_secs=DAY), NOW)


@_query(f"select json_extract_string(log_attributes, '$.k') as group_key, count(*) as n from logs_v where log_time between {_W} group by 1", "logs")
def log_group_count_attr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.group_counts(view(spark, sf_dir, "logs"), Rule("log_group_count", "g", group_by="attr:k", window_secs=DAY), NOW)


_NEW = Rule("log_new_signature", "new", window_secs=DAY, baseline_secs=28 * DAY)
_KNOWN = "select {what} from logs_v where log_time >= timestamp '2024-01-02 00:00:00' and log_time < timestamp '2024-01-29 00:00:00' {more}"


@_query(f"""select body as group_key, count(*) as n from logs_v where log_time between {_W} and body is not null
    and body not in ({_KNOWN.format(what='body', more='and body is not null')}) group by body""", "logs")
def log_new_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.new_groups(view(spark, sf_dir, "logs"), _NEW, NOW)


@_query(f"select body as group_key, count(*) as n from logs_v where log_time between {_W} group by body having body not in ({_KNOWN.format(what='body', more='')})", "logs")
def log_new_signature_sql_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.new_groups(view(spark, sf_dir, "logs"), _NEW, NOW, sql_null_semantics=True)


ORACLES["kept_baselines"] = with_views("", "logs").rstrip() + ", " + _BUCKETS + f""" select 'anomaly' as group_key, round(((select count(*) from logs_v where log_time between {_W} and severity_number >= 17) - avg(n)) / stddev_pop(n), 6) as value from b
    union all select body, cast(count(*) as double) from logs_v where log_time between {_W} and body is not null and body not in ({_KNOWN.format(what='body', more='and body is not null')}) group by body"""


# -- joins ---------------------------------------------------------------------------------------------
@_query("""select e.session_id, e.event_id, e.event_name, e.timestamp_client, l.log_id, l.log_time, cast(l.severity_number as varchar) as severity_number, l.body
    from events_v as e join logs_v as l on e.session_id = l.session_id""", "events", "logs")
def events_logs_by_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir, "events", "logs")
    return correlate.events_with_logs(v["events"], v["logs"]).withColumn("severity_number", F.col("severity_number").cast("string"))


@_query("""select e.session_id, e.event_id, e.event_name, l.log_id, cast(l.severity_number as varchar) as severity_number from events_v as e join logs_v as l on e.session_id = l.session_id""", "events", "logs")
def events_logs_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same join over tables bucketed by session, which do not move; sessions with 20 events or more are split."""
    out, v = scratch_path(spark, "bucketed"), views(spark, sf_dir, "events", "logs")
    tag = out.rpartition("-")[2]
    left = correlate.write_bucketed(v["events"].select("session_id", "event_id", "event_name"), f"events_{tag}", "session_id", f"{out}/events", 8)
    right = correlate.write_bucketed(v["logs"].select("session_id", "log_id", "severity_number"), f"logs_{tag}", "session_id", f"{out}/logs", 8)
    return correlate.join_bucketed(left, right, "session_id", least=20).withColumn("severity_number", F.col("severity_number").cast("string"))


@_query("select s.trace_id, s.span_id, s.name, s.duration_ms, l.log_id, cast(l.severity_number as varchar) as severity_number, l.body from spans_v as s join logs_v as l on s.trace_id = l.trace_id", "spans", "logs")
def spans_logs_by_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir, "spans", "logs")
    return correlate.spans_with_logs(v["spans"], v["logs"]).withColumn("severity_number", F.col("severity_number").cast("string"))


@_query("select * from events_v where session_id in (select distinct session_id from logs_v where severity_number >= 17)", "events", "logs")
def sessions_with_errors_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir, "events", "logs")
    return correlate.events_of_failing_sessions(v["events"], v["logs"])


# -- cold SQL through the gate -------------------------------------------------------------------------
def _gated(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    for n, df in views(spark, sf_dir, "events", "logs").items():
        df.createOrReplaceTempView(f"{n}_v")
    return gate.execute(spark, sql, {"events_v", "logs_v"})


def _cold(name: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _gated(spark, sf_dir, sql)

    run.__name__ = name
    QUERIES[name], ORACLES[name] = run, with_views(sql, "events", "logs")


_cold("event_frequency", "select event_name, count(*) as n from events_v group by event_name order by n desc, event_name limit 20")
_cold("actor_activity", "select actor_id, count(*) as n, count(distinct session_id) as sessions from events_v group by actor_id order by n desc, actor_id limit 50")
_cold("session_sequence", "select event_id, event_name, timestamp_client from events_v where session_id = 'user-7/2024-01-10' order by timestamp_client, event_id")
_cold("events_by_hour", "select date_trunc('hour', timestamp_client) as hour, event_name, count(*) as n from events_v group by 1, 2")
_cold("severity_breakdown", "select service_name, severity_text, count(*) as n, count(body) as bodies from logs_v group by service_name, severity_text")
_cold("failing_actors", "select distinct actor_id from events_v where session_id in (select session_id from logs_v where severity_number >= 17)")
_cold("ranked_services", """select service_name, n, rank() over (order by n desc) as place from (select service_name, count(*) as n from logs_v where severity_number >= 17 group by service_name) as x""")
_cold("tenant_rollup", "select tenant_id, event_name, count(*) as n from events_v group by rollup (tenant_id, event_name)")


@_query("""select session_id, min(timestamp_client) as started, max(timestamp_client) as ended, count(*) as n,
    cast(epoch_us(max(timestamp_client)) - epoch_us(min(timestamp_client)) as double) / 1e6 as seconds from events_v group by session_id""", "events")
def session_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir, """select session_id, min(timestamp_client) as started, max(timestamp_client) as ended, count(*) as n,
        cast(unix_micros(cast(max(timestamp_client) as timestamp)) - unix_micros(cast(min(timestamp_client) as timestamp)) as double) / 1e6D as seconds from events_v group by session_id""")


# -- lifecycle -----------------------------------------------------------------------------------------
_LINE = "l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice"


@_query(f"""select {_LINE} from (select *, row_number() over (partition by l_orderkey, l_linenumber
    order by l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity) as n from lineitem) as x where n = 1""")
def dedup_first_received(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw(spark, sf_dir, "lineitem").select(*_LINE.split(", "))
    return merge.first_received(rows, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"])


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as rows of the stored table."""
    events = view(spark, sf_dir, "events")
    rows = events.withColumns({c: F.col(c).cast("timestamp") for c in ("timestamp_client", "received_at")})
    return rows.select(*schema("events").names)


@_query("select event_id, event_name from events_v where event_id not in (select event_id from events_v where event_name = 'view')", "events")
def merge_insert_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, sent twice, against a store that holds the views."""
    events = view(spark, sf_dir, "events")
    fresh = merge.dedup_batch(events.unionByName(events), "events")
    return merge.new_rows(fresh, events.where("event_name = 'view'"), ["timestamp_client", "event_id"]).select("event_id", "event_name")


@_query("""select 1 as step, count(*) as inserted, count(*) as stored from events_v where event_name = 'view'
    union all select 2, count(*) filter (event_name <> 'view'), count(*) from events_v union all select 3, 0, count(*) from events_v""", "events")
def merge_into_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The views, then all events twice over, then all again are merged into day folders."""
    root, rows, steps = scratch_path(spark, "merge"), _stored(spark, sf_dir), []
    for step, batch in enumerate((rows.where("event_name = 'view'"), rows.unionByName(rows), rows), 1):
        n = merge.merge(batch, root, "events")
        steps.append((step, n, DayTable(spark, root, "events").read().count()))
    return spark.createDataFrame(steps, "step int, inserted long, stored long")


_PER_DAY = "select cast(cast(timestamp_client as date) as varchar) as day, count(*) as n, count(distinct event_id) as ids from events_v {where} group by cast(timestamp_client as date)"


def _days(df: DataFrame) -> DataFrame:
    return df.groupBy(F.col("date").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))


@_query(_PER_DAY.format(where="where cast(timestamp_client as date) >= date '2024-01-10'"), "events")
def retention_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All days are written; then a retention of 20 days drops folders on 2024-01-30."""
    root = scratch_path(spark, "retention")
    cold.write_days(_stored(spark, sf_dir), root, "events", mode="overwrite")
    cold.purge(spark, cold.table_path(root, "events"), NOW.date(), 20)
    return _days(cold.scan(spark, root, "events"))


@_query("""select event_id, event_name, session_id from events_v where session_id = (select min(session_id) from events_v where event_name = 'purchase')
    union all select 'row groups', case when count(*) > 0 then 'few' end, null from events_v""", "events")
def session_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session of the clustered day table, looked up by its id alone; a last row says whether the scan took up to a tenth of
    the rows or a few row groups of each file it opened, by its own metrics."""
    store = DayTable(spark, scratch_path(spark, "lookup"), "events", row_group_rows=2_000)
    rows = _stored(spark, sf_dir)
    store.append(rows)
    wanted = rows.where("event_name = 'purchase'").agg(F.min("session_id")).first()[0]
    found = store.read().where(F.col("session_id") == wanted).select("event_id", "event_name", "session_id")
    scanned, files = scanned_rows(found)
    few = scanned <= max(store.read().count() // 10, 4_000 * files)
    return found.unionByName(spark.range(1).select(F.lit("row groups").alias("event_id"), F.lit("few" if few else "many").alias("event_name"), F.lit(None).cast("string").alias("session_id")))


@_query(_PER_DAY.format(where="where cast(timestamp_client as date) in (date '2024-01-05', date '2024-01-28', date '2024-01-29')"), "events")
def scheduled_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run on 2024-01-30, to which a late batch adds 2024-01-05; it is repeated, which changes nothing."""
    root, tables = scratch_path(spark, "export"), {"events": _stored(spark, sf_dir)}
    for _ in range(2):
        cold.export_due(tables, root, NOW.date(), late=[datetime(2024, 1, 5).date()])
    return _days(cold.scan(spark, root, "events"))


@_query(_PER_DAY.format(where="where timestamp_client >= timestamp '2024-01-01' and timestamp_client < timestamp '2024-02-01'"), "events")
def cold_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month of the cold table by its prefix, of which other partitions are not read."""
    root = scratch_path(spark, "cold")
    cold.write_days(_stored(spark, sf_dir), root, "events", mode="overwrite")
    return _days(cold.scan(spark, root, "events", "2024-01"))


@_query("""select event_name, count(*) as n from events_v where timestamp_client >= timestamp '2024-01-15 00:00:00' and timestamp_client < timestamp '2024-01-16 00:00:00' group by event_name""", "events")
def day_export_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = cold.export_day(_stored(spark, sf_dir), scratch_path(spark, "day"), "events", datetime(2024, 1, 15).date())
    return spark.read.schema(schema("events")).parquet(folder).groupBy("event_name").agg(F.count(F.lit(1)).alias("n"))


_RECEIVED = "timestamp '2024-01-20 12:00:00'"


@_query(f"""select count(*) filter (ok) as received, count(*) filter (not ok) as dropped_skew from
    (select timestamp_client between {_RECEIVED} - interval 10 day and {_RECEIVED} + interval 24 hour as ok from events_v) as x""", "events")
def skew_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = view(spark, sf_dir, "events").withColumn("received_at", F.expr("timestamp_ntz '2024-01-20 12:00:00'"))
    ok = P.within_skew("timestamp_client", past="10 days")
    return events.agg(F.count_if(ok).alias("received"), F.count_if(~ok).alias("dropped_skew"))


@_query("""select count(*) as received, count(distinct (l_orderkey, l_linenumber)) as inserted, count(*) - count(distinct (l_orderkey, l_linenumber)) as deduplicated from lineitem""")
def ingest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw(spark, sf_dir, "lineitem").select(*_LINE.split(", "))
    found = reads.ingest_stats(rows.count(), merge.first_received(rows, ["l_orderkey", "l_linenumber"], ["l_shipdate"]).count())
    return spark.range(1).select(*(F.lit(found[k]).cast("long").alias(k) for k in ("received", "inserted", "deduplicated")))


@_query("""select e.id, e.timeout_secs, h.last_seen, (epoch_us(timestamp '2024-01-30 00:00:00') - epoch_us(h.last_seen)) / 1e6 as silent_secs,
        coalesce((epoch_us(timestamp '2024-01-30 00:00:00') - epoch_us(h.last_seen)) / 1e6 > e.timeout_secs, true) as down
    from (select distinct concat('user-', cast(user_id as varchar)) as id, cast(43200 as bigint) as timeout_secs from events
          union all select 'user-none', cast(43200 as bigint)) as e
    left join (select actor_id as id, max(timestamp_client) as last_seen from events_v where timestamp_client <= timestamp '2024-01-30 00:00:00' group by actor_id) as h on e.id = h.id""", "events")
def companion_liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = view(spark, sf_dir, "events")
    beats = events.where(F.col("timestamp_client") <= P.instant(events, "timestamp_client", NOW)).select(F.col("actor_id").alias("id"), F.col("timestamp_client").alias("ts"))
    expected = raw(spark, sf_dir, "events").select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("id")).distinct()
    expected = expected.unionByName(spark.range(1).select(F.lit("user-none").alias("id"))).withColumn("timeout_secs", F.lit(43_200).cast("bigint"))
    return liveness.liveness(beats, expected, NOW).select("id", "timeout_secs", "last_seen", "silent_secs", "down")


@_query(""", t as (select k, timestamp '2024-01-02 00:00:00' + k * interval 6 hour as due from (select unnest(range(0, 113)) as k) as x),
    i as (select distinct concat('user-', cast(user_id as varchar)) as id from events union all select 'user-none'),
    heard as (select i.id, t.k, t.due, max(e.timestamp_client) as seen from i cross join t left join events_v as e on e.actor_id = i.id and e.timestamp_client <= t.due group by i.id, t.k, t.due),
    d as (select *, epoch_us(due) - epoch_us(seen) as silent from heard),
    c as (select *, coalesce(silent > 43200000000, true) as down, lag(coalesce(silent > 43200000000, true), 1, false) over (partition by id order by k) as was from d)
    select id, epoch_us(due) as "at", case when down then 'firing' else 'resolved' end as state, cast(coalesce(silent // 1000000, 0) as double) as value, cast(43200 as double) as threshold,
           concat('companion ', chr(39), id, chr(39), case when seen is null then ' never seen' else concat(' silent for ', cast(silent // 1000000 as varchar), 's (timeout 43200s)') end) as description
    from c where was <> down""", "events")
def liveness_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user is expected to be heard of twice a day; what evaluations every six hours report in four weeks."""
    beats = view(spark, sf_dir, "events").select(F.col("actor_id").alias("id"), F.col("timestamp_client").alias("ts"))
    expected = raw(spark, sf_dir, "events").select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("id")).distinct()
    expected = expected.unionByName(spark.range(1).select(F.lit("user-none").alias("id"))).withColumn("timeout_secs", F.lit(43_200).cast("bigint"))
    return liveness.transitions(beats, expected, datetime(2024, 1, 2), 113, 21_600).withColumn("at", F.unix_micros("at"))


@_query("""select id, ts, ok, failures, change from (select *, case when failures = 3 then 'firing'
        when ok and lag(failures, 1, 0) over (partition by id order by ts, ok) >= 3 then 'resolved' end as change
    from (select *, cast(sum(case when ok then 0 else 1 end) over (partition by id, run order by ts, ok rows unbounded preceding) as bigint) as failures
    from (select *, sum(case when ok then 1 else 0 end) over (partition by id order by ts, ok rows unbounded preceding) as run
    from (select cast(user_id as varchar) as id, ts, event_type <> 'error' as ok from events) as a) as b) as c) as d""")
def consecutive_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = raw(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("id"), "ts", (F.col("event_type") != "error").alias("ok"))
    return liveness.failure_runs(probes)


_IP = "case when user_id % 50 = 0 then '0.0.0.0' else concat('10.0.0.', cast(user_id % 50 as {text})) end"


@_query(f"""with r as (select cast(event_id as varchar) as request, {_IP.format(text="varchar")} as ip, concat(cast(user_id as varchar), '/', cast(cast(ts as date) as varchar)) as session, event_type = 'error' as bad, ts from events),
    b as (select *, ip <> '0.0.0.0' and coalesce(sum(cast(bad as integer)) over (partition by ip order by ts, request rows between unbounded preceding and 1 preceding), 0) >= 40 as banned from r),
    s as (select *, row_number() over (partition by session order by ts, request) as k from b where not banned and not bad),
    f as (select ip, session, row_number() over (partition by ip order by min(ts), min(request) filter (k = 1)) as place from s where k = 1 group by ip, session)
    select b.request, case when b.banned then 'ban' when b.bad then 'bad' when s.k > 1 then 'session' when f.place > 9 and b.ip <> '0.0.0.0' then 'address' end as refused
    from b left join s on s.request = b.request left join f on f.ip = b.ip and f.session = b.session""")
def admission_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is a request of its user's address and of the user's day as its session, errors are malformed ones; all pass the chain
    of limits as a stream. Buckets do not refill and bans do not end, so that SQL can say who is refused."""
    forever, out = 1e12, scratch_path(spark, "admission")
    source = raw_stream(spark, sf_dir, "events")
    asked = source.selectExpr(
        "cast(event_id as string) as request", f"{_IP.format(text='string')} as ip", "concat(cast(user_id as string), '/', cast(cast(ts as date) as string)) as session", "cast(1 as double) as cost",
        "event_type = 'error' as bad", "cast(ts as timestamp) as at")
    settings = admission.Limits(session={"rate": 0.0, "burst": 1.0}, address={"cap": 9, "window": forever}, bans={"threshold": 40, "window": forever, "ban": forever}, buckets=8, delay="3650 days")
    stream = admission.decided(asked, settings).select("request", "refused").writeStream.format("parquet").option("path", f"{out}/decided").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.schema("request string, refused string").parquet(f"{out}/decided")


# -- flattening of wire documents built from the events table -------------------------------------------
_NS = "cast(unix_micros(cast(ts as timestamp)) * 1000 as string)"
_SERVICE = """'"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"svc-', cast(user_id % 5 as string), '"}}]}'"""
_OWN = """'"attributes":[{"key":"user.id","value":{"stringValue":"user-', cast(user_id as string), '"}},{"key":"n","value":{"intValue":"', cast(event_id as string), '"}}]'"""


def _documents(spark: SparkSession, sf_dir: str, *parts: str) -> DataFrame:
    """One request for each event; it arrives ten seconds after the event."""
    return raw(spark, sf_dir, "events").selectExpr(f"concat({', '.join(parts)}) as value", "cast(ts as timestamp) + interval 10 seconds as received_at")


def _micros(c: str, name: str):
    return F.unix_micros(c).alias(name)


@_query("""select epoch_us(ts) as at, concat('svc-', cast(user_id % 5 as varchar)) as service_name, concat('user-', cast(user_id as varchar)) as actor_id,
    case when event_type = 'error' then 24 else 9 end as severity, event_type as body, concat('{"n":', cast(event_id as varchar), ',"user.id":"user-', cast(user_id as varchar), '"}') as log_attributes from events""")
def flatten_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(
        spark, sf_dir, "'{\"resourceLogs\":[{'", _SERVICE, "',\"scopeLogs\":[{\"logRecords\":[{\"timeUnixNano\":\"'", _NS, "'\",\"severityNumber\":'", "if(event_type = 'error', '99', '9')",
        "',\"body\":{\"stringValue\":\"'", "event_type", "'\"},'", _OWN, "'}]}]}]}'")
    rows, _ = otlp.accept(otlp.flatten_logs(docs), "logs")
    return rows.select(_micros("log_time", "at"), "service_name", "actor_id", F.col("severity_number").cast("int").alias("severity"), "body", "log_attributes")


@_query("""select epoch_us(ts) as at, 2.5e0 as duration_ms, cast(user_id as varchar) as trace_id, cast(event_id as varchar) as span_id, event_type as name, case when event_type = 'error' then 2 else 1 end as status,
    concat('user-', cast(user_id as varchar)) as actor_id from events where event_type <> 'view'""")
def flatten_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views have no span id and are left out."""
    docs = _documents(
        spark, sf_dir, "'{\"resourceSpans\":[{'", _SERVICE, "',\"scopeSpans\":[{\"spans\":[{\"traceId\":\"'", "cast(user_id as string)", "'\",\"spanId\":\"'", "if(event_type = 'view', '', cast(event_id as string))",
        "'\",\"name\":\"'", "event_type", "'\",\"startTimeUnixNano\":\"'", _NS, "'\",\"endTimeUnixNano\":'", "cast(unix_micros(cast(ts as timestamp)) * 1000 + 2500000 as string)",
        "',\"status\":{\"code\":'", "if(event_type = 'error', '7', '1')", "'},'", _OWN, "'}]}]}]}'")
    rows = otlp.flatten_spans(docs)
    return rows.select(_micros("start_time", "at"), "duration_ms", "trace_id", "span_id", "name", F.col("status_code").cast("int").alias("status"), "actor_id")


@_query("""select epoch_us(ts) as at, concat('app.', event_type) as metric_name, 'gauge' as metric_type, value as value_double, concat('svc-', cast(user_id % 5 as varchar)) as service_name from events""")
def flatten_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(
        spark, sf_dir, "'{\"resourceMetrics\":[{'", _SERVICE, "',\"scopeMetrics\":[{\"metrics\":[{\"name\":\"app.'", "event_type", "'\",\"gauge\":{\"dataPoints\":[{\"timeUnixNano\":\"'", _NS,
        "'\",\"asDouble\":'", "cast(value as string)", "'}]}}]}]}]}'")
    return otlp.flatten_metrics(docs).select(_micros("time", "at"), "metric_name", "metric_type", "value_double", "service_name")


@_query("""select case when user_id % 7 = 0 then 'invalid' else 'ok' end as outcome, count(*) as batches from events group by 1""")
def event_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch for each event; those of every seventh user have a blank actor and are refused."""
    at = "date_format(cast(ts as timestamp), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")"
    docs = _documents(
        spark, sf_dir, "'{\"events\":[{\"event_id\":\"00000000-0000-0000-0000-'", "lpad(cast(event_id as string), 12, '0')", "'\",\"event_name\":\"'", "event_type", "'\",\"session_id\":\"s\",\"actor_id\":\"'",
        "if(user_id % 7 = 0, ' ', cast(user_id as string))", "'\",\"timestamp_client\":\"'", at, "'\",\"properties\":'", "props", "'}]}'")
    _, verdicts = event_source.read_batches(docs)
    return verdicts.groupBy("outcome").agg(F.count(F.lit(1)).alias("batches"))


_POINT = ("'{\"resourceMetrics\":[{'", _SERVICE, "',\"scopeMetrics\":[{\"metrics\":[{\"name\":\"app.'", "event_type", "'\",\"unit\":\"1\",'")


@_query("""select epoch_us(ts) as at, concat('app.', event_type) as metric_name, 'sum' as metric_type, event_id as value_int, concat('user-', cast(user_id as varchar)) as actor_id from events""")
def flatten_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers that come as text."""
    docs = _documents(spark, sf_dir, *_POINT, "'\"sum\":{\"dataPoints\":[{\"timeUnixNano\":'", _NS, "',\"asInt\":\"'", "cast(event_id as string)", "'\",'", _OWN, "'}]}}]}]}]}'")
    return otlp.flatten_metrics(docs).select(_micros("time", "at"), "metric_name", "metric_type", "value_int", "actor_id")


@_query("""select epoch_us(ts) as at, 'histogram' as metric_type, event_id as n, value as total, concat('{"bounds":[1.5,10.0],"counts":[', cast(event_id as varchar), ',2,0]}') as buckets from events""")
def flatten_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(
        spark, sf_dir, *_POINT, "'\"histogram\":{\"dataPoints\":[{\"timeUnixNano\":\"'", _NS, "'\",\"count\":\"'", "cast(event_id as string)", "'\",\"sum\":'", "cast(value as string)",
        "',\"explicitBounds\":[1.5,10.0],\"bucketCounts\":[\"'", "cast(event_id as string)", "'\",2,\"0\"]}]}}]}]}]}'")
    return otlp.flatten_metrics(docs).select(_micros("time", "at"), "metric_type", F.col("count").alias("n"), F.col("sum").alias("total"), "buckets")


@_query("""select epoch_us(ts) + case when event_type = 'error' then 10000000 else 0 end as at,
    concat('{"kind":"', event_type, '","n":[', cast(event_id as varchar), ',true,null]}') as body from events""")
def flatten_log_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured bodies; a log without a time of its own has the observed one, and without both its arrival."""
    docs = _documents(
        spark, sf_dir, "'{\"resourceLogs\":[{\"scopeLogs\":[{\"logRecords\":[{'",
        "case event_type when 'error' then '\"timeUnixNano\":0,' when 'click' then concat('\"observedTimeUnixNano\":\"', " + _NS + ", '\",') else concat('\"timeUnixNano\":', " + _NS + ", ',') end",
        "'\"body\":{\"kvlistValue\":{\"values\":[{\"key\":\"kind\",\"value\":{\"stringValue\":\"'", "event_type",
        "'\"}},{\"key\":\"n\",\"value\":{\"arrayValue\":{\"values\":[{\"intValue\":\"'", "cast(event_id as string)", "'\"},{\"boolValue\":true},{}]}}}]}}}]}]}]}'")
    return otlp.flatten_logs(docs).select(_micros("log_time", "at"), "body")


@_query("""select cast(event_id as varchar) as span_id, concat('[{"attributes":{"n":', cast(event_id as varchar), '},"name":"hit","time":null}]') as events,
    concat('[{"attributes":{},"span_id":"', cast(user_id as varchar), '","trace_id":"t"}]') as links from events""")
def flatten_span_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and links of spans, whose attributes are objects."""
    docs = _documents(
        spark, sf_dir, "'{\"resourceSpans\":[{\"scopeSpans\":[{\"spans\":[{\"traceId\":\"t\",\"spanId\":\"'", "cast(event_id as string)",
        "'\",\"events\":[{\"name\":\"hit\",\"attributes\":[{\"key\":\"n\",\"value\":{\"intValue\":'", "cast(event_id as string)", "'}}]}],\"links\":[{\"traceId\":\"t\",\"spanId\":\"'", "cast(user_id as string)", "'\"}]}]}]}]}'")
    return otlp.flatten_spans(docs).select("span_id", "events", "links")


@_query("select count(*) filter (event_type = 'view') as dropped_invalid from events")
def span_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "'{\"resourceSpans\":[{\"scopeSpans\":[{\"spans\":[{\"traceId\":\"'", "cast(user_id as string)", "'\",\"spanId\":\"'", "if(event_type = 'view', '', cast(event_id as string))", "'\"}]}]}]}'")
    return otlp.invalid_spans(docs)


@_query("""select case event_type when 'error' then 'invalid' when 'signup' then 'too_many' else 'ok' end as outcome, count(*) as requests,
    cast(sum(case event_type when 'signup' then 3 when 'error' then 0 else 1 end) as bigint) as records from events group by 1""")
def ingest_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with one log, with three where two are allowed, and with numbers where the protocol has none."""
    one = "concat('{\"timeUnixNano\":\"', " + _NS + ", '\"}')"
    docs = _documents(
        spark, sf_dir, "'{\"resourceLogs\":[{\"scopeLogs\":[{\"logRecords\":['",
        f"case event_type when 'error' then '{{\"body\":{{\"doubleValue\":\"abc\"}},\"timeUnixNano\":9}}' when 'signup' then concat({one}, ',', {one}, ',', {one}) else {one} end", "']}]}]}'")
    return otlp.admit(docs, "logs", most=2).groupBy("outcome").agg(F.count(F.lit(1)).alias("requests"), F.sum("n_records").cast("long").alias("records"))


@_query("select count(*) filter (timestamp_client is not null) as received, count(*) filter (event_name = 'error') as dropped_oversized from events_v", "events")
def oversized_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of errors have a body beyond the bound of a record."""
    docs = _documents(spark, sf_dir, "'{\"resourceLogs\":[{\"scopeLogs\":[{\"logRecords\":[{\"timeUnixNano\":'", _NS, "',\"body\":{\"stringValue\":\"'", "if(event_type = 'error', repeat('x', 70000), 'x')", "'\"}}]}]}]}'")
    _, counts = otlp.accept(otlp.flatten_logs(docs), "logs")
    return counts.select("received", "dropped_oversized")


@_query("select concat('user-', cast(user_id as varchar)) as id, epoch_us(max(ts)) + 10000000 as last_seen from events where event_type <> 'view' group by user_id")
def heartbeat_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One heartbeat for each event; those of views have a blank id and are refused."""
    docs = _documents(spark, sf_dir, "'{\"id\":\" '", "if(event_type = 'view', '', concat('user-', cast(user_id as string)))", "' \"}'")
    beats, _ = heartbeats.read_heartbeats(docs)
    return liveness.registry(beats).select("id", _micros("last_seen", "last_seen"))


@_query("select count(*) as n, count(distinct event_type) as ids from events")
def log_content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of equal content have one id: of those at one instant, one for each type of event."""
    docs = _documents(spark, sf_dir, "'{\"resourceLogs\":[{\"scopeLogs\":[{\"logRecords\":[{\"timeUnixNano\":1700000000000000000,\"body\":{\"stringValue\":\"'", "event_type", "'\"}}]}]}]}'")
    return otlp.flatten_logs(docs).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("log_id").alias("ids"))
