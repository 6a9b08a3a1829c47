"""The driver's events table seen as the engine's four tables; the same SQL runs on Spark and on the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SVC = "concat('svc-', cast(user_id % 5 as string))"
_TENANT = "concat('tenant-', cast(user_id % 3 as string))"
_USER = "concat('user-', cast(user_id as string))"
_SESSION = "concat('user-', cast(user_id as string), '/', cast(cast(ts as date) as string))"

SQL = {
    "events": f"""select cast(event_id as string) as event_id, event_type as event_name, {_TENANT} as tenant_id, {_USER} as actor_id, {_SESSION} as session_id,
        ts as timestamp_client, ts as received_at, props as properties from events""",
    "logs": f"""select cast(event_id as string) as log_id, ts as log_time,
        cast(case event_type when 'error' then 17 when 'purchase' then 13 when 'signup' then 9 when 'view' then 5 else null end as smallint) as severity_number,
        case event_type when 'error' then 'ERROR' when 'purchase' then 'WARN' when 'signup' then 'INFO' when 'view' then 'DEBUG' else null end as severity_text,
        case when event_id % 50 = 0 then null else concat(event_type, ' k=', regexp_extract(props, '([0-9]+)', 1), ' ', {_SVC}) end as body,
        {_SVC} as service_name, {_SESSION} as trace_id, {_TENANT} as tenant_id, {_USER} as actor_id, {_SESSION} as session_id, props as log_attributes from events""",
    "spans": f"""select {_SESSION} as trace_id, cast(event_id as string) as span_id,
        lag(cast(event_id as string)) over (partition by user_id, cast(ts as date) order by ts, event_id) as parent_span_id, ts as start_time,
        case when event_id % 97 = 0 then null else value end as duration_ms, event_type as name, {_SVC} as service_name,
        cast(case when event_type = 'error' then 2 else 1 end as smallint) as status_code, {_TENANT} as tenant_id from events""",
    "metrics": f"""select cast(event_id as string) as point_id, ts as time, concat('app.', event_type, '.value') as metric_name,
        case when event_id % 2 = 0 then 'gauge' else 'sum' end as metric_type, case when event_id % 2 = 0 then value end as value_double,
        case when event_id % 2 = 1 then cast(floor(value) as bigint) end as value_int, {_SVC} as service_name, {_TENANT} as tenant_id from events""",
}


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream of its files, whether it is one file or a folder of them."""
    path = f"{sf_dir}/{name}.parquet"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    reader = spark.readStream.schema(raw(spark, sf_dir, name).schema)
    return reader.parquet(path) if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(SQL[name].replace("from events", "from {src}"), src=raw(spark, sf_dir, "events"))


def views(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: view(spark, sf_dir, n) for n in names or SQL}


def with_views(sql: str, *names: str) -> str:
    """Oracle SQL over the views, named events_v and so on."""
    return "with " + ", ".join(f"{n}_v as ({SQL[n]})" for n in names) + " " + sql
