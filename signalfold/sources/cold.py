"""Day-partitioned Parquet: scans, registration, export, retention."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from signalfold.functions.predicates import on_day
from signalfold.sources.schemas import KEYS, schema

RETENTION_DAYS = 90
#: Tables that the cold area holds; the others can be opened by asking for them.
COLD_TABLES = ("events", "logs")


def valid_prefix(prefix: str) -> str:
    """A relative path without backslashes, parent steps or control characters, without its last slash."""
    if prefix.startswith("/") or "\\" in prefix or ".." in prefix or re.search(r"[\x00-\x1f\x7f]", prefix):
        raise ValueError(f"unsafe prefix {prefix!r}")
    return prefix.rstrip("/")


def table_path(root: str, table: str, prefix: str = "") -> str:
    p = valid_prefix(prefix)
    return "/".join([root.rstrip("/"), *([p] if p else []), table])


def object_store(spark: SparkSession, endpoint: str, region: str, key: str, secret: str, allow_http: bool = False) -> None:
    """Settings of an S3-compatible store for s3a:// paths."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for k, v in {"endpoint": endpoint, "endpoint.region": region, "access.key": key, "secret.key": secret, "path.style.access": "true", "connection.ssl.enabled": str(not allow_http).lower()}.items():
        conf.set(f"fs.s3a.{k}", v)


def scan(spark: SparkSession, root: str, table: str, date_prefix: str | None = None, prefix: str = "", allowed: Iterable[str] = COLD_TABLES) -> DataFrame:
    """The table with its partition column `date`; `date_prefix` (YYYY, YYYY-MM or a day) prunes partitions."""
    if table not in allowed:
        raise ValueError(f"unknown cold table {table!r}: one of {', '.join(allowed)}")
    fields = StructType([*schema(table).fields, StructField("date", DateType())])
    df = spark.read.schema(fields).parquet(table_path(root, table, prefix))
    return df if date_prefix is None else df.where(between_days(date_prefix))


def between_days(date_prefix: str):
    """A range on `date` (so that partitions are pruned) for a day, month or year."""
    parts = [int(p) for p in date_prefix.rstrip("/").split("-")]
    if len(parts) == 3:
        return F.col("date") == F.lit(date(*parts))
    first = date(parts[0], parts[1] if len(parts) > 1 else 1, 1)
    following = date(first.year + 1, 1, 1) if len(parts) == 1 or first.month == 12 else date(first.year, first.month + 1, 1)
    return (F.col("date") >= F.lit(first)) & (F.col("date") < F.lit(following))


def register(spark: SparkSession, root: str, tables: Iterable[str] = COLD_TABLES, date_prefix: str | None = None, prefix: str = "") -> None:
    """Temporary views of the tables; a view of the same name is replaced."""
    for t in tables:
        scan(spark, root, t, date_prefix, prefix, allowed=tables).createOrReplaceTempView(t)


def write_days(df: DataFrame, root: str, table: str, mode: str = "append", prefix: str = "") -> None:
    """Rows into date=YYYY-MM-DD folders, few files for each day, sorted by key within files. Overwriting replaces the days that df touches."""
    time, key = KEYS[table]
    out = df.select(*schema(table).names, F.to_date(time).alias("date")).hint("rebalance", "date").sortWithinPartitions("date", *key)
    out.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("date").parquet(table_path(root, table, prefix))


def export_day(df: DataFrame, root: str, table: str, day: date, prefix: str = "", files: int = 1) -> str:
    """One UTC day into its folder, whatever is there; a day without rows leaves an empty file. Returns the folder."""
    time, key = KEYS[table]
    folder = f"{table_path(root, table, prefix)}/date={day.isoformat()}"
    rows = df.where(on_day(df, time, day)).select(*schema(table).names)
    rows = rows.repartitionByRange(files, *key) if files > 1 else rows.coalesce(1)
    rows.sortWithinPartitions(*key).write.mode("overwrite").option("compression", "zstd").parquet(folder)
    return folder


def touched_days(batch: DataFrame, table: str) -> list[date]:
    """The days that a batch has rows of: they are re-exported, however late the rows came."""
    return sorted(r.d for r in batch.select(F.to_date(KEYS[table][0]).alias("d")).distinct().collect() if r.d is not None)


def scheduled_days(today: date) -> list[date]:
    return [today - timedelta(days=1), today - timedelta(days=2)]


def export_due(tables: Mapping[str, DataFrame], root: str, today: date, late: Iterable[date] = (), prefix: str = "") -> dict[tuple[str, date], str]:
    """One run of the scheduled export: the two days before today and the `late` ones (those that batches touched since the last
    run), each table's day into its folder, whatever is there. A day that is not over is left to a later run. Returns the folders."""
    days = sorted({*scheduled_days(today), *(d for d in late if d < today)})
    return {(name, d): export_day(df, root, name, d, prefix) for d in days for name, df in tables.items()}


def partitions(spark: SparkSession, path: str) -> list[tuple[date, str]]:
    """(day, folder) of each date= folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [(f.getPath().getName(), f.getPath().toString()) for f in fs.listStatus(at)]
    return sorted((date.fromisoformat(n[5:]), p) for n, p in names if re.fullmatch(r"date=\d{4}-\d\d-\d\d", n))


def purge(spark: SparkSession, path: str, today: date, days: int = RETENTION_DAYS) -> int:
    """Drop the folders of days strictly before today - days; returns how many."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = [p for d, p in partitions(spark, path) if d < today - timedelta(days=days)]
    for p in gone:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p), True)
    return len(gone)


def render(df: DataFrame, form: str = "table", limit: int | None = None) -> tuple[str, int]:
    """(all rows as an ASCII table or a JSON array, how many there are); `limit`: only so many, if asked for."""
    shown = df if limit is None else df.limit(limit)
    if form == "json":
        rows = list(shown.toJSON().toLocalIterator())
        return "[" + ",".join(rows) + "]", len(rows)
    n = shown.count()
    return shown._jdf.showString(n, 0, False), n
