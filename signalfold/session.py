"""Sessions for the engine, and shipping of its code to executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: UTC everywhere, no SQL over bare file paths, runtime re-planning on.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.runSQLOnFiles": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
}


def build_session(name: str = "signalfold", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the engine's settings; `settings` are further or other ones (dots as in Spark's names)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables that the cluster names in spark.checkpoint.dir. Where it is unset: one in the warehouse
    if driver and executors are one process, and an error on a cluster, whose machines need not share the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def scanned_rows(df: DataFrame) -> tuple[int, int]:
    """(rows that the file scans of df gave, files that they opened), by the scans' own metrics after df has run: row groups that
    statistics or Bloom filters rule out are not among the rows."""
    execution = df._jdf.queryExecution()
    df._jdf.collectToPython()
    stack, rows, files = [execution.executedPlan()], 0, 0
    while stack:
        p = stack.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            stack.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            stack.append(p.plan())
        elif name == "FileSourceScanExec":
            rows += p.metrics().apply("numOutputRows").value()
            files += p.metrics().apply("numFiles").value()
        it = p.children().iterator()
        while it.hasNext():
            stack.append(it.next())
    return rows, files


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let executors import this package: the driver serves it to them, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    top = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = os.path.join(folder, os.path.basename(top) + ".zip")
    with zipfile.ZipFile(name, "w") as z:
        for at, _, files in os.walk(top):
            for f in files:
                if f.endswith(".py"):
                    z.write(os.path.join(at, f), os.path.relpath(os.path.join(at, f), os.path.dirname(top)))
    spark.sparkContext.addPyFile(name)
