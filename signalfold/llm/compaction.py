"""Sharding by size-tiered compaction under a versioned manifest.

Arrivals are appended as small immutable shards. A compaction groups the live shards into tiers by size
(each tier spans a factor of FAN), and merges each tier that holds at least FAN shards into files of about
the target size: the tier's files, each under half the target, are packed into read splits of at most the
target, and each split is written as one file, a narrow job with no shuffle. All files but the last are over
half the target or belong to a higher tier, so a row is rewritten a logarithmic number of times. Arrivals are
read in splits of a FAN-th of the target, so their shards are small whatever the cluster's own split is. A version is a Parquet table of its shards (path, rows, bytes) and a small pointer file
that is renamed into place without overwriting: readers see the old or the new version, a second writer of
the same version fails, and a lost job leaves only files that no manifest names.

Defined cases: nulls, empty and long texts, ties and repeated rows are stored as they are; an empty arrival makes a
version without new rows, and a store of empty arrivals alone is read as an empty table of their columns; columns that
come later are null in older rows, and one that comes with another type is an error; all columns pass through, and one
named `__shard` stays in place of the name of the file; a shard over the target is never merged again.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

FAN = 4
TARGET_BYTES = 128 << 20
MANIFEST = "path string, rows bigint, bytes bigint, tier int"


@contextmanager
def _settings(spark: SparkSession, **values: int) -> Iterator[None]:
    """spark.sql.files.<name> for the jobs inside; the old values come back after."""
    old = {f"spark.sql.files.{k}": spark.conf.get(f"spark.sql.files.{k}", None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(f"spark.sql.files.{k}", str(v))
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fan: int = FAN):
        self.spark, self.root, self.target, self.fan = spark, root.rstrip("/"), target_bytes, fan
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- files -------------------------------------------------------------------------------------
    def _read_text(self, path: str) -> str:
        at = self._fs.open(self._path(path))
        try:
            return bytes(at.readAllBytes()).decode()
        finally:
            at.close()

    def _commit_text(self, path: str, text: str) -> None:
        """Write aside, then rename; raises if the file is there already."""
        jvm = self.spark.sparkContext._jvm
        aside = self._path(f"{path}.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(aside, False)
        out.write(bytearray(text.encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(aside, self._path(path), options)
        except Exception:
            self._fs.delete(aside, False)
            raise

    def _children(self, path: str) -> list:
        at = self._path(path)
        return list(self._fs.listStatus(at)) if self._fs.exists(at) else []

    # -- manifest ----------------------------------------------------------------------------------
    def version(self) -> int:
        names = [x.getPath().getName() for x in self._children(f"{self.root}/versions")]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """The shards of a version; they are facts about files, not about rows, in one file and hence one partition."""
        v = self.version() if version is None else version
        if v == 0:
            return self._facts(MANIFEST, [])
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/{self._pointer(v)['shards']}").coalesce(1)

    def _pointer(self, version: int) -> dict:
        return json.loads(self._read_text(f"{self.root}/versions/v{version:09d}.json"))

    def _facts(self, ddl: str, rows: list[dict]) -> DataFrame:
        """A small table of facts about files, made in the plan itself."""
        return self.spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{ddl}>>")))

    def schema(self, version: int | None = None) -> StructType:
        """The columns of a version's rows; there are none before the first."""
        v = self.version() if version is None else version
        return StructType.fromJson(self._pointer(v)["schema"]) if v else StructType()

    def _tier(self, size: int) -> int:
        return max(0, int(math.log(max(size, 1), self.fan)))

    def _commit(self, base: int, shards: DataFrame, schema: StructType) -> int:
        name = f"shards/v{base + 1:09d}-{uuid.uuid4().hex}"
        shards.coalesce(1).write.parquet(f"{self.root}/{name}")
        self._commit_text(f"{self.root}/versions/v{base + 1:09d}.json", json.dumps({"version": base + 1, "shards": name, "schema": schema.jsonValue()}))
        return base + 1

    def _described(self, folder: str, schema) -> DataFrame:
        """Manifest rows of the files in a folder that a job wrote."""
        sizes = [(x.getPath().getName(), int(x.getLen())) for x in self._children(folder) if x.getPath().getName().endswith(".parquet")]
        if not sizes:
            return self._facts(MANIFEST, [])
        rows = self.spark.read.schema(schema).parquet(folder).groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count(F.lit(1)).alias("rows"))
        known = self._facts("name string, path string, bytes bigint, tier int", [{"name": n, "path": f"{folder}/{n}", "bytes": s, "tier": self._tier(s)} for n, s in sizes])
        return rows.join(F.broadcast(known), "name").select("path", "rows", "bytes", "tier")

    # -- operations --------------------------------------------------------------------------------
    def append(self, arrivals: DataFrame) -> int:
        """Store arrivals as new shards, one for each of their partitions; returns the version."""
        base = self.version()
        schema = self.schema(base)
        for f in arrivals.schema:
            if f.name not in schema.names:
                schema = schema.add(StructField(f.name, f.dataType))
            elif schema[f.name].dataType != f.dataType:
                raise ValueError(f"column {f.name} is {schema[f.name].dataType.simpleString()} and comes as {f.dataType.simpleString()}")
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        split = self.spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
        with _settings(self.spark, maxPartitionBytes=min(split, max(1, self.target // self.fan))):
            arrivals.write.option("compression", "zstd").parquet(folder)
        return self._commit(base, self.manifest(base).unionByName(self._described(folder, arrivals.schema)), schema)

    def compact(self) -> int:
        """Merge every tier that has enough shards below the target size, as long as merged shards fill one; returns the version."""
        while self._merge_tiers():
            pass
        return self.version()

    def _merge_tiers(self) -> bool:
        base = self.version()
        live, schema = self.manifest(base), self.schema(base)
        small = live.where(F.col("bytes") < self.target / 2)
        # One row a tier: their number is the logarithm of the target.
        tiers = small.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).where(F.col("n") >= self.fan).collect()
        made = []
        for t in sorted(tiers, key=lambda t: t.tier):
            paths = sorted(r.path for r in small.where(F.col("tier") == t.tier).toLocalIterator())
            folder = f"{self.root}/data/{uuid.uuid4().hex}"
            rows = self.spark.read.schema(schema).parquet(*paths)
            with _settings(self.spark, maxPartitionBytes=self.target, openCostInBytes=0, minPartitionNum=1):
                # Splits are packed up to the target, which at least halves the files, each under half of it. Where the cluster
                # insists on smaller splits, these go together.
                wanted = -(-t.bytes // self.target)
                if rows.rdd.getNumPartitions() > max(wanted, t.n // 2):
                    rows = rows.coalesce(wanted)
                rows.write.option("compression", "zstd").parquet(folder)
            made.append(self._described(folder, schema))
        if not made:
            return False
        out = live.where(~F.col("tier").isin([t.tier for t in tiers]) | (F.col("bytes") >= self.target / 2))
        for m in made:
            out = out.unionByName(m)
        self._commit(base, out, schema)
        return True

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version; `__shard` is the file that holds each, unless the rows have such a column."""
        v = self.version() if version is None else version
        if v == 0:
            raise ValueError("the store has no version")
        schema, shards = self.schema(v), sorted(r.path for r in self.manifest(v).select("path").toLocalIterator())
        if not shards:
            rows = self.spark.createDataFrame([], schema)
            return rows if "__shard" in schema.names else rows.withColumn("__shard", F.lit(None).cast("string"))
        rows = self.spark.read.schema(schema).parquet(*shards)
        return rows if "__shard" in schema.names else rows.withColumn("__shard", F.col("_metadata.file_path"))

    def vacuum(self) -> int:
        """Delete data files that the newest version doesn't name (no reader may still use an older one); returns how many."""
        live = {r.path.split("/data/")[1] for r in self.manifest().select("path").toLocalIterator()}
        gone = 0
        for folder in self._children(f"{self.root}/data"):
            for f in self._children(folder.getPath().toString()):
                name = f"{folder.getPath().getName()}/{f.getPath().getName()}"
                if name.endswith(".parquet") and name not in live:
                    gone += bool(self._fs.delete(f.getPath(), False))
        return gone
