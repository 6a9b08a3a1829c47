"""A day-partitioned table whose readers see whole commits.

A writer leaves a batch's rows in files that no version names, `date=<day>/seg=<name>/`, and publishes them by renaming a small
pointer file into place, `_versions/v<n>.json`, which lists the segments of the version. The rename never overwrites: of two
writers of the same version one fails (`Conflict`) and its files stay unnamed. A reader opens the segments of one version and keeps
these, whatever is merged or compacted meanwhile; `vacuum` deletes what no kept version names once it is old enough.

A pointer can also hold the last batch of each stream that wrote (`source`), so a batch that is repeated after a failure
is seen in the same step that publishes it.

Segments of a day are merged by size tiers: FAN of one tier become one segment, so that a row is rewritten a logarithmic number of
times and a day holds at most (FAN - 1) segments a tier beside full ones; `settle` merges what is left of a quiet day. The
pointer lists (days kept) x (segments of a day), a bound that does not grow with rows.

A table may keep rollups: counts of its rows for each minute and some columns, staged with a batch's rows and published by the same
rename, so they are as exact as the rows. A late row adds to the minute it belongs to; tiers of counts merge by adding up.

Files are clustered by the columns that reads narrow down (a service and a time, or a metric and a time) and carry Parquet
Bloom filters on the ids that reads look up, so a read of one trace or session opens only row groups that may hold it.
"""

from __future__ import annotations

import json
import math
import re
import time
import uuid
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, LongType, StructField, StructType

from signalfold.sources.cold import table_path
from signalfold.sources.schemas import KEYS, schema

TARGET_BYTES, FAN = 128 << 20, 8
#: Bytes of the lowest tier: smaller segments count as one of it.
LEAST_BYTES = 64 << 10
ROW_GROUP_ROWS = 50_000
#: Columns that each table is clustered by within a day, and ids with a Bloom filter.
CLUSTERS = {"events": ["event_name", "timestamp_client"], "logs": ["service_name", "log_time"], "spans": ["service_name", "start_time"], "metric_points": ["metric_name", "time"]}
LOOKUPS = {"events": ["session_id"], "logs": ["trace_id", "session_id"], "spans": ["trace_id"], "metric_points": []}#: Rollups a table can keep: columns that its counts are told apart by.
ROLLUPS = {
    "events": {"counts": ["event_name", "tenant_id"]},
    "logs": {"counts": ["service_name", "tenant_id", "severity_number"], "signatures": ["service_name", "tenant_id", "severity_number", "body"]},
    "spans": {"counts": ["service_name", "name", "tenant_id", "status_code"]},
    "metric_points": {},
}
CELL = "minute"

_TIMES = "spark.sql.parquet.outputTimestampType"


class Conflict(RuntimeError):
    """Another writer published the version first."""


@dataclass(frozen=True)
class Segment:
    day: str
    name: str
    bytes: int
    rollup: str = ""  # of rows, unless it is named


@dataclass(frozen=True)
class Version:
    number: int
    segments: tuple[Segment, ...]
    sources: Mapping[str, int]


def tier(size: int, fan: int) -> int:
    return max(0, math.floor(math.log(max(size, 1) / LEAST_BYTES, fan)))


def due(segments: Iterable[Segment], target: int, fan: int) -> list[list[Segment]]:
    """Segments to merge: those of each day's tiers that are full, of segments under half the target."""
    tiers: dict[tuple[str, str, int], list[Segment]] = {}
    for s in segments:
        if s.bytes < target / 2:
            tiers.setdefault((s.rollup, s.day, tier(s.bytes, fan)), []).append(s)
    return [found for _, found in sorted(tiers.items()) if len(found) >= fan]


class DayTable:
    def __init__(self, spark: SparkSession, root: str, table: str, target_bytes: int = TARGET_BYTES, fan: int = FAN, row_group_rows: int = ROW_GROUP_ROWS, rollups: Iterable[str] = ()):
        self.rollups = {name: ROLLUPS[table][name] for name in rollups}
        self.spark, self.table, self.path = spark, table, table_path(root, table)
        self.target, self.fan, self.row_group_rows = target_bytes, fan, row_group_rows
        self.schema, (self.time, self.key) = schema(table), KEYS[table]
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    # -- versions ----------------------------------------------------------------------------------
    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _numbers(self) -> list[int]:
        at = self._at("_versions")
        names = [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(m[1]) for m in (re.fullmatch(r"v(\d+)\.json", n) for n in names) if m)

    def version(self, number: int | None = None) -> Version:
        """The newest version, or an older one that is still there; version 0 is empty."""
        n = max(self._numbers(), default=0) if number is None else number
        if n == 0:
            return Version(0, (), {})
        at = self._fs.open(self._at(f"_versions/v{n:012d}.json"))
        try:
            held = json.loads(bytes(at.readAllBytes()))
        finally:
            at.close()
        return Version(n, tuple(Segment(*s) for s in held["segments"]), held["sources"])

    def _publish(self, base: Version, segments: Iterable[Segment], sources: Mapping[str, int]) -> Version:
        new = Version(base.number + 1, tuple(sorted(segments, key=lambda s: (s.rollup, s.day, s.name))), dict(sources))
        text = json.dumps({"segments": [[s.day, s.name, s.bytes, s.rollup] for s in new.segments], "sources": new.sources})
        self._fs.mkdirs(self._at("_versions"))
        aside, place = self._at(f"_versions/.{uuid.uuid4().hex}.tmp"), self._at(f"_versions/v{new.number:012d}.json")
        out = self._fs.create(aside, False)
        out.write(bytearray(text.encode()))
        out.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            files.rename(aside, place, self.spark.sparkContext._gateway.new_array(getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename"), 0))
        except Exception as e:
            self._fs.delete(aside, False)
            if self._fs.exists(place):
                raise Conflict(f"version {new.number} of {self.path} is there already") from e
            raise
        return new

    # -- rows --------------------------------------------------------------------------------------
    def _folder(self, rollup: str) -> str:
        return f"{self.path}.{rollup}" if rollup else self.path

    def _fields(self, rollup: str) -> StructType:
        if not rollup:
            return StructType([*self.schema.fields, StructField("date", DateType())])
        return StructType([self.schema[self.time], *(self.schema[c] for c in ROLLUPS[self.table][rollup]), StructField("n", LongType()), StructField("date", DateType())])

    def _open(self, segments: Iterable[Segment], rollup: str) -> DataFrame:
        fields, path = self._fields(rollup), self._folder(rollup)
        folders = [f"{path}/date={s.day}/seg={s.name}" for s in segments if s.rollup == rollup]
        if not folders:
            return self.spark.createDataFrame([], fields)
        return self.spark.read.schema(fields).option("basePath", path).parquet(*folders).select(*fields.names)

    def read(self, days: Iterable[date] | None = None, version: Version | None = None, rollup: str = "") -> DataFrame:
        """The rows of a version (the newest now), with their `date`, or the counts of one of its rollups, which hold `n` rows of the minute
        that begins at their time (a minute may come in several parts); `days`: only these, others are not opened."""
        held = self.version() if version is None else version
        wanted = None if days is None else {d.isoformat() for d in days}
        return self._open((s for s in held.segments if wanted is None or s.day in wanted), rollup)

    def _counted(self, rows: DataFrame, rollup: str) -> DataFrame:
        """Rows (with n, or each for itself) as counts of minutes."""
        n = F.sum("n") if "n" in rows.columns else F.count(F.lit(1))
        return rows.groupBy(F.date_trunc(CELL, self.time).alias(self.time), *ROLLUPS[self.table][rollup]).agg(n.alias("n"))

    def _stage(self, rows: DataFrame, rollup: str = "") -> list[Segment]:
        """Write rows, or their counts, into files that no version names yet."""
        name, path = f"s{uuid.uuid4().hex}", self._folder(rollup)
        if rollup:
            rows = self._counted(rows, rollup)
            order = [self.time, *ROLLUPS[self.table][rollup]]
        else:
            order = [*CLUSTERS[self.table], *self.key]
        out = rows.select(*(n for n in self._fields(rollup).names if n != "date"), F.to_date(self.time).alias("date"), F.lit(name).alias("seg"))
        # Few files for each day, however many partitions the rows come in; large days keep several.
        out = out.where(F.col("date").isNotNull()).hint("rebalance", "date").sortWithinPartitions("date", "seg", *order)
        writer = out.write.mode("append").option("compression", "zstd").option("parquet.block.row.count.limit", self.row_group_rows)
        for c in LOOKUPS[self.table] if not rollup else []:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", self.row_group_rows)
        # Times as whole microseconds: the older form has no statistics to skip row groups by.
        kept = self.spark.conf.get(_TIMES, None)
        self.spark.conf.set(_TIMES, "TIMESTAMP_MICROS")
        try:
            writer.partitionBy("date", "seg").parquet(path)
        finally:
            self.spark.conf.unset(_TIMES) if kept is None else self.spark.conf.set(_TIMES, kept)
        found = self._fs.globStatus(self._jvm.org.apache.hadoop.fs.Path(f"{path}/date=*/seg={name}")) or []
        return [Segment(f.getPath().getParent().getName()[5:], name, int(self._fs.getContentSummary(f.getPath()).getLength()), rollup) for f in found]

    def append(self, rows: DataFrame, source: tuple[str, int] | None = None, base: Version | None = None) -> Version:
        """Publish rows (of a stream's batch, if given) on top of `base`, the newest version unless given; full tiers are then merged."""
        base = self.version() if base is None else base
        sources = dict(base.sources) | ({source[0]: source[1]} if source else {})
        staged = self._stage(rows)
        for rollup in self.rollups if staged else ():
            staged += self._stage(rows, rollup)
        if not staged and sources == dict(base.sources):
            return base
        self._publish(base, [*base.segments, *staged], sources)
        return self.compact({s.day for s in staged})

    def seen(self, source: tuple[str, int], version: Version) -> bool:
        """Whether the stream's batch, or a later one, is published."""
        return version.sources.get(source[0], -1) >= source[1]

    # -- upkeep ------------------------------------------------------------------------------------
    def _merged(self, base: Version, groups: list[list[Segment]]) -> Version:
        gone = {s for g in groups for s in g}
        staged = [made for rollup in sorted({s.rollup for s in gone}) for made in self._stage(self._open(gone, rollup), rollup)]
        return self._publish(base, [*(s for s in base.segments if s not in gone), *staged], base.sources)

    def compact(self, days: Iterable[str] | None = None) -> Version:
        """Merge full tiers (of the days given) as long as there are any; one job for all of them at a time."""
        wanted = None if days is None else set(days)
        while True:
            base = self.version()
            groups = due((s for s in base.segments if wanted is None or s.day in wanted), self.target, self.fan)
            if not groups:
                return base
            self._merged(base, groups)

    def settle(self, before: date) -> Version:
        """Merge what is left in small segments of the days before this one, which are taken to be quiet."""
        base, small = self.version(), {}
        for s in base.segments:
            if s.day < before.isoformat() and s.bytes < self.target / 2:
                small.setdefault((s.rollup, s.day), []).append(s)
        groups = [g for g in small.values() if len(g) > 1]
        return self._merged(base, groups) if groups else base

    def purge(self, cutoff: date) -> int:
        """Publish a version without the days before cutoff; returns how many days went."""
        base = self.version()
        kept = [s for s in base.segments if s.day >= cutoff.isoformat()]
        gone = {s.day for s in base.segments} - {s.day for s in kept}
        if gone:
            self._publish(base, kept, base.sources)
        return len(gone)

    def _folders(self) -> Iterator[tuple[str, str, str, object]]:
        for rollup in ("", *ROLLUPS[self.table]):
            for f in self._fs.globStatus(self._jvm.org.apache.hadoop.fs.Path(f"{self._folder(rollup)}/date=*/seg=*")) or []:
                yield rollup, f.getPath().getParent().getName()[5:], f.getPath().getName()[4:], f

    def vacuum(self, keep: int = 2, older_secs: float = 3600.0) -> int:
        """Delete pointers but the newest `keep`, and segments that none of these names and that are older than `older_secs`
        (younger ones may belong to a writer that has not published yet); returns how many segments went."""
        numbers = self._numbers()
        named = {(s.rollup, s.day, s.name) for n in numbers[-keep:] for s in self.version(n).segments}
        for n in numbers[:-keep]:
            self._fs.delete(self._at(f"_versions/v{n:012d}.json"), False)
        gone = 0
        for rollup, day, name, f in self._folders():
            if (rollup, day, name) not in named and time.time() - f.getModificationTime() / 1000 >= older_secs:
                gone += bool(self._fs.delete(f.getPath(), True))
        return gone
