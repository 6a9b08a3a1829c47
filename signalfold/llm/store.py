"""Shared folders for intermediate tables, and size checks before a broadcast."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalfold.session import scratch_path
from signalfold.session import ship as ship_package

#: ASCII white space, and the letters A-Z with their small forms (fixed values).
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: What a Python worker takes from an Arrow batch at a time: bytes of text, and rows.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 1024

#: Rows up to which a table of a few numbers a row is broadcast (some 100 MB at most).
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df into the shared folder and read it again: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int | None = None, bound: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint when df has at most `bound` rows; beyond it the join shuffles both sides."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= bound else df


#: Groups of so many rows are heavy; the second figure bounds how many heavy groups there can be.
HEAVY_ROWS, HEAVY_GROUPS = 1024, 20_000


def heavy_light_join(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """rows joined with their group (one row a group, `size` its rows): hot groups never meet in one task.

    Groups over a share of 1 / HEAVY_GROUPS of the rows, of which there are few by construction, are broadcast; the
    rest shuffle.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    least = max(HEAVY_ROWS, total // HEAVY_GROUPS)
    heavy, light = groups.where(F.col(size) >= least), groups.where(F.col(size) < least)
    marks = F.broadcast(heavy.select(*keys, F.lit(True).alias("__heavy")))
    rest = rows.join(marks, keys, "left").where(F.col("__heavy").isNull()).drop("__heavy")
    return rows.join(F.broadcast(heavy), keys).unionByName(rest.join(light, keys))


def fold_ascii(col):
    """Small letters for A-Z alone: other scripts keep their case."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def place(df: DataFrame) -> tuple[Column, Column]:
    """The file (a hash of its path) and the number in it of each row of a table read from files."""
    at = df.metadataColumn("_metadata")
    return F.xxhash64(at["file_path"]), at["row_index"]


def read_from_files(df: DataFrame) -> bool:
    try:
        df.select(*place(df))
    except AnalysisException:
        return False
    return True


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession) -> None:
    """Let executors import this package."""
    ship_package(spark)


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """A batch in slices of up to `rows` rows whose texts in `column` have `most` bytes together; a longer text is alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = min(max(at + 1, int(np.searchsorted(ends, before + most, side="right"))), at + rows)
        yield batch.slice(at, stop - at)
        at = stop


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """mapInArrow for columns of any names (it can't take dots); the function sees them by place."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(function, schema)
