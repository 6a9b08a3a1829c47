"""Idempotent merges: the earliest arrival of a key wins within a batch, what is stored wins over a batch."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalfold.sources import cold
from signalfold.sources.daytable import DayTable
from signalfold.sources.schemas import KEYS


def first_received(df: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """One row of each key: the first in `order`."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def new_rows(batch: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the batch whose key isn't stored yet."""
    return batch.join(stored.select(*key), key, "left_anti")


def dedup_batch(batch: DataFrame, table: str) -> DataFrame:
    key = KEYS[table][1]
    rest = [c for c in batch.columns if c not in key and c != "received_at"]
    return first_received(batch, key, ["received_at", *rest])


def merge(batch: DataFrame, root: str, table: str, source: tuple[str, int] | None = None, rollups: Iterable[str] = ()) -> int:
    """Insert a batch into the day table in one step that readers see; returns the rows inserted. Repeating a batch inserts nothing,
    and one that its `source` (a stream and the batch's number) has published already is not even looked at.

    Only keys of the days that the batch touches are read. rollups: those that the table keeps.
    """
    store = DayTable(batch.sparkSession, root, table, rollups=rollups)
    base = store.version()
    if source and store.seen(source, base):
        return 0
    fresh = dedup_batch(batch, table).persist()
    try:
        there = {s.day for s in base.segments} & {d.isoformat() for d in cold.touched_days(fresh, table)}
        rows = fresh
        if there:
            rows = new_rows(fresh, store.read([date.fromisoformat(d) for d in there], base), KEYS[table][1])
        rows = rows.where(F.col(KEYS[table][0]).isNotNull()).persist()
        n = rows.count()
        if n or source:
            store.append(rows, source, base)
        rows.unpersist()
        return n
    finally:
        fresh.unpersist()
