"""Heartbeats of remote senders: one JSON document a row with the sender's id, seen when it arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from signalfold.sources import schemas as S


def read_heartbeats(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests (value, received_at) -> (heartbeats (id, ts), one row (refused): documents without a usable id)."""
    # An id must come as text; a number would be cast to it, so the raw document decides.
    parsed = requests.select(F.from_json("value", StructType.fromDDL(S.HEARTBEAT)).alias("b"), "value", "received_at")
    id_ = F.regexp_replace("b.id", r"^\s+|\s+$", "")
    fine = F.coalesce((F.length(id_) > 0) & F.col("value").rlike(r'(?s)"id"\s*:\s*"'), F.lit(False))
    return parsed.where(fine).select(id_.alias("id"), F.col("received_at").alias("ts")), parsed.agg(F.count_if(~fine).alias("refused"))
