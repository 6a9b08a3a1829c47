"""Product event batches: validation of whole batches, then of each event's time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from signalfold.functions import otlp_values as V
from signalfold.functions.predicates import within_skew
from signalfold.session import ship
from signalfold.sources import schemas as S

#: Bounds of a batch and of its events (fixed values).
MAX_EVENTS, MAX_TEXT, MAX_PROPERTY_BYTES, MAX_DEPTH = 500, 200, 16_384, 16
UUID = "^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$"
RFC3339 = r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"


def valid_text(c: Column) -> Column:
    """1 to MAX_TEXT characters, not all blank."""
    return F.coalesce((F.length(F.regexp_replace(c, r"^\s+|\s+$", "")) > 0) & (F.char_length(c) <= MAX_TEXT), F.lit(False))


def canonical_uuid(c: Column) -> Column:
    h = F.lower(F.replace(c, F.lit("-"), F.lit("")))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def checked(batches: DataFrame) -> DataFrame:
    """batches (value: JSON text, received_at, other columns) with `b` (the parsed batch), n_events, `outcome` and dropped_skew.

    Outcomes: ok, empty or invalid (refused whole), too_many. A batch is judged by its own row, without a shuffle.
    """
    ship(batches.sparkSession)
    df = batches.withColumn("b", F.from_json("value", StructType.fromDDL(S.EVENT_BATCH)))
    size = F.coalesce(F.size("b.events"), F.lit(-1))
    events = F.coalesce("b.events", F.array())
    df = df.withColumn("__depth", V.depths(F.transform(events, lambda e: _properties(e))))
    fine = F.forall(events, _fine) & F.coalesce(F.col("__depth") <= MAX_DEPTH, F.lit(False))
    outcome = F.when(size == 0, "empty").when(size > MAX_EVENTS, "too_many").when((size > 0) & fine, "ok").otherwise("invalid")
    late = F.size(F.filter(events, lambda e: ~_timely(e)))
    return df.withColumns({"n_events": size, "outcome": outcome}).withColumn("dropped_skew", F.when(F.col("outcome") == "ok", late).otherwise(0)).drop("__depth")


def _properties(e: Column) -> Column:
    text = F.coalesce(e["properties"], F.lit("{}"))
    return F.when(text == "null", "{}").otherwise(text)


def _fine(e: Column) -> Column:
    text = _properties(e)
    return (
        F.coalesce(e["event_id"].rlike(UUID), F.lit(False)) & F.coalesce(e["timestamp_client"].rlike(RFC3339), F.lit(False))
        & valid_text(e["event_name"]) & valid_text(e["actor_id"]) & valid_text(e["session_id"])
        & (e["tenant_id"].isNull() | valid_text(e["tenant_id"])) & F.ltrim(text).startswith("{") & (F.octet_length(text) <= MAX_PROPERTY_BYTES)
    )


def _timely(e: Column) -> Column:
    return F.coalesce(within_skew(F.try_to_timestamp(e["timestamp_client"])), F.lit(False))


def rows_of(judged: DataFrame) -> DataFrame:
    """Rows of the events table from checked batches that are ok; events outside the skew are left out."""
    x = judged.where("outcome = 'ok'").select("received_at", F.explode(F.filter("b.events", _timely)).alias("e"))
    x = x.select("received_at", "e.*", _properties(F.col("e")).alias("__properties"))
    return x.withColumns({
        "event_id": canonical_uuid(F.col("event_id")), "timestamp_client": F.try_to_timestamp("timestamp_client"), "properties": F.col("__properties")}).select(*S.schema("events").names)


def read_batches(batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """batches (value, received_at) -> (rows of the events table, one row per batch: n_events, outcome, dropped_skew)."""
    judged = checked(batches)
    return rows_of(judged), judged.select("n_events", "outcome", "dropped_skew")
