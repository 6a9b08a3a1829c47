"""Streaming ingest: files of requests -> flattened, checked rows -> idempotent day-partitioned merge.

The sources replay after a failure, and the merge ignores rows that are stored already, so every record is kept once
however often its file or batch is delivered.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from signalfold.functions import otlp_values as V
from signalfold.operators.merge import merge
from signalfold.operators.reads import ingest_stats
from signalfold.sources import events, otlp
from signalfold.streaming.admission import Limits, decided, refusals, write_refusals

#: Rows a batch may wait for at most, in seconds, when it runs on a timer (fixed value).
TRIGGER = "200 milliseconds"


class Stats(Counter):
    """Counts of one table's ingest."""

    def summary(self) -> dict[str, int]:
        return ingest_stats(self["received"], self["inserted"], **{k: v for k, v in self.items() if k not in ("received", "inserted")})


def requests(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """One JSON document a line; arrival is the time of processing."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder).withColumn("received_at", F.current_timestamp())


def judged(batch: DataFrame, table: str) -> DataFrame:
    """Requests (value, received_at) with `outcome` (ok, or why the request is refused whole) and the counts of their table, row by row."""
    return events.checked(batch) if table == "events" else otlp.admit(batch, table)


def asking(source: DataFrame, table: str) -> DataFrame:
    """Requests as the limits see them: their session is the token's or else the first event's, or the service of the first record that is
    kept, or else their address; they cost their records, before single ones are left out for their size."""
    df = judged(source, table)
    if table == "events":
        first, cost = F.coalesce(F.nullif("b.token", F.lit("")), F.get("b.events", F.lit(0))["session_id"]), F.col("n_events")
    else:
        first, cost = V.attributes(F.col("first_resource"))["service_name"], F.col("n_records")
    text = F.concat_ws("|", "value", "ip", F.col("received_at").cast("string"))
    return df.select("value", "received_at", "ip", F.sha2(text, 256).alias("request"), F.coalesce(F.nullif(first, F.lit("")), "ip", F.lit("")).alias("session"), cost.cast("double").alias("cost"),
                     (F.col("outcome") != "ok").alias("bad"), F.col("received_at").alias("at"))


def store(root: str, table: str, stats: Stats, notes: str | None = None, stream: str | None = None, rollups: Iterable[str] = ()) -> Callable[[DataFrame, int], None]:
    """The sink of a batch of requests for `table`: requests that are malformed, too large or `refused` by a limit (if they have that column)
    are counted, and the others go on. notes: the folder for refusals that count as bad requests. stream: a name under which
    the table remembers which batches it holds."""

    def sink(batch: DataFrame, number: int) -> None:
        held: list[DataFrame] = []

        def hold(df: DataFrame) -> DataFrame:
            held.append(df.persist())
            return held[-1]

        batch = hold(batch)
        try:
            if notes:
                write_refusals(batch, notes, number)
            if "refused" in batch.columns:
                stats.update({f"refused_{r.refused}": r.n for r in batch.where("refused <> 'bad'").groupBy("refused").agg(F.count(F.lit(1)).alias("n")).collect()})
                stats.update({"refused": batch.where("refused <> 'bad'").count()})
                batch = batch.where("refused is null or refused = 'bad'")
            found = hold(judged(batch.select("value", "received_at"), table))
            if table == "events":
                rows = events.rows_of(found)
                seen = found.agg(F.sum(F.when(F.col("outcome") == "ok", F.col("n_events") - F.col("dropped_skew")).otherwise(0)).alias("received"), F.sum("dropped_skew").alias("dropped_skew"), F.count_if(F.col("outcome") != "ok").alias("refused")).first()
                stats.update({k: v or 0 for k, v in seen.asDict().items()})
            else:
                stats.update(found.agg(F.count_if(F.col("outcome") != "ok").alias("refused")).first().asDict())
                taken = found.where("outcome = 'ok'").select("value", "received_at")
                if table == "spans":
                    stats.update(otlp.invalid_spans(taken).first().asDict())
                rows, counts = otlp.accept(hold(otlp.FLATTEN[table](taken)), table)
                counted = counts.first().asDict()
                counted["received"] -= counted["dropped_oversized"]
                stats.update(counted)
            if not rows.isEmpty():
                stats.update({"inserted": merge(rows, root, table, (stream, number) if stream else None, rollups)})
            stats.update({"flushes": 1})
        finally:
            for df in held:
                df.unpersist()

    return sink


def start(
    source: DataFrame, root: str, table: str, checkpoint: str, stats: Stats, available_now: bool = True, limits: Limits | None = None, resent_within: str | None = None, rollups: Iterable[str] = (),
) -> StreamingQuery:
    """Run the ingest of one table. limits: requests (which then have an `ip`) pass the chain of limits first. resent_within: a request
    whose text came before within that time is left out, so that nothing stored is opened for it; what comes later is found by the merge. rollups: counts that the table keeps, for rules to read (operators/baselines.py)."""
    notes = f"{root.rstrip('/')}/_refusals/{table}" if limits else None
    if limits:
        source = decided(asking(source, table), limits, refusals(source.sparkSession, notes))
    if resent_within:
        text = F.sha2("value", 256)
        if limits:
            text = F.when(F.col("refused").isNull(), text).otherwise(F.col("request"))
        else:
            source = source.withWatermark("received_at", resent_within)
        source = source.withColumn("__text", F.coalesce(text, F.lit(""))).dropDuplicatesWithinWatermark(["__text"]).drop("__text")
    writer = source.writeStream.foreachBatch(store(root, table, stats, notes, checkpoint, rollups)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=TRIGGER)).start()
