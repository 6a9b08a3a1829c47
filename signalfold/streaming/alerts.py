"""Alerts as streams: a tick evaluates rules over look-back windows; transitions can also be kept as keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from datetime import UTC, datetime
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from signalfold.operators.alert_state import Alert, Sink, State, evaluate_once
from signalfold.operators.rules import Rule

#: Seconds between evaluations (fixed value).
PERIOD = 60


def ticker(spark: SparkSession, tables: Callable[[], Mapping[str, DataFrame]], rules: list[Rule], state: State, sink: Sink, out: list[Alert], checkpoint: str, period: int = PERIOD) -> StreamingQuery:
    """Evaluate on a timer: windows end at the tick, so this is a batch job for each, not an epoch-aligned window."""

    def tick(batch: DataFrame, _: int) -> None:
        out.extend(evaluate_once(tables(), rules, state, datetime.now(UTC).replace(tzinfo=None), sink))

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=f"{period} seconds").start()


def transitions(evaluations: DataFrame) -> DataFrame:
    """evaluations (key, value, breaching, cooldown_secs, at) -> alerts (key, state, value, at), one state for each key."""
    schema = "key string, state string, value double, at timestamp"

    def run(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        firing, notified = state.get if state.exists else (False, None)
        out = []
        for r in pd.concat(list(batches)).sort_values("at", kind="stable").itertuples():
            before, firing = firing, bool(r.breaching)
            now = r.at.timestamp()
            if before == firing or (notified is not None and max(0.0, now - notified) < r.cooldown_secs):
                continue
            notified = now
            out.append((key[0], "firing" if firing else "resolved", float(r.value), r.at))
        state.update((firing, notified))
        yield pd.DataFrame(out, columns=["key", "state", "value", "at"])

    return evaluations.groupBy("key").applyInPandasWithState(run, schema, "firing boolean, notified double", "append", GroupStateTimeout.NoTimeout)
