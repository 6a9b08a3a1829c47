"""The limits of the ingest path as a chain of stateful stream operators: ban, then session, then address.

Each limit is a processor with arbitrary state (`transformWithStateInPandas`). It is keyed by buckets of the limit's key (a hash modulo
BUCKETS), holds the bucket's keys in map state and their number in value state, and sweeps keys that act like fresh ones by an
event-time timer, so state is bounded by the keys that were active lately and by the cap on tracked keys. A cap counts
within a bucket (its share of the whole). Beyond it a new session or address is refused, while a new offender takes the place of the one
that was seen first. A bucket's rows within one micro-batch are one group, which the trigger bounds; they are taken in order of
time, then of request.

What a limit refuses costs nothing at the later ones, and nothing is given back at the earlier ones. Requests that are malformed or too
large count as bad ones of their address at once; refusals of the session and address limits become notes (`refusals`),
which the sink writes and the chain reads as a second source, so they count from a following batch on. Unknown addresses share
no limit and no ban.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from signalfold.session import ship
from signalfold.streaming import limits as limit_classes
from signalfold.streaming.limits import SESSION_BURST, SESSION_RATE, AddressSessions, BadRequests, TokenBucket, known_address

#: What the chain asks of a request, and what it remembers of one that a later limit refused.
REQUEST = "request string, ip string, session string, cost double, bad boolean, at timestamp"
NOTE = "request string, ip string, at timestamp"
#: Keys that a limit tracks in all (fixed value), and the buckets that share them.
TRACKED, BUCKETS = 100_000, 64
SWEEP_SECS = 60.0
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Limits:
    """Settings of the chain, where they are not the usual ones."""

    session: dict[str, float] = field(default_factory=dict)
    address: dict[str, float] = field(default_factory=dict)
    bans: dict[str, float] = field(default_factory=dict)
    tracked: int = TRACKED
    buckets: int = BUCKETS
    sweep_secs: float = SWEEP_SECS
    delay: str = "10 minutes"  # how far behind the latest time a request may be


def idle(limit: TokenBucket | AddressSessions | BadRequests, now: float) -> bool:
    """Whether the limit acts like a fresh one from now on."""
    if isinstance(limit, TokenBucket):
        return limit.tokens is None or limit.tokens + max(0.0, now - limit.last) * limit.rate >= limit.burst
    if isinstance(limit, AddressSessions):
        return all(now - t >= limit.window for t in limit.seen.values())
    return now >= limit.until and (limit.start is None or now - limit.start > limit.window)


class Keyed(StatefulProcessor):
    """One limit over the keys of a bucket. `step` decides on a row: what refuses it, or None; `applies` says which rows it sees."""

    def __init__(self, name: str, key: str, make: Callable[..., Any], applies: Callable[[Any], bool], step: Callable[[Any, Any, float], str | None], cap: int, sweep_secs: float, evicts: bool):
        self.name, self.key, self.make, self.applies, self.step = name, key, make, applies, step
        self.cap, self.sweep_ms, self.evicts = cap, int(sweep_secs * 1000), evicts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getMapState("kept", "key string", "state string")
        self.number = handle.getValueState("number", "n int")

    def _first_seen(self) -> str:
        return min(self.kept.iterator(), key=lambda kv: (json.loads(kv[1][0]).get("start") or 0.0, kv[0][0]))[0][0]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["at", "request"], kind="stable")
        held: dict[str, Any] = {}
        n = before = (self.number.get() or (0,))[0]
        verdicts = []
        for r in frame.itertuples():
            refused = r.refused if isinstance(r.refused, str) else None
            if refused is None and self.applies(r):
                k = getattr(r, self.key)
                if k not in held:
                    if self.kept.exists() and self.kept.containsKey((k,)):
                        held[k] = self.make(**json.loads(self.kept.getValue((k,))[0]))
                    elif n < self.cap:
                        held[k], n = self.make(), n + 1
                    elif self.evicts:
                        for name, limit in held.items():
                            self.kept.updateValue((name,), (json.dumps(vars(limit)),))
                        gone = self._first_seen()
                        self.kept.removeKey((gone,))
                        held.pop(gone, None)
                        held[k] = self.make()
                refused = self.step(held[k], r, r.at.timestamp()) if k in held else self.name
            verdicts.append(refused)
        for k, limit in held.items():
            self.kept.updateValue((k,), (json.dumps(vars(limit)),))
        if n != before:
            self.number.update((n,))
        if held and not list(self.handle.listTimers()):
            self.handle.registerTimer(int(frame["at"].iloc[-1].timestamp() * 1000) + self.sweep_ms)
        frame["refused"] = pd.Series(verdicts, index=frame.index, dtype=object)
        yield frame

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() / 1000
        entries = list(self.kept.iterator())
        gone = [k for k, v in entries if idle(self.make(**json.loads(v[0])), now)]
        for k in gone:
            self.kept.removeKey(k)
        left = len(entries) - len(gone)
        if left:
            self.number.update((left,))
            self.handle.registerTimer(int(now * 1000) + self.sweep_ms)
        else:
            self.number.clear()
        return iter([])

    def close(self) -> None:
        pass


def _made(kind: type, settings: dict) -> Callable[..., Any]:
    return lambda **state: kind(**(settings | state))


def _banned(limit: BadRequests, r: Any, now: float) -> str | None:
    if r.note:
        limit.record(now)
        return None
    if limit.banned(now):
        return "ban"
    if r.bad:
        limit.record(now)
        return "bad"
    return None


def processors(limits: Limits) -> list[tuple[str, Keyed]]:
    """(column that is dealt into buckets, processor), in their order."""
    cap = max(1, -(-limits.tracked // limits.buckets))
    session = {"rate": SESSION_RATE, "burst": SESSION_BURST} | limits.session
    return [
        ("ip", Keyed("ban", "ip", _made(BadRequests, limits.bans), lambda r: known_address(r.ip), _banned, cap, limits.sweep_secs, True)),
        ("session", Keyed("session", "session", _made(TokenBucket, session), lambda r: not (r.note or r.bad), lambda b, r, now: None if b.take(max(1.0, float(r.cost)), now) else "session", cap, limits.sweep_secs, False)),
        ("ip", Keyed("address", "ip", _made(AddressSessions, limits.address), lambda r: not (r.note or r.bad) and known_address(r.ip), lambda a, r, now: None if a.admit(r.session, now) else "address", cap, limits.sweep_secs, False)),
    ]


def refusals(spark: SparkSession, folder: str) -> DataFrame:
    """The notes that sinks left in a folder, as a stream."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)
    return spark.readStream.schema(NOTE).option("recursiveFileLookup", "true").parquet(folder)


def write_refusals(decided: DataFrame, folder: str, batch: int) -> None:
    """Leave notes of a batch's refused requests of known addresses; a batch that is repeated replaces its own."""
    late = decided.where("refused in ('session', 'address')").select(*(x.split()[0] for x in NOTE.split(", ")))
    late.coalesce(1).write.mode("overwrite").parquet(f"{folder}/batch-{batch}")


def decided(requests: DataFrame, limits: Limits, notes: DataFrame | None = None) -> DataFrame:
    """A stream of requests (REQUEST and other columns) with `refused`: null, ban, bad, session or address."""
    spark = requests.sparkSession
    ship(spark)
    for module in (sys.modules[__name__], limit_classes):  # the driver's own worker sees no shipped files
        cloudpickle.register_pickle_by_value(module)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # the store that arbitrary state needs
    rows = requests.withColumn("note", F.lit(False))
    if notes is not None:
        rows = rows.unionByName(notes.withColumn("note", F.lit(True)), allowMissingColumns=True)
    rows = rows.withColumn("refused", F.when(F.col("bad") & ~F.coalesce(F.col("ip").isNotNull() & ~F.trim("ip").isin("", "0.0.0.0", "::"), F.lit(False)), "bad")).withWatermark("at", limits.delay)
    for column, processor in processors(limits):
        # Rows that the limit doesn't see are spread by their request.
        spread = F.when(F.col("note") & F.lit(column != "ip"), F.col("request")).otherwise(F.coalesce(F.nullif(column, F.lit("")), "request"))
        dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(spread), F.lit(limits.buckets)).cast("int"))
        names = [f.name for f in dealt.schema if f.name != "bucket"]
        rows = dealt.groupBy("bucket").transformWithStateInPandas(_Named(processor, names), dealt.select(*names).schema, "Append", "EventTime", eventTimeColumnName="at")
    return rows.where(~F.col("note")).drop("note")


class _Named(StatefulProcessor):
    """A processor whose rows have the columns of its output, in their order."""

    def __init__(self, inner: Keyed, names: list[str]):
        self.inner, self.names = inner, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.inner.init(handle)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for frame in self.inner.handleInputRows(key, rows, timerValues):
            yield frame[self.names]

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        return self.inner.handleExpiredTimer(key, timerValues, expiredTimerInfo)

    def close(self) -> None:
        pass
