"""Admission limits as keyed state: token buckets, sessions of an address, bans after bad requests.

Each limit is a small class over event time, and a stateful operator that runs it for every key. The order is session,
address, global; what a later limit refuses is not given back to an earlier one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, StructField, StructType

from signalfold.session import ship

#: Rates a second and bursts, sessions of an address and their window, bad requests and bans (fixed values).
SESSION_RATE, SESSION_BURST, GLOBAL_RATE, GLOBAL_BURST = 100.0, 1_000.0, 50_000.0, 100_000.0
ADDRESS_SESSIONS, ADDRESS_WINDOW = 200, 1_800.0
BAD_REQUESTS, BAD_WINDOW, BAN_SECONDS = 100, 60.0, 300.0
#: Addresses that stand for none (fixed values).
UNKNOWN = ("", "0.0.0.0", "::")


@dataclass
class TokenBucket:
    rate: float
    burst: float
    tokens: float | None = None
    last: float = 0.0

    def take(self, n: float, now: float) -> bool:
        if self.tokens is None:
            self.tokens, self.last = self.burst, now
        self.tokens = min(self.burst, self.tokens + max(0.0, now - self.last) * self.rate)
        self.last = now
        if self.tokens < n:
            return False
        self.tokens -= n
        return True


@dataclass
class AddressSessions:
    cap: int = ADDRESS_SESSIONS
    window: float = ADDRESS_WINDOW
    seen: dict[str, float] = field(default_factory=dict)

    def admit(self, session: str, now: float) -> bool:
        """A known session is refreshed; a refused one leaves no trace."""
        self.seen = {s: t for s, t in self.seen.items() if now - t < self.window}
        if session not in self.seen and len(self.seen) >= self.cap:
            return False
        self.seen[session] = now
        return True


@dataclass
class BadRequests:
    threshold: int = BAD_REQUESTS
    window: float = BAD_WINDOW
    ban: float = BAN_SECONDS
    count: int = 0
    start: float | None = None
    until: float = 0.0

    def banned(self, now: float) -> bool:
        return now < self.until

    def record(self, now: float) -> bool:
        """Count a bad request; True if it starts a ban, after which counting begins anew."""
        fresh = self.start is None or now - self.start > self.window
        bad = 1 if fresh else self.count + 1
        full = bad >= self.threshold
        self.start = now if fresh or full else self.start
        self.count = 0 if full else bad
        self.until = now + self.ban if full else self.until
        return full


def _stateful(df: DataFrame, key: str, make, step, ttl_ms: int) -> DataFrame:
    """Adds `allowed` to the rows, run in order of `at` through the key's object, which keys lose when event time is past the ttl."""
    schema = StructType([*df.schema.fields, StructField("allowed", BooleanType())])

    ship(df.sparkSession)

    def run(_: Any, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        obj = make(**json.loads(state.get[0])) if state.exists else make()
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        rows["allowed"] = [step(obj, r, r.at.timestamp()) for r in rows.itertuples()]
        state.update((json.dumps(vars(obj)),))
        state.setTimeoutTimestamp(max(int(rows["at"].iloc[-1].timestamp() * 1000), state.getCurrentWatermarkMs()) + ttl_ms)
        yield rows

    timed = df.withWatermark("at", f"{ttl_ms} milliseconds")
    return timed.groupBy(key).applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.EventTimeTimeout)


def session_limit(df: DataFrame, rate: float = SESSION_RATE, burst: float = SESSION_BURST) -> DataFrame:
    """df (session, cost, at, ...): a bucket for each session."""
    return _stateful(df, "session", lambda **s: TokenBucket(**({"rate": rate, "burst": burst} | s)), lambda b, r, now: b.take(float(r.cost), now), 3_600_000)


def known_address(ip) -> bool:
    """Senders without an address share no limit and no ban."""
    return isinstance(ip, str) and ip.strip() not in UNKNOWN


def address_limit(df: DataFrame, cap: int = ADDRESS_SESSIONS, window: float = ADDRESS_WINDOW) -> DataFrame:
    """df (session, ip, at, ...): distinct sessions of each address within the window; unknown addresses are always allowed."""

    def step(a: AddressSessions, r: Any, now: float) -> bool:
        return not known_address(r.ip) or a.admit(r.session, now)

    return _stateful(df, "ip", lambda **s: AddressSessions(**({"cap": cap, "window": window} | s)), step, int(window * 2000))


def global_limit(df: DataFrame, rate: float = GLOBAL_RATE, burst: float = GLOBAL_BURST) -> DataFrame:
    """df (everyone, cost, at, ...): one bucket, hence one key; it sees admission requests, not records."""
    return _stateful(df, "everyone", lambda **s: TokenBucket(**({"rate": rate, "burst": burst} | s)), lambda b, r, now: b.take(float(r.cost), now), 3_600_000)


def ban_limit(df: DataFrame, threshold: int = BAD_REQUESTS, window: float = BAD_WINDOW, ban: float = BAN_SECONDS) -> DataFrame:
    """df (ip, bad, at, ...): false while the address is banned; bad requests count towards the next ban. Unknown addresses are never banned."""

    def step(b: BadRequests, r: Any, now: float) -> bool:
        if not known_address(r.ip):
            return True
        if b.banned(now):
            return False
        if r.bad:
            b.record(now)
        return True

    return _stateful(df, "ip", lambda **s: BadRequests(**({"threshold": threshold, "window": window, "ban": ban} | s)), step, int((window + ban) * 2000))


def admit(session: TokenBucket, address: AddressSessions | None, everyone: TokenBucket, name: str, cost: float, now: float) -> str | None:
    """The limit that refuses, if any, in their order; address: None for an unknown one. A request costs 1 at least."""
    cost = max(cost, 1.0)
    if not session.take(cost, now):
        return "session"
    if address and not address.admit(name, now):
        return "address"
    return None if everyone.take(cost, now) else "global"
