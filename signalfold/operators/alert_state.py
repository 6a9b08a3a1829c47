"""The alert state machine, pure over (state, evaluation): ok <-> firing, with a cooldown for each key."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from datetime import datetime

from signalfold.operators.evaluate import composite, group_counts, new_groups, values
from signalfold.operators.rules import GROUPED, Rule, describe

FIRING, RESOLVED = "firing", "resolved"


@dataclass
class KeyState:
    firing: bool = False
    last_notified: datetime | None = None


@dataclass(frozen=True)
class Alert:
    rule_name: str
    severity: str
    state: str
    value: float
    threshold: float
    description: str
    group_key: str | None = None


Notifier = Callable[[Alert], bool]
State = dict[str, KeyState]


@dataclass
class Sink:
    """Notifiers by action type; a rule without actions goes to the defaults."""

    defaults: list[Notifier] = field(default_factory=list)
    by_type: Mapping[str, Callable[[dict], Notifier]] = field(default_factory=dict)

    def send(self, rule: Rule, alert: Alert) -> bool:
        chosen = [self.by_type[a["type"]](a) for a in rule.actions if a["type"] in self.by_type] if rule.actions else self.defaults
        sent = False
        for n in chosen:
            try:
                sent = n(alert) is not False or sent
            except Exception:  # noqa: BLE001  one channel's failure leaves the others alone
                continue
        return sent


def transition(state: State, key: str, breaching: bool, rule: Rule, value: float, now: datetime, sink: Sink, group_key: str | None = None) -> Alert | None:
    """Move a key; the alert if one was delivered. The flag moves even if the cooldown or a failure keeps it silent."""
    entry = state.setdefault(key, KeyState())
    before, entry.firing = entry.firing, breaching
    if before == breaching:
        return None
    if entry.last_notified is not None and max(0.0, (now - entry.last_notified).total_seconds()) < rule.cooldown_secs:
        return None
    alert = Alert(rule.name, rule.severity, FIRING if breaching else RESOLVED, value, rule.threshold, describe(rule), group_key)
    if not sink.send(rule, alert):
        return None
    entry.last_notified = now
    return alert


def apply_groups(state: State, rule: Rule, groups: Iterable[tuple[str, float]], now: datetime, sink: Sink) -> list[Alert]:
    """One state for each group; firing groups that are gone resolve with value 0."""
    out, prefix, seen = [], f"{rule.name}::", set()
    for key, n in groups:
        seen.add(key)
        out.append(transition(state, prefix + key, rule.breaches(n), rule, float(n), now, sink, key))
    for full in [k for k, v in state.items() if v.firing and k.startswith(prefix) and k[len(prefix):] not in seen]:
        out.append(transition(state, full, False, rule, 0.0, now, sink, full[len(prefix):]))
    return [a for a in out if a]


def evaluate_once(tables: Mapping, rules: Iterable[Rule], state: State, now: datetime, sink: Sink) -> list[Alert]:
    """One evaluation of all rules: scalar ones in fused scans, grouped ones each in theirs."""
    rules = list(rules)
    scalar = [r for r in rules if r.kind not in GROUPED and r.kind != "composite"]
    found = {r.rule: r.value for r in values(tables, scalar, now).collect()} if scalar else {}
    out: list[Alert] = []
    for r in rules:
        if r.kind in GROUPED:
            df = (new_groups if r.kind == "log_new_signature" else group_counts)(tables["logs"], r, now)
            out += apply_groups(state, r, ((x.group_key, x.n) for x in df.toLocalIterator()), now, sink)
            continue
        if r.kind == "composite":
            row = composite(tables, r, now).first()
            value, breaching = row.value, row.breaching
        else:
            value, breaching = found[r.name], r.breaches(found[r.name])
        if a := transition(state, r.name, breaching, r, value, now, sink):
            out.append(a)
    return out
