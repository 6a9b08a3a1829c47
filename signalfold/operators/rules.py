"""Alert rules: parsing, validation, project defaults and the text of their condition."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace
from typing import Any

from signalfold.functions.predicates import group_expr_key

KINDS = (
    "log_count", "log_group_count", "metric_threshold", "telemetry_count", "error_ratio", "span_duration", "relative_change", "composite", "log_new_signature", "anomaly",
)
GROUPED = ("log_group_count", "log_new_signature")
SOURCES = ("logs", "events", "spans", "metrics")
AGGREGATES = ("avg", "max", "min", "sum", "count", "last", "p50", "p90", "p95", "p99")
QUANTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
COMPARATORS: dict[str, tuple[str, Callable[[float, float], bool]]] = {
    "gt": (">", lambda a, b: a > b), "gte": (">=", lambda a, b: a >= b), "lt": ("<", lambda a, b: a < b), "lte": ("<=", lambda a, b: a <= b),
}
OPS = {"all": ("ALL", " AND "), "any": ("ANY", " OR ")}
ACTIONS = {"slack": ("channel",), "email": ("to",), "webhook": ("url", "headers")}
DAY = 86_400


class RuleError(ValueError):
    pass


@dataclass(frozen=True)
class Rule:
    kind: str = "log_count"
    name: str = ""
    source: str = "logs"
    service: str | None = None
    tenant: str | None = None
    severity_min: int | None = None
    metric_name: str | None = None
    agg: str | None = None
    event_name: str | None = None
    operation: str | None = None
    error_only: bool = False
    min_count: int = 0
    baseline_secs: int | None = None
    window_secs: int = 0
    comparator: str = "gt"
    threshold: float = 0.0
    cooldown_secs: int = 0
    severity: str = "warning"
    group_by: str | None = None
    op: str | None = None
    conditions: tuple[Rule, ...] = ()
    actions: tuple[dict, ...] = field(default=(), hash=False)

    @property
    def breaches(self) -> Callable[[float], bool]:
        test = COMPARATORS[self.comparator][1]
        return lambda value: test(value, self.threshold)

    @property
    def baseline(self) -> int:
        if self.baseline_secs is not None:
            return self.baseline_secs
        return 30 * self.window_secs if self.kind == "anomaly" else DAY


def _choice(value: Any, allowed, what: str) -> None:
    if value not in allowed:
        raise RuleError(f"{what}: {value!r} is none of {', '.join(allowed)}")


def rule_of(spec: dict[str, Any]) -> Rule:
    known = {f.name for f in fields(Rule)}
    if unknown := set(spec) - known:
        raise RuleError(f"unknown fields: {', '.join(sorted(unknown))}")
    if "kind" not in spec:
        raise RuleError("a rule needs a kind")
    values = dict(spec)
    values["conditions"] = tuple(rule_of(c) for c in spec.get("conditions") or ())
    values["actions"] = tuple(spec.get("actions") or ())
    return Rule(**values)


def validate(rule: Rule, inside: bool = False) -> Rule:
    """The rule itself, or RuleError. `inside`: as a condition of a composite, which has no name."""
    who = f"rule {rule.name!r}"
    if not inside and not rule.name.strip():
        raise RuleError("a rule needs a name")
    _choice(rule.kind, KINDS, f"{who}: kind")
    _choice(rule.source, SOURCES, f"{who}: source")
    _choice(rule.comparator, COMPARATORS, f"{who}: comparator")
    if rule.agg is not None:
        _choice(rule.agg, AGGREGATES, f"{who}: agg")
    if rule.op is not None:
        _choice(rule.op, OPS, f"{who}: op")
    if rule.kind == "composite":
        if inside:
            raise RuleError(f"{who}: a composite can't be a condition")
        if not rule.conditions:
            raise RuleError(f"{who}: a composite needs conditions")
        for c in rule.conditions:
            validate(c, True)
    elif rule.window_secs <= 0:
        raise RuleError(f"{who}: window_secs must be above 0")
    elif rule.kind == "metric_threshold" and not (rule.metric_name and rule.agg):
        raise RuleError(f"{who}: metric_threshold needs metric_name and agg")
    elif rule.kind == "error_ratio" and rule.source not in ("logs", "spans"):
        raise RuleError(f"{who}: error_ratio needs logs or spans")
    elif rule.kind in GROUPED:
        if inside:
            raise RuleError(f"{who}: {rule.kind} can't be a condition")
        try:
            group_expr_key(rule.group_by)
        except ValueError as e:
            raise RuleError(f"{who}: {e}") from None
    for a in rule.actions:
        _choice(a.get("type"), ACTIONS, f"{who}: action")
        if set(a) - {"type", *ACTIONS[a["type"]]}:
            raise RuleError(f"{who}: unknown fields in an action")
        if a["type"] == "webhook" and not str(a.get("url") or "").strip():
            raise RuleError(f"{who}: a webhook needs a url")
    return rule


def parse_rules(text: str) -> list[Rule]:
    try:
        spec = json.loads(text)
    except ValueError as e:
        raise RuleError(f"not JSON: {e}") from None
    return [validate(rule_of(r)) for r in spec.get("rules", [])]


def with_defaults(rule: Rule, service: str | None = None, tenant: str | None = None) -> Rule:
    """A project's service and tenant where the rule or a condition names none."""
    inner = tuple(with_defaults(c, service, tenant) for c in rule.conditions)
    return replace(rule, service=rule.service or service, tenant=rule.tenant or tenant, conditions=inner)


def _number(x: float) -> str:
    """As the notifications print it: no trailing zeros."""
    return str(int(x)) if float(x).is_integer() and abs(x) < 1e16 else repr(float(x))


def _filters(r: Rule) -> str:
    named = (("service=", r.service), ("severity>=", r.severity_min), ("event=", r.event_name), ("op=", r.operation), ("metric=", r.metric_name))
    return " ".join([r.source, *(f"{k}{v}" for k, v in named if v is not None), *(["errors"] if r.error_only else [])])


def describe(r: Rule) -> str:
    """The canonical text of a rule's condition."""
    test = f"{COMPARATORS[r.comparator][0]} {_number(r.threshold)}"
    over = f"over {r.window_secs}s"
    if r.kind in ("log_count", "log_group_count"):
        least = "" if r.severity_min is None else f", severity>={r.severity_min}"
        by = "" if r.kind == "log_count" else f" by {r.group_by or 'body'}"
        return f"count(logs service={r.service or '*'}{least}){by} {test} {over}"
    if r.kind == "metric_threshold":
        return f"{r.agg or 'avg'}({r.metric_name or ''}) {test} {over}"
    if r.kind == "telemetry_count":
        return f"count({_filters(r)}) {test} {over}"
    if r.kind == "error_ratio":
        return f"error_ratio({_filters(r)}) {test} {over}"
    if r.kind == "span_duration":
        what = f"service={r.service or '*'}" + (f" op={r.operation}" if r.operation is not None else "") + (" errors" if r.error_only else "")
        return f"{r.agg or 'p95'}(span.duration_ms {what}) {test}ms {over}"
    if r.kind == "relative_change":
        return f"change({_filters(r)}) {test}x vs previous {r.window_secs}s"
    if r.kind == "log_new_signature":
        return f"new signature({_filters(r)} by {r.group_by or 'body'}, baseline {r.baseline}s) {test} {over}"
    if r.kind == "anomaly":
        return f"anomaly(count {_filters(r)}) z {test} {over} baseline {r.baseline}s"
    word, joint = OPS[r.op or "all"]
    return f"{word} of [{joint.join(map(describe, r.conditions))}]"
