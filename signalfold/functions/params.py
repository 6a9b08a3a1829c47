"""Query parameters: instants, durations and limits."""

from __future__ import annotations

import re
from datetime import UTC, datetime

#: Default and greatest row limits of the read queries (fixed values).
READ_LIMIT, READ_LIMIT_MAX = 100, 1000
JOURNEY_LIMIT, JOURNEY_LIMIT_MAX = 20, 200

_UNITS = {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86400}
_OFFSET = re.compile(r"(?:[zZ]|[+-]\d\d:\d\d)$")


def clamp_limit(n: int | None, default: int = READ_LIMIT, most: int = READ_LIMIT_MAX) -> int:
    return max(1, min(default if n is None else n, most))


def parse_instant(value: str | None, name: str = "value") -> datetime | None:
    """An RFC 3339 instant in UTC; None for nothing or blanks; ValueError names the parameter."""
    text = (value or "").strip()
    if not text:
        return None
    try:
        if not _OFFSET.search(text) or len(text) < 20:
            raise ValueError
        return datetime.fromisoformat(text.upper().replace("Z", "+00:00")).astimezone(UTC)
    except ValueError:
        raise ValueError(f"{name}: not an RFC 3339 instant: {value!r}") from None


def parse_duration(value: str) -> float:
    """Seconds of 200ms, 15s, 30m, 24h, 31d."""
    m = re.fullmatch(r"\s*(\d+)\s*(ms|s|m|h|d)\s*", value)
    if not m:
        raise ValueError(f"not a duration: {value!r}")
    return int(m[1]) * _UNITS[m[2]]
