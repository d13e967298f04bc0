"""Instants of event time.  ``None`` stands for the current state, which isn't "as of now"."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from tidemark.errors import TimeError

EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
_RFC3339 = re.compile(r"(\d{4}-\d\d-\d\d)[Tt ](\d\d:\d\d:\d\d)(?:\.(\d{1,9}))?([Zz]|[+-]\d\d:\d\d)")


def parse_instant(text: str) -> datetime:
    """An RFC 3339 instant in UTC; an offset is required, digits beyond microseconds are cut."""
    m = _RFC3339.fullmatch(text.strip())
    if not m:
        raise TimeError(f"not an RFC 3339 instant: {text!r}")
    zone = "+00:00" if m[4] in "Zz" else m[4]
    try:
        return datetime.fromisoformat(f"{m[1]}T{m[2]}.{(m[3] or '0')[:6].ljust(6, '0')}{zone}").astimezone(UTC)
    except ValueError as e:
        raise TimeError(f"not an RFC 3339 instant: {text!r}") from e


def instant(value: str | datetime | None) -> datetime | None:
    if value is None or isinstance(value, datetime):
        if value is not None and value.tzinfo is None:
            raise TimeError("an instant needs a time zone")
        return value if value is None else value.astimezone(UTC)
    return parse_instant(value)


def format_instant(at: datetime) -> str:
    return at.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"


def micros(at: datetime) -> int:
    return (at - EPOCH) // timedelta(microseconds=1)
