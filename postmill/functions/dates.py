"""Dates of queries and options, read on the driver."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

_UNITS = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 1e-3, "us": 1e-6, "ns": 1e-9}


def parse_date(text: str) -> datetime | None:
    """YYYY-MM-DD or an RFC 3339 time, in UTC; None for anything else."""
    if re.fullmatch(r"\d{4}-\d\d-\d\d(T\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d))?", text or ""):
        try:
            found = datetime.fromisoformat(text)
        except ValueError:
            return None
        return (found if found.tzinfo else found.replace(tzinfo=timezone.utc)).astimezone(timezone.utc)
    return None


def parse_since(text: str, now: datetime) -> datetime:
    """A date, days or weeks back (30d, 4w), or hours, minutes and seconds back (1h30m); ValueError otherwise."""
    text = text.strip()
    if found := parse_date(text.replace("/", "-") if re.fullmatch(r"\d{4}/\d\d/\d\d", text) else text):
        return found
    if m := re.fullmatch(r"([+-]?\d+)([dw])", text):
        return now - timedelta(days=int(m[1]) * (7 if m[2] == "w" else 1))
    if m := re.fullmatch(r"([+-]?)((?:\d+(?:\.\d*)?(?:h|ms|m|us|ns|s))+)", text):
        seconds = sum(float(n) * _UNITS[u] for n, u in re.findall(r"(\d+(?:\.\d*)?)(h|ms|m|us|ns|s)", m[2]))
        return now - timedelta(seconds=-seconds if m[1] == "-" else seconds)
    raise ValueError(f"not a date or a window: {text!r} (30d, 4w, 720h and 2026-07-01 are)")
