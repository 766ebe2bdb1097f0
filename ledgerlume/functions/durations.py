"""Durations written as "1d", "12h", "2w", "30s", "15min"."""

from __future__ import annotations

import re

UNITS = {"d": 86_400_000_000, "h": 3_600_000_000, "w": 604_800_000_000, "s": 1_000_000, "min": 60_000_000, "ms": 1000, "us": 1}


def duration_us(spec: str) -> int:
    """Microseconds of a duration; several parts add up."""
    parts = re.findall(r"(\d+(?:\.\d+)?)\s*([a-z]+)", spec.strip().lower())
    if not parts or any(u.rstrip("s") not in UNITS and u not in UNITS for _, u in parts):
        raise ValueError(f"not a duration: {spec!r}")
    return round(sum(float(n) * UNITS.get(u, UNITS.get(u.rstrip("s"), 0)) for n, u in parts))
