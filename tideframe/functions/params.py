"""Checks of parameters, on the driver."""

from __future__ import annotations

from collections.abc import Iterable


def allowed(name: str, value: str, values: Iterable[str]) -> str:
    """``value`` if it is one of ``values``; else an error that names them, sorted."""
    values = sorted(set(values))
    if value not in values:
        raise ValueError(f"{name}={value!r} is not allowed. Allowed values: {', '.join(values)}")
    return value


def allowed_list(name: str, text: str, values: Iterable[str]) -> list[str]:
    """The parts of a comma-separated parameter; none, or one that isn't allowed, is an error."""
    parts = [p.strip() for p in text.split(",") if p.strip()]
    if not parts:
        raise ValueError(f"{name} must name at least one value")
    return [allowed(name, p, values) for p in parts]


def time_range(start: int | None, end: int | None) -> tuple[int | None, int | None]:
    if start is not None and end is not None and start > end:
        raise ValueError("start must not be after end")
    return start, end


def positive(name: str, n: int) -> int:
    if n <= 0:
        raise ValueError(f"{name} must be positive")
    return n
