"""Relative date ranges, resolved once to constants so that they reach the scan."""

from __future__ import annotations

from datetime import date, datetime, timedelta

LAST_DAYS = {"last 7 days": 7, "last 10 days": 10, "last 30 days": 30}
NAMED = ("today", "yesterday", "this week", "last week", "this month", "last month", "this quarter", "last quarter", "this year", "last year", "year to date")
UNITS = ("days", "weeks", "months", "quarters", "years")


def _months(d: date, n: int) -> date:
    k = d.year * 12 + d.month - 1 + n
    return date(k // 12, k % 12 + 1, 1)


def start(d: date, unit: str) -> date:
    """First day of the unit that holds d; weeks begin on Sunday."""
    if unit == "days":
        return d
    if unit == "weeks":
        return d - timedelta(days=(d.weekday() + 1) % 7)
    if unit == "months":
        return d.replace(day=1)
    if unit == "quarters":
        return date(d.year, (d.month - 1) // 3 * 3 + 1, 1)
    return date(d.year, 1, 1)


def step(d: date, unit: str, n: int) -> date:
    if unit == "days":
        return d + timedelta(days=n)
    if unit == "weeks":
        return d + timedelta(weeks=n)
    return _months(d, n * {"months": 1, "quarters": 3, "years": 12}[unit])


def named_range(op: str, now: datetime) -> tuple[date, date | None]:
    """[from, to) of a named range; None: open."""
    d = now.date()
    if op in LAST_DAYS:
        return d - timedelta(days=LAST_DAYS[op]), None
    if op == "today":
        return d, d + timedelta(days=1)
    if op == "yesterday":
        return d - timedelta(days=1), d
    if op == "year to date":
        return start(d, "years"), d + timedelta(days=1)
    which, unit = op.split()
    s = start(d, f"{unit}s")
    return (s, step(s, f"{unit}s", 1)) if which == "this" else (step(s, f"{unit}s", -1), s)


def relative_range(period: str, n: int, unit: str, now: datetime) -> tuple[date, date]:
    """previous: n units before the current one; this: the current one; next: n units after it."""
    if unit not in UNITS:
        raise ValueError(f"unknown date unit: {unit}")
    s = start(now.date(), unit)
    if period == "previous":
        return step(s, unit, -n), s
    if period == "this":
        return s, step(s, unit, 1)
    if period == "next":
        return step(s, unit, 1), step(s, unit, 1 + n)
    raise ValueError(f"unknown period: {period}")


def previous_start(op: str, now: datetime) -> date:
    """Where the period before a named range begins; it ends where the range begins."""
    d, (lo, hi) = now.date(), named_range(op, now)
    if op in LAST_DAYS:
        return d - timedelta(days=2 * LAST_DAYS[op])
    if op in ("today", "yesterday"):
        return lo - timedelta(days=1)
    unit = "years" if op == "year to date" else f"{op.split()[1]}s"
    return step(lo, unit, -1)
