"""Seasonal periods of an interval."""

from __future__ import annotations

from seriesloom.meta import MONTHS, SECONDS, Interval

#: Length in seconds of the periods that a sub-daily index may have, longest first.
_LONG = {"year": 31557600.0, **SECONDS}


def common_periods(interval: Interval) -> dict[str, float]:
    """Names and lengths (in steps) of the usual seasons; an irregular index and plain numbers have period 1."""
    n, unit = interval.n, interval.unit
    if unit == "unit" or not n:
        return {"none": 1.0}
    if unit in MONTHS:
        return {"year": 12 / MONTHS[unit] / n}
    if unit == "week":
        return {"year": 52 / n}
    if unit == "day":
        return {"year": 365.25 / n, "week": 7 / n}
    step = SECONDS[unit] * n
    return {k: s / step for k, s in _LONG.items() if s / step > 1}


def get_frequencies(period: float | str | list | None, interval: Interval, auto: str = "smallest") -> list[float]:
    """Numbers stay; names and durations (``7 days``) become steps; None takes the smallest, largest or all common periods."""
    if period is None:
        some = sorted(p for p in common_periods(interval).values() if p >= 1) or [1.0]
        return {"smallest": some[:1], "largest": some[-1:], "all": some}[auto]
    if isinstance(period, list):
        return [f for p in period for f in get_frequencies(p, interval, auto)]
    if isinstance(period, str):
        known = common_periods(interval)
        if period in known:
            return [known[period]]
        n, _, unit = period.rpartition(" ")
        unit = unit.rstrip("s")
        size = float(n or 1) * _seconds(unit)
        return [size / (_seconds(interval.unit) * interval.n)]
    return [float(period)]


def _seconds(unit: str) -> float:
    if unit in MONTHS:
        return 31557600.0 / 12 * MONTHS[unit]
    return SECONDS[unit]


def seasonal_lag(period: float | str | None, interval: Interval) -> int:
    """The period as a whole number of rows: fractions are cut."""
    return max(1, int(get_frequencies(period, interval)[0]))
