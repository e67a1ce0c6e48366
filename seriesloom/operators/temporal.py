"""Calendar windows, gaps and future dates."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.calendar import get_frequencies
from seriesloom.meta import MONTHS, SeriesFrame, join_on, quoted


def parse_window(window: str) -> tuple[int, str]:
    """``2 weeks`` as (2, week)."""
    m = re.fullmatch(r"(?:(\d+)\s+)?(day|week|month|quarter|year)s?", window.strip())
    if not m:
        raise ValueError(f"not a window of days, weeks, months, quarters or years: {window}")
    return int(m[1] or 1), m[2]


def bin_start(day: Column, n: int, unit: str, origin: Column, shift: Column | int = 0) -> Column:
    """Start of the half-open bin that holds ``day``.

    Bins begin at the start of ``origin``'s unit (weeks on Monday) and are ``n``
    units long; all are moved by ``shift`` days.
    """
    d = F.date_sub(day, F.lit(shift) if isinstance(shift, int) else shift)
    if unit in ("day", "week"):
        width = n * (7 if unit == "week" else 1)
        first = F.trunc(origin, "week") if unit == "week" else origin
        start = F.date_add(first, (F.floor(F.datediff(d, first) / width) * width).cast("int"))
    else:
        width = n * MONTHS[unit]
        first = F.trunc(origin, unit)
        months = (F.year(d) - F.year(first)) * 12 + F.month(d) - F.month(first)
        start = F.add_months(first, (F.floor(months / width) * width).cast("int"))
    return F.date_add(start, F.lit(shift) if isinstance(shift, int) else shift)


def bin_end(start: Column, n: int, unit: str, shift: Column | int = 0) -> Column:
    s = F.lit(shift) if isinstance(shift, int) else shift
    if unit in ("day", "week"):
        return F.date_add(start, F.lit(n * (7 if unit == "week" else 1)))
    return F.date_add(F.add_months(F.date_sub(start, s), F.lit(n * MONTHS[unit])), s)


def aggregate_index(frame: SeriesFrame, window: str, aggs: Mapping[str, Column], offset: str | None = "end", bin_size: int | None = None) -> SeriesFrame:
    """Aggregate a daily series to calendar windows; windows that lack days are left out.

    ``offset`` moves all windows: ``start`` so that one begins at the first day,
    ``end`` so that one ends before the last day (which, the bins being half-open,
    is in none), None not at all.  First and last day are those of the whole
    table.  A window is complete with as many rows as it has days, or
    ``bin_size``.
    """
    n, unit = parse_window(window)
    day = F.col(f"`{frame.index}`").cast("date")
    ends = frame.df.agg(F.min(day).alias("__lo"), F.max(day).alias("__hi"))
    df = frame.df.join(F.broadcast(ends))  # one row
    if offset in ("end", True):
        last = bin_start(F.col("__hi"), n, unit, F.col("__lo"))
        shift: Column | int = F.datediff("__hi", last)
    elif offset == "start":
        shift = F.datediff("__lo", bin_start(F.col("__lo"), n, unit, F.col("__lo")))
    elif offset in (None, "none", False):
        shift = 0
    else:
        raise ValueError("offset is start, end or None")
    df = df.withColumn("__shift", shift if isinstance(shift, Column) else F.lit(shift))
    if offset in ("end", True):
        df = df.filter(day < F.col("__hi"))
    df = df.withColumn("__bin", bin_start(day, n, unit, F.col("__lo"), F.col("__shift")))
    out = df.groupBy(*quoted(frame.key), "__bin", "__shift").agg(*[c.alias(k) for k, c in aggs.items()], F.count("*").alias("__n"))
    need = F.lit(bin_size) if bin_size else F.datediff(bin_end(F.col("__bin"), n, unit, F.col("__shift")), F.col("__bin"))
    out = out.filter(F.col("__n") == need).select(*quoted(frame.key), F.col("__bin").alias(frame.index), *aggs)
    return SeriesFrame(out, frame.key, frame.index, replace(frame.interval, unit=unit, n=n))


def horizon(frame: SeriesFrame, h: int | str | None) -> int:
    """Rows to forecast: a number, a duration, or twice the smallest season."""
    if h is None:
        return round(2 * get_frequencies(None, frame.interval)[0])
    return round(min(get_frequencies(h, frame.interval)))


def future(frame: SeriesFrame, h: int | str | None = None) -> SeriesFrame:
    """The next ``h`` index values of each series, and ``h`` from 1."""
    n = horizon(frame, h)
    last = frame.df.groupBy(*quoted(frame.key)).agg(F.max(frame.index).alias("__last"))
    rows = last.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return replace(SeriesFrame(rows, frame.key, frame.index, frame.interval), df=rows.select(*quoted(frame.key), frame.interval.step(F.col("__last"), F.col("h")).alias(frame.index), "h"))


def fill_gaps(frame: SeriesFrame, full: bool = False) -> SeriesFrame:
    """Rows for missing index values, null otherwise; ``full``: from the first to the last day of the table for every series."""
    unit, n = frame.interval.unit, int(frame.interval.n)
    i = F.col(f"`{frame.index}`")
    ends = frame.df.groupBy(*quoted(frame.key)).agg(F.min(i).alias("__lo"), F.max(i).alias("__hi"))
    if full:
        both = frame.df.agg(F.min(i).alias("__lo"), F.max(i).alias("__hi"))
        ends = ends.drop("__lo", "__hi").join(F.broadcast(both))  # one row
    by = F.lit(n) if unit == "unit" else F.expr(f"INTERVAL {n * (3 if unit == 'quarter' else 1)} {'month' if unit == 'quarter' else unit}")
    grid = ends.select(*quoted(frame.key), F.explode(F.sequence("__lo", "__hi", by)).alias(frame.index))
    return replace(frame, df=join_on(grid, frame.df, [*frame.key, frame.index], "left").select(*frame.df.columns))


def gaps(frame: SeriesFrame) -> DataFrame:
    """(key, before, after, n): runs of missing index values of daily and coarser series."""
    w = frame.window()
    nxt = F.lead(frame.index).over(w)
    rows = frame.df.select(*quoted(frame.key), F.col(f"`{frame.index}`").alias("before"), nxt.alias("after"))
    unit = frame.interval.unit
    if unit in MONTHS:
        n = F.months_between("after", "before") / (MONTHS[unit] * frame.interval.n)
    elif unit == "unit":
        n = (F.col("after") - F.col("before")) / frame.interval.n
    else:
        n = F.datediff("after", "before") / (7 if unit == "week" else 1) / frame.interval.n
    return rows.withColumn("n", (F.round(n) - 1).cast("long")).filter("n > 0")
