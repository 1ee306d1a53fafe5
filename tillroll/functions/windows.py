"""Date windows that the analyses hang off an explicit ``as_of`` date.

The reference scripts compute these from CURRENT_DATE(); here every window is
a pure function of ``as_of`` so runs are reproducible.  All bounds are
inclusive (SQL BETWEEN).
"""

from __future__ import annotations

import calendar
import datetime as dt
from typing import NamedTuple


class Window(NamedTuple):
    start: dt.date
    end: dt.date


def as_date(value) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.date.fromisoformat(str(value))


def add_months(day: dt.date, months: int) -> dt.date:
    """Calendar month shift with end-of-month clamping (like Spark add_months)."""
    total = day.year * 12 + (day.month - 1) + months
    year, month = divmod(total, 12)
    month += 1
    return dt.date(year, month, min(day.day, calendar.monthrange(year, month)[1]))


def add_years(day: dt.date, years: int) -> dt.date:
    return add_months(day, 12 * years)


def month_start(day: dt.date) -> dt.date:
    return day.replace(day=1)


def month_end(day: dt.date) -> dt.date:
    return day.replace(day=calendar.monthrange(day.year, day.month)[1])


def trailing_year(as_of) -> Window:
    """Last day of the previous month, and one year before it (1 year + 1 day)."""
    end = month_start(as_date(as_of)) - dt.timedelta(days=1)
    return Window(add_years(end, -1), end)


def prior_trailing_year(as_of) -> Window:
    cur = trailing_year(as_of)
    return Window(add_years(cur.start, -1), add_years(cur.end, -1))


def previous_calendar_year(as_of) -> Window:
    y = as_date(as_of).year - 1
    return Window(dt.date(y, 1, 1), dt.date(y, 12, 31))


def calendar_years_back(as_of, first_back: int = 3, last_back: int = 1) -> Window:
    y = as_date(as_of).year
    return Window(dt.date(y - first_back, 1, 1), dt.date(y - last_back, 12, 31))


def year_to_date(as_of) -> Window:
    """Jan 1 of the as_of year up to yesterday (empty on Jan 1)."""
    d = as_date(as_of)
    return Window(dt.date(d.year, 1, 1), d - dt.timedelta(days=1))


def year_to_yesterday(as_of) -> Window:
    """Jan 1 of yesterday's year up to yesterday."""
    y = as_date(as_of) - dt.timedelta(days=1)
    return Window(dt.date(y.year, 1, 1), y)


def last_days(as_of, back: int = 16) -> Window:
    d = as_date(as_of)
    return Window(d - dt.timedelta(days=back), d)


def kpi_months(as_of) -> list[Window]:
    """The month before yesterday's month and yesterday's month.

    Each window runs from the first of the month to its last day, the last one
    cut at yesterday.
    """
    yesterday = as_date(as_of) - dt.timedelta(days=1)
    first = add_months(month_start(yesterday), -1)
    out = []
    cur = first
    while cur <= yesterday:
        eom = month_end(cur)
        out.append(Window(cur, eom if eom < as_date(as_of) else yesterday))
        cur = add_months(cur, 1)
    return out


def dates_between(window: Window) -> list[dt.date]:
    n = (window.end - window.start).days
    return [window.start + dt.timedelta(days=i) for i in range(n + 1)]
