"""Billing periods and calendar arithmetic.

A period is stored as the first day of the month that names it. With
``cutoff_day=25`` the period of May runs from 25 April to 24 May; with
``cutoff_day=None`` periods are plain calendar months.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def shift_month(month: date, n: int) -> date:
    """The first day of the month ``n`` months after ``month`` (driver-side literal)."""
    index = month.year * 12 + month.month - 1 + n
    return date(index // 12, index % 12 + 1, 1)


@dataclass(frozen=True)
class BillingCalendar:
    cutoff_day: int | None = 25

    def __post_init__(self):
        if self.cutoff_day is not None and not 2 <= self.cutoff_day <= 28:
            raise ValueError("cutoff_day must be in 2..28, or None for calendar months")

    def period(self, day: Column | str) -> Column:
        """Period of a date or timestamp column."""
        d = as_column(day).cast("date")
        if self.cutoff_day is None:
            return F.trunc(d, "MM")
        rolled = F.when(F.dayofmonth(d) >= self.cutoff_day, F.add_months(d, 1)).otherwise(d)
        return F.trunc(rolled, "MM")

    def period_of(self, day: date) -> date:
        """Period of a literal date."""
        rolled = self.cutoff_day is not None and day.day >= self.cutoff_day
        return shift_month(day, 1 if rolled else 0)

    def first_day(self, period: date) -> date:
        """First day that belongs to the period."""
        if self.cutoff_day is None:
            return period.replace(day=1)
        return shift_month(period, -1).replace(day=self.cutoff_day)

    def end_day(self, period: date) -> date:
        """First day after the period."""
        return self.first_day(shift_month(period, 1))

    def last_day(self, period: Column | str) -> Column:
        """Last day of a period column."""
        p = as_column(period)
        if self.cutoff_day is None:
            return F.last_day(p)
        return F.date_add(p, self.cutoff_day - 2)

    def within(self, day: Column | str, first: date, last: date) -> Column:
        """``period(day) between first and last`` as a plain range, so it reaches the scan."""
        d = as_column(day)
        return (d >= F.lit(self.first_day(first))) & (d < F.lit(self.end_day(last)))

    def up_to(self, day: Column | str, last: date) -> Column:
        """``period(day) <= last`` as a plain bound, so it reaches the scan."""
        return as_column(day) < F.lit(self.end_day(last))


BILLING_CYCLE = BillingCalendar(25)
CALENDAR_MONTH = BillingCalendar(None)


def month_diff(start: Column | str, end: Column | str) -> Column:
    """Month boundaries crossed from start to end (31 Jan to 1 Feb is 1)."""
    s, e = as_column(start), as_column(end)
    return (F.year(e) - F.year(s)) * 12 + F.month(e) - F.month(s)


def day_diff(start: Column | str, end: Column | str) -> Column:
    """Midnights crossed from start to end."""
    return F.datediff(as_column(end), as_column(start))


def next_period(period: Column | str, n: int = 1) -> Column:
    return F.add_months(as_column(period), n)


def month_label(period: Column | str) -> Column:
    """``1996-05``."""
    return F.date_format(as_column(period), "yyyy-MM")


def short_month_label(period: Column | str) -> Column:
    """``May '96``."""
    return F.date_format(as_column(period), "MMM ''yy")
