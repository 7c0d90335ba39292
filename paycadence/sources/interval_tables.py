"""Adapters whose daily snapshots come from stored intervals instead of daily rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.intervals import boundary_days, cut, day_after
from ..plans.windows import Windows
from .base import Tables


class IntervalTables(Tables):
    """The frames of ``base``, except that daily snapshots are the ends of intervals.

    Intervals are cut wherever the reports of ``windows`` look: at months, billing cycles, and the
    first and last days of cohorts and coverage. What reports take of the days in between (least
    and greatest days, and whether there is one) is then the same as over all days, so reports give
    the same rows. ``statuses`` are the intervals of the second daily table, if there is one.
    """

    def __init__(self, base: Tables, intervals: DataFrame, windows: Windows, statuses: DataFrame | None = None):
        super().__init__(base.spark)
        self.base, self.intervals, self.statuses = base, intervals, statuses
        self.frequencies = base.frequencies
        w = windows
        self.cuts = sorted({w.since, day_after(w.until), w.coverage[0], day_after(w.coverage[1])})

    def daily(self) -> DataFrame:
        return boundary_days(cut(self.intervals, self.cuts))

    def lease_status(self) -> DataFrame:
        if self.statuses is None:
            return super().lease_status()
        return boundary_days(cut(self.statuses, self.cuts)).select("lease_id", "snapshot_date", "status")

    def payments(self, *args, **kwargs) -> DataFrame:
        return self.base.payments(*args, **kwargs)

    def leases(self) -> DataFrame:
        return self.base.leases()

    def tenants(self) -> DataFrame:
        return self.base.tenants()

    def entries(self) -> DataFrame:
        return self.base.entries()

    def accounts(self) -> DataFrame:
        return self.base.accounts()

    def named_accounts(self) -> DataFrame:
        return self.base.named_accounts()

    def events(self, *args, **kwargs) -> DataFrame:
        return self.base.events(*args, **kwargs)

    def returns(self) -> DataFrame:
        return self.base.returns()
