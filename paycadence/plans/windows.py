"""Dates and thresholds of one reporting run."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from ..functions.calendar import BILLING_CYCLE, shift_month


def inclusive_days(first: date, last: date) -> dict[str, date]:
    """First and last day of some billing cycles, as ``since`` and ``until``."""
    end = BILLING_CYCLE.end_day(last)
    return {"since": BILLING_CYCLE.first_day(first), "until": end - timedelta(days=1)}


@dataclass(frozen=True)
class Windows:
    """Pairs are (first, last) periods, both included, unless said otherwise."""

    # Activation funnel: days of the cohort, end of follow-up, first event day.
    since: date
    until: date
    cutoff: date
    events_since: date
    # Payer cohorts, the end excluded.
    cohorts: tuple[date, date]
    eligible: tuple[date, date]
    # First-time payers: how far back "first ever" looks, and the reported periods.
    lookback: date
    first: date
    last: date
    batches_first: date
    detail: tuple[date, date]
    mix: tuple[date, date]
    # The current cycle, and the first payment and first reported cycle of the churn series.
    cycle: date
    churn_since: date
    churn: tuple[date, date]
    day_ranges: tuple[tuple[date, date], ...]
    landings_since: date
    landings: tuple[date, date]
    new_active: tuple[date, date]
    rates: tuple[date, date]
    # Allocation: earliest entry and payment day, reported periods; and for reactivated payers.
    charges: tuple[date, date, date, date]
    reactivated_charges: tuple[date, date, date, date]
    # Days of the invite coverage, both included.
    coverage: tuple[date, date]
    # Reactivations: earliest payment day, then the reported periods.
    gaps: tuple[date, date, date]
    seasonality: tuple[date, date, date]
    history: tuple[date, date]
    # Thresholds.
    attach_days: int = 45
    outcome_windows: tuple[tuple[int, int], tuple[int, int]] = ((0, 45), (45, 90))
    retained_window: tuple[int, int] = (30, 90)
    batch_max_rate: float = 0.05
    batch_min_size: int = 20
    heavy_min_size: int = 80
    # Days between snapshots that still belong to one run.
    snapshot_gap: int = 1
    # Active leases are those active at the last day of the cycle, or on any of its days.
    active_at_cutoff: bool = True
    # Account name patterns: label -> pattern, and the accounts of the timeline.
    leave_out: tuple[tuple[str, str], ...] = ()
    timeline: tuple[str, ...] = ()

    @property
    def followed(self) -> date:
        """Last day on which a payment can still count for the activation outcomes."""
        reach = max(high for _, high in (*self.outcome_windows, self.retained_window))
        return self.until + timedelta(days=self.attach_days + reach)

    @classmethod
    def for_cycle(cls, cycle: date, **changes) -> Windows:
        """The usual windows of a monthly run for one billing cycle."""

        def back(n: int) -> date:
            return shift_month(cycle, -n)

        def day_before(day: date) -> date:
            return day - timedelta(days=1)

        values = {
            "since": back(8),
            "until": day_before(BILLING_CYCLE.end_day(cycle)),
            "cutoff": back(-1).replace(day=15),
            "events_since": back(10),
            "cohorts": (back(16), back(-1)),
            "eligible": (back(8), back(-1)),
            "lookback": back(40),
            "first": back(16),
            "last": cycle,
            "batches_first": back(15),
            "detail": (back(1), cycle),
            "mix": (back(15), cycle),
            "cycle": cycle,
            "churn_since": back(15),
            "churn": (back(13), cycle),
            "day_ranges": ((back(15), day_before(back(12))), (back(3), day_before(cycle))),
            "landings_since": back(52),
            "landings": (back(28), cycle),
            "new_active": (back(1), cycle),
            "rates": (back(15), cycle),
            "charges": (back(19), back(19).replace(day=20), back(18), cycle),
            "reactivated_charges": (back(21), back(21).replace(day=20), back(16), cycle),
            "coverage": (back(8), day_before(back(-1))),
            "gaps": (BILLING_CYCLE.first_day(back(19)), back(8), cycle),
            "seasonality": (BILLING_CYCLE.first_day(back(28)), back(27), cycle),
            "history": (back(16), cycle),
        }
        return cls(**{**values, **changes})


# The test tables hold payments of 1995 to 2001 on random days, so windows are wider and
# thresholds looser than in a monthly run.
TEST_WINDOWS = Windows(
    since=date(1995, 2, 1),
    until=date(1997, 12, 24),
    cutoff=date(1998, 3, 31),
    events_since=date(1995, 1, 15),
    cohorts=(date(1995, 1, 1), date(1996, 7, 1)),
    eligible=(date(1995, 1, 1), date(1996, 7, 1)),
    lookback=date(1995, 3, 1),
    first=date(1995, 1, 1),
    last=date(1997, 12, 1),
    batches_first=date(1995, 2, 1),
    detail=(date(1995, 1, 1), date(1995, 4, 1)),
    mix=(date(1995, 4, 1), date(2000, 12, 1)),
    cycle=date(1997, 5, 1),
    churn_since=date(1996, 2, 1),
    churn=(date(1996, 4, 1), date(1997, 12, 1)),
    day_ranges=((date(1996, 2, 1), date(1996, 4, 30)), (date(1997, 2, 1), date(1997, 4, 30))),
    landings_since=date(1995, 2, 1),
    landings=(date(1995, 1, 1), date(1997, 12, 1)),
    new_active=(date(1996, 4, 1), date(1996, 9, 1)),
    rates=(date(1995, 2, 1), date(2001, 6, 1)),
    charges=(date(1995, 3, 1), date(1995, 3, 25), date(1995, 4, 1), date(2000, 12, 1)),
    reactivated_charges=(date(1995, 2, 1), date(1995, 2, 20), date(1995, 4, 1), date(2000, 12, 1)),
    coverage=(date(1995, 9, 1), date(1997, 5, 31)),
    gaps=(date(1996, 1, 25), date(1996, 6, 1), date(1998, 5, 1)),
    seasonality=(date(1995, 12, 25), date(1996, 2, 1), date(1999, 5, 1)),
    history=(date(1995, 1, 1), date(2000, 12, 1)),
    attach_days=180,
    outcome_windows=((0, 180), (180, 360)),
    retained_window=(30, 240),
    batch_max_rate=0.34,
    batch_min_size=4,
    heavy_min_size=8,
    snapshot_gap=31,
    leave_out=(("a", "supplier#00000000%"), ("b", "Supplier#00000001%")),
    timeline=("supplier#00000002%",),
)
