"""Segment labels: account maturity, ages, lags, gaps and day buckets.

The maturity definitions differ on purpose; each report names the one it uses.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .calendar import as_column, day_diff, month_diff

ONBOARDING, MATURE, UNKNOWN = "Onboarding", "Mature", "unknown"


def tenure_label(first_period, period, max_months: int = 2, missing: str | None = ONBOARDING) -> Column:
    """Onboarding while at most ``max_months`` periods have passed since ``first_period``."""
    label = F.when(month_diff(first_period, period) <= max_months, ONBOARDING).otherwise(MATURE)
    if missing is None:
        return label
    return F.when(as_column(first_period).isNull(), missing).otherwise(label)


def invoice_age_label(first_invoice, anchor, days: int = 90, missing: str = MATURE) -> Column:
    """Onboarding when the anchor date falls less than ``days`` days after the first invoice."""
    return (
        F.when(as_column(first_invoice).isNull(), missing)
        .when(day_diff(first_invoice, anchor) < days, ONBOARDING)
        .otherwise(MATURE)
    )


# Account age buckets as published, en dash included.
AGE_BUCKETS = (
    ("Onboarding (0–2)", 2),
    ("Growth (3–6)", 6),
    ("Developed (7–12)", 12),
    ("Mature (13+)", None),
)
AGE_UNKNOWN = "Unknown"


def age_bucket(start, period) -> Column:
    """Account age in months, bucketed; null start is ``Unknown``."""
    months = month_diff(start, period)
    out = F.when(months.isNull(), AGE_UNKNOWN)
    for name, upper in AGE_BUCKETS:
        out = out.when(months <= upper, name) if upper is not None else out.otherwise(name)
    return out


# Newness labels as published.
NEW_ACCOUNT = "Account first-time paid this month"
EXISTING_ACCOUNT = "Existing account (paid before)"


def newness_label(account_first, period) -> Column:
    """``Unknown`` without an account."""
    first = as_column(account_first)
    return F.when(first.isNull(), AGE_UNKNOWN).when(first == as_column(period), NEW_ACCOUNT).otherwise(EXISTING_ACCOUNT)


def lag_bucket(months: Column | str) -> Column:
    """Periods between activation and first payment."""
    m = as_column(months)
    return (
        F.when(m.isNull(), UNKNOWN)
        .when(m <= 0, "M0")
        .when(m <= 3, F.concat(F.lit("M_"), m.cast("string")))
        .otherwise("before")
    )


def skip_bucket(gap: Column | str) -> Column:
    """Periods skipped before a reactivation (gap 2 = one skipped)."""
    g = as_column(gap)
    return F.when(g == 2, "1_skip1").when(g == 3, "2_skip2").otherwise("3_skip3plus")


# Day-of-month ranges around the cut-off.
DAY_BUCKETS = (("a_01-05", 1, 5), ("b_06-19", 6, 19), ("c_20-24_precutoff", 20, 24))
DAY_BUCKET_REST = "d_25-EOM_nextcycle"


def day_bucket(day: Column | str) -> Column:
    d = F.dayofmonth(as_column(day))
    out = None
    for name, low, high in DAY_BUCKETS:
        out = (F if out is None else out).when(d.between(low, high), name)
    return out.otherwise(DAY_BUCKET_REST)
