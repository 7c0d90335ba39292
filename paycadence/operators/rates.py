"""Counts and rates of payments and returns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import BILLING_CYCLE, CALENDAR_MONTH, BillingCalendar
from ..functions.labels import day_bucket
from ..functions.ratios import pct
from ..sources.canonical import ACH


def day_distribution(payments: DataFrame, ranges: Sequence[tuple[date, date]]) -> DataFrame:
    """Payments by calendar month and day-of-month bucket, within inclusive day ranges."""
    kept = F.lit(False)
    for start, end in ranges:
        kept = kept | F.col("created").between(F.lit(start), F.lit(end))
    return (
        payments.filter(kept)
        .groupBy(CALENDAR_MONTH.period("created").alias("month"), day_bucket("created").alias("day_bucket"))
        .agg(F.count("*").alias("payments"))
    )


def return_rate(
    payments: DataFrame,
    returns: DataFrame,
    first: date,
    last: date,
    method: str = ACH,
    cal: BillingCalendar = BILLING_CYCLE,
) -> DataFrame:
    """Returned payments as a percentage of payments by the method; periods need both."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        kept = df.filter(cal.within("created", first, last))
        return kept.groupBy(cal.period("created").alias("period")).agg(F.count("*").alias(name))

    paid = counted(payments.filter(F.lower("method") == method), "payments")
    return counted(returns, "returned").join(paid, "period").withColumn("returned_pct", pct("returned", "payments"))


def returns_by_tier(
    returns: DataFrame,
    tiers: Mapping[str, Decimal],
    first: date,
    last: date,
    cal: BillingCalendar = BILLING_CYCLE,
) -> DataFrame:
    """Returned payments per period, in total and by exact fee."""
    cells = [F.count_if(F.col("fee") == F.lit(fee)).alias(name) for name, fee in tiers.items()]
    return (
        returns.filter(cal.within("created", first, last))
        .groupBy(cal.period("created").alias("period"))
        .agg(*cells, F.count("*").alias("total"))
    )
