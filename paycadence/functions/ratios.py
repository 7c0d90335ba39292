"""Ratios with an explicit rule for empty denominators."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .calendar import as_column


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Double quotient; null when the denominator is zero or null."""
    return F.try_divide(
        as_column(numerator).cast("double"), as_column(denominator).cast("double")
    )


def pct(numerator: Column | str, denominator: Column | str) -> Column:
    return F.lit(100.0) * ratio(numerator, denominator)


def ratio_or_zero(numerator: Column | str, denominator: Column | str) -> Column:
    """Double quotient; zero when the denominator is zero, null when either side is null."""
    n, d = as_column(numerator).cast("double"), as_column(denominator).cast("double")
    return F.when(d == 0, F.lit(0.0)).otherwise(F.try_divide(n, d))


def pct_or_zero(numerator: Column | str, denominator: Column | str) -> Column:
    return F.lit(100.0) * ratio_or_zero(numerator, denominator)


def currency(cents: Column | str) -> Column:
    """Double currency units from whole cents."""
    return as_column(cents).cast("double") / F.lit(100.0)


def money_ratio(numerator_cents: Column | str, denominator_cents: Column | str) -> Column:
    """Quotient of two amounts held in cents, taken in currency units."""
    return ratio(currency(numerator_cents), currency(denominator_cents))


def money_pct(numerator_cents: Column | str, denominator_cents: Column | str) -> Column:
    return F.lit(100.0) * money_ratio(numerator_cents, denominator_cents)


def sum_if(condition: Column, value: Column | str) -> Column:
    """Sum of ``value`` over rows where the condition holds; zero when none does."""
    v = as_column(value)
    return F.sum(F.when(condition, v).otherwise(F.lit(0)))


def flag(condition: Column) -> Column:
    """Per-group 0/1: does any row satisfy the condition?"""
    return F.max(F.when(condition, F.lit(1)).otherwise(F.lit(0)))


def rounded(df: DataFrame, digits: Mapping[str, int]) -> DataFrame:
    """Round the named columns for presentation."""
    return df.withColumns({name: F.round(name, n) for name, n in digits.items()})


def scaled(df: DataFrame, divisors: Mapping[str, float]) -> DataFrame:
    """Divide the named columns (report in thousands or millions)."""
    return df.withColumns({name: F.col(name).cast("double") / F.lit(float(d)) for name, d in divisors.items()})
