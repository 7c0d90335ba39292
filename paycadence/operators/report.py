"""Report-time steps over finished marts (a few rows per period)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import month_label, short_month_label
from ..functions.ratios import pct, ratio, rounded, scaled


def complete_periods(mart: DataFrame, cutoff: date, period: str = "period") -> DataFrame:
    """Rows up to the last complete period."""
    return mart.filter(F.col(period) <= F.lit(cutoff))


def ordered(mart: DataFrame, *keys: str) -> DataFrame:
    """Rows in report order; ``-name`` sorts descending, and nulls come last either way."""
    return mart.orderBy(
        *[F.desc_nulls_last(k[1:]) if k.startswith("-") else F.asc_nulls_last(k) for k in keys]
    )


def report_series(
    mart: DataFrame,
    category: str,
    value: str,
    columns: dict[str, str],
    cutoff: date,
    period: str = "period",
) -> DataFrame:
    """One row per period: the value of each category (zero if absent), in named columns, with a total.

    ``columns`` maps each category to its column; the total sums these columns only.
    """
    out = complete_periods(mart, cutoff, period).groupBy(period).agg(
        *[
            F.sum(F.when(F.col(category) == name, F.col(value)).otherwise(F.lit(0))).alias(column)
            for name, column in columns.items()
        ]
    )
    total = F.lit(0)
    for column in columns.values():
        total = total + F.col(column)
    return out.withColumn("total", total)


def presented(mart: DataFrame, digits: Mapping[str, int], units: Mapping[str, float] | None = None) -> DataFrame:
    """The mart as it is published: ``period`` as month (``1996-05``), amounts in thousands or millions, rounded.

    Only for showing: ratios of presented numbers are off by their rounding.
    """
    month = mart.withColumn("period", month_label("period")).withColumnRenamed("period", "month")
    return rounded(scaled(month, units or {}), digits)


def with_label(series: DataFrame, period: str = "period") -> DataFrame:
    return series.withColumn("label", short_month_label(period))


def composition(
    mart: DataFrame, category: str, value: str, at: date, exclude: Sequence[str] = (), period: str = "period"
) -> DataFrame:
    """Share (%) of each category in one period, leaving out some categories."""
    kept = mart.filter((F.col(period) == F.lit(at)) & ~F.col(category).isin(*exclude))
    return (
        kept.groupBy(period, category)
        .agg(F.sum(value).alias(value))
        .withColumn("share_pct", pct(value, F.sum(value).over(Window.partitionBy(period))))
    )


def with_previous(mart: DataFrame, values: Sequence[str], months: int, suffix: str, period: str = "period") -> DataFrame:
    """Adds each value as it was ``months`` periods earlier; null when that period is absent.

    Every row also stands as the past of a later period, so the mart is computed once
    instead of being joined to itself. Other columns are kept as they are.
    """
    kept = [c for c in mart.columns if c != period]

    def side(at, own: bool):
        return F.struct(
            at.alias(period),
            F.lit(own).alias("_own"),
            *[F.when(F.lit(own), F.col(c)).alias(c) for c in kept],
            *[F.when(F.lit(not own), F.col(v)).alias(v + suffix) for v in values],
        )

    both = F.array(side(F.col(period), True), side(F.add_months(period, months), False))
    return (
        mart.select(F.explode(both).alias("s"))
        .select("s.*")
        .groupBy(period)
        .agg(
            F.max("_own").alias("_own"),
            *[F.max(c).alias(c) for c in kept],
            *[F.max(v + suffix).alias(v + suffix) for v in values],
        )
        .filter("_own")
        .drop("_own")
    )


def period_changes(mart: DataFrame, values: Sequence[str], period: str = "period") -> DataFrame:
    """Adds <value>_change, the difference from the period before."""
    out = with_previous(mart, values, 1, "_before", period)
    return out.withColumns({f"{v}_change": F.col(v) - F.col(f"{v}_before") for v in values}).drop(
        *[f"{v}_before" for v in values]
    )


def year_over_year(mart: DataFrame, value: str, period: str = "period") -> DataFrame:
    """Value, value a year before, change, and change in percent."""
    out = with_previous(mart.select(period, value), [value], 12, "_year_ago", period)
    ago = F.col(f"{value}_year_ago")
    return out.withColumns(
        {"change": F.col(value) - ago, "change_pct": pct(F.col(value) - ago, ago)}
    )


def peak(mart: DataFrame, value: str, period: str = "period") -> DataFrame:
    """The period with the greatest value (the latest one on a tie), and that value."""
    best = F.max(F.struct(value, period)).alias("_b")
    return mart.agg(best).select(F.col(f"_b.{period}").alias("peak_period"), F.col(f"_b.{value}").alias("peak_value"))


def expansion(mart: DataFrame, payers: str = "payers", accounts: str = "accounts") -> DataFrame:
    return mart.withColumn("expansion", ratio(payers, accounts))


def agreement(pairs: Mapping[str, tuple[DataFrame, DataFrame, str]], period: str = "period") -> DataFrame:
    """For each named pair of marts: how many periods they have, and in how many their sums differ."""
    sides = [
        mart.select(F.lit(name).alias("pair"), period, *[(F.col(value) if own else F.lit(None).cast("bigint")).alias(c) for c, own in columns])
        for name, (left, right, value) in pairs.items()
        for mart, columns in ((left, (("a", True), ("b", False))), (right, (("a", False), ("b", True))))
    ]
    sums = reduce(DataFrame.unionByName, sides).groupBy("pair", period).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    differ = ~F.col("a").eqNullSafe(F.col("b"))
    return sums.groupBy("pair").agg(F.count("*").alias("periods"), F.count_if(differ).alias("mismatched"))


def reconcile(left: DataFrame, right: DataFrame, value: str, period: str = "period") -> DataFrame:
    """Periods whose totals differ between two marts, with both totals; empty when they agree."""
    def tagged(df: DataFrame, own: str, other: str) -> DataFrame:
        return df.select(period, F.col(value).alias(own), F.lit(None).cast("bigint").alias(other))

    both = tagged(left, "left_total", "right_total").unionByName(tagged(right, "right_total", "left_total"))
    return (
        both.groupBy(period)
        .agg(F.sum("left_total").alias("left_total"), F.sum("right_total").alias("right_total"))
        .filter(~F.col("left_total").eqNullSafe(F.col("right_total")))
    )
