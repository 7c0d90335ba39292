"""Who pays in which period: first, existing, reactivated, churned.

Payments are first reduced to one row per key and period. That aggregation
combines on the map side, so a key with very many payments reaches the window
below as at most one row per period.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import BILLING_CYCLE, BillingCalendar, month_diff, next_period
from ..functions.labels import skip_bucket
from ..functions.ratios import money_pct, ratio, sum_if
from ..sources.canonical import CARD


def period_activity(
    payments: DataFrame,
    key: str,
    measures: Sequence[Column] = (),
    cal: BillingCalendar = BILLING_CYCLE,
    day: str = "created",
    keep: DataFrame | None = None,
) -> DataFrame:
    """One row per key and period, with the given aggregates.

    ``keep`` restricts the keys to those of another frame. It is applied after the
    reduction: joined before, the rows of a very frequent key would meet in one task.
    """
    grouped = payments.filter(F.col(key).isNotNull()).groupBy(key, cal.period(day).alias("period"))
    rows = grouped.agg(*measures) if measures else grouped.agg(F.lit(1).alias("_")).drop("_")
    return rows if keep is None else rows.join(keep, key, "left_semi")


def lifecycle(activity: DataFrame, key: str) -> DataFrame:
    """Adds first, prev and next active period, the gap to prev, and the state.

    States: ``first``, ``existing`` (active one period before), ``reactivated``.
    """
    w = Window.partitionBy(key).orderBy("period")
    placed = activity.withColumns(
        {
            "first": F.first("period").over(w),
            "prev": F.lag("period").over(w),
            "next": F.lead("period").over(w),
        }
    )
    gap = month_diff("prev", "period")
    return placed.withColumns(
        {
            "gap": gap,
            "state": F.when(F.col("prev").isNull(), "first").when(gap == 1, "existing").otherwise("reactivated"),
            "returns_next": F.col("next").isNotNull() & (month_diff("period", "next") == 1),
        }
    )


def first_period(payments: DataFrame, key: str, cal: BillingCalendar = BILLING_CYCLE) -> DataFrame:
    """One row per key: the first period it was active in."""
    days = payments.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("created").alias("_day"))
    return days.select(key, cal.period("_day").alias("first"))


def between(period: str, first: date, last: date) -> Column:
    return F.col(period).between(F.lit(first), F.lit(last))


def landings(payments: DataFrame, key: str, first: date, last: date, cal: BillingCalendar = BILLING_CYCLE) -> DataFrame:
    """Keys by the period of their first payment."""
    return (
        first_period(payments.filter(cal.up_to("created", last)), key, cal)
        .filter(between("first", first, last))
        .groupBy(F.col("first").alias("period"))
        .agg(F.count("*").alias("landed"))
    )


def churn_series(
    payments: DataFrame,
    key: str,
    first: date,
    last: date,
    keep: DataFrame | None = None,
    cal: BillingCalendar = BILLING_CYCLE,
) -> DataFrame:
    """Keys active in a period but not in the next one, labelled with the next one."""
    seen = payments.filter(cal.up_to("created", last))
    life = lifecycle(period_activity(seen, key, cal=cal, keep=keep), key)
    return (
        life.filter(~F.col("returns_next"))
        .select(next_period("period").alias("churn_period"))
        .filter(between("churn_period", first, last))
        .groupBy("churn_period")
        .agg(F.count("*").alias("churned"))
    )


def churn_mix(
    payments: DataFrame,
    key: str,
    pairs: Sequence[tuple[str, date, bool]],
    card: str = CARD,
    cal: BillingCalendar = BILLING_CYCLE,
) -> DataFrame:
    """Payers and card share (%) of churned or retained payers.

    Each pair is (label, period, retained): its payers of that period that did,
    or did not, pay in the period after. All labels come from one pass.
    """
    activity = period_activity(
        payments,
        key,
        [
            F.sum("cents").alias("cents"),
            sum_if(F.col("method") == card, "cents").alias("card_cents"),
        ],
        cal,
    )
    label = F.lit(None).cast("string")
    for name, period, retained in pairs:
        hit = (F.col("period") == F.lit(period)) & (F.col("returns_next") == F.lit(retained))
        label = F.coalesce(label, F.when(hit, name))
    return (
        lifecycle(activity, key)
        .withColumn("label", label)
        .filter(F.col("label").isNotNull())
        .groupBy("label")
        .agg(
            F.count("*").alias("payers"),
            money_pct(F.sum("card_cents"), F.sum("cents")).alias("card_share_pct"),
        )
    )


def reactivations(payments: DataFrame, key: str, first: date, last: date, cal: BillingCalendar = BILLING_CYCLE) -> DataFrame:
    """One row per return after at least one skipped period."""
    seen = payments.filter(cal.up_to("created", last))
    life = lifecycle(period_activity(seen, key, cal=cal), key)
    return life.filter((F.col("state") == "reactivated") & between("period", first, last))


def reactivation_series(payments: DataFrame, key: str, first: date, last: date, cal: BillingCalendar = BILLING_CYCLE) -> DataFrame:
    return (
        reactivations(payments, key, first, last, cal).groupBy("period").agg(F.count("*").alias("reactivated"))
    )


def reactivation_gaps(payments: DataFrame, key: str, first: date, last: date, cal: BillingCalendar = BILLING_CYCLE) -> DataFrame:
    """Reactivations by number of skipped periods."""
    return (
        reactivations(payments, key, first, last, cal)
        .groupBy("period", skip_bucket("gap").alias("gap_bucket"))
        .agg(F.count("*").alias("reactivated"))
    )


def paid_breakdown(payments: DataFrame, key: str, first: date, last: date, cal: BillingCalendar = BILLING_CYCLE) -> DataFrame:
    """Paid keys per period = existing + first time + reactivated; churned since the period before.

    Each row counts in its own period and, if the key does not pay next time,
    as churned in the following one. Payments after ``last`` do not change any row.
    """
    seen = payments.filter(cal.up_to("created", last))
    life = lifecycle(period_activity(seen, key, cal=cal), key)
    own = F.struct(F.col("period").alias("period"), F.col("state").alias("kind"))
    lost = F.struct(next_period("period").alias("period"), F.lit("churned").alias("kind"))
    long = life.select(
        F.explode(F.when(F.col("returns_next"), F.array(own)).otherwise(F.array(own, lost))).alias("e")
    ).select("e.*")
    kind = F.col("kind")
    return (
        long.filter(between("period", first, last))
        .groupBy("period")
        .agg(
            F.count_if(kind != "churned").alias("paid"),
            F.count_if(kind == "existing").alias("existing"),
            F.count_if(kind == "first").alias("first_time"),
            F.count_if(kind == "reactivated").alias("reactivated"),
            F.count_if(kind == "churned").alias("churned"),
        )
    )


def first_and_returning(payments: DataFrame, key: str, first: date, last: date, cal: BillingCalendar = BILLING_CYCLE) -> DataFrame:
    """Paid keys per period, split into first-time and returning, with shares."""
    activity = period_activity(payments.filter(cal.up_to("created", last)), key, cal=cal)
    is_first = F.col("period") == F.min("period").over(Window.partitionBy(key))
    return (
        activity.withColumn("is_first", is_first)
        .filter(between("period", first, last))
        .groupBy("period")
        .agg(
            F.count("*").alias("paid"),
            F.count_if("is_first").alias("first_time"),
            F.count_if(~F.col("is_first")).alias("returning"),
        )
        .withColumns(
            {
                "first_time_share": ratio("first_time", "paid"),
                "returning_share": ratio("returning", "paid"),
            }
        )
    )
