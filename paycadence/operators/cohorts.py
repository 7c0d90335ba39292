"""Cohort retention by payer and by lease."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import (
    BILLING_CYCLE,
    CALENDAR_MONTH,
    BillingCalendar,
    month_diff,
    next_period,
)
from ..functions.ratios import flag, pct
from ..sources.canonical import ACH, ACTIVE, CARD, CARD_OR_ACH
from .lifecycle import between, period_activity


def retention_matrix(
    payments: DataFrame,
    start: date,
    end: date,
    key: str = "customer_id",
    first_methods: Sequence[str] | None = None,
    return_methods: Sequence[str] | None = None,
    horizon: int = 12,
    cal: BillingCalendar = CALENDAR_MONTH,
) -> DataFrame:
    """Cohort period, size, and m0..m<horizon>: members who paid that many periods later.

    A payer belongs to the cohort of its first-ever period if it used one of
    ``first_methods`` in that period, so a payer using both methods is in both
    cohorts. Cells count payers who used one of ``return_methods``; a cell
    nobody reached is null. Periods start inclusive, end exclusive.
    """

    def used(methods):
        return flag(F.col("method").isin(*methods)) if methods is not None else F.max(F.lit(1))

    activity = period_activity(
        payments.filter(F.col("created") < F.lit(cal.first_day(end))),
        key,
        [used(first_methods).alias("starts"), used(return_methods).alias("stays")],
        cal,
    )
    w = Window.partitionBy(key).orderBy("period")
    members = (
        activity.withColumns(
            {"cohort": F.first("period").over(w), "member": F.first("starts").over(w)}
        )
        .withColumn("offset", month_diff("cohort", "period"))
        .filter(
            (F.col("cohort") >= F.lit(start)) & (F.col("member") == 1) & F.col("offset").between(0, horizon)
        )
    )
    cells = [
        F.nullif(F.count_if((F.col("offset") == k) & (F.col("stays") == 1)), F.lit(0)).alias(f"m{k}")
        for k in range(horizon + 1)
    ]
    return members.groupBy("cohort").agg(F.count_if(F.col("offset") == 0).alias("cohort_size"), *cells)


def active_periods(daily: DataFrame, before: int, after: int, status: str = ACTIVE) -> DataFrame:
    """(lease, period) pairs where the lease was active within the period's eligibility window.

    The window of a calendar month runs from ``before`` days before it to ``after``
    days into the next month. Daily rows are first reduced to the first and last
    active day per lease and month, which is all the window test needs.
    """
    if not (0 <= before <= 28 and 0 <= after <= 28):
        raise ValueError("before and after must be in 0..28 days")
    months = (
        daily.filter(F.col("status") == status)
        .groupBy("lease_id", F.trunc("snapshot_date", "MM").alias("_month"))
        .agg(F.min("snapshot_date").alias("_from"), F.max("snapshot_date").alias("_to"))
    )
    month = F.col("_month")
    ahead = next_period(month)
    reached = F.filter(
        F.array(
            month,
            F.when(F.col("_to") >= F.date_sub(ahead, before), ahead),
            F.when(F.col("_from") < F.date_add(month, after), next_period(month, -1)),
        ),
        lambda m: m.isNotNull(),
    )
    return months.select("lease_id", F.explode(reached).alias("period")).distinct()


def eligible_retention(
    payments: DataFrame,
    cohort_payments: DataFrame,
    daily: DataFrame,
    start: date,
    end: date,
    horizon: int = 12,
    before: int = 7,
    after: int = 24,
    cal: BillingCalendar = BILLING_CYCLE,
) -> DataFrame:
    """First period × first method × offset: size, still eligible, eligible and paid by method.

    ``cohort_payments`` are the payments that may start a cohort (on leases with a
    recurring rent); ``payments`` are all payments that count as paid. A payer's
    first payment is the earliest by day, ties broken by method and lease.
    """
    two = F.col("method").isin(*CARD_OR_ACH) & F.col("lease_id").isNotNull()
    starts = (
        cohort_payments.filter(two & (F.col("created") < F.lit(cal.first_day(end))))
        .groupBy("customer_id")
        .agg(F.min(F.struct("created", "method", "lease_id")).alias("_f"))
        .select(
            "customer_id",
            cal.period("_f.created").alias("cohort"),
            F.col("_f.method").alias("first_method"),
            F.col("_f.lease_id").alias("lease_id"),
        )
        .filter((F.col("cohort") >= F.lit(start)) & (F.col("cohort") < F.lit(end)))
    )
    last_offset = F.least(F.lit(horizon), month_diff("cohort", F.lit(end)) - 1)
    expanded = starts.withColumn("offset", F.explode(F.sequence(F.lit(0), last_offset))).withColumn(
        "period", next_period("cohort", F.col("offset"))
    )
    paid = period_activity(
        payments.filter(two & cal.within("created", start, end)),
        "customer_id",
        [
            flag(F.col("method") == CARD).alias("card"),
            flag(F.col("method") == ACH).alias("ach"),
        ],
        cal,
    )
    day = F.col("snapshot_date")
    watched = (day >= F.date_sub(F.lit(start), before)) & (day < F.date_add(F.lit(end), after))
    eligible = active_periods(daily.filter(watched), before, after).withColumn("eligible", F.lit(True))
    rows = expanded.join(paid, ["customer_id", "period"], "left").join(eligible, ["lease_id", "period"], "left")
    ok = F.col("eligible").isNotNull()
    return rows.groupBy("cohort", "first_method", "offset").agg(
        F.count("*").alias("cohort_size"),
        F.count_if(ok).alias("eligible"),
        F.count_if(ok & (F.col("card") == 1)).alias("paid_card"),
        F.count_if(ok & (F.col("ach") == 1)).alias("paid_ach"),
        F.count_if(ok & F.col("card").isNotNull()).alias("paid_any"),
    )


def contract_retention(
    cohort: DataFrame,
    payments: DataFrame,
    horizon: int = 7,
    last: date | None = None,
    cal: BillingCalendar = BILLING_CYCLE,
) -> DataFrame:
    """Lease cohort (lease_id, cohort, label) × m0..m<horizon>: leases that paid k periods after activation.

    With ``last``, cells beyond that period are null instead of zero.
    """
    paid = period_activity(payments, "lease_id", cal=cal)
    offset = month_diff("cohort", "period")
    reached = cohort.join(
        paid, (cohort["lease_id"] == paid["lease_id"]) & (paid["period"] >= cohort["cohort"]), "left"
    ).select(cohort["lease_id"], "cohort", "label", offset.alias("offset"))
    # One row per lease first, on the partitioning of the join; then plain sums instead of
    # one distinct count per cell.
    cells = [f"m{k}" for k in range(horizon + 1)]
    per_lease = reached.groupBy("lease_id", "cohort", "label").agg(
        *[flag(F.col("offset") == k).alias(cell) for k, cell in enumerate(cells)]
    )
    out = per_lease.groupBy("cohort", "label").agg(
        F.count("*").alias("cohort_size"), *[F.sum(cell).alias(cell) for cell in cells]
    )
    if last is None:
        return out
    return out.withColumns(
        {
            f"m{k}": F.when(next_period("cohort", k) <= F.lit(last), F.col(f"m{k}"))
            for k in range(horizon + 1)
        }
    )


def with_percentages(matrix: DataFrame, size: str = "cohort_size") -> DataFrame:
    """Adds mk_pct = mk / size in percent; null cells stay null."""
    cells = [c for c in matrix.columns if c.startswith("m") and c[1:].isdigit()]
    return matrix.withColumns({f"{c}_pct": pct(c, size) for c in cells})


def stickiness(
    payments: DataFrame,
    start: date,
    last: date,
    key: str = "customer_id",
    horizon: int = 12,
    cal: BillingCalendar = BILLING_CYCLE,
) -> DataFrame:
    """First method × offset: active payers, those who kept to the first method, and switchers.

    A switcher used the other method in that period. ``observable`` counts payers
    whose period at that offset has ended by ``last``; retention is active / observable.
    """
    activity = period_activity(
        payments.filter(F.col("method").isin(*CARD_OR_ACH) & cal.up_to("created", last)),
        key,
        [
            F.min(F.when(F.col("method") == CARD, F.col("created"))).alias("card_day"),
            F.min(F.when(F.col("method") == ACH, F.col("created"))).alias("ach_day"),
        ],
        cal,
    )
    card, ach = F.col("card_day").isNotNull(), F.col("ach_day").isNotNull()
    # The method of the earliest day; card if both were used on it.
    earliest = F.when(card & (~ach | (F.col("card_day") <= F.col("ach_day"))), CARD).otherwise(ACH)
    w = Window.partitionBy(key).orderBy("period")
    rows = (
        activity.withColumns(
            {"first": F.first("period").over(w), "first_method": F.first(earliest).over(w)}
        )
        .filter(between("first", start, last))
        .withColumn("offset", month_diff("first", "period"))
        .filter(F.col("offset") <= horizon)
    )
    other = F.when(F.col("first_method") == CARD, ach).otherwise(card)
    cells = rows.groupBy("first_method", "first", "offset").agg(
        F.count("*").alias("active"),
        F.count_if(~other).alias("stuck"),
        F.count_if(other).alias("switched"),
    )
    # A cohort's size (its cell at offset 0) is observable at every offset that has ended.
    reach = F.least(F.lit(horizon), month_diff("first", F.lit(last)))
    size = F.when(F.col("offset") == 0, F.col("active"))
    nothing = F.lit(0).cast("bigint")

    def cell(offset, active, stuck, switched, observable):
        return F.struct(
            offset.alias("offset"),
            active.alias("active"),
            stuck.alias("stuck"),
            switched.alias("switched"),
            observable.alias("observable"),
        )

    own = F.array(cell(F.col("offset"), F.col("active"), F.col("stuck"), F.col("switched"), nothing))
    seen = F.transform(F.sequence(F.lit(0), reach), lambda k: cell(k, nothing, nothing, nothing, size))
    long = cells.select(
        "first_method", F.explode(F.when(size.isNull(), own).otherwise(F.concat(own, seen))).alias("c")
    ).select("first_method", "c.*")
    return (
        long.groupBy("first_method", "offset")
        .agg(*[F.sum(c).alias(c) for c in ("active", "stuck", "switched", "observable")])
        .filter(F.col("active") > 0)
        .withColumn("retention_pct", pct("active", "observable"))
    )
