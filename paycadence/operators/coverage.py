"""How much of the active base does something: coverage, paid share, state transitions."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import (
    BILLING_CYCLE,
    CALENDAR_MONTH,
    BillingCalendar,
    month_diff,
    next_period,
)
from ..functions.labels import invoice_age_label
from ..functions.ratios import flag, pct, ratio
from ..sources.canonical import ACTIVE
from .lifecycle import between, period_activity


def coverage(active: DataFrame, acting: DataFrame, on: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Active entities, those that acted, and the percentage, by group.

    ``active`` holds one row per entity and period; ``acting`` is reduced to ``on``.
    An unknown entity (a null in ``on``) isn't counted.
    """
    on, by = list(on), list(by)
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in on])
    acted = acting.groupBy(*on).agg(F.lit(1).alias("_acted"))
    return (
        active.join(acted, on, "left")
        .groupBy(*by)
        .agg(F.count_if(known).alias("active"), F.count_if(known & F.col("_acted").isNotNull()).alias("acting"))
        .withColumn("pct", pct("acting", "active"))
    )


def active_accounts(daily: DataFrame, since: date, until: date, days: int = 90) -> DataFrame:
    """(period, account, label): accounts with an active lease in a calendar month, by invoice age at its end.

    The first invoice is taken over the account's whole history, the activity between
    two days. Both come from one reduction to account and month.
    """
    in_range = (F.col("status") == ACTIVE) & F.col("snapshot_date").between(F.lit(since), F.lit(until))
    months = (
        daily.filter(F.col("merchant_flag") == 1)
        .groupBy("account", CALENDAR_MONTH.period("snapshot_date").alias("period"))
        .agg(flag(in_range).alias("_active"), F.min("account_first_invoice").alias("_invoice"))
    )
    invoice = F.min("_invoice").over(Window.partitionBy("account"))
    return (
        months.withColumn("_first", invoice)
        .filter(F.col("_active") == 1)
        .select("period", "account", invoice_age_label("_first", F.last_day("period"), days).alias("label"))
    )


def inviting_accounts(events: DataFrame, cal: BillingCalendar = CALENDAR_MONTH) -> DataFrame:
    """(period, account) of invites that real users sent to payers from the product."""
    sent = (
        (F.col("env") == "production")
        & ~F.col("is_test")
        & (F.col("source") == "Product")
        & (F.col("sent_to_type") == "TENANT")
        & F.col("account").isNotNull()
    )
    return period_activity(events.filter(sent), "account", cal=cal, day="ts")


def active_leases(
    daily: DataFrame, first: date, last: date, cal: BillingCalendar = BILLING_CYCLE, at_cutoff: bool = False
) -> DataFrame:
    """(lease_id, period, account): leases with an active day in the period.

    With ``at_cutoff``, leases that are active in their latest snapshot of the period,
    which is the stock on its last day where snapshots are daily.
    """
    if at_cutoff:
        latest = F.max(F.struct("snapshot_date", (F.col("status") == ACTIVE).alias("active"), "account")).alias("_s")
        rows = daily.filter(cal.within("snapshot_date", first, last))
        ends = period_activity(rows, "lease_id", [latest], cal, "snapshot_date").filter("_s.active")
        return ends.select("lease_id", "period", F.col("_s.account").alias("account"))
    rows = daily.filter((F.col("status") == ACTIVE) & cal.within("snapshot_date", first, last))
    return period_activity(rows, "lease_id", [F.max("account").alias("account")], cal, "snapshot_date")


def paid_leases(payments: DataFrame, first: date, last: date, cal: BillingCalendar = BILLING_CYCLE) -> DataFrame:
    """(lease_id, period, account): leases with a payment in the period."""
    rows = payments.filter(cal.within("created", first, last))
    return period_activity(rows, "lease_id", [F.max("account").alias("account")], cal)


def active_and_paid(active: DataFrame, paid: DataFrame) -> DataFrame:
    """One row per lease and period in either set: is_active, is_paid, account (of the active row first)."""
    a = active.select("lease_id", "period", F.col("account").alias("_a"), F.lit(None).cast(_type(paid, "account")).alias("_p"))
    p = paid.select("lease_id", "period", F.lit(None).cast(_type(active, "account")).alias("_a"), F.col("account").alias("_p"))
    tagged = a.withColumns({"_x": F.lit(1), "_y": F.lit(0)}).unionByName(
        p.withColumns({"_x": F.lit(0), "_y": F.lit(1)})
    )
    return tagged.groupBy("lease_id", "period").agg(
        (F.max("_x") == 1).alias("is_active"),
        (F.max("_y") == 1).alias("is_paid"),
        F.coalesce(F.max("_a"), F.max("_p")).alias("account"),
    )


def _type(df: DataFrame, column: str):
    return df.schema[column].dataType


def paid_share(states: DataFrame, by: Sequence[str] = ("period",)) -> DataFrame:
    """Active and paid leases and paid / active; null where nothing is active."""
    return (
        states.groupBy(*by)
        .agg(F.count_if("is_active").alias("active"), F.count_if("is_paid").alias("paid"))
        .withColumn("paid_share", ratio("paid", "active"))
    )


def eligible_share(states: DataFrame, registrations: DataFrame, eligible: Column) -> DataFrame:
    """Active, eligible and paid leases per period with the three ratios in percent.

    ``registrations`` holds one row per lease; ``eligible`` is a predicate over its
    columns and the period, applied to active leases.
    """
    rows = states.join(registrations, "lease_id", "left")
    met = F.col("is_active") & F.coalesce(eligible, F.lit(False))
    return (
        rows.groupBy("period")
        .agg(
            F.count_if("is_active").alias("active"),
            F.count_if(met).alias("eligible"),
            F.count_if("is_paid").alias("paid"),
        )
        .withColumns(
            {
                "eligible_of_active_pct": pct("eligible", "active"),
                "paid_of_eligible_pct": pct("paid", "eligible"),
                "paid_of_active_pct": pct("paid", "active"),
            }
        )
    )


def paid_share_by_segment(states: DataFrame, accounts: DataFrame, unknown: str = "Unknown") -> DataFrame:
    """Paid share per period and account segment; ``unknown`` where the account has none.

    Leases are counted per account before the segment is joined.
    """
    per_account = states.groupBy("period", "account").agg(
        F.count_if("is_active").alias("active"), F.count_if("is_paid").alias("paid")
    )
    return (
        per_account.join(accounts.select("account", "segment"), "account", "left")
        .groupBy("period", F.coalesce("segment", F.lit(unknown)).alias("segment"))
        .agg(F.sum("active").alias("active"), F.sum("paid").alias("paid"))
        .withColumn("paid_share", ratio("paid", "active"))
    )


# Transition name by (state before, state after) among active leases.
_MOVES = {
    ("paid", "paid"): "retained_paid",
    ("unpaid", "paid"): "converted",
    ("absent", "paid"): "new_paid",
    ("unpaid", "unpaid"): "retained_unpaid",
    ("absent", "unpaid"): "new_unpaid",
    ("paid", "unpaid"): "downgraded",
    ("paid", "absent"): "paid_dropped",
    ("unpaid", "absent"): "dropped_unpaid",
}


def state_transitions(states: DataFrame, first: date, last: date, firsts: DataFrame | None = None) -> DataFrame:
    """Waterfall of active leases from one period to the next.

    Active leases are paid or unpaid in a period and absent otherwise. Counts per
    period: active, paid (active or not), how each arrived or left since the period
    before, and first-time paid. The first period has no period before, so everything in
    it is new. ``paid_inactive`` are paid leases outside the active set, which close
    the balance: paid = retained_paid + converted + new_paid + paid_inactive. A lease is
    first-time paid in its period in ``firsts`` (lease_id, first), which may reach back
    further than ``states``; without it, in the first period it is paid in ``states``.
    """
    w = Window.partitionBy("lease_id").orderBy("period")
    paid_now = F.when(F.col("is_paid"), "paid").otherwise("unpaid")
    state = F.when(F.col("is_active"), paid_now).otherwise("absent")
    first_paid = F.min(F.when(F.col("is_paid"), F.col("period"))).over(Window.partitionBy("lease_id"))
    if firsts is not None:
        states = states.join(firsts, "lease_id", "left")
        first_paid = F.col("first")
    placed = states.withColumn("state", state).withColumns(
        {
            "before": F.when(
                month_diff(F.lag("period").over(w), "period") == 1, F.lag("state").over(w)
            ).otherwise("absent"),
            "follows": F.coalesce(month_diff("period", F.lead("period").over(w)) == 1, F.lit(False)),
            "first_paid": first_paid,
        }
    )

    def item(period, before, after, paid, new):
        return F.struct(
            period.alias("period"),
            before.alias("before"),
            after.alias("after"),
            paid.alias("is_paid"),
            new.alias("is_first"),
        )

    no, absent = F.lit(False), F.lit("absent")
    own = item(
        F.col("period"),
        F.col("before"),
        F.col("state"),
        F.col("is_paid"),
        F.col("is_active") & F.col("is_paid") & (F.col("first_paid") == F.col("period")),
    )
    gone = item(next_period("period"), F.col("state"), absent, no, no)
    # A lease with no row in the next period leaves a departure there.
    long = placed.select(
        F.explode(F.when(F.col("follows"), F.array(own)).otherwise(F.array(own, gone))).alias("m")
    ).select("m.*")

    def moved(b: str, a: str) -> Column:
        return F.count_if((F.col("before") == b) & (F.col("after") == a))

    moves = {name: moved(*pair) for pair, name in _MOVES.items()}
    moves["paid_churned"] = moved("paid", "unpaid") + moved("paid", "absent")
    return (
        long.filter(between("period", first, last))
        .groupBy("period")
        .agg(
            F.count_if(F.col("after") != "absent").alias("active"),
            F.count_if("is_paid").alias("paid"),
            *[c.alias(name) for name, c in moves.items()],
            F.count_if(F.col("is_paid") & (F.col("after") == "absent")).alias("paid_inactive"),
            F.count_if("is_first").alias("first_time_paid"),
        )
        .withColumn("paid_pct", pct("paid", "active"))
    )
