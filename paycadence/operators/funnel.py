"""Activation funnel: new leases, their milestones, and what they go on to do.

``activation_cohort`` and ``journeys`` give one row per lease; the reports below
aggregate those rows. Payments are reduced to distinct days per lease before they
are joined, so a lease with very many payments brings at most one row per day.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import BILLING_CYCLE, BillingCalendar, day_diff
from ..functions.labels import invoice_age_label, tenure_label
from ..functions.quantiles import grouped_median
from ..functions.ratios import flag, pct, pct_or_zero
from ..sources.canonical import ACTIVE, INVITE, PAGE_VIEW
from .lifecycle import between


def activation_cohort(
    daily: DataFrame,
    account_first: DataFrame,
    since: date,
    until: date,
    frequencies: Sequence[str],
    max_months: int = 2,
    cal: BillingCalendar = BILLING_CYCLE,
) -> DataFrame:
    """Leases first seen on or after ``since`` and activated by ``until``.

    One row per lease: lease_id, account, activated, cohort (period) and label, which
    says whether the account was still onboarding (see ``tenure_label``).
    ``account_first`` holds (account, first): the first period of each account.
    """
    active = (
        (F.col("status") == ACTIVE)
        & F.col("snapshot_date").between(F.lit(since), F.lit(until))
        & F.col("frequency").isin(*frequencies)
        & (F.col("merchant_flag") == 1)
    )
    # Daily rows shrink to one row per lease and account in each task; choosing the
    # account of the earliest active day is then cheap.
    # Later days change neither the first day seen nor an activation by ``until``.
    spans = daily.filter(F.col("snapshot_date") <= F.lit(until)).groupBy("lease_id", "account").agg(
        F.min("snapshot_date").alias("seen"),
        F.min(F.when(active, F.col("snapshot_date"))).alias("activated"),
    )
    start = F.when(F.col("activated").isNotNull(), F.struct("activated", "account"))
    leases = (
        spans.groupBy("lease_id")
        .agg(F.min("seen").alias("seen"), F.min(start).alias("_s"))
        .filter((F.col("seen") >= F.lit(since)) & F.col("_s").isNotNull())
        .select(
            "lease_id",
            F.col("_s.account").alias("account"),
            F.col("_s.activated").alias("activated"),
            cal.period("_s.activated").alias("cohort"),
        )
        .filter(between("cohort", cal.period_of(since), cal.period_of(until)))
    )
    return leases.join(account_first.select("account", "first"), "account", "left").select(
        "lease_id",
        "account",
        "activated",
        "cohort",
        tenure_label("first", "cohort", max_months).alias("label"),
    )


def new_active_leases(
    activations: DataFrame, first: date, last: date, days: int = 90, cal: BillingCalendar = BILLING_CYCLE
) -> DataFrame:
    """Activated leases per period by the age of their first account invoice (see ``activation_dates``)."""
    return (
        activations.withColumn("period", cal.period("activated"))
        .filter(between("period", first, last))
        .groupBy("period", invoice_age_label("lease_first_invoice", "activated", days).alias("label"))
        .agg(F.count("*").alias("leases"))
    )


def memberships(leases: DataFrame) -> DataFrame:
    """(lease_id, tenant_id) pairs of leases that are not deleted; empty lists give none."""
    return leases.filter(~F.col("deleted")).select(
        "lease_id", F.explode(F.array_distinct("tenants.tenant")).alias("tenant_id")
    )


def milestones(
    members: DataFrame, tenants: DataFrame, events: DataFrame | None = None, min_leases: int = 2
) -> DataFrame:
    """First milestone times per lease, over all its payers.

    Columns: accepted_at, last_sent_at, invited_at, viewed_at (null without ``events``)
    and shared_accepted_at, the first acceptance by a payer on ``min_leases`` or more
    leases. Facts are gathered per payer first, so members are joined only once.
    """
    payers = members.groupBy("tenant_id").agg(F.count("*").alias("leases"))
    portal = tenants.select("tenant_id", "portal.accepted_at", "portal.last_sent_at")
    payers = payers.join(portal, "tenant_id", "left")
    if events is None:
        nothing = F.lit(None).cast("timestamp_ntz")
        payers = payers.withColumns({"invited_at": nothing, "viewed_at": nothing})
    else:
        seen = events.groupBy(F.col("sent_to_id").alias("tenant_id")).agg(
            F.min(F.when(F.col("event") == INVITE, F.col("ts"))).alias("invited_at"),
            F.min(F.when(F.col("event") == PAGE_VIEW, F.col("ts"))).alias("viewed_at"),
        )
        payers = payers.join(seen, "tenant_id", "left")
    shared = F.when(F.col("leases") >= min_leases, F.col("accepted_at"))
    times = ("accepted_at", "last_sent_at", "invited_at", "viewed_at")
    return (
        members.join(payers, "tenant_id")
        .groupBy("lease_id")
        .agg(*[F.min(c).alias(c) for c in times], F.min(shared).alias("shared_accepted_at"))
    )


def is_retained_member() -> Column:
    """Did a payer with several leases accept an invite before this lease was activated?"""
    return F.coalesce(F.col("shared_accepted_at") < F.col("activated"), F.lit(False))


def journeys(cohort: DataFrame, lease_milestones: DataFrame) -> DataFrame:
    """Cohort rows with their milestones; null where a lease has none."""
    return cohort.join(lease_milestones, "lease_id", "left")


def exclude_retained_members(all_journeys: DataFrame) -> DataFrame:
    return all_journeys.filter(~is_retained_member())


def retained_member_counts(all_journeys: DataFrame) -> DataFrame:
    """Cohort leases, those excluded as retained members, and those kept."""
    return (
        all_journeys.withColumn("_out", is_retained_member())
        .groupBy("cohort", "label")
        .agg(
            F.count("*").alias("leases"),
            F.count_if("_out").alias("excluded"),
            F.count_if(~F.col("_out")).alias("kept"),
        )
    )


def near(start: str, event: str, days: int) -> Column:
    """Within ``days`` days of the start, before or after; false when either is unknown."""
    return F.coalesce(F.abs(day_diff(start, event)) <= days, F.lit(False))


def _with_payment_days(rows: DataFrame, payments: DataFrame) -> DataFrame:
    """Each lease row repeated per payment day on or after activation; kept once without any."""
    days = payments.groupBy("lease_id", F.col("created").alias("paid_on")).agg(F.lit(1).alias("_")).drop("_")
    match = (rows["lease_id"] == days["lease_id"]) & (days["paid_on"] >= rows["activated"])
    return rows.join(days, match, "left").drop(days["lease_id"])


def lease_outcomes(
    rows: DataFrame,
    payments: DataFrame,
    attach_days: int = 45,
    windows: Sequence[tuple[int, int]] = ((0, 45), (45, 90)),
) -> DataFrame:
    """One row per lease with milestone and payment flags.

    A lease converts when it is portal-active and pays within ``attach_days`` of
    activation. ``kept_<i>`` says whether it paid again more than ``low`` and at most
    ``high`` days after that first payment, for the i-th window (low, high). Where payments
    have a time of day, so has the first one, and windows are counted from that time: a
    second payment of the same day is later than the first.
    """
    timed = isinstance(payments.schema["created"].dataType, T.TimestampNTZType)

    def after_first(days: int) -> Column:
        day = F.col("first_paid")
        return day + F.make_dt_interval(days=F.lit(days)) if timed else F.date_add(day, days)

    flags = rows.select(
        "lease_id",
        "account",
        "activated",
        "cohort",
        "label",
        near("activated", "accepted_at", attach_days).alias("portal_active"),
        near("activated", "last_sent_at", attach_days).alias("sent"),
        near("activated", "invited_at", attach_days).alias("invited"),
        near("activated", "viewed_at", attach_days).alias("viewed"),
        day_diff("activated", "last_sent_at").alias("days_to_sent"),
    )
    keys = flags.columns
    in_time = F.col("portal_active") & (F.col("paid_on") <= F.date_add("activated", attach_days))
    first = F.min(F.when(in_time, F.col("paid_on"))).over(Window.partitionBy("lease_id"))
    kept = [
        flag((F.col("paid_on") > after_first(low)) & (F.col("paid_on") <= after_first(high))).alias(f"kept_{i}")
        for i, (low, high) in enumerate(windows, start=1)
    ]
    # The join, the window and this aggregation share one partitioning by lease.
    return (
        _with_payment_days(flags, payments)
        .withColumn("first_paid", first)
        .groupBy(*keys, "first_paid")
        .agg(*kept)
    )


def activation_kpi(outcomes: DataFrame) -> DataFrame:
    """New, portal-active, converted and retained leases per cohort and label, with rates."""
    base = F.count("first_paid")
    one, two = F.col("kept_1") == 1, F.col("kept_2") == 1
    return outcomes.groupBy("cohort", "label").agg(
        F.count("*").alias("leases"),
        F.count_if("portal_active").alias("portal_active"),
        base.alias("converted"),
        base.alias("retention_base"),
        F.count_if(one).alias("retained_p1"),
        F.count_if(two).alias("retained_p2"),
        pct_or_zero(F.count_if(one), base).alias("retention_p1_pct"),
        pct_or_zero(F.count_if(two), base).alias("retention_p2_pct"),
        pct_or_zero(F.count_if(one & two), base).alias("habit_pct"),
        F.count_if("sent").alias("invites_sent"),
    )


def event_funnel(outcomes: DataFrame) -> DataFrame:
    """Leases reaching each step per cohort and label: invited, viewed, registered, paid, retained."""
    return outcomes.groupBy("cohort", "label").agg(
        F.count("*").alias("leases"),
        F.count_if("invited").alias("invited"),
        F.count_if("viewed").alias("viewed"),
        F.count_if("portal_active").alias("registered"),
        F.count("first_paid").alias("converted"),
        F.count_if(F.col("kept_1") == 1).alias("retained_p1"),
        F.count_if(F.col("kept_2") == 1).alias("retained_p2"),
    )


def activation_kpi_wide(outcomes: DataFrame) -> DataFrame:
    """The earlier, wider KPI: all rates, median days to invite, and invite coverage of accounts.

    ``retained`` uses the last window of the outcomes, so pass three windows to
    ``lease_outcomes``. Leases are summed per account first: accounts are then plain rows.
    """
    one, two = F.col("kept_1") == 1, F.col("kept_2") == 1
    sums = {
        "leases": F.count("*"),
        "portal_active": F.count_if("portal_active"),
        "converted": F.count("first_paid"),
        "retained": F.count_if(F.col("kept_3") == 1),
        "retained_p1": F.count_if(one),
        "retained_p2": F.count_if(two),
        "habit": F.count_if(one & two),
        "invites_sent": F.count_if("sent"),
    }
    per_account = outcomes.groupBy("cohort", "label", "account").agg(
        *[c.alias(name) for name, c in sums.items()]
    )
    totals = per_account.groupBy("cohort", "label").agg(
        *[F.sum(name).alias(name) for name in sums],
        F.count("account").alias("accounts"),
        F.count_if(F.col("account").isNotNull() & (F.col("invites_sent") > 0)).alias("accounts_invited"),
    )
    median = grouped_median(
        outcomes.filter("sent"), ["cohort", "label"], "days_to_sent", "median_days_to_invite"
    )
    return totals.join(median, ["cohort", "label"], "left").select(
        "cohort",
        "label",
        "leases",
        "portal_active",
        pct_or_zero("portal_active", "leases").alias("attach_pct"),
        "converted",
        pct_or_zero("converted", "portal_active").alias("conversion_pct"),
        F.col("converted").alias("retention_base"),
        "retained",
        pct_or_zero("retained", "converted").alias("retention_pct"),
        "retained_p1",
        "retained_p2",
        pct_or_zero("retained_p1", "converted").alias("retention_p1_pct"),
        pct_or_zero("retained_p2", "converted").alias("retention_p2_pct"),
        pct_or_zero("habit", "converted").alias("habit_pct"),
        "invites_sent",
        pct_or_zero("invites_sent", "leases").alias("invite_pct"),
        "median_days_to_invite",
        "accounts",
        "accounts_invited",
        pct_or_zero("accounts_invited", "accounts").alias("account_coverage_pct"),
    )


def days_to_event(
    rows: DataFrame, payments: DataFrame, cutoff: date, thresholds: Sequence[int] = (7, 14, 30, 45, 90)
) -> DataFrame:
    """Leases that first paid within N days of activation, cumulative, per cohort and label."""
    paid = payments.filter(F.col("created") <= F.lit(cutoff))
    per_lease = (
        _with_payment_days(rows.select("lease_id", "cohort", "label", "activated"), paid)
        .groupBy("lease_id", "cohort", "label", "activated")
        .agg(F.min("paid_on").alias("first_paid"))
    )
    days = day_diff("activated", "first_paid")
    return per_lease.groupBy("cohort", "label").agg(
        F.count("*").alias("leases"),
        F.max("activated").alias("last_activated"),
        *[F.count_if(days.between(0, n)).alias(f"within_{n}") for n in thresholds],
    )


def step_dates(rows: DataFrame, payments: DataFrame, cutoff: date) -> DataFrame:
    """One row per lease: activated, invited, registered, first_paid and second_paid dates up to the cut-off."""

    def until(column: str) -> Column:
        day = F.col(column).cast("date")
        return F.when(day <= F.lit(cutoff), day)

    steps = rows.select(
        "lease_id",
        "cohort",
        "label",
        "activated",
        until("invited_at").alias("invited"),
        until("accepted_at").alias("registered"),
    )
    keys = steps.columns
    nth = F.row_number().over(Window.partitionBy("lease_id").orderBy("paid_on"))

    def paid(n: int) -> Column:
        return F.max(F.when(F.col("_n") == n, F.col("paid_on")))

    return (
        _with_payment_days(steps, payments.filter(F.col("created") <= F.lit(cutoff)))
        .withColumn("_n", nth)
        .groupBy(*keys)
        .agg(paid(1).alias("first_paid"), paid(2).alias("second_paid"))
    )


# Step pairs: name -> (start, end, directed). Undirected pairs count events before the start too.
TRANSITIONS: Mapping[str, tuple[str, str, bool]] = {
    "activation_to_payment": ("activated", "first_paid", True),
    "activation_to_invite": ("activated", "invited", False),
    "invite_to_registration": ("invited", "registered", True),
    "registration_to_payment": ("registered", "first_paid", True),
    "payment_to_second": ("first_paid", "second_paid", True),
}


def censored_transitions(
    steps: DataFrame,
    cutoff: date,
    thresholds: Sequence[int] = (7, 14, 30, 45, 90),
    pairs: Mapping[str, tuple[str, str, bool]] = TRANSITIONS,
) -> DataFrame:
    """Per cohort, label and step pair: reach, and for each N the observable leases and the hits.

    A lease is observable for N when N days have passed between the start and the
    cut-off. All pairs go through one aggregation in long form.
    """
    long = steps.select(
        "cohort",
        "label",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("metric"),
                        F.col(start).alias("start"),
                        day_diff(start, end).alias("days"),
                        F.lit(directed).alias("directed"),
                    )
                    for name, (start, end, directed) in pairs.items()
                ]
            )
        ).alias("p"),
    ).select("cohort", "label", "p.*")
    cells = []
    for n in thresholds:
        seen = F.date_add("start", n) <= F.lit(cutoff)
        hit = F.when(F.col("directed"), F.col("days").between(0, n)).otherwise(F.abs("days") <= n)
        cells += [F.count_if(seen).alias(f"obs_{n}"), F.count_if(seen & hit).alias(f"hit_{n}")]
    return long.groupBy("cohort", "label", "metric").agg(F.count("start").alias("reach"), *cells)


def share_of_leases(rows: DataFrame, condition: Column, name: str) -> DataFrame:
    """Leases per cohort and label, those meeting the condition, and the percentage."""
    met = F.count_if(F.coalesce(condition, F.lit(False)))
    return rows.groupBy("cohort", "label").agg(
        F.count("*").alias("leases"), met.alias(name), pct(met, F.count("*")).alias(f"{name}_pct")
    )
