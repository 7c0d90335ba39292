"""Every report, over any set of adapters and the windows of a run."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, timedelta
from decimal import Decimal
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import BILLING_CYCLE, CALENDAR_MONTH, shift_month
from ..functions.labels import (
    AGE_UNKNOWN,
    EXISTING_ACCOUNT,
    NEW_ACCOUNT,
    UNKNOWN,
    age_bucket,
    invoice_age_label,
    lag_bucket,
    tenure_label,
)
from ..operators import (
    allocation,
    cohorts,
    coverage,
    first_payers,
    funnel,
    intervals,
    lifecycle,
    lifecycle_state,
    mix,
    rates,
    report,
)
from ..sources.base import Tables
from ..sources.canonical import ACH, CARD, INVITE, PAGE_VIEW
from ..sources.tables import StarTables
from .windows import TEST_WINDOWS, Windows, inclusive_days

Builder = Callable[[Tables, Windows], DataFrame]
BUILDERS: dict[str, Builder] = {}
# The same reports on the test tables, by directory.
REPORTS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

TENURE = partial(tenure_label, "account_first", "period")
AGE = partial(age_bucket, "account_start", "period")


def report_named(name: str):
    def register(build: Builder) -> Builder:
        BUILDERS[name] = build
        REPORTS[name] = lambda spark, directory: build(StarTables(spark, directory), TEST_WINDOWS)
        return build

    return register


# Lease states ---------------------------------------------------------------------


@report_named("s02_lease_intervals")
def lease_intervals(t: Tables, w: Windows) -> DataFrame:
    """Runs of one account and status in a lease's snapshots, built in two day ranges and merged at the seam."""
    state, seam = ("account", "status"), w.first
    before = intervals.compact(t.daily(), state, last=seam, gap_days=w.snapshot_gap)
    after = intervals.compact(t.daily(), state, first=seam + timedelta(days=1), gap_days=w.snapshot_gap)
    return intervals.merged(before.unionByName(after), state, w.snapshot_gap)


# Activation funnel ---------------------------------------------------------------


def _cohort(t: Tables, w: Windows) -> DataFrame:
    def build():
        # An account that starts later is as new as one that never does.
        payments = t.payments(until=w.until, customers=False, accounts=True)
        accounts = lifecycle.first_period(payments, "account")
        return funnel.activation_cohort(t.daily(), accounts, w.since, w.until, t.frequencies)

    return t.share("cohort", build)


def _journeys(t: Tables, w: Windows, events: bool = False, exclude: bool = True) -> DataFrame:
    def build():
        seen = t.events([INVITE, PAGE_VIEW], since=w.events_since) if events else None
        steps = funnel.milestones(funnel.memberships(t.leases()), t.tenants(), seen)
        return funnel.journeys(_cohort(t, w), steps)

    rows = t.share("event_journeys" if events else "journeys", build)
    return funnel.exclude_retained_members(rows) if exclude else rows


def _outcomes(t: Tables, w: Windows, windows: Sequence[tuple[int, int]], events: bool = False) -> DataFrame:
    payments = t.payments(since=w.since, until=w.followed, customers=False, methods=None)
    return funnel.lease_outcomes(_journeys(t, w, events), payments, w.attach_days, windows)


@report_named("c01_activation_kpi")
def activation_kpi(t: Tables, w: Windows) -> DataFrame:
    return funnel.activation_kpi(_outcomes(t, w, w.outcome_windows))


@report_named("f06_kpi_by_time")
def kpi_by_time(t: Tables, w: Windows) -> DataFrame:
    """C-01 at time grain: windows run from the time of the first payment.

    Tables without times of day get an hour from the amount, so that payments of one day differ.
    """
    payments = t.payments(since=w.since, until=w.followed, customers=False, methods=None)
    if payments.schema["created"].dataType.typeName() == "date":
        hour = F.make_dt_interval(hours=(F.col("cents") % 24).cast("int"))
        payments = payments.withColumn("created", F.col("created").cast("timestamp_ntz") + hour)
    return funnel.activation_kpi(funnel.lease_outcomes(_journeys(t, w), payments, w.attach_days, w.outcome_windows))


@report_named("c02_event_funnel")
def event_funnel(t: Tables, w: Windows) -> DataFrame:
    return funnel.event_funnel(_outcomes(t, w, w.outcome_windows, events=True))


@report_named("c03_days_to_event")
def days_to_event(t: Tables, w: Windows) -> DataFrame:
    payments = t.payments(since=w.since, until=w.until, customers=False)
    return funnel.days_to_event(_journeys(t, w), payments, w.until)


@report_named("c04_censored_transitions")
def censored_transitions(t: Tables, w: Windows) -> DataFrame:
    payments = t.payments(since=w.since, until=w.cutoff, customers=False)
    steps = funnel.step_dates(_journeys(t, w, events=True), payments, w.cutoff)
    return funnel.censored_transitions(steps, w.cutoff)


@report_named("c05_retained_members")
def retained_members(t: Tables, w: Windows) -> DataFrame:
    return funnel.retained_member_counts(_journeys(t, w, exclude=False))


# Payer and lease retention -------------------------------------------------------


def _retention(t: Tables, w: Windows, first_methods=None, return_methods=None) -> DataFrame:
    return cohorts.retention_matrix(
        t.payments(recurring=True, methods=None), *w.cohorts, first_methods=first_methods, return_methods=return_methods
    )


@report_named("c06_retention_any")
def retention_any(t: Tables, w: Windows) -> DataFrame:
    return _retention(t, w)


@report_named("c07_retention_ach")
def retention_ach(t: Tables, w: Windows) -> DataFrame:
    return _retention(t, w, [ACH], [ACH])


@report_named("c08_retention_card")
def retention_card(t: Tables, w: Windows) -> DataFrame:
    return _retention(t, w, [CARD], [CARD])


@report_named("c09_retention_ach_any_return")
def retention_ach_any(t: Tables, w: Windows) -> DataFrame:
    return _retention(t, w, [ACH])


@report_named("c10_retention_card_any_return")
def retention_card_any(t: Tables, w: Windows) -> DataFrame:
    return _retention(t, w, [CARD])


@report_named("c11_eligible_retention")
def eligible_retention(t: Tables, w: Windows) -> DataFrame:
    return cohorts.eligible_retention(t.payments(), t.payments(recurring=True), t.lease_status(), *w.eligible)


def _lease_retention(t: Tables, w: Windows, last: date, cut: date | None = None) -> DataFrame:
    until = BILLING_CYCLE.end_day(last) - timedelta(days=1)
    since = BILLING_CYCLE.first_day(BILLING_CYCLE.period_of(w.since))
    payments = t.payments(since=since, until=until, customers=False)
    return cohorts.contract_retention(_cohort(t, w), payments, last=cut)


@report_named("c12_lease_retention")
def lease_retention(t: Tables, w: Windows) -> DataFrame:
    return _lease_retention(t, w, shift_month(BILLING_CYCLE.period_of(w.until), 7))


# First-time payers ---------------------------------------------------------------


def _scoped_firsts(t: Tables, w: Windows) -> DataFrame:
    payments = t.payments(recurring=True, methods=None)
    return first_payers.first_payments(payments, ["created", "lease_id"], ["lease_id"], last=w.last)


def _account_payments(t: Tables, w: Windows) -> DataFrame:
    return t.payments(since=w.lookback, customers=False, accounts=True)


@report_named("c13_payers_by_account_tenure")
def payers_by_tenure(t: Tables, w: Windows) -> DataFrame:
    payments = t.payments(since=w.lookback, accounts=True).filter(F.col("account").isNotNull())
    order = [BILLING_CYCLE.period("created"), "account"]
    firsts = first_payers.first_payments(payments, order, ["account"], last=w.last)
    totals = first_payers.with_account_start(first_payers.account_totals(firsts), _account_payments(t, w))
    return first_payers.split_accounts(totals, TENURE(missing=None), "label", w.first, w.last)


@report_named("c14_method_by_account_tenure")
def method_by_tenure(t: Tables, w: Windows) -> DataFrame:
    payments = t.payments(since=w.lookback, accounts=True).filter(F.col("account").isNotNull())
    firsts = first_payers.first_payments(payments, ["created", "account"], ["account", "method"], last=w.last)
    totals = first_payers.with_account_start(first_payers.account_totals(firsts), _account_payments(t, w))
    measures = first_payers.method_measures()
    return first_payers.split_accounts(totals, TENURE(missing=None), "label", w.first, w.last, measures)


@report_named("c15_low_mix_batches")
def low_mix_batches(t: Tables, w: Windows) -> DataFrame:
    payments = t.payments(since=w.lookback, accounts=True, named=True)
    return first_payers.low_mix_batches(payments, w.batches_first, w.last, w.batch_max_rate, w.batch_min_size)


def _activated_firsts(t: Tables, w: Windows) -> DataFrame:
    return first_payers.with_activation(_scoped_firsts(t, w), t.daily(), t.frequencies)


@report_named("c16_activation_lag")
def activation_lag(t: Tables, w: Windows) -> DataFrame:
    bucket = lag_bucket(first_payers.activation_lag())
    return first_payers.split(_activated_firsts(t, w), bucket, "bucket", w.first, w.last)


@report_named("c17_payers_by_lease_invoice_age")
def payers_by_lease_age(t: Tables, w: Windows) -> DataFrame:
    known = invoice_age_label("lease_first_invoice", "activated")
    label = F.when(F.col("activated").isNull(), UNKNOWN).otherwise(known)
    return first_payers.split(_activated_firsts(t, w), label, "label", w.first, w.last)


@report_named("c18_payers_by_account_invoice_age")
def payers_by_account_age(t: Tables, w: Windows) -> DataFrame:
    firsts = first_payers.with_account_invoice(_scoped_firsts(t, w), t.daily())
    label = invoice_age_label("account_first_invoice", "created", missing=UNKNOWN)
    return first_payers.split(firsts, label, "label", w.first, w.last)


@report_named("c19_adoption_trend")
def adoption_trend(t: Tables, w: Windows) -> DataFrame:
    return first_payers.adoption_trend(t.payments(since=w.lookback), w.first, w.last)


@report_named("c20_first_payment_size")
def first_payment_size(t: Tables, w: Windows) -> DataFrame:
    payments = t.payments(since=w.lookback)
    firsts = first_payers.first_payments(payments, ["created", "cents"], ["cents"], last=w.last)
    return first_payers.amount_stats(firsts, w.first, w.last)


@report_named("f09_first_payment_size_by_month")
def first_payment_size_by_month(t: Tables, w: Windows) -> DataFrame:
    whole = {"mean_amount": 0, "median_amount": 0}
    return report.ordered(report.presented(first_payment_size(t, w), whole), "month")


# Contribution and mix ------------------------------------------------------------


def _detail(t: Tables, w: Windows, first: date, last: date | None) -> DataFrame:
    payments = t.payments(since=w.lookback, accounts=True, named=True)
    return mix.first_period_detail(payments, t.named_accounts(), first, last)


def _two_period_detail(t: Tables, w: Windows) -> DataFrame:
    return t.share("detail", lambda: _detail(t, w, *w.detail))


@report_named("c21_leave_one_out")
def leave_one_out(t: Tables, w: Windows) -> DataFrame:
    return mix.leave_one_out(_two_period_detail(t, w), dict(w.leave_out))


@report_named("c22_heavy_hitters")
def heavy_hitters(t: Tables, w: Windows) -> DataFrame:
    return report.ordered(mix.heavy_hitters(_two_period_detail(t, w), w.heavy_min_size), "period", "-payers")


@report_named("c23_account_timeline")
def account_timeline(t: Tables, w: Windows) -> DataFrame:
    """Every period since the lookback: the timeline has no end."""
    if not w.timeline:
        raise ValueError("the account timeline needs name patterns in the windows' timeline")
    return mix.account_timeline(_detail(t, w, BILLING_CYCLE.period_of(w.lookback), None), w.timeline)


@report_named("c24_mix_decomposition")
def mix_decomposition(t: Tables, w: Windows) -> DataFrame:
    return mix.mix_decomposition(t.payments(since=w.lookback), *w.mix)


@report_named("c25_volume_and_fee")
def volume_and_fee(t: Tables, w: Windows) -> DataFrame:
    return mix.volume_and_fee(t.payments(**inclusive_days(w.cycle, w.cycle), customers=False), w.cycle)


@report_named("f17_volume_in_millions")
def volume_in_millions(t: Tables, w: Windows) -> DataFrame:
    """Volume in millions, fees in thousands, as published for the cycle."""
    rows = volume_and_fee(t, w).withColumn("period", F.lit(w.cycle))
    shown = report.presented(rows, {"volume": 1, "fees": 1, "fee_pct": 3}, {"volume": 1e6, "fees": 1e3})
    return report.ordered(shown, "method")


@report_named("c26_churn_mix")
def churn_mix(t: Tables, w: Windows) -> DataFrame:
    before, earlier = shift_month(w.cycle, -1), shift_month(w.cycle, -2)
    payments = t.payments(**inclusive_days(earlier, w.cycle), recurring=True)
    return lifecycle.churn_mix(
        payments.filter(F.col("method").isin(CARD, ACH)),
        "customer_id",
        [
            (f"1 churned in {w.cycle:%Y-%m}, {before:%Y-%m} mix", before, False),
            (f"2 churned in {before:%Y-%m}, {earlier:%Y-%m} mix", earlier, False),
            (f"3 retained {before:%Y-%m} to {w.cycle:%Y-%m}", before, True),
        ],
    )


@report_named("c27_churn_series")
def churn_series(t: Tables, w: Windows) -> DataFrame:
    payments = t.payments(**inclusive_days(w.churn_since, w.churn[1]), customers=False, methods=None)
    return lifecycle.churn_series(payments, "lease_id", *w.churn, keep=t.recurring_leases())


@report_named("c28_day_distribution")
def day_distribution(t: Tables, w: Windows) -> DataFrame:
    since, until = min(w.day_ranges)[0], max(w.day_ranges)[1]
    payments = t.payments(since=since, until=until, recurring=True, methods=None)
    return rates.day_distribution(payments, w.day_ranges)


@report_named("c29_account_landings")
def account_landings(t: Tables, w: Windows) -> DataFrame:
    payments = t.payments(since=w.landings_since, customers=False, accounts=True)
    return lifecycle.landings(payments, "account", *w.landings)


@report_named("c30_new_active_leases")
def new_active_leases(t: Tables, w: Windows) -> DataFrame:
    activations = first_payers.activation_dates(t.daily(), t.frequencies)
    return funnel.new_active_leases(activations, *w.new_active)


@report_named("c31_return_rate")
def return_rate(t: Tables, w: Windows) -> DataFrame:
    payments = t.payments(**inclusive_days(*w.rates), customers=False)
    return rates.return_rate(payments, t.returns(), *w.rates)


# The two fee tiers reported on.
TIERS = {"txn_25": Decimal("0.25"), "txn_40": Decimal("0.40")}


@report_named("c32_returns_by_tier")
def returns_by_tier(t: Tables, w: Windows) -> DataFrame:
    return rates.returns_by_tier(t.returns(), TIERS, *w.rates)


# Allocation ----------------------------------------------------------------------


@report_named("c33_charge_allocation")
def charge_allocation(t: Tables, w: Windows) -> DataFrame:
    entries_since, since, first, last = w.charges
    payments = t.payments(since=since, until=inclusive_days(last, last)["until"], customers=False)
    charges = allocation.settled_charges(t.entries(), entries_since, t.accounts(), round_charges=True)
    return allocation.allocate(payments, charges, first, last)


def _reactivated(t: Tables, w: Windows, before_gap: bool) -> DataFrame:
    entries_since, since, first, last = w.reactivated_charges
    charges = allocation.settled_charges(t.entries(), entries_since)

    def build():
        return allocation.payer_entries(t.payments(since=since, until=inclusive_days(last, last)["until"]))

    return allocation.reactivated_charges(t.share("payer_entries", build), charges, first, last, before_gap=before_gap)


@report_named("c36_reactivated_charges")
def reactivated_charges(t: Tables, w: Windows) -> DataFrame:
    return _reactivated(t, w, before_gap=False)


@report_named("c37_charges_before_gap")
def charges_before_gap(t: Tables, w: Windows) -> DataFrame:
    return _reactivated(t, w, before_gap=True)


# Coverage and reactivation -------------------------------------------------------


@report_named("c34_invite_coverage")
def invite_coverage(t: Tables, w: Windows) -> DataFrame:
    active = coverage.active_accounts(t.daily(), *w.coverage)
    inviting = coverage.inviting_accounts(t.events([INVITE], *w.coverage))
    return coverage.coverage(active, inviting, ["period", "account"], ["period", "label"])


@report_named("c35_reactivation_gaps")
def reactivation_gaps(t: Tables, w: Windows) -> DataFrame:
    since, first, last = w.gaps
    payments = t.payments(since=since, recurring=True, methods=None)
    return lifecycle.reactivation_gaps(payments, "customer_id", first, last)


@report_named("c38_reactivation_series")
def reactivation_series(t: Tables, w: Windows) -> DataFrame:
    since, first, last = w.seasonality
    payments = t.payments(since=since, recurring=True, methods=None)
    return lifecycle.reactivation_series(payments, "customer_id", first, last)


@report_named("c39_totals_with_rollup")
def totals_with_rollup(t: Tables, w: Windows) -> DataFrame:
    payments = t.payments(**inclusive_days(w.cycle, w.cycle), customers=False, methods=None)
    return report.ordered(mix.totals_with_rollup(payments, w.cycle, t.recurring_leases()), "-volume")


@report_named("a13_distinct_levels")
def distinct_levels(t: Tables, w: Windows) -> DataFrame:
    """Leases that paid, by period and method and on every level above."""
    payments = t.payments(**inclusive_days(w.first, w.last), customers=False)
    return mix.distinct_levels(payments, w.first, w.last)


# Published results ---------------------------------------------------------------


@report_named("r01_first_and_returning_mix")
def population_mix(t: Tables, w: Windows) -> DataFrame:
    return first_payers.population_mix(t.payments(), *w.history)


def _month_firsts(t: Tables, w: Windows) -> DataFrame:
    def build():
        order, keep = ["created", "account", "method"], ["account", "method", "cents"]
        payments = t.payments(accounts=True)
        return first_payers.first_payments(payments, order, keep, cal=CALENDAR_MONTH, last=w.last)

    return t.share("month_firsts", build)


def _aged_totals(t: Tables, w: Windows) -> DataFrame:
    starts = t.daily().groupBy("account").agg(F.min("account_first_invoice").alias("account_start"))
    return first_payers.account_totals(_month_firsts(t, w)).join(starts, "account", "left")


@report_named("r02_first_payers_by_account_age")
def by_account_age(t: Tables, w: Windows) -> DataFrame:
    measures = first_payers.amount_measures()
    return first_payers.split_accounts(_aged_totals(t, w), AGE(), "bucket", w.first, w.last, measures)


@report_named("r03_first_payers_by_newness")
def by_newness(t: Tables, w: Windows) -> DataFrame:
    payments = t.payments(customers=False, accounts=True)
    return first_payers.by_account_newness(_month_firsts(t, w), payments, w.first, w.last).drop("expansion")


@report_named("r04_first_payers_and_accounts")
def payers_and_accounts(t: Tables, w: Windows) -> DataFrame:
    measures = first_payers.account_measures()
    return first_payers.split_accounts(_aged_totals(t, w), AGE(), "bucket", w.first, w.last, measures).drop("expansion")


@report_named("r05_first_payer_paths")
def payer_paths(t: Tables, w: Windows) -> DataFrame:
    order = ["created", "lease_id", "account"]
    payments = t.payments(recurring=True, accounts=True, methods=None)
    firsts = first_payers.first_payments(payments, order, ["lease_id", "account"], last=w.last)
    firsts = first_payers.with_activation(firsts, t.daily(), t.frequencies)
    paths = first_payers.payer_paths(firsts, w.first, w.last)
    starts = first_payers.with_account_start(paths, t.payments(customers=False, accounts=True), how="left")
    return first_payers.paths_by_label(starts, TENURE(missing=UNKNOWN))


@report_named("r06_invited_at_activation")
def invited_at_activation(t: Tables, w: Windows) -> DataFrame:
    rows = _journeys(t, w, events=True, exclude=False)
    return funnel.share_of_leases(rows, F.col("invited_at").cast("date") <= F.col("activated"), "invited")


@report_named("r07_activation_kpi_wide")
def activation_kpi_wide(t: Tables, w: Windows) -> DataFrame:
    return funnel.activation_kpi_wide(_outcomes(t, w, (*w.outcome_windows, w.retained_window)))


@report_named("r08_attach_rate")
def attach_rate(t: Tables, w: Windows) -> DataFrame:
    attached = funnel.near("activated", "accepted_at", w.attach_days)
    return funnel.share_of_leases(_journeys(t, w, exclude=False), attached, "attached")


@report_named("r09_new_lease_eligibility")
def new_lease_eligibility(t: Tables, w: Windows) -> DataFrame:
    registered = F.col("accepted_at").cast("date") <= BILLING_CYCLE.last_day("cohort")
    return funnel.share_of_leases(_journeys(t, w, exclude=False), registered, "eligible")


@report_named("r10_paid_accounts")
def paid_accounts(t: Tables, w: Windows) -> DataFrame:
    return lifecycle.first_and_returning(t.payments(customers=False, accounts=True), "account", *w.history)


def _states(t: Tables, w: Windows) -> DataFrame:
    def build():
        payments = t.payments(**inclusive_days(w.first, w.last), customers=False, accounts=True)
        return coverage.active_and_paid(
            coverage.active_leases(t.daily(), w.first, w.last, at_cutoff=w.active_at_cutoff),
            coverage.paid_leases(payments, w.first, w.last),
        )

    return t.share("states", build)


@report_named("r11_eligible_and_paid")
def eligible_and_paid(t: Tables, w: Windows) -> DataFrame:
    registered = funnel.milestones(funnel.memberships(t.leases()), t.tenants()).select("lease_id", "accepted_at")
    rule = F.col("accepted_at").cast("date") <= BILLING_CYCLE.last_day("period")
    return coverage.eligible_share(_states(t, w), registered, rule)


@report_named("r12_state_transitions")
def state_transitions(t: Tables, w: Windows) -> DataFrame:
    firsts = lifecycle.first_period(t.payments(until=inclusive_days(w.last, w.last)["until"], customers=False), "lease_id")
    moves = coverage.state_transitions(_states(t, w), w.first, w.last, firsts)
    return report.period_changes(moves, ["active", "paid", "paid_pct"])


@report_named("r13_paid_breakdown")
def paid_breakdown(t: Tables, w: Windows) -> DataFrame:
    return lifecycle.paid_breakdown(t.payments(customers=False), "lease_id", *w.history)


@report_named("r13_payers_by_increment")
def payers_by_increment(t: Tables, w: Windows) -> DataFrame:
    """The paid breakdown of payers for the last three periods, each closed from the state before it and its own payments."""
    key, last = "customer_id", w.history[1]
    base = shift_month(last, -3)
    known = lifecycle.period_activity(t.payments(until=inclusive_days(base, base)["until"]), key)
    moved = lifecycle_state.transitions_of(known, key)
    state = lifecycle_state.state_of(moved, key)
    for period in (shift_month(base, n) for n in (1, 2, 3)):
        paid = lifecycle_state.paid_keys(t.payments(**inclusive_days(period, period)), key, period)
        rows, state = lifecycle_state.close(state, paid, key, period)
        moved = moved.unionByName(rows)
    return lifecycle_state.breakdown(moved, shift_month(base, 1), last)


@report_named("r14_paid_by_segment")
def paid_by_segment(t: Tables, w: Windows) -> DataFrame:
    return coverage.paid_share_by_segment(_states(t, w), t.accounts())


@report_named("r15_retention_heatmap")
def retention_heatmap(t: Tables, w: Windows) -> DataFrame:
    return cohorts.with_percentages(_lease_retention(t, w, w.last, cut=w.last))


@report_named("r16_paid_share")
def paid_share(t: Tables, w: Windows) -> DataFrame:
    return coverage.paid_share(_states(t, w))


@report_named("r17_method_stickiness")
def method_stickiness(t: Tables, w: Windows) -> DataFrame:
    return cohorts.stickiness(t.payments(), w.first, w.last)


# Report-time steps ---------------------------------------------------------------

POPULATIONS = {"first_time": "first_time", "returning": "returning"}
NEWNESS = {EXISTING_ACCOUNT: "existing", NEW_ACCOUNT: "new", AGE_UNKNOWN: "unknown"}


@report_named("d01_report_series")
def report_series(t: Tables, w: Windows) -> DataFrame:
    return report.report_series(by_newness(t, w), "segment", "payers", NEWNESS, w.last)


@report_named("d02_stacked_total")
def stacked_total(t: Tables, w: Windows) -> DataFrame:
    complete = shift_month(w.history[1], -6)
    series = report.report_series(population_mix(t, w), "population", "payers", POPULATIONS, complete)
    return series.select("period", "total")


@report_named("d03_composition")
def composition(t: Tables, w: Windows) -> DataFrame:
    mart = by_account_age(t, w).select("period", "bucket", "payers")
    return report.composition(mart, "bucket", "payers", w.first, [AGE_UNKNOWN])


def _paid_series(t: Tables, w: Windows) -> DataFrame:
    return lifecycle.paid_breakdown(t.payments(), "customer_id", *w.history).select("period", "paid")


@report_named("d04_year_over_year")
def year_over_year(t: Tables, w: Windows) -> DataFrame:
    return report.year_over_year(_paid_series(t, w), "paid")


@report_named("d04_peak_period")
def peak_period(t: Tables, w: Windows) -> DataFrame:
    return report.peak(_paid_series(t, w), "paid")


@report_named("d05_expansion")
def expansion(t: Tables, w: Windows) -> DataFrame:
    return report.expansion(payers_and_accounts(t, w)).select("period", "bucket", "expansion")


@report_named("d06_reconcile")
def reconcile(t: Tables, w: Windows) -> DataFrame:
    return report.reconcile(by_account_age(t, w), by_newness(t, w), "payers")


@report_named("d06_mismatches")
def mismatches(t: Tables, w: Windows) -> DataFrame:
    two_methods = population_mix(t, w).filter(F.col("population") == "first_time")
    return report.reconcile(by_newness(t, w), two_methods, "payers")


@report_named("d06_invariants")
def invariants(t: Tables, w: Windows) -> DataFrame:
    """Pairs of marts that must agree: periods compared, and those whose totals differ."""
    states, aged, newness = _states(t, w), by_account_age(t, w), by_newness(t, w)
    segments, share = coverage.paid_share_by_segment(states, t.accounts()), coverage.paid_share(states)
    moves, lives = state_transitions(t, w), paid_breakdown(t, w).filter(F.col("period").between(w.first, w.last))
    return report.agreement(
        {
            "active: segments and all": (segments, share, "active"),
            "paid: segments and all": (segments, share, "paid"),
            "paid: transitions and breakdown": (moves, lives, "paid"),
            "first-time payers: age and newness": (aged, newness, "payers"),
        }
    )


@report_named("d07_month_label")
def labelled_series(t: Tables, w: Windows) -> DataFrame:
    series = report.report_series(population_mix(t, w), "population", "payers", POPULATIONS, w.history[1])
    return report.with_label(series).select("period", "label", "first_time", "returning", "total")
