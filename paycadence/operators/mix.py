"""Payment mix, contribution of accounts, and period totals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import BILLING_CYCLE, BillingCalendar
from ..functions.ratios import currency, flag, money_pct, pct, sum_if
from ..sources.canonical import CARD
from . import distinct
from .lifecycle import between, period_activity


def mix_decomposition(
    payments: DataFrame,
    first: date,
    last: date,
    method: str = CARD,
    key: str = "customer_id",
    cal: BillingCalendar = BILLING_CYCLE,
) -> DataFrame:
    """Dollar share of the method overall, among first-time and returning payers, and first-time volume share."""
    activity = period_activity(
        payments.filter(cal.up_to("created", last)),
        key,
        [
            F.sum("cents").alias("cents"),
            sum_if(F.col("method") == method, "cents").alias("card"),
        ],
        cal,
    )
    new = F.col("period") == F.col("first")
    return (
        activity.withColumn("first", F.min("period").over(Window.partitionBy(key)))
        .filter(between("period", first, last))
        .groupBy("period")
        .agg(
            money_pct(F.sum("card"), F.sum("cents")).alias("overall_share"),
            money_pct(sum_if(new, "card"), sum_if(new, "cents")).alias("first_share"),
            money_pct(sum_if(~new, "card"), sum_if(~new, "cents")).alias("returning_share"),
            money_pct(sum_if(new, "cents"), F.sum("cents")).alias("first_pct_of_volume"),
        )
    )


def volume_and_fee(payments: DataFrame, period: date, cal: BillingCalendar = BILLING_CYCLE) -> DataFrame:
    """Volume, fees, effective fee (%) and number of payments by method in one period."""
    return (
        payments.filter(cal.within("created", period, period))
        .groupBy("method")
        .agg(
            currency(F.sum("cents")).alias("volume"),
            F.sum("fee").cast("double").alias("fees"),
            pct(F.sum("fee"), currency(F.sum("cents"))).alias("fee_pct"),
            F.count("*").alias("payments"),
        )
    )


def totals_with_rollup(
    payments: DataFrame, period: date, leases: DataFrame | None = None, cal: BillingCalendar = BILLING_CYCLE
) -> DataFrame:
    """Payments, volume and distinct leases by method and in total, one period.

    Rows are reduced per lease and method before they are restricted to ``leases``. The total's
    leases are the ``or`` of the methods' bitmaps, so no row is doubled; a null method keeps its
    own row.
    """
    per_lease = (
        payments.filter(cal.within("created", period, period))
        .groupBy(F.lower("method").alias("method"), "lease_id")
        .agg(F.count("*").alias("payments"), F.sum("cents").alias("cents"))
    )
    if leases is not None:
        per_lease = per_lease.join(leases.select("lease_id"), "lease_id", "left_semi")
    sums = ["payments", "cents"]
    cells = distinct.bitmaps(distinct.numbered(per_lease, "lease_id"), ["method"], *sums)
    total = distinct.counts(cells, [], "leases", *sums).withColumn("method", F.lit("TOTAL"))
    both = distinct.counts(cells, ["method"], "leases", *sums).unionByName(total)
    return both.select("method", "payments", currency("cents").alias("volume"), "leases")


def distinct_levels(
    payments: DataFrame, first: date, last: date, key: str = "lease_id", cal: BillingCalendar = BILLING_CYCLE
) -> DataFrame:
    """Distinct keys by period and method, by either, and over all, from the bitmaps of period and method."""
    rows = payments.filter(cal.within("created", first, last)).select(
        cal.period("created").alias("period"), "method", key
    )
    cells = distinct.bitmaps(distinct.numbered(rows.distinct(), key), ["period", "method"])
    groups = (["period", "method"], ["period"], ["method"], [])
    return distinct.levels(cells, groups, "keys", {"period": "date", "method": "string"})


def first_period_detail(
    payments: DataFrame,
    accounts: DataFrame,
    first: date,
    last: date | None,
    method: str = CARD,
    cal: BillingCalendar = BILLING_CYCLE,
) -> DataFrame:
    """First-time payers × account name in their first period: dollars, card dollars, used card.

    Payments are reduced once, per payer, period and account; of these rows only first
    periods are kept (found over all periods), before any account name is joined.
    Without ``last`` there is no end.
    """
    seen = payments.filter(F.col("customer_id").isNotNull())
    if last is not None:
        seen = seen.filter(cal.up_to("created", last))
    is_card = F.col("method") == method
    sums = {
        "cents": F.sum("cents"),
        "card_cents": sum_if(is_card, "cents"),
        "used_card": flag(is_card),
    }
    per_account = (
        seen.groupBy("customer_id", cal.period("created").alias("period"), "account")
        .agg(*[c.alias(name) for name, c in sums.items()])
        .withColumn("_first", F.min("period").over(Window.partitionBy("customer_id")))
        .filter((F.col("_first") == F.col("period")) & (F.col("period") >= F.lit(first)))
        .drop("_first")
    )
    # Accounts may share a name, and all accounts without one count as the same.
    return (
        per_account.join(accounts.select("account", "name"), "account", "left")
        .groupBy("customer_id", "period", "name")
        .agg(
            F.sum("cents").alias("cents"),
            F.sum("card_cents").alias("card_cents"),
            F.max("used_card").alias("used_card"),
        )
    )


def leave_one_out(detail: DataFrame, patterns: Mapping[str, str]) -> DataFrame:
    """Adoption and dollar share over all first-time payers, and without each account pattern.

    A payer belongs to its greatest account name; patterns match without regard to case
    and a payer without a name matches none.
    """
    payers = detail.groupBy("period", "customer_id").agg(
        F.max("name").alias("name"),
        F.sum("cents").alias("cents"),
        F.sum("card_cents").alias("card_cents"),
        F.max("used_card").alias("used_card"),
    )
    outside = {
        label: ~F.coalesce(F.col("name"), F.lit("")).ilike(pattern) for label, pattern in patterns.items()
    }
    adoption: list[Column] = [pct(F.sum("used_card"), F.count("*")).alias("adoption_all")]
    dollars: list[Column] = [money_pct(F.sum("card_cents"), F.sum("cents")).alias("share_all")]
    for label, kept in outside.items():
        adoption.append(pct(sum_if(kept, "used_card"), F.count_if(kept)).alias(f"adoption_without_{label}"))
        dollars.append(money_pct(sum_if(kept, "card_cents"), sum_if(kept, "cents")).alias(f"share_without_{label}"))
    return payers.groupBy("period").agg(F.count("*").alias("payers"), *adoption, *dollars)


def heavy_hitters(detail: DataFrame, min_size: int = 80, unmapped: str = "(unmapped)") -> DataFrame:
    """Account names with at least ``min_size`` first-time payers: payers, volume, card share."""
    # One row per payer, period and name, so counting rows counts payers.
    return (
        detail.groupBy("period", F.coalesce("name", F.lit(unmapped)).alias("name"))
        .agg(
            F.count("*").alias("payers"),
            currency(F.sum("cents")).alias("volume"),
            money_pct(F.sum("card_cents"), F.sum("cents")).alias("card_share"),
        )
        .filter(F.col("payers") >= min_size)
    )


def account_timeline(detail: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """First-time payers, volume and card share per period on accounts matching any pattern."""
    match = F.lit(False)
    for pattern in patterns:
        match = match | F.col("name").ilike(pattern)
    return (
        detail.filter(match)
        .groupBy("period", "customer_id")
        .agg(F.sum("cents").alias("cents"), F.sum("card_cents").alias("card_cents"))
        .groupBy("period")
        .agg(
            F.count("*").alias("payers"),
            currency(F.sum("cents")).alias("volume"),
            money_pct(F.sum("card_cents"), F.sum("cents")).alias("card_share"),
        )
    )
