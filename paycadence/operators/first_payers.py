"""First-time payers: who they are, what they pay with, and how they split."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import BILLING_CYCLE, CALENDAR_MONTH, BillingCalendar, month_diff
from ..functions.labels import UNKNOWN, newness_label
from ..functions.quantiles import grouped_median
from ..functions.ratios import currency, flag, money_ratio, pct, ratio, sum_if
from ..sources.canonical import ACH, CARD
from .lifecycle import between, first_period, period_activity


def first_payments(
    payments: DataFrame,
    order: Sequence[str | Column],
    keep: Sequence[str],
    key: str = "customer_id",
    cal: BillingCalendar = BILLING_CYCLE,
    last: date | None = None,
) -> DataFrame:
    """One row per payer: its first payment by ``order``, with its period.

    With ``last``, payers who start after that period are left out.

    Ties that ``order`` leaves open are broken by the kept columns, so the result
    does not depend on how rows are distributed. The minimum is taken per task
    before the shuffle, so a payer with very many payments moves few rows.
    """
    columns = list(dict.fromkeys(["created", *keep]))
    if last is not None:
        payments = payments.filter(cal.up_to("created", last))
    ranks = [F.col(o) if isinstance(o, str) else o.alias(f"_{i}") for i, o in enumerate(order)]
    rest = [c for c in columns if c not in [o for o in order if isinstance(o, str)]]
    pick = F.min(F.struct(*ranks, *rest)).alias("_f")
    picked = payments.filter(F.col(key).isNotNull()).groupBy(key).agg(pick)
    return picked.select(
        key, *[F.col(f"_f.{c}").alias(c) for c in columns], cal.period("_f.created").alias("period")
    )


def adoption_trend(
    payments: DataFrame,
    first: date,
    last: date,
    method: str = CARD,
    key: str = "customer_id",
    cal: BillingCalendar = BILLING_CYCLE,
) -> DataFrame:
    """First-period payers and the percentage that used the method at all in that period.

    A payer used it in its first period exactly when its first day with the method
    falls in the same period as its first day, so one aggregate per payer is enough.
    """
    seen = payments.filter(F.col(key).isNotNull() & cal.up_to("created", last))
    days = seen.groupBy(key).agg(
        F.min("created").alias("_any"),
        F.min(F.when(F.col("method") == method, F.col("created"))).alias("_with"),
    )
    return (
        days.select(cal.period("_any").alias("period"), cal.period("_with").alias("with_period"))
        .filter(between("period", first, last))
        .groupBy("period")
        .agg(
            F.count("*").alias("payers"),
            F.count_if(F.col("period") == F.col("with_period")).alias("adopters"),
        )
        .withColumn("adoption_pct", pct("adopters", "payers"))
    )


def amount_stats(firsts: DataFrame, first: date, last: date) -> DataFrame:
    """Count, median and mean of first payments per period."""
    kept = firsts.filter(between("period", first, last))
    totals = kept.groupBy("period").agg(
        F.count("*").alias("payers"),
        ratio(currency(F.sum("cents")), F.count("cents")).alias("mean_amount"),
    )
    median = grouped_median(kept, ["period"], "cents", "median_amount", unit=100)
    return totals.join(median, "period", "left")


def split(
    firsts: DataFrame,
    dimension: Column,
    name: str,
    first: date,
    last: date,
    measures: Sequence[Column] = (),
) -> DataFrame:
    """First-time payers per period and value of a dimension, with extra aggregates."""
    return (
        firsts.filter(between("period", first, last))
        .groupBy("period", dimension.alias(name))
        .agg(F.count("*").alias("payers"), *measures)
    )


def account_totals(firsts: DataFrame) -> DataFrame:
    """First-time payers per period and account, with payers and cents by method where known.

    Account attributes are joined to these totals, not to the payers: an account with
    very many first-time payers is then one row per period.
    """
    sums = {"payers": F.count("*")}
    card, ach = F.col("method") == CARD, F.col("method") == ACH
    if "method" in firsts.columns:
        sums |= {"card_payers": F.count_if(card), "ach_payers": F.count_if(ach)}
    if "cents" in firsts.columns:
        sums |= {"cents": F.sum("cents"), "card_cents": sum_if(card, "cents"), "ach_cents": sum_if(ach, "cents")}
    return firsts.groupBy("period", "account").agg(*[c.alias(name) for name, c in sums.items()])


def with_account_start(
    rows: DataFrame, payments: DataFrame, cal: BillingCalendar = BILLING_CYCLE, how: str = "inner"
) -> DataFrame:
    """Adds ``account_first``: the first period in which the account received a payment.

    With ``how="left"`` rows without an account stay, with a null there.
    """
    accounts = first_period(payments, "account", cal).withColumnRenamed("first", "account_first")
    return rows.join(accounts, "account", how)


def split_accounts(
    totals: DataFrame, dimension: Column, name: str, first: date, last: date, measures: Sequence[Column] = ()
) -> DataFrame:
    """Account totals per period and value of an account dimension, with extra aggregates."""
    return (
        totals.filter(between("period", first, last))
        .groupBy("period", dimension.alias(name))
        .agg(F.sum("payers").alias("payers"), *measures)
    )


def with_activation(firsts: DataFrame, daily: DataFrame, frequencies: Sequence[str]) -> DataFrame:
    """Adds the lease's activation date and first account invoice; null where unknown."""
    return firsts.join(activation_dates(daily, frequencies), "lease_id", "left")


def activation_dates(daily: DataFrame, frequencies: Sequence[str], status: str = "ACTIVE") -> DataFrame:
    """First active day and first account invoice per lease with a merchant account."""
    return (
        daily.filter(
            (F.col("status") == status)
            & (F.col("merchant_flag") == 1)
            & F.col("frequency").isin(*frequencies)
        )
        .groupBy("lease_id")
        .agg(
            F.min("snapshot_date").alias("activated"),
            F.min("account_first_invoice").alias("lease_first_invoice"),
        )
    )


def with_account_invoice(firsts: DataFrame, daily: DataFrame) -> DataFrame:
    """Adds ``account_first_invoice`` through the lease's account; null where unknown.

    A lease seen on several accounts takes the greatest one.
    """
    merchants = daily.filter(F.col("merchant_flag") == 1)
    pairs = merchants.groupBy("lease_id", "account").agg(
        F.min("account_first_invoice").alias("account_first_invoice")
    )
    lease_account = pairs.groupBy("lease_id").agg(F.max("account").alias("lease_account"))
    account_start = pairs.groupBy(F.col("account").alias("lease_account")).agg(
        F.min("account_first_invoice").alias("account_first_invoice")
    )
    return firsts.join(lease_account, "lease_id", "left").join(account_start, "lease_account", "left")


def method_measures() -> list[Column]:
    """Payers by card with their percentage, over account totals."""
    return [
        F.sum("card_payers").alias("card_payers"),
        pct(F.sum("card_payers"), F.sum("payers")).alias("card_pct"),
    ]


def amount_measures() -> list[Column]:
    """Payers and dollars by method with their shares of the group, over account totals."""
    out = []
    for method in ("card", "ach"):
        payers, cents = F.sum(f"{method}_payers"), F.sum(f"{method}_cents")
        out += [
            payers.alias(f"{method}_payers"),
            ratio(payers, F.sum("payers")).alias(f"{method}_share"),
            currency(cents).alias(f"{method}_amount"),
            money_ratio(cents, F.sum("cents")).alias(f"{method}_amount_share"),
        ]
    return [*out, currency(F.sum("cents")).alias("total_amount")]


def account_measures() -> list[Column]:
    """Distinct accounts and payers per account, over account totals (one row per account)."""
    return [
        F.count("account").alias("accounts"),
        ratio(F.sum("payers"), F.count("account")).alias("expansion"),
    ]


def activation_lag(cal: BillingCalendar = BILLING_CYCLE) -> Column:
    """Periods from activation to first payment; negative if the payment came first."""
    return month_diff(cal.period("activated"), "period")


def by_account_newness(firsts: DataFrame, payments: DataFrame, first: date, last: date) -> DataFrame:
    """First-time payers by whether their account also paid for the first time (calendar months).

    Payers without an account are a group of their own.
    """
    known = with_account_start(account_totals(firsts), payments, CALENDAR_MONTH, how="left")
    label = newness_label("account_first", "period")
    return split_accounts(known, label, "segment", first, last, account_measures())


def low_mix_batches(
    payments: DataFrame,
    first: date,
    last: date,
    max_rate: float = 0.05,
    min_size: int = 20,
    method: str = CARD,
    cal: BillingCalendar = BILLING_CYCLE,
) -> DataFrame:
    """Adoption per period with and without batches.

    A batch is an account and period with at least ``min_size`` first-time payers
    of whom less than ``max_rate`` used the method. Payers without an account are
    never in a batch.
    """
    per_payer = period_activity(
        payments.filter(cal.up_to("created", last)),
        "customer_id",
        [flag(F.col("method") == method).alias("used"), F.max("account").alias("account")],
        cal,
    )
    firsts = per_payer.withColumn(
        "first", F.min("period").over(Window.partitionBy("customer_id"))
    ).filter((F.col("first") == F.col("period")) & between("period", first, last))
    groups = firsts.groupBy("period", "account").agg(
        F.count("*").alias("n"), F.sum("used").alias("used")
    )
    in_batch = (
        F.col("account").isNotNull()
        & (ratio("used", "n") < max_rate)
        & (F.col("n") >= min_size)
    )
    return (
        groups.withColumn("in_batch", in_batch)
        .groupBy("period")
        .agg(
            F.sum("n").alias("payers"),
            pct(F.sum("used"), F.sum("n")).alias("adoption_pct"),
            pct(sum_if(~F.col("in_batch"), "used"), sum_if(~F.col("in_batch"), "n")).alias("adoption_pct_without"),
            sum_if(F.col("in_batch"), "n").alias("payers_in_batches"),
        )
    )


def population_mix(
    payments: DataFrame, first: date, last: date, cal: BillingCalendar = CALENDAR_MONTH
) -> DataFrame:
    """First-time and returning payers per period: payers and dollars by method.

    First-time payers enter with their first payment only; returning payers with
    all their payments of the period, so one using both methods counts in both.
    The payer share is card / (card + ach), as published.
    """
    card, ach = F.col("method") == CARD, F.col("method") == ACH
    pick = F.min(F.struct("created", "method", "cents")).alias("_f")
    activity = period_activity(
        payments.filter((card | ach) & cal.up_to("created", last)),
        "customer_id",
        [
            flag(card).alias("card"),
            flag(ach).alias("ach"),
            sum_if(card, "cents").alias("card_cents"),
            sum_if(ach, "cents").alias("ach_cents"),
            pick,
        ],
        cal,
    )
    is_first = F.col("period") == F.min("period").over(Window.partitionBy("customer_id"))
    first_card = F.col("_f.method") == CARD
    one, zero = F.lit(1), F.lit(0)

    def choose(when_first: Column, otherwise: str) -> Column:
        return F.when(F.col("is_first"), when_first).otherwise(F.col(otherwise))

    rows = activity.withColumn("is_first", is_first).select(
        "period",
        F.when(F.col("is_first"), "first_time").otherwise("returning").alias("population"),
        choose(F.when(first_card, one).otherwise(zero), "card").alias("card"),
        choose(F.when(first_card, zero).otherwise(one), "ach").alias("ach"),
        choose(F.when(first_card, F.col("_f.cents")).otherwise(zero), "card_cents").alias("card_cents"),
        choose(F.when(first_card, zero).otherwise(F.col("_f.cents")), "ach_cents").alias("ach_cents"),
    )
    total = F.sum("card_cents") + F.sum("ach_cents")
    return (
        rows.filter(between("period", first, last))
        .groupBy("period", "population")
        .agg(
            F.count("*").alias("payers"),
            F.sum("card").alias("card_payers"),
            F.sum("ach").alias("ach_payers"),
            currency(F.sum("card_cents")).alias("card_amount"),
            currency(F.sum("ach_cents")).alias("ach_amount"),
            currency(total).alias("total_amount"),
            money_ratio(F.sum("card_cents"), total).alias("card_share"),
            ratio(F.sum("card"), F.sum("card") + F.sum("ach")).alias("card_payer_share"),
        )
    )


def payer_paths(firsts: DataFrame, first: date, last: date, cal: BillingCalendar = BILLING_CYCLE) -> DataFrame:
    """First-time payers per period and account by when their lease was activated: same period, earlier, later or unknown."""
    lag = activation_lag(cal)
    return (
        firsts.filter(between("period", first, last))
        .withColumn("_lag", lag)
        .groupBy("period", "account")
        .agg(
            F.count("*").alias("payers"),
            F.count_if(F.col("_lag") == 0).alias("same_period"),
            F.count_if(F.col("_lag") > 0).alias("earlier"),
            F.count_if(F.col("_lag") < 0).alias("later"),
            F.count_if(F.col("_lag").isNull()).alias(UNKNOWN),
        )
    )


def paths_by_label(paths: DataFrame, label: Column) -> DataFrame:
    """The counts of ``payer_paths`` summed by a label of the account."""
    counts = [c for c in paths.columns if c not in ("period", "account", "account_first")]
    return paths.groupBy("period", label.alias("label")).agg(*[F.sum(c).alias(c) for c in counts])
