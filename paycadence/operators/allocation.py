"""What payments were for: allocation to the charges they settle.

The grain is a ledger entry. A payment entry lists the charges it settles, and
several payments can share one entry. Charges are reduced to one row per entry
and due month and payments to one row per entry and period before they meet, so
an entry with very many charges or payments never multiplies them.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import BILLING_CYCLE, BillingCalendar, month_diff
from ..functions.ratios import currency, money_pct, pct, sum_if
from ..sources.canonical import CARD_OR_ACH, PAYMENT_ENTRY
from .lifecycle import between, lifecycle


def settled_charges(
    entries: DataFrame,
    since: date,
    accounts: DataFrame | None = None,
    round_charges: bool = False,
) -> DataFrame:
    """(entry_id, due_month, charged) of live payment entries.

    Charges whose own entry is missing or deleted drop out, and so do those of test
    accounts or unknown accounts if ``accounts`` is given. ``due_month`` is null when
    the due date is not a date. ``round_charges`` rounds each charge to whole units.
    """
    cents = F.col("_c.cents")
    lines = (
        entries.filter(
            (F.col("type") == PAYMENT_ENTRY)
            & ~F.col("deleted")
            & (F.col("due") >= F.lit(since.isoformat()))
        )
        .select("entry_id", F.explode("charges").alias("_c"))
        .select(
            "entry_id",
            F.col("_c.linked").alias("linked"),
            (F.round(cents, -2) if round_charges else cents).alias("cents"),
        )
    )
    charge = entries.filter(~F.col("deleted")).select(
        F.col("entry_id").alias("linked"),
        "account",
        F.trunc(F.try_to_date("due"), "MM").alias("due_month"),
    )
    if accounts is not None:
        live = accounts.filter(~F.col("is_test")).select("account")
        charge = charge.join(live, "account")
    return lines.join(charge, "linked").groupBy("entry_id", "due_month").agg(F.sum("cents").alias("charged"))


def _shares(offset: Column, part: Column, buckets, share=pct) -> list[Column]:
    """Percentage of the parts per named offset range (inclusive, None is open)."""
    cells = []
    for name, low, high in buckets:
        inside = F.lit(True)
        if low is not None:
            inside = inside & (offset >= low)
        if high is not None:
            inside = inside & (offset <= high)
        cells.append(share(sum_if(offset.isNotNull() & inside, part), F.sum(part)).alias(name))
    return cells


# Offset ranges (due month minus paying period) of the three reports.
PAID_FOR = (
    ("pct_prepay", 1, None),
    ("pct_current", 0, 0),
    ("pct_prior1", -1, -1),
    ("pct_prior2", -2, -2),
    ("pct_prior3plus", None, -3),
)
REACTIVATED_FOR = (
    ("pct_prepay", 1, None),
    ("pct_current", 0, 0),
    ("pct_prior1", -1, -1),
    ("pct_prior2plus", None, -2),
)
BEFORE_GAP_FOR = (
    ("pct_arrears", None, -1),
    ("pct_previous", 0, 0),
    ("pct_skipped", 1, 1),
    ("pct_ahead2plus", 2, None),
)


def apportioned(rows: DataFrame, groups: Sequence[str], cents: str, weight: str, total: str, tie: str, out: str) -> DataFrame:
    """Splits the cents of each group over its rows by weight, in whole cents that add up to them.

    Every row gets its exact share rounded down; the cents left over go to the largest remainders, one
    each, equal ones by the least ``tie`` (null first). ``total`` is the sum of the group's
    weights; where it is zero nothing is split and parts are null. Weights may be negative.
    """
    # Products that fit a long stay longs; the others, far beyond usual amounts, are decimals for a moment.
    placed = rows.withColumns({"_by": F.abs(total), "_w": F.col(weight) * F.signum(total).cast("bigint")})
    fits = f"abs(CAST({cents} AS DOUBLE) * _w) < 9.0e18D"
    exact = f"CAST({cents} AS DECIMAL(18,0)) * CAST(_w AS DECIMAL(18,0))"
    rest = f"CASE WHEN _by = 0 THEN NULL WHEN {fits} THEN pmod({cents} * _w, _by) ELSE CAST(pmod({exact}, CAST(_by AS DECIMAL(18,0))) AS BIGINT) END"
    down = f"CASE WHEN _by = 0 THEN NULL WHEN {fits} THEN ({cents} * _w - _rest) div _by ELSE CAST(({exact} - _rest) div CAST(_by AS DECIMAL(18,0)) AS BIGINT) END"
    placed = placed.withColumn("_rest", F.expr(rest)).withColumn("_down", F.expr(down))
    group = Window.partitionBy(*groups)
    left = F.col(cents) - F.sum("_down").over(group)
    rank = F.row_number().over(group.orderBy(F.col("_rest").desc(), F.col(tie).asc_nulls_first()))
    return placed.withColumn(out, F.col("_down") + (rank <= left).cast("bigint")).drop("_by", "_w", "_rest", "_down")


def payer_entries(payments: DataFrame, cal: BillingCalendar = BILLING_CYCLE) -> DataFrame:
    """Payments per payer, entry and period, for ``reactivated_charges``."""
    return _by_entry(payments, cal, "customer_id")


def _by_entry(payments: DataFrame, cal: BillingCalendar, *keys: str) -> DataFrame:
    return (
        payments.filter(F.col("method").isin(*CARD_OR_ACH))
        .groupBy(*keys, "je_id", cal.period("created").alias("period"))
        .agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))
    )


def allocate(
    payments: DataFrame,
    charges: DataFrame,
    first: date,
    last: date,
    cal: BillingCalendar = BILLING_CYCLE,
) -> DataFrame:
    """Payments split pro rata over the charges of their entry, by offset of the due month.

    An entry whose charges add up to zero allocates nothing. What an entry was paid in a period is
    split in whole cents by largest remainders, so its parts add up to it.
    """
    total = F.sum("charged").over(Window.partitionBy("entry_id"))
    shares = charges.select("entry_id", "due_month", "charged", total.alias("total"))
    paid = _by_entry(payments.filter(cal.within("created", first, last)), cal)
    rows = apportioned(paid.join(shares, paid["je_id"] == shares["entry_id"]), ["je_id", "period"], "cents", "charged", "total", "due_month", "part")
    rows = rows.select("period", month_diff("period", "due_month").alias("offset"), "part")
    return rows.groupBy("period").agg(
        currency(F.sum("part")).alias("allocated"),
        *_shares(F.col("offset"), F.col("part"), PAID_FOR),
    )


def reactivated_charges(
    by_entry: DataFrame,
    charges: DataFrame,
    first: date,
    last: date,
    gap: int = 2,
    before_gap: bool = False,
) -> DataFrame:
    """Charges settled by payers returning after a gap, by offset of the due month.

    ``by_entry`` is the result of ``payer_entries``; both directions can share it.
    By default the payments of the returning period are looked at; with ``before_gap``
    those of the last period before the gap, still reported by returning period.
    Charges count in full, once per payment on their entry.
    """
    life = lifecycle(by_entry.select("customer_id", "period").distinct(), "customer_id")
    returning = life.filter((F.col("gap") == gap) & between("period", first, last)).select(
        "customer_id",
        F.col("period").alias("returned"),
        (F.col("prev") if before_gap else F.col("period")).alias("period"),
    )
    paid = (
        by_entry.join(returning, ["customer_id", "period"])
        .groupBy("je_id", "returned", "period")
        .agg(F.sum("n").alias("n"))
    )
    rows = paid.join(charges, paid["je_id"] == charges["entry_id"]).select(
        "returned",
        month_diff("period", "due_month").alias("offset"),
        (F.col("n") * F.col("charged")).alias("part"),
    )
    buckets = BEFORE_GAP_FOR if before_gap else REACTIVATED_FOR
    return rows.groupBy(F.col("returned").alias("period")).agg(
        currency(F.sum("part")).alias("charged"),
        *_shares(F.col("offset"), F.col("part"), buckets, money_pct),
    )
