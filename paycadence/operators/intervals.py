"""Daily lease snapshots as intervals: one row for each run of days in which nothing changed.

A day range is first reduced to one row per lease, state and month, holding a mask of its days;
that aggregation combines inside each task, so the shuffle carries months, not days. Runs are read
off the masks and merged at the seams of months and of day ranges by a window over a lease's runs.

An intervals frame has the key, the state columns, ``first_day`` and ``last_day`` (included). It
says the same as the daily rows: ``boundary_days`` gives back the days that matter to an operator
that takes least or greatest days, after ``cut`` has split intervals where a report looks.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import BILLING_CYCLE, BillingCalendar

STATE = ("account", "status", "frequency", "merchant_flag", "account_first_invoice")


def _runs(keys: list[str], masks: DataFrame) -> DataFrame:
    def days(beside: str) -> Column:
        return F.expr(f"filter(sequence(1, 31), d -> getbit(_mask, d) = 1 AND getbit(_mask, {beside}) = 0)")

    zipped = F.transform(days("d - 1"), lambda d, i: F.struct(d.alias("a"), F.get(days("d + 1"), i).alias("z")))
    runs = masks.select(*keys, "_month", F.explode(zipped).alias("_r"))
    day = lambda c: F.date_add("_month", F.col(f"_r.{c}") - 1)
    return runs.select(*keys, day("a").alias("first_day"), day("z").alias("last_day"))


def compact(
    daily: DataFrame, state: Sequence[str] = STATE, first: date | None = None, last: date | None = None, gap_days: int = 1, key: str = "lease_id"
) -> DataFrame:
    """Intervals of the snapshots between two days; repeated rows count once, rows without a day not at all.

    Days up to ``gap_days`` apart belong to one run: 1 for daily snapshots, 31 for monthly ones.
    """
    rows = daily.filter(F.col("snapshot_date").isNotNull())
    if first is not None:
        rows = rows.filter(F.col("snapshot_date") >= F.lit(first))
    if last is not None:
        rows = rows.filter(F.col("snapshot_date") <= F.lit(last))
    keys = [key, *state]
    masks = rows.groupBy(*keys, F.trunc("snapshot_date", "MM").alias("_month")).agg(
        F.expr("bit_or(shiftleft(1L, day(snapshot_date)))").alias("_mask")
    )
    return merged(_runs(keys, masks), state, gap_days, key)


def merged(intervals: DataFrame, state: Sequence[str] = STATE, gap_days: int = 1, key: str = "lease_id") -> DataFrame:
    """Joins intervals of one key and state that overlap or follow each other within ``gap_days``."""
    keys = [key, *state]
    w = Window.partitionBy(*keys).orderBy("first_day", "last_day")
    before = F.max("last_day").over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = before.isNull() | (F.datediff("first_day", before) > gap_days)
    placed = intervals.withColumn("_new", apart.cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = placed.groupBy(*keys, "_run").agg(F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"))
    return rows.select(*keys, "first_day", "last_day")


def without(intervals: DataFrame, first: date, last: date) -> DataFrame:
    """The intervals with the days between ``first`` and ``last`` taken out."""
    before = F.struct("first_day", F.least("last_day", F.date_sub(F.lit(first), 1)).alias("last_day"))
    after = F.struct(F.greatest("first_day", F.date_add(F.lit(last), 1)).alias("first_day"), "last_day")
    others = [c for c in intervals.columns if c not in ("first_day", "last_day")]
    parts = F.filter(F.array(before, after), lambda p: p["first_day"] <= p["last_day"])
    return intervals.select(*others, F.explode(parts).alias("_p")).select(*others, "_p.*").distinct()


def replaced(
    intervals: DataFrame, daily: DataFrame, first: date, last: date, state: Sequence[str] = STATE, gap_days: int = 1, key: str = "lease_id"
) -> DataFrame:
    """Intervals with one day range built anew; only that range of ``daily`` is read."""
    fresh = compact(daily, state, first, last, gap_days, key)
    return merged(without(intervals, first, last).unionByName(fresh), state, gap_days, key)


def cut(intervals: DataFrame, days: Sequence[date] = (), cal: BillingCalendar = BILLING_CYCLE) -> DataFrame:
    """Splits intervals so that pieces start at the given days, at each month and at each period of ``cal``."""
    starts = sorted({1, cal.cutoff_day or 1})
    others = [c for c in intervals.columns if c not in ("first_day", "last_day")]
    months = "sequence(trunc(first_day, 'MM'), trunc(last_day, 'MM'), interval 1 month)"
    each = ", ".join(f"date_add(m, {d - 1})" for d in starts)
    fixed = F.array(*[F.lit(d) for d in days]).cast("array<date>")
    all_ = F.concat(F.expr(f"flatten(transform({months}, m -> array({each})))"), fixed)
    inside = F.array_sort(F.array_distinct(F.filter(all_, lambda d: (d > F.col("first_day")) & (d <= F.col("last_day")))))
    split = intervals.select("*", inside.alias("_at"))
    tails = F.concat(F.transform("_at", lambda d: F.date_sub(d, 1)), F.array("last_day"))
    heads = F.concat(F.array("first_day"), F.col("_at"))
    pieces = split.select(*others, heads.alias("_a"), tails.alias("_z")).select(*others, F.explode(F.arrays_zip("_a", "_z")).alias("_p"))
    return pieces.select(*others, F.col("_p._a").alias("first_day"), F.col("_p._z").alias("last_day"))


def boundary_days(pieces: DataFrame) -> DataFrame:
    """The first and the last day of each piece, as rows of daily snapshots."""
    others = [c for c in pieces.columns if c not in ("first_day", "last_day")]
    return pieces.select(*others, F.explode(F.array_distinct(F.array("first_day", "last_day"))).alias("snapshot_date"))


def active_on(intervals: DataFrame, day: date, status: str, key: str = "lease_id") -> DataFrame:
    """Keys in a status on a day, with the other state columns."""
    return intervals.filter((F.col("status") == status) & F.lit(day).between(F.col("first_day"), F.col("last_day"))).drop("first_day", "last_day")


def day_after(day: date) -> date:
    return day + timedelta(days=1)
