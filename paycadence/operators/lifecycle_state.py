"""The payer lifecycle kept up cycle by cycle.

``state`` holds one row per key: first, prev and last active period. A closed period is merged into
it from the keys that paid in it alone, one row per key on either side, and leaves one transition per
paying key (period, first, prev, gap and state as in ``lifecycle.lifecycle``). Reports read transitions,
so a cycle costs the payments of that cycle and one pass over the keys, not the whole history.

Payments that arrive late reopen their period: the state before it is what the transitions before it
say, and it and the periods after it are closed again from the keys that paid in them.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import BILLING_CYCLE, BillingCalendar, month_diff, next_period, shift_month
from ..functions.labels import skip_bucket
from .lifecycle import between, lifecycle, period_activity

COLUMNS = ("period", "first", "prev", "gap", "state")


def paid_keys(payments: DataFrame, key: str, period: date, cal: BillingCalendar = BILLING_CYCLE) -> DataFrame:
    """The keys that paid in a period; payments of other days are not read."""
    return period_activity(payments.filter(cal.within("created", period, period)), key, cal=cal).select(key)


def transitions_of(activity: DataFrame, key: str) -> DataFrame:
    """All transitions from (key, period) rows at once: where a history begins, and what increments are held against."""
    return lifecycle(activity, key).select(key, *COLUMNS)


def state_of(transitions: DataFrame, key: str) -> DataFrame:
    """The state after the last of these transitions."""
    last = F.max(F.struct("period", "prev"))
    return transitions.groupBy(key).agg(F.min("first").alias("first"), last.alias("_l")).select(key, "first", F.col("_l.prev").alias("prev"), F.col("_l.period").alias("last"))


def close(state: DataFrame, paid: DataFrame, key: str, period: date) -> tuple[DataFrame, DataFrame]:
    """The transitions of a period and the state after it, from the state before it and the keys that paid in it."""
    now = F.lit(period)
    both = (
        state.select(key, "first", "prev", "last", F.lit(False).alias("paid"))
        .unionByName(paid.select(key, *[F.lit(None).cast("date").alias(c) for c in ("first", "prev", "last")], F.lit(True).alias("paid")))
        .groupBy(key)
        .agg(*[F.max(c).alias(c) for c in ("first", "prev", "last", "paid")])
    )
    gap = month_diff("last", F.lit(period))
    label = F.when(F.col("last").isNull(), "first").when(gap == 1, "existing").otherwise("reactivated")
    moved = both.filter("paid").select(
        key, now.alias("period"), F.coalesce("first", now).alias("first"), F.col("last").alias("prev"), gap.alias("gap"), label.alias("state")
    )
    after = both.select(
        key,
        F.coalesce("first", now).alias("first"),
        F.when(F.col("paid"), F.col("last")).otherwise(F.col("prev")).alias("prev"),
        F.when(F.col("paid"), now).otherwise(F.col("last")).alias("last"),
    )
    return moved, after


def breakdown(transitions: DataFrame, first: date, last: date) -> DataFrame:
    """As ``lifecycle.paid_breakdown``, from transitions: churned is what paid a period before and doesn't exist now."""
    state = F.col("state")
    rows = transitions.filter(between("period", shift_month(first, -1), last)).groupBy("period").agg(
        F.count("*").alias("paid"),
        F.count_if(state == "existing").alias("existing"),
        F.count_if(state == "first").alias("first_time"),
        F.count_if(state == "reactivated").alias("reactivated"),
    )
    # A period in which nobody pays has its churned keys all the same.
    nothing = {c: F.lit(0).cast("long") for c in ("paid", "existing", "first_time", "reactivated")}
    own = rows.withColumn("was", F.lit(0).cast("long"))
    after = rows.select(next_period("period").alias("period"), F.col("paid").alias("was")).withColumns(nothing)
    names = ["paid", "existing", "first_time", "reactivated", "was"]
    sums = own.unionByName(after).groupBy("period").agg(*[F.sum(c).alias(c) for c in names])
    out = sums.withColumn("churned", F.col("was") - F.col("existing")).drop("was")
    return out.filter(between("period", first, last)).filter("paid + churned > 0")


def gap_mix(transitions: DataFrame, first: date, last: date) -> DataFrame:
    """As ``lifecycle.reactivation_gaps``."""
    back = transitions.filter((F.col("state") == "reactivated") & between("period", first, last))
    return back.groupBy("period", skip_bucket("gap").alias("gap_bucket")).agg(F.count("*").alias("reactivated"))


class LifecycleStore:
    """Transitions by period and the state after the last closed one, as Parquet in a shared folder.

    Closing or reopening replaces the partitions of its periods and no others; states go to a folder each,
    so a run that fails leaves the one before it.
    """

    def __init__(self, spark, folder: str, key: str, cal: BillingCalendar = BILLING_CYCLE):
        self.spark, self.folder, self.key, self.cal = spark, folder.rstrip("/"), key, cal
        self.last: date | None = None

    def transitions(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/transitions")

    def state(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/state/{self.last}")

    def _write(self, moved: DataFrame) -> None:
        writer = moved.write.partitionBy("period").mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.parquet(f"{self.folder}/transitions")

    def start(self, payments: DataFrame, last: date) -> None:
        """Closes all periods up to ``last`` from the history."""
        self._write(transitions_of(period_activity(payments.filter(self.cal.up_to("created", last)), self.key, cal=self.cal), self.key))
        self.last = last
        state_of(self.transitions(), self.key).write.mode("overwrite").parquet(f"{self.folder}/state/{last}")

    def _close(self, before: DataFrame, paid: DataFrame, period: date) -> None:
        moved, after = close(before, paid, self.key, period)
        after.write.mode("overwrite").parquet(f"{self.folder}/state/{period}")
        self._write(moved)

    def close(self, payments: DataFrame) -> date:
        """Closes the next period; returns it."""
        period = shift_month(self.last, 1)
        self._close(self.state(), paid_keys(payments, self.key, period, self.cal), period)
        self.last = period
        return period

    def reopen(self, payments: DataFrame, period: date) -> None:
        """Takes late ``payments`` of ``period`` in and closes it and all periods after it again."""
        rows = self.transitions()
        before = state_of(rows.filter(F.col("period") < F.lit(period)), self.key)
        paid, at = [], period
        while at <= self.last:
            paid.append((at, rows.filter(F.col("period") == F.lit(at)).select(self.key)))
            at = shift_month(at, 1)
        late = paid_keys(payments, self.key, period, self.cal)
        paid[0] = (period, paid[0][1].unionByName(late).distinct())
        # Read before their partitions are replaced.
        stored = []
        for at, keys in paid:
            keys.write.mode("overwrite").parquet(f"{self.folder}/reopened/{at}")
            stored.append((at, self.spark.read.parquet(f"{self.folder}/reopened/{at}")))
        folder = f"{self.folder}/reopened/state-before-{period}"
        before.write.mode("overwrite").parquet(folder)
        before = self.spark.read.parquet(folder)
        for at, keys in stored:
            self._close(before, keys, at)
            before = self.spark.read.parquet(f"{self.folder}/state/{at}")
