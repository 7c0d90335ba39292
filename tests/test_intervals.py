from __future__ import annotations

import random
from collections import defaultdict
from dataclasses import replace
from datetime import date, timedelta

import pytest
from conftest import records
from pyspark.sql import functions as F

from paycadence.operators import intervals
from paycadence.plans.reports import BUILDERS
from paycadence.plans.windows import TEST_WINDOWS
from paycadence.sources.interval_tables import IntervalTables
from paycadence.sources.tables import StarTables

STATE = ("account", "status")
DAILY = "lease_id string, account string, status string, snapshot_date date, extra int"


def random_days(seed, n=900):
    random.seed(seed)
    base = date(2023, 12, 20)
    rows = [(f"l{random.randint(0, 9)}", random.choice(["a", "b", None]), random.choice(["ACTIVE", "FUTURE"]), base + timedelta(random.randint(0, 120)), 1) for _ in range(n)]
    hot = [("hot", "a", "ACTIVE", base + timedelta(d % 100), 2) for d in range(400)]
    return rows + rows[:50] + hot + [("l1", "a", "ACTIVE", None, 0), (None, "a", "ACTIVE", base, 0)]


def plain_runs(rows, gap=1, first=date.min, last=date.max):
    days = defaultdict(set)
    for lease, account, status, day, *_ in rows:
        if day is not None and first <= day <= last:
            days[lease, account, status].add(day)
    out = []
    for key, found in days.items():
        run = []
        for day in sorted(found):
            if run and (day - run[-1]).days > gap:
                out.append((*key, run[0], run[-1]))
                run = []
            run.append(day)
        out.append((*key, run[0], run[-1]))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("lease_id", "account", "status", "first_day", "last_day").collect()), key=repr)


@pytest.mark.parametrize("gap", [1, 4, 31])
def test_intervals_are_runs_of_days(spark, gap):
    rows = random_days(gap)
    daily = spark.createDataFrame(rows, DAILY)
    assert found(intervals.compact(daily, STATE, gap_days=gap)) == plain_runs(rows, gap)
    # Day ranges built apart and merged at the seam say the same, wherever the seam lies.
    for seam in (date(2023, 12, 31), date(2024, 2, 10)):
        parts = intervals.compact(daily, STATE, last=seam, gap_days=gap).unionByName(intervals.compact(daily, STATE, first=seam + timedelta(1), gap_days=gap))
        assert found(intervals.merged(parts, STATE, gap)) == plain_runs(rows, gap)
    assert intervals.compact(daily.limit(0), STATE).count() == 0


def test_a_day_range_is_replaced(spark):
    first, last = date(2024, 1, 10), date(2024, 2, 15)
    old, new = random_days(7), random_days(8)
    stored = intervals.compact(spark.createDataFrame(old, DAILY), STATE)
    got = intervals.replaced(stored, spark.createDataFrame(new, DAILY), first, last, STATE)
    inside = [r for r in new if r[3] is not None and first <= r[3] <= last]
    outside = [r for r in old if r[3] is not None and not first <= r[3] <= last]
    assert found(got) == plain_runs(inside + outside)
    late = intervals.without(intervals.compact(spark.createDataFrame([("x", "a", "S", first, 0)], DAILY), STATE), first, last)
    assert late.count() == 0


def test_pieces_start_where_reports_look(spark):
    rows = [("l", "a", "ACTIVE", date(2024, 1, 20) + timedelta(d), 0) for d in range(40)]
    runs = intervals.compact(spark.createDataFrame(rows, DAILY), STATE)
    pieces = [(str(r.first_day), str(r.last_day)) for r in intervals.cut(runs, [date(2024, 2, 3), date(2030, 1, 1)]).orderBy("first_day").collect()]
    assert pieces == [("2024-01-20", "2024-01-24"), ("2024-01-25", "2024-01-31"), ("2024-02-01", "2024-02-02"), ("2024-02-03", "2024-02-24"), ("2024-02-25", "2024-02-28")]
    days = intervals.boundary_days(intervals.cut(runs)).count()
    assert days == 8 and intervals.active_on(runs, date(2024, 2, 28), "ACTIVE").count() == 1
    assert intervals.active_on(runs, date(2024, 2, 29), "ACTIVE").count() == 0


class DenseStar(StarTables):
    """Each monthly snapshot of the test tables holds for some days on; longer runs cross months."""

    def daily(self):
        length = (F.pmod(F.xxhash64("lease_id"), F.lit(45)) + 1).cast("int")
        days = F.sequence("snapshot_date", F.date_add("snapshot_date", length))
        return super().daily().withColumn("snapshot_date", F.explode(days)).distinct()


@pytest.fixture(scope="module")
def dense(spark, tables, tmp_path_factory):
    folder = tmp_path_factory.mktemp("dense")
    daily = DenseStar(spark, tables).daily()
    daily.write.parquet(f"{folder}/daily")
    stored = spark.read.parquet(f"{folder}/daily")
    intervals.compact(stored).write.parquet(f"{folder}/intervals")
    base = DenseStar(spark, tables)
    base.daily = lambda: stored
    return base, spark.read.parquet(f"{folder}/intervals")


READ_DAILY = (
    "c01_activation_kpi c05_retained_members c11_eligible_retention c12_lease_retention c16_activation_lag c17_payers_by_lease_invoice_age "
    "c18_payers_by_account_invoice_age c30_new_active_leases c34_invite_coverage r02_first_payers_by_account_age r05_first_payer_paths "
    "r12_state_transitions r16_paid_share"
).split()


@pytest.mark.parametrize("name", READ_DAILY)
def test_reports_over_intervals_equal_those_over_days(dense, name):
    base, stored = dense
    windows = replace(TEST_WINDOWS, since=date(1995, 2, 13), coverage=(date(1995, 3, 9), date(1997, 11, 20)))
    over_days = BUILDERS[name](base, windows)
    want = records(over_days, *over_days.columns)
    got = records(BUILDERS[name](IntervalTables(base, stored, windows), windows), *over_days.columns)
    assert want and got == want
    assert stored.count() * 5 < base.daily().count()


def test_only_the_day_range_is_read(spark, tmp_path):
    spark.createDataFrame(random_days(3), DAILY).write.parquet(f"{tmp_path}/daily")
    stored = spark.read.parquet(f"{tmp_path}/daily")
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    try:
        plan = intervals.compact(stored, STATE, date(2024, 1, 1), date(2024, 1, 31))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(snapshot_date,2024-01-01)" in plan and "LessThanOrEqual(snapshot_date,2024-01-31)" in plan
    assert "extra" not in plan
