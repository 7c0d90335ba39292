"""Shapes that the plans must keep as the data grows."""

from __future__ import annotations

import re

import pytest

from paycadence.plans.reports import REPORTS


def plan_of(spark, df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def no_broadcast(spark):
    """Tables too large to broadcast, as on a cluster, and plans shown before they adapt."""
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.maxMetadataStringLength": "10000",
    }
    saved = {key: spark.conf.get(key) for key in changed}
    for key, value in changed.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in saved.items():
        spark.conf.set(key, value)


FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "Exchange SinglePartition")


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_plan_has_no_unscalable_step(no_broadcast, tables, name):
    plan = plan_of(no_broadcast, REPORTS[name](no_broadcast, tables))
    # The peak is one row of a finished series; its single partition holds partial results.
    allowed = ("Exchange SinglePartition",) if name == "d04_peak_period" else ()
    assert [step for step in FORBIDDEN if step in plan and step not in allowed] == []
    # Many distinct counts in one aggregation, or a rollup, would multiply the rows.
    assert "Expand" not in plan


BOUNDED = "c01_activation_kpi c13_payers_by_account_tenure c24_mix_decomposition c25_volume_and_fee c28_day_distribution c39_totals_with_rollup".split()


@pytest.mark.parametrize("name", BOUNDED)
def test_date_range_reaches_the_scan(no_broadcast, tables, name):
    plan = plan_of(no_broadcast, REPORTS[name](no_broadcast, tables))
    scans = [line for line in plan.splitlines() if "lineitem.parquet" in line]
    assert any("GreaterThanOrEqual(l_shipdate" in scan for scan in scans)


@pytest.mark.parametrize("name", ["c19_adoption_trend", "c06_retention_any", "r13_paid_breakdown", "r10_paid_accounts"])
def test_days_after_the_last_period_are_not_read(no_broadcast, tables, name):
    plan = plan_of(no_broadcast, REPORTS[name](no_broadcast, tables))
    scans = [line for line in plan.splitlines() if "lineitem.parquet" in line]
    assert scans and all("LessThan(l_shipdate" in scan for scan in scans)


@pytest.mark.parametrize("name", ["c21_leave_one_out", "c22_heavy_hitters"])
def test_payments_are_read_once(no_broadcast, tables, name):
    plan = plan_of(no_broadcast, REPORTS[name](no_broadcast, tables))
    assert sum("lineitem.parquet" in line for line in plan.splitlines()) == 1


def test_scans_read_only_needed_columns(no_broadcast, tables):
    plan = plan_of(no_broadcast, REPORTS["c29_account_landings"](no_broadcast, tables))
    schema = re.search(r"ReadSchema: struct<([^>]*)", plan).group(1)
    assert "orders.parquet" not in plan
    assert sorted(c.split(":")[0] for c in schema.split(",")) == ["l_extendedprice", "l_partkey", "l_shipdate"]


def test_hot_leases_are_reduced_before_they_are_joined(no_broadcast, tables):
    for name in ("c27_churn_series", "c39_totals_with_rollup", "c12_lease_retention", "c01_activation_kpi", "c33_charge_allocation"):
        lines = plan_of(no_broadcast, REPORTS[name](no_broadcast, tables)).splitlines()
        # Above every scan of payments the first shuffle carries partially aggregated rows.
        for at, line in enumerate(lines):
            if "lineitem.parquet" in line:
                above = [s for s in reversed(lines[:at]) if "Exchange" in s or "HashAggregate" in s]
                assert "HashAggregate" in above[0], name
