from __future__ import annotations

from datetime import date, datetime
from statistics import median

import pytest
from conftest import day, records
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paycadence.functions import labels
from paycadence.functions.calendar import (
    BILLING_CYCLE,
    CALENDAR_MONTH,
    BillingCalendar,
    day_diff,
    month_diff,
    month_label,
    short_month_label,
)
from paycadence.functions.quantiles import grouped_median
from paycadence.functions.ratios import pct_or_zero, ratio, ratio_or_zero, rounded, scaled, sum_if


@pytest.mark.parametrize(
    "text, period",
    [
        ("2024-01-24", "2024-01-01"),
        ("2024-01-25", "2024-02-01"),
        ("2024-01-31", "2024-02-01"),
        ("2024-02-29", "2024-03-01"),
        ("2024-12-24", "2024-12-01"),
        ("2024-12-25", "2025-01-01"),
        ("2024-12-31", "2025-01-01"),
    ],
)
def test_cycle_rolls_over(spark, text, period):
    row = spark.range(1).select(
        BILLING_CYCLE.period(F.lit(day(text))).alias("p"),
        BILLING_CYCLE.period(F.lit(text).cast("timestamp_ntz")).alias("t"),
        CALENDAR_MONTH.period(F.lit(day(text))).alias("m"),
    ).first()
    assert row.p == row.t == day(period)
    assert row.m == day(text).replace(day=1)
    assert BILLING_CYCLE.period_of(day(text)) == day(period)


@settings(max_examples=40, deadline=None)
@given(st.dates(date(1990, 1, 1), date(2040, 12, 31)), st.sampled_from([None, 2, 15, 25, 28]))
def test_period_bounds_agree_with_period_of(value, cutoff):
    cal = BillingCalendar(cutoff)
    period = cal.period_of(value)
    assert cal.first_day(period) <= value < cal.end_day(period)


def test_range_filter_equals_period_filter(spark):
    days = spark.range(900).select(F.date_add(F.lit(date(2023, 1, 1)), F.col("id").cast("int")).alias("d"))
    first, last = date(2023, 5, 1), date(2024, 3, 1)
    by_range = days.filter(BILLING_CYCLE.within("d", first, last)).count()
    by_period = days.filter(BILLING_CYCLE.period("d").between(F.lit(first), F.lit(last))).count()
    assert by_range == by_period > 0


def test_last_day_of_period(spark):
    row = spark.range(1).select(
        BILLING_CYCLE.last_day(F.lit(date(2024, 5, 1))).alias("c"),
        CALENDAR_MONTH.last_day(F.lit(date(2024, 2, 1))).alias("m"),
    ).first()
    assert (row.c, row.m) == (date(2024, 5, 24), date(2024, 2, 29))


def test_bad_cutoff_is_refused():
    with pytest.raises(ValueError):
        BillingCalendar(31)


@pytest.mark.parametrize(
    "start, end, months, days",
    [
        ("2024-01-31", "2024-02-01", 1, 1),
        ("2024-01-01", "2024-01-31", 0, 30),
        ("2024-12-31", "2025-01-01", 1, 1),
        ("2024-03-01", "2024-01-31", -2, -30),
    ],
)
def test_differences_count_boundaries(spark, start, end, months, days):
    row = spark.range(1).select(
        month_diff(F.lit(day(start)), F.lit(day(end))).alias("m"),
        day_diff(F.lit(day(start)), F.lit(day(end))).alias("d"),
    ).first()
    assert (row.m, row.d) == (months, days)


def test_day_difference_counts_midnights(spark):
    late, early = datetime(2024, 1, 1, 23), datetime(2024, 1, 2, 1)
    df = spark.createDataFrame([(late, early)], "a timestamp_ntz, b timestamp_ntz")
    assert df.select(day_diff("a", "b")).first()[0] == 1


def test_period_labels(spark):
    row = spark.range(1).select(
        month_label(F.lit(date(2026, 5, 1))).alias("a"), short_month_label(F.lit(date(2026, 5, 1))).alias("b")
    ).first()
    assert (row.a, row.b) == ("2026-05", "May '26")


def test_ratios(spark):
    df = spark.createDataFrame([(1, 4), (1, 0), (None, 4), (None, 0)], "n int, d int")
    rows = df.select(ratio("n", "d").alias("r"), ratio_or_zero("n", "d").alias("z"), pct_or_zero("n", "d").alias("p")).collect()
    assert [(r.r, r.z, r.p) for r in rows] == [(0.25, 0.25, 25.0), (None, 0.0, 0.0), (None, None, None), (None, 0.0, 0.0)]


def test_conditional_sum_is_zero_when_nothing_matches(spark):
    df = spark.createDataFrame([(1,), (2,)], "v int")
    assert df.agg(sum_if(F.col("v") > 5, "v")).first()[0] == 0


def test_presentation_helpers(spark):
    df = spark.createDataFrame([(1234567, 12.345)], "v long, p double")
    out = rounded(scaled(df, {"v": 1e6}), {"v": 2, "p": 1}).first()
    assert (out.v, out.p) == (1.23, 12.3)


def test_tenure_labels(spark):
    df = spark.createDataFrame(
        [(day("2024-01-01"), day("2024-03-01")), (day("2024-01-01"), day("2024-04-01")), (None, day("2024-04-01"))],
        "f date, p date",
    )
    got = [r[0] for r in df.select(labels.tenure_label("f", "p")).collect()]
    assert got == ["Onboarding", "Mature", "Onboarding"]
    assert df.select(labels.tenure_label("f", "p", missing=None)).collect()[2][0] == "Mature"


def test_invoice_age_labels(spark):
    df = spark.createDataFrame(
        [(day("2024-01-01"), day("2024-03-30")), (day("2024-01-01"), day("2024-03-31")), (None, day("2024-03-31"))],
        "f date, a date",
    )
    assert [r[0] for r in df.select(labels.invoice_age_label("f", "a")).collect()] == ["Onboarding", "Mature", "Mature"]
    assert df.select(labels.invoice_age_label("f", "a", missing=labels.UNKNOWN)).collect()[2][0] == "unknown"


def test_bucket_labels(spark):
    df = spark.createDataFrame([(n,) for n in (None, -1, 0, 1, 3, 4, 7, 13)], "n int")
    start = F.lit(date(2024, 1, 1))
    rows = df.select(
        labels.lag_bucket("n").alias("lag"),
        labels.age_bucket(start, F.add_months(start, F.col("n"))).alias("age"),
    ).collect()
    assert [r.lag for r in rows] == ["unknown", "M0", "M0", "M_1", "M_3", "before", "before", "before"]
    assert [r.age for r in rows] == [
        "Unknown", "Onboarding (0–2)", "Onboarding (0–2)", "Onboarding (0–2)",
        "Growth (3–6)", "Growth (3–6)", "Developed (7–12)", "Mature (13+)",
    ]


def test_day_buckets(spark):
    days = spark.createDataFrame([(date(2024, 1, n),) for n in (1, 5, 6, 19, 20, 24, 25, 31)], "d date")
    got = [r[0][:1] for r in days.select(labels.day_bucket("d")).collect()]
    assert got == list("aabbccdd")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-(10**9), 10**9), st.integers(0, 50))),
        min_size=1,
        max_size=40,
    )
)
def test_grouped_median_is_exact(spark, rows):
    df = spark.createDataFrame(rows, "k string, v bigint")
    got = {r.k: r.m for r in grouped_median(df, ["k"], "v", "m", unit=100).collect()}
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    assert got == pytest.approx({k: median(v) / 100 for k, v in groups.items()})


def test_grouped_median_with_two_keys_and_one_dominant_value(spark):
    df = spark.range(1000).select(
        (F.col("id") % 2).alias("a"), F.lit("x").alias("b"), F.when(F.col("id") < 700, 5).otherwise(F.col("id")).alias("v")
    )
    assert [r["m"] for r in records(grouped_median(df, ["a", "b"], "v", "m"), "a")] == [5.0, 5.0]
