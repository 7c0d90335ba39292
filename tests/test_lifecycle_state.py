from __future__ import annotations

import random
from datetime import date

from conftest import records, simple_payments
from pyspark.sql import functions as F

from paycadence.functions.calendar import shift_month
from paycadence.operators import lifecycle, lifecycle_state
from paycadence.operators.lifecycle_state import LifecycleStore

KEY = "customer_id"
FIRST, LAST = date(2023, 1, 1), date(2024, 2, 1)


def history(seed, n=400):
    random.seed(seed)
    rows = []
    for _ in range(n):
        month = shift_month(FIRST, random.randint(0, 13))
        rows.append((f"c{random.randint(0, 40)}", random.choice(["charge", "payment"]), 100, str(month.replace(day=random.choice([1, 10, 24])))))
    rows += [("hot", "charge", 1, f"2023-{m:02}-05") for m in range(1, 13) for _ in range(20)] + [(None, "charge", 5, "2023-03-03")]
    return rows


def everything(payments, last=LAST):
    return lifecycle_state.transitions_of(lifecycle.period_activity(payments.filter(lifecycle.BILLING_CYCLE.up_to("created", last)), KEY), KEY)


def same(a, b):
    assert records(a, *b.columns) == records(b, *b.columns)


def test_one_cycle_at_a_time_equals_the_whole_history(spark):
    payments = simple_payments(spark, history(1))
    state = lifecycle_state.state_of(everything(payments, FIRST), KEY)
    moved = everything(payments, FIRST)
    for n in range(1, 14):
        period = shift_month(FIRST, n)
        rows, state = lifecycle_state.close(state, lifecycle_state.paid_keys(payments, KEY, period), KEY, period)
        # Each closed cycle is stored, as on a cluster; here it is only held.
        rows, state = spark.createDataFrame(rows.collect(), rows.schema), spark.createDataFrame(state.collect(), state.schema)
        moved = moved.unionByName(rows)
        if n in (1, 6, 13):
            same(moved, everything(payments, period).select(moved.columns))
            same(state, lifecycle_state.state_of(everything(payments, period), KEY))
    since = shift_month(FIRST, 2)
    same(lifecycle_state.breakdown(moved, since, LAST), lifecycle.paid_breakdown(payments, KEY, since, LAST))
    same(lifecycle_state.gap_mix(moved, since, LAST), lifecycle.reactivation_gaps(payments, KEY, since, LAST))


def test_a_store_closes_and_reopens_cycles(spark, tmp_path):
    rows = history(2)
    payments = simple_payments(spark, rows)
    store = LifecycleStore(spark, f"{tmp_path}/store", KEY)
    store.start(payments, shift_month(LAST, -2))
    assert store.close(payments) == shift_month(LAST, -1) and store.close(payments) == LAST
    same(store.transitions(), everything(payments))
    same(store.state(), lifecycle_state.state_of(everything(payments), KEY))
    # A new payer, a known one and one that had skipped the cycle pay late; all cycles after it follow.
    period = date(2023, 11, 1)
    late = [("new", "charge", 9, "2023-11-03"), ("hot", "charge", 9, "2023-11-03"), *[(f"c{i}", "charge", 9, "2023-10-30") for i in range(15)]]
    untouched = records(store.transitions().filter(F.col("period") < F.lit(period)), KEY, "period")
    store.reopen(simple_payments(spark, late), period)
    after = simple_payments(spark, rows + late)
    same(store.transitions(), everything(after))
    same(store.state(), lifecycle_state.state_of(everything(after), KEY))
    assert records(store.transitions().filter(F.col("period") < F.lit(period)), KEY, "period") == untouched
    same(lifecycle_state.breakdown(store.transitions(), shift_month(LAST, -5), LAST), lifecycle.paid_breakdown(after, KEY, shift_month(LAST, -5), LAST))


def test_empty_cycles(spark):
    none = simple_payments(spark, [("c1", "charge", 1, "2023-01-05")])
    state = lifecycle_state.state_of(everything(none, FIRST), KEY)
    period = shift_month(FIRST, 1)
    moved, after = lifecycle_state.close(state, lifecycle_state.paid_keys(none, KEY, period), KEY, period)
    assert moved.count() == 0
    same(after, state)
    row = records(lifecycle_state.breakdown(everything(none, FIRST).unionByName(moved), period, LAST))
    assert [(r["period"], r["paid"], r["churned"]) for r in row] == [(period, 0, 1)]
