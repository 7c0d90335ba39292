from __future__ import annotations

import random
from datetime import date, datetime
from fractions import Fraction

from conftest import day, payments, records, simple_payments
from pyspark.sql import functions as F

from paycadence.functions import labels
from paycadence.functions.calendar import CALENDAR_MONTH
from paycadence.operators import allocation, cohorts, coverage, first_payers, funnel, lifecycle, mix, rates, report

LOW, HIGH = date(2020, 1, 1), date(2030, 1, 1)


def test_lifecycle_states_and_gaps(spark):
    months = ["2024-01", "2024-02", "2024-04", "2024-07", "2024-11"]
    df = simple_payments(spark, [("p", "charge", 1, f"{m}-03") for m in months])
    rows = records(lifecycle.lifecycle(lifecycle.period_activity(df, "customer_id"), "customer_id"), "period")
    assert [r["state"] for r in rows] == ["first", "existing", "reactivated", "reactivated", "reactivated"]
    assert [r["gap"] for r in rows] == [None, 1, 2, 3, 4]
    assert [r["returns_next"] for r in rows] == [True, False, False, False, False]
    gaps = records(lifecycle.reactivation_gaps(df, "customer_id", LOW, HIGH), "period")
    assert [r["gap_bucket"] for r in gaps] == ["1_skip1", "2_skip2", "3_skip3plus"]


def test_breakdown_balances(spark):
    df = simple_payments(
        spark,
        [("a", "charge", 1, d) for d in ("2024-01-03", "2024-02-03", "2024-04-03")]
        + [("b", "charge", 1, d) for d in ("2024-02-03", "2024-03-03", "2024-04-03")],
    )
    rows = records(lifecycle.paid_breakdown(df, "customer_id", LOW, HIGH), "period")
    for before, row in zip(rows, rows[1:]):
        assert row["paid"] == row["existing"] + row["first_time"] + row["reactivated"]
        assert row["churned"] == before["paid"] - row["existing"]
    assert [r["churned"] for r in rows] == [0, 0, 1, 0, 2]


def test_churn_is_labelled_with_the_next_period(spark):
    df = simple_payments(spark, [("a", "charge", 1, "2024-12-24"), ("b", "charge", 1, "2024-12-03"), ("b", "charge", 1, "2024-12-25")])
    rows = records(lifecycle.churn_series(df, "customer_id", date(2025, 1, 1), date(2025, 1, 1)))
    assert rows == [{"churn_period": date(2025, 1, 1), "churned": 1}]
    only = spark.createDataFrame([("b",)], "customer_id string")
    assert lifecycle.churn_series(df, "customer_id", date(2025, 1, 1), date(2025, 1, 1), keep=only).count() == 0


def test_churn_mix_shares(spark):
    df = simple_payments(
        spark,
        [("a", "charge", 100, "2024-04-02"), ("a", "payment", 300, "2024-04-03"), ("b", "charge", 50, "2024-04-02"), ("b", "charge", 1, "2024-05-02")],
    )
    april = date(2024, 4, 1)
    rows = records(lifecycle.churn_mix(df, "customer_id", [("gone", april, False), ("kept", april, True)]), "label")
    assert [(r["label"], r["payers"], r["card_share_pct"]) for r in rows] == [("gone", 1, 25.0), ("kept", 1, 100.0)]


def test_payer_using_both_methods_is_in_both_cohorts(spark):
    df = simple_payments(
        spark,
        [("a", "charge", 1, "2024-01-03"), ("a", "payment", 1, "2024-01-20"), ("a", "payment", 1, "2024-02-20"), ("b", "payment", 1, "2024-01-31")],
    )
    start, end = date(2024, 1, 1), date(2024, 4, 1)
    card = records(cohorts.retention_matrix(df, start, end, first_methods=["charge"], return_methods=["charge"]))
    ach = records(cohorts.retention_matrix(df, start, end, first_methods=["payment"], return_methods=["payment"]))
    mixed = records(cohorts.retention_matrix(df, start, end, first_methods=["charge"]))
    assert (card[0]["cohort_size"], card[0]["m0"], card[0]["m1"]) == (1, 1, None)
    assert (ach[0]["cohort_size"], ach[0]["m0"], ach[0]["m1"]) == (2, 2, 1)
    assert mixed[0]["m1"] == 1


def test_cohort_needs_the_first_ever_month(spark):
    df = simple_payments(spark, [("a", "charge", 1, "2023-12-03"), ("a", "charge", 1, "2024-01-03")])
    assert cohorts.retention_matrix(df, date(2024, 1, 1), date(2024, 4, 1)).count() == 0


def test_eligibility_window_edges(spark):
    rows = [("l", day(d), "ACTIVE") for d in ("2024-03-24", "2024-05-24", "2024-05-25", "2024-06-24")] + [
        ("l", day("2024-09-10"), "ENDED")
    ]
    daily = spark.createDataFrame(rows, "lease_id string, snapshot_date date, status string")
    got = {}
    for d in ("2024-03-24", "2024-03-25", "2024-04-24", "2024-04-25"):
        one = spark.createDataFrame([("l", day(d), "ACTIVE")], daily.schema)
        got[d] = [r["period"].isoformat()[:7] for r in records(cohorts.active_periods(one, 7, 24), "period")]
    assert got == {
        "2024-03-24": ["2024-02", "2024-03"],
        "2024-03-25": ["2024-03", "2024-04"],
        "2024-04-24": ["2024-03", "2024-04", "2024-05"],
        "2024-04-25": ["2024-04", "2024-05"],
    }
    brute = set()
    for target in [date(2024, m, 1) for m in range(1, 13)]:
        low = date.fromordinal(target.toordinal() - 7)
        high = date.fromordinal(target.replace(month=target.month % 12 + 1, year=target.year + target.month // 12).toordinal() + 24)
        if any(low <= d < high for _, d, s in rows if s == "ACTIVE"):
            brute.add(target)
    assert {r["period"] for r in records(cohorts.active_periods(daily, 7, 24))} == brute


def test_eligible_retention_orders_its_counts(spark):
    df = simple_payments(spark, [("a", "charge", 1, "2024-01-03"), ("a", "payment", 1, "2024-02-03"), ("b", "charge", 1, "2024-01-04")])
    daily = spark.createDataFrame(
        [("lease-a", day("2024-01-10"), "ACTIVE"), ("lease-a", day("2024-02-10"), "ACTIVE")],
        "lease_id string, snapshot_date date, status string",
    )
    rows = records(cohorts.eligible_retention(df, df, daily, date(2024, 1, 1), date(2024, 4, 1)), "offset")
    assert [(r["offset"], r["cohort_size"], r["eligible"], r["paid_card"], r["paid_ach"], r["paid_any"]) for r in rows] == [
        (0, 2, 1, 1, 0, 1),
        (1, 2, 1, 0, 1, 1),
        (2, 2, 0, 0, 0, 0),
    ]


def test_contract_retention_counts_each_lease_once(spark):
    cohort = spark.createDataFrame(
        [("x", date(2024, 1, 1), "New"), ("y", date(2024, 1, 1), "New")], "lease_id string, cohort date, label string"
    )
    df = payments(spark, [("c", "x", "a", "charge", 1, d) for d in ("2023-12-01", "2024-01-03", "2024-01-04", "2024-03-01")])
    row = records(cohorts.with_percentages(cohorts.contract_retention(cohort, df, horizon=3, last=date(2024, 3, 1))))[0]
    assert [row[f"m{k}"] for k in range(4)] == [1, 0, 1, None]
    assert (row["cohort_size"], row["m0_pct"], row["m3_pct"]) == (2, 50.0, None)


def test_stickiness_adds_up(spark):
    df = simple_payments(
        spark,
        [("a", "charge", 1, "2024-01-03"), ("a", "payment", 1, "2024-02-03"), ("b", "charge", 1, "2024-01-03"),
         ("b", "charge", 1, "2024-02-03"), ("c", "charge", 1, "2024-02-03")],
    )
    rows = records(cohorts.stickiness(df, date(2024, 1, 1), date(2024, 2, 1)), "offset")
    assert [(r["offset"], r["active"], r["stuck"], r["switched"], r["observable"]) for r in rows] == [(0, 3, 3, 0, 3), (1, 2, 1, 1, 2)]


def test_first_payment_tie_is_deterministic(spark):
    rows = [("p", "l2", "b", "payment", 5, "2024-01-03"), ("p", "l1", "a", "charge", 7, "2024-01-03")]
    for order in (rows, rows[::-1]):
        got = records(first_payers.first_payments(payments(spark, order), ["created"], ["lease_id", "method"]))
        assert (got[0]["lease_id"], got[0]["method"]) == ("l1", "charge")


def test_adoption_looks_at_the_whole_first_period(spark):
    df = simple_payments(spark, [("a", "payment", 1, "2024-01-03"), ("a", "charge", 1, "2024-01-20"), ("b", "payment", 1, "2024-01-03"), ("b", "charge", 1, "2024-01-25")])
    row = records(first_payers.adoption_trend(df, LOW, HIGH))[0]
    assert (row["payers"], row["adopters"], row["adoption_pct"]) == (2, 1, 50.0)


def test_amount_stats_interpolate(spark):
    df = simple_payments(spark, [(c, "charge", n, "2024-01-03") for c, n in (("a", 100), ("b", 301), ("c", 500), ("d", 1000))])
    row = records(first_payers.amount_stats(first_payers.first_payments(df, ["created"], ["cents"]), LOW, HIGH))[0]
    assert (row["payers"], row["median_amount"], row["mean_amount"]) == (4, 4.005, 4.7525)


def test_batches_are_left_out(spark):
    rows = [(f"p{i}", f"l{i}", "big", "payment", 1, "2024-01-03") for i in range(4)]
    rows += [("q", "lq", "small", "charge", 1, "2024-01-03"), ("r", "lr", None, "payment", 1, "2024-01-03")]
    row = records(first_payers.low_mix_batches(payments(spark, rows), LOW, HIGH, max_rate=0.05, min_size=4))[0]
    assert (row["payers"], row["payers_in_batches"], row["adoption_pct_without"]) == (6, 4, 50.0)


def test_mix_and_totals(spark):
    df = simple_payments(
        spark,
        [("a", "charge", 100, "2024-01-03"), ("a", "payment", 100, "2024-02-03"), ("b", "payment", 300, "2024-02-03"), ("b", None, 1, "2024-02-04")],
    )
    rows = records(mix.mix_decomposition(df.filter("method is not null"), LOW, HIGH), "period")
    assert (rows[0]["overall_share"], rows[0]["returning_share"]) == (100.0, None)
    assert (rows[1]["first_share"], rows[1]["first_pct_of_volume"]) == (0.0, 75.0)
    total = {r["method"]: (r["payments"], r["leases"]) for r in records(mix.totals_with_rollup(df, date(2024, 2, 1)))}
    assert total == {"payment": (2, 2), None: (1, 1), "TOTAL": (3, 2)}


def test_contribution_by_account(spark):
    rows = [("p", "l1", "a", "charge", 100, "2024-01-03"), ("p", "l2", "b", "payment", 300, "2024-01-04"),
            ("q", "l3", "z", "payment", 100, "2024-01-05"), ("q", "l3", "a", "charge", 100, "2024-02-05")]
    accounts = spark.createDataFrame([("a", "Alpha"), ("b", "Beta")], "account string, name string")
    detail = mix.first_period_detail(payments(spark, rows), accounts, LOW, HIGH)
    hitters = {r["name"]: r["payers"] for r in records(mix.heavy_hitters(detail, min_size=1))}
    assert hitters == {"Alpha": 1, "Beta": 1, "(unmapped)": 1}
    row = records(mix.leave_one_out(detail, {"beta": "bet%"}))[0]
    assert (row["payers"], row["adoption_all"], row["adoption_without_beta"], row["share_all"]) == (2, 50.0, 0.0, 20.0)
    assert records(mix.account_timeline(detail, ["ALPHA%", "beta"]))[0]["payers"] == 1


def test_return_rate_needs_both_sides(spark):
    df = simple_payments(spark, [("a", "payment", 1, "2024-01-03"), ("a", "payment", 1, "2024-01-04"), ("a", "payment", 1, "2024-03-04")])
    back = spark.createDataFrame([(day("2024-01-24"), "0.25"), (day("2024-01-25"), "0.4")], "created date, fee string").withColumn(
        "fee", F.col("fee").cast("decimal(18,4)")
    )
    got = records(rates.return_rate(df, back, date(2024, 1, 1), date(2024, 6, 1)))
    assert [(r["period"], r["returned"], r["returned_pct"]) for r in got] == [(date(2024, 1, 1), 1, 50.0)]


def _entries(spark, rows):
    schema = "entry_id string, account string, type string, deleted boolean, due string, charges array<struct<linked string, cents bigint>>"
    return spark.createDataFrame(rows, schema)


def test_allocation_prorates_and_survives_odd_entries(spark):
    entries = _entries(
        spark,
        [
            ("pay", "a", "leasePayment", False, "2024-02-03", [("now", 3000), ("late", 1000), ("gone", 500), ("none", 700)]),
            ("zero", "a", "leasePayment", False, "2024-02-03", [("now", 0)]),
            ("empty", "a", "leasePayment", False, "2024-02-03", []),
            ("null", "a", "leasePayment", False, "2024-02-03", None),
            ("now", "a", "charge", False, "2024-02-01", None),
            ("late", "a", "charge", False, "2024-01-01", None),
            ("gone", "a", "charge", True, "2024-01-01", None),
        ],
    )
    accounts = spark.createDataFrame([("a", False)], "account string, is_test boolean")
    charges = allocation.settled_charges(entries, date(2024, 1, 1), accounts)
    df = payments(spark, [("p", e, "a", "charge", n, "2024-02-03") for e, n in (("pay", 800), ("pay", 200), ("zero", 100), ("empty", 100))])
    row = records(allocation.allocate(df, charges, LOW, HIGH))[0]
    assert (row["allocated"], row["pct_current"], row["pct_prior1"]) == (10.0, 75.0, 25.0)


def test_parts_are_whole_cents_that_add_up(spark):
    """Against largest remainders in exact fractions; ties, negative weights and totals, and groups without a total."""
    random.seed(4)
    rows, want = [], {}
    for g in range(120):
        weights = [random.choice([1, 1, 2, 7, 333, -1, 0, 10**9 + 7]) * random.choice([1, 1, 1, -1 if g % 7 == 0 else 1]) for _ in range(random.randint(1, 6))]
        cents, total = random.choice([1, 2, 100, 99_999_999_999]), sum(weights)
        months = [None if i == 1 else date(2024, i + 1, 1) for i in range(len(weights))]
        rows += [(g, cents, w, total, m) for w, m in zip(weights, months)]
        if total == 0:
            want |= {(g, m): None for m in months}
            continue
        exact = [Fraction(cents * w, total) for w in weights]
        down = [x.numerator // x.denominator for x in exact]
        order = sorted(range(len(weights)), key=lambda i: (down[i] - exact[i], months[i] is not None, months[i] or date.min))
        for i in order[: cents - sum(down)]:
            down[i] += 1
        assert sum(down) == cents
        want |= {(g, m): d for m, d in zip(months, down)}
    df = spark.createDataFrame(rows, "g int, cents bigint, charged bigint, total bigint, due_month date")
    got = allocation.apportioned(df, ["g"], "cents", "charged", "total", "due_month", "part")
    assert {(r.g, r.due_month): r.part for r in got.collect()} == want


def test_charges_can_be_rounded_to_whole_units(spark):
    entries = _entries(
        spark,
        [("pay", "a", "leasePayment", False, "2024-02-03", [("c", 1250)]), ("tiny", "a", "leasePayment", False, "2024-02-03", [("c", 49)]),
         ("c", "a", "charge", False, "2024-02-01", None)],
    )
    got = {r["entry_id"]: r["charged"] for r in records(allocation.settled_charges(entries, date(2024, 1, 1), round_charges=True))}
    assert got == {"pay": 1300, "tiny": 0}


def test_reactivated_charges_count_once_per_payment(spark):
    entries = _entries(
        spark,
        [("old", "a", "leasePayment", False, "2024-01-03", [("jan", 400)]), ("new", "a", "leasePayment", False, "2024-03-03", [("jan", 100), ("mar", 300)]),
         ("jan", "a", "charge", False, "2024-01-01", None), ("mar", "a", "charge", False, "2024-03-01", None)],
    )
    charges = allocation.settled_charges(entries, date(2024, 1, 1))
    df = payments(spark, [("p", "old", "a", "charge", 9, "2024-01-03"), ("p", "new", "a", "charge", 9, "2024-03-03"), ("p", "new", "a", "payment", 9, "2024-03-04")])
    now = records(allocation.reactivated_charges(allocation.payer_entries(df), charges, LOW, HIGH))[0]
    assert (now["charged"], now["pct_current"], now["pct_prior2plus"]) == (8.0, 75.0, 25.0)
    before = records(allocation.reactivated_charges(allocation.payer_entries(df), charges, LOW, HIGH, before_gap=True))[0]
    assert (before["charged"], before["pct_previous"], before["period"]) == (4.0, 100.0, date(2024, 3, 1))


DAILY = "lease_id string, snapshot_date date, status string, account string, frequency string, merchant_flag int, account_first_invoice date"


def _daily(spark, rows):
    return spark.createDataFrame([(l, day(d), s, a, "Monthly", 1, None) for l, d, s, a in rows], DAILY)


def test_activation_cohort_takes_the_first_active_day(spark):
    daily = _daily(
        spark,
        [("new", "2024-02-02", "FUTURE", "a"), ("new", "2024-02-25", "ACTIVE", "a"), ("new", "2024-02-26", "ACTIVE", "b"),
         ("old", "2024-01-15", "ACTIVE", "a"), ("old", "2024-02-15", "ACTIVE", "a")],
    )
    starts = spark.createDataFrame([("a", date(2023, 11, 1))], "account string, first date")
    rows = records(funnel.activation_cohort(daily, starts, date(2024, 2, 1), date(2024, 5, 24), ["Monthly"]))
    assert [(r["lease_id"], r["account"], r["activated"], r["cohort"], r["label"]) for r in rows] == [
        ("new", "a", date(2024, 2, 25), date(2024, 3, 1), "Mature")
    ]


def _rows(spark, accepted, activated="2024-02-01", **extra):
    base = {"invited_at": None, "viewed_at": None, "last_sent_at": None, "shared_accepted_at": None, **extra}
    values = ("l", "a", day(activated), date(2024, 2, 1), "New", accepted, *base.values())
    stamps = ", ".join(f"{c} timestamp_ntz" for c in ("accepted_at", *base))
    return spark.createDataFrame([values], f"lease_id string, account string, activated date, cohort date, label string, {stamps}")


def test_payment_windows_are_open_below_and_closed_above(spark):
    rows = _rows(spark, datetime(2024, 2, 1, 23))
    for days, kept in ((0, (0, 0)), (45, (1, 0)), (46, (0, 1)), (90, (0, 1)), (91, (0, 0))):
        paid = ["2024-03-17", date.fromordinal(day("2024-03-17").toordinal() + days).isoformat()]
        df = payments(spark, [("p", "l", "a", "charge", 1, d) for d in ["2024-01-31", *paid]])
        out = records(funnel.lease_outcomes(rows, df))[0]
        assert out["first_paid"] == date(2024, 3, 17)  # the 45th day after activation still converts
        assert (out["kept_1"], out["kept_2"]) == kept
    late = payments(spark, [("p", "l", "a", "charge", 1, "2024-03-18")])
    assert records(funnel.lease_outcomes(rows, late))[0]["first_paid"] is None


def test_kpi_rates_are_zero_without_a_base(spark):
    out = records(funnel.activation_kpi(funnel.lease_outcomes(_rows(spark, None), payments(spark, []))))[0]
    assert (out["leases"], out["portal_active"], out["converted"], out["retention_p1_pct"]) == (1, 0, 0, 0.0)


def test_retained_members_are_excluded(spark):
    leases = spark.createDataFrame(
        [("l1", False, [("t",), ("u",), ("t",)]), ("l2", False, [("t",)]), ("l3", False, []), ("l4", False, None), ("l5", True, [("u",)])],
        "lease_id string, deleted boolean, tenants array<struct<tenant string>>",
    )
    members = funnel.memberships(leases)
    assert sorted((r.lease_id, r.tenant_id) for r in members.collect()) == [("l1", "t"), ("l1", "u"), ("l2", "t")]
    tenants = spark.createDataFrame(
        [("t", (datetime(2024, 1, 10), None)), ("u", (datetime(2024, 1, 5), datetime(2024, 1, 1)))],
        "tenant_id string, portal struct<accepted_at: timestamp_ntz, last_sent_at: timestamp_ntz>",
    )
    steps = funnel.milestones(members, tenants)
    by_lease = {r["lease_id"]: r for r in records(steps)}
    assert by_lease["l1"]["accepted_at"] == datetime(2024, 1, 5)
    assert by_lease["l1"]["shared_accepted_at"] == datetime(2024, 1, 10)
    cohort = spark.createDataFrame(
        [("l1", day("2024-01-08")), ("l2", day("2024-02-01")), ("l9", day("2024-02-01"))], "lease_id string, activated date"
    )
    rows = funnel.journeys(cohort, steps)
    assert sorted(r.lease_id for r in rows.collect()) == ["l1", "l2", "l9"]
    assert sorted(r.lease_id for r in funnel.exclude_retained_members(rows).collect()) == ["l1", "l9"]


def test_transitions_are_censored_and_directed(spark):
    steps = spark.createDataFrame(
        [("2024-01-01", "2024-01-08"), ("2024-01-01", "2024-01-09"), ("2024-01-10", "2024-01-03"), ("2024-01-25", "2024-01-26"), ("2024-01-24", None)],
        "a string, b string",
    ).select(F.lit(1).alias("cohort"), F.lit("x").alias("label"), F.to_date("a").alias("a"), F.to_date("b").alias("b"))
    pairs = {"directed": ("a", "b", True), "either": ("a", "b", False)}
    got = {r["metric"]: r for r in records(funnel.censored_transitions(steps, date(2024, 1, 31), (7,), pairs))}
    assert (got["directed"]["reach"], got["directed"]["obs_7"], got["directed"]["hit_7"]) == (5, 4, 1)
    assert got["either"]["hit_7"] == 2


def test_days_to_event_is_cumulative(spark):
    rows = _rows(spark, None)
    df = payments(spark, [("p", "l", "a", "charge", 1, d) for d in ("2024-01-20", "2024-02-08", "2024-02-20")])
    out = records(funnel.days_to_event(rows, df, date(2024, 12, 31), (6, 7, 14)))[0]
    assert (out["within_6"], out["within_7"], out["within_14"]) == (0, 1, 1)


def test_state_transitions_balance(spark):
    active = [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 1), ("d", 2), ("e", 1)]
    paid = [("a", 1), ("a", 2), ("b", 2), ("c", 1), ("d", 2), ("z", 2)]

    def frame(rows):
        return spark.createDataFrame([(l, date(2024, m, 1), "acct") for l, m in rows], "lease_id string, period date, account string")

    states = coverage.active_and_paid(frame(active), frame(paid))
    out = records(coverage.state_transitions(states, date(2024, 1, 1), date(2024, 2, 1)), "period")[1]
    assert out["paid"] == out["retained_paid"] + out["converted"] + out["new_paid"] + out["paid_inactive"] == 4
    assert (out["retained_paid"], out["converted"], out["new_paid"], out["paid_dropped"], out["dropped_unpaid"]) == (1, 1, 1, 1, 1)
    assert (out["paid_churned"], out["first_time_paid"]) == (1, 2)
    share = records(coverage.paid_share(states), "period")
    assert [(r["active"], r["paid"]) for r in share] == [(4, 2), (3, 4)]


def test_paid_share_is_null_without_active_leases(spark):
    states = spark.createDataFrame([(date(2024, 1, 1), False, True, None)], "period date, is_active boolean, is_paid boolean, account string")
    accounts = spark.createDataFrame([("a", "S")], "account string, segment string")
    row = records(coverage.paid_share_by_segment(states, accounts))[0]
    assert (row["segment"], row["paid"], row["paid_share"]) == ("Unknown", 1, None)


def test_report_steps(spark):
    mart = spark.createDataFrame(
        [(date(2023, 5, 1), "old", 8), (date(2024, 5, 1), "old", 9), (date(2024, 5, 1), "new", 1), (date(2024, 6, 1), "new", 70)],
        "period date, kind string, payers long",
    )
    series = report.report_series(mart, "kind", "payers", {"old": "existing", "new": "new"}, date(2024, 5, 1))
    rows = records(series, "period")
    assert [(r["existing"], r["new"], r["total"]) for r in rows] == [(8, 0, 8), (9, 1, 10)]
    yearly = records(report.year_over_year(series, "total"), "period")
    assert (yearly[0]["change"], yearly[1]["change"], yearly[1]["change_pct"]) == (None, 2, 25.0)
    assert records(report.peak(series, "total"))[0] == {"peak_period": date(2024, 5, 1), "peak_value": 10}
    parts = records(report.composition(mart, "kind", "payers", date(2024, 5, 1)), "kind")
    assert [r["share_pct"] for r in parts] == [10.0, 90.0]
    assert report.composition(mart, "kind", "payers", date(2024, 5, 1), exclude=["new"]).first()["share_pct"] == 100.0
    changed = records(report.period_changes(mart.filter("kind = 'new'"), ["payers"]), "period")
    assert [(r["payers_change"], r["kind"]) for r in changed] == [(None, "new"), (69, "new")]
    assert report.reconcile(series.withColumnRenamed("total", "payers"), mart.filter("period < '2024-06-01'"), "payers").count() == 0
    assert report.reconcile(mart, mart.filter("kind = 'old'"), "payers").count() == 2


def test_report_order_puts_nulls_last(spark):
    mart = spark.createDataFrame([("a", None), ("b", 1), (None, 3), ("c", 3)], "k string, v int")
    assert [r.v for r in report.ordered(mart, "-v", "k").collect()] == [3, 3, 1, None]
    assert [r.k for r in report.ordered(mart, "k").collect()] == ["a", "b", "c", None]


def test_coverage_counts_entities_once(spark):
    active = spark.createDataFrame([("p1", "a", "New"), ("p1", "b", "New")], "period string, account string, label string")
    acting = spark.createDataFrame([("p1", "a"), ("p1", "a"), ("p1", "z")], "period string, account string")
    row = records(coverage.coverage(active, acting, ["period", "account"], ["period", "label"]))[0]
    assert (row["active"], row["acting"], row["pct"]) == (2, 1, 50.0)


def test_population_mix_takes_only_the_first_payment_of_new_payers(spark):
    df = simple_payments(spark, [("a", "charge", 100, "2024-01-03"), ("a", "payment", 900, "2024-01-09"), ("a", "payment", 300, "2024-02-03"), ("a", "charge", 100, "2024-02-09")])
    rows = records(first_payers.population_mix(df, LOW, HIGH, CALENDAR_MONTH), "period")
    assert (rows[0]["card_payers"], rows[0]["ach_payers"], rows[0]["total_amount"]) == (1, 0, 1.0)
    assert (rows[1]["card_payers"], rows[1]["ach_payers"], rows[1]["card_share"], rows[1]["card_payer_share"]) == (1, 1, 0.25, 0.5)


def test_payers_without_an_account_stay(spark):
    rows = [("p", "l", "a", "charge", 100, "2024-01-03"), ("q", "m", None, "payment", 200, "2024-01-04"), ("r", "l", "a", "payment", 300, "2024-02-04")]
    df = payments(spark, rows)
    firsts = first_payers.first_payments(df, ["created"], ["account", "method", "cents", "lease_id"])
    span = (date(2024, 1, 1), date(2024, 2, 1))
    out = records(first_payers.by_account_newness(firsts, df, *span), "period", "segment")
    assert [(r["segment"], r["payers"], r["accounts"]) for r in out] == [
        ("Account first-time paid this month", 1, 1), ("Unknown", 1, 0), ("Existing account (paid before)", 1, 1),
    ]
    activated = spark.createDataFrame([("l", day("2024-01-01"))], "lease_id string, activated date")
    paths = first_payers.payer_paths(firsts.join(activated, "lease_id", "left"), *span)
    starts = first_payers.with_account_start(paths, df, how="left")
    label = labels.tenure_label("account_first", "period", missing=labels.UNKNOWN)
    got = records(first_payers.paths_by_label(starts, label), "period", "label")
    assert [(r["label"], r["payers"], r["same_period"], r["earlier"], r["unknown"]) for r in got] == [
        ("Onboarding", 1, 1, 0, 0), ("unknown", 1, 0, 0, 1), ("Onboarding", 1, 0, 1, 0),
    ]


def test_marts_that_disagree_are_counted(spark):
    def mart(rows):
        return spark.createDataFrame([(date(2024, m, 1), n) for m, n in rows], "period date, payers long")

    out = records(report.agreement({"x": (mart([(1, 2), (2, 1)]), mart([(1, 1), (1, 1), (2, 2), (3, 1)]), "payers")}))
    assert out == [{"pair": "x", "periods": 3, "mismatched": 2}]


def test_an_unknown_account_is_not_covered(spark):
    schema = "period date, account string, label string"
    active = spark.createDataFrame([(date(2024, 1, 1), a, "Mature") for a in ("a", None)], schema)
    acting = spark.createDataFrame([(date(2024, 1, 1), a) for a in ("a", None)], "period date, account string")
    row = records(coverage.coverage(active, acting, ["period", "account"], ["period", "label"]))[0]
    assert (row["active"], row["acting"], row["pct"]) == (1, 1, 100.0)


def test_active_at_the_cutoff_is_the_latest_state(spark):
    days = [("x", "2024-01-26", "ACTIVE"), ("x", "2024-02-20", "ENDED"), ("y", "2024-01-26", "FUTURE"), ("y", "2024-02-24", "ACTIVE"), ("y", "2024-02-25", "ENDED")]
    daily = spark.createDataFrame([(l, day(d), s, "acct") for l, d, s in days], "lease_id string, snapshot_date date, status string, account string")
    span = (date(2024, 2, 1), date(2024, 2, 1))
    assert {r["lease_id"] for r in records(coverage.active_leases(daily, *span))} == {"x", "y"}
    assert {r["lease_id"] for r in records(coverage.active_leases(daily, *span, at_cutoff=True))} == {"y"}


def test_first_time_paid_looks_back_over_all_payments(spark):
    active = spark.createDataFrame([("a", date(2024, 2, 1), "acct"), ("b", date(2024, 2, 1), "acct")], "lease_id string, period date, account string")
    states = coverage.active_and_paid(active, active)
    firsts = spark.createDataFrame([("a", date(2023, 5, 1)), ("b", date(2024, 2, 1))], "lease_id string, first date")
    row = records(coverage.state_transitions(states, date(2024, 2, 1), date(2024, 2, 1), firsts))[0]
    assert (row["active"], row["first_time_paid"]) == (2, 1)


def test_a_payment_between_the_cycle_start_and_its_month_counts(spark):
    cohort = spark.createDataFrame([("l", date(2024, 2, 1), "Onboarding")], "lease_id string, cohort date, label string")
    paid = payments(spark, [("p", "l", "a", "charge", 100, "2024-01-28")])
    assert records(cohorts.contract_retention(cohort, paid))[0]["m0"] == 1


def test_windows_run_from_the_time_of_the_first_payment(spark):
    """A second payment of the same day, and ones just before and after the end of a window, by time and by day."""
    rows = spark.createDataFrame(
        [(k, "a", date(2024, 1, 1), date(2024, 1, 5), "Mature", datetime(2024, 1, 5), None, None, None) for k in ("same", "before", "after", "never", "once")],
        "lease_id string, account string, cohort date, activated date, label string, accepted_at timestamp_ntz, last_sent_at timestamp_ntz, invited_at timestamp_ntz, viewed_at timestamp_ntz",
    )
    first = datetime(2024, 1, 10, 12)
    paid = [("same", first), ("same", first.replace(hour=13)), ("before", first), ("before", datetime(2024, 2, 24, 11)), ("after", first), ("after", datetime(2024, 2, 24, 13)), ("once", first), ("once", first)]
    timed = spark.createDataFrame(paid, "lease_id string, created timestamp_ntz")
    by_time = {r.lease_id: (r.first_paid, r.kept_1, r.kept_2) for r in funnel.lease_outcomes(rows, timed).collect()}
    assert by_time["never"][0] is None and by_time["once"] == (first, 0, 0)
    assert [by_time[k][1:] for k in ("same", "before", "after")] == [(1, 0), (1, 0), (0, 1)]
    days = timed.withColumn("created", F.col("created").cast("date"))
    by_day = {r.lease_id: (r.kept_1, r.kept_2) for r in funnel.lease_outcomes(rows, days).collect()}
    assert [by_day[k] for k in ("same", "before", "after", "once")] == [(0, 0), (1, 0), (1, 0), (0, 0)]


def test_presented_marts_have_months_units_and_rounded_numbers(spark):
    rows = [(date(2026, 5, 1), 1_250_000.0, 12.3456), (date(2026, 4, 1), None, None), (None, 40_000.0, 0.0005)]
    df = spark.createDataFrame(rows, "period date, volume double, share double")
    out = report.presented(df, {"volume": 1, "share": 3}, {"volume": 1e6})
    assert out.columns == ["month", "volume", "share"]
    assert [tuple(r.values()) for r in records(out, "month")] == [("2026-04", None, None), ("2026-05", 1.3, 12.346), (None, 0.0, 0.001)]
    assert records(report.presented(df.limit(0), {"share": 1})) == []
