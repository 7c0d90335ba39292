from __future__ import annotations

import json
from dataclasses import replace
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from conftest import day, records
from pyspark.sql import functions as F

from paycadence.functions.calendar import month_label
from paycadence.operators import allocation, first_payers, funnel, mix
from paycadence.plans.reports import BUILDERS, REPORTS
from paycadence.plans.run import run, shared_folder
from paycadence.plans.windows import TEST_WINDOWS, Windows
from paycadence.sources import landed, marts
from paycadence.sources.canonical import FREQUENCIES, INVITE, PAGE_VIEW
from paycadence.sources.layout import with_variants
from paycadence.sources.tables import StarTables

RAW_PAYMENTS = "id string, customer_id string, lease_id long, je_id string, type string, amounttotransfer decimal(18,2), fee double, created timestamp_ntz"


def raw_payments(spark):
    rows = [
        ("1", "c1", 1, "e1", "Charge", "12.50", 0.5, datetime(2024, 1, 24, 23)),
        ("2", "c1", 1, "e1", "payment", "7.50", 0.1, datetime(2024, 1, 25)),
        ("3", "c2", 2, "e9", "payment", "0.00", 0.0, datetime(2024, 1, 3)),
        ("4", "c2", 2, "e9", "payment", "5.00", 0.0, datetime(2024, 2, 3)),
    ]
    names = [c.split()[0] for c in RAW_PAYMENTS.split(", ")]
    return spark.createDataFrame(rows, RAW_PAYMENTS.replace("decimal(18,2)", "string")).selectExpr(
        *[f"cast({n} as decimal(18,2)) {n}" if n == "amounttotransfer" else n for n in names]
    )


def raw_entries(spark, as_text):
    schema = "_id string, dbtenant string, type string, deleted string, transactiondate string, "
    charges = [{"linkedTransaction": "c1", "amount": 12.5}, {"linkedTransaction": "c2", "amount": 0.49}]
    if as_text:
        body = [json.dumps({"linkedCharges": charges}), json.dumps({"linkedCharges": None}), None, None]
        schema += "leasepayment string"
    else:
        body = [([(c["linkedTransaction"], c["amount"]) for c in charges],), (None,), None, None]
        schema += "leasepayment struct<linkedCharges: array<struct<linkedTransaction: string, amount: double>>>"
    rows = [
        ("e1", "a", "leasePayment", "false", "2024-01-24", body[0]),
        ("e2", "a", "leasePayment", "FALSE", "2024-01-24", body[1]),
        ("c1", "a", "leaseCharge", "false", "2024-02-01", body[2]),
        ("c2", "a", "leaseCharge", "false", "bad date", body[3]),
    ]
    return spark.createDataFrame(rows, schema)


def test_landed_payments(spark):
    entries = landed.entries(raw_entries(spark, True))
    kept = landed.payments(raw_payments(spark), since=date(2024, 1, 1), until=date(2024, 2, 3))
    rows = records(landed.with_accounts(kept, entries), "created", "customer_id")
    assert landed.payments(raw_payments(spark), methods=["charge"]).count() == 1
    assert landed.payments(raw_payments(spark), methods=["charge"], exact=True).count() == 0
    assert [(r["customer_id"], r["lease_id"], r["method"], r["cents"], r["created"], r["account"]) for r in rows] == [
        ("c1", "1", "charge", 1250, date(2024, 1, 24), "a"),
        ("c1", "1", "payment", 750, date(2024, 1, 25), "a"),
        ("c2", "2", "payment", 500, date(2024, 2, 3), None),
    ]


def test_landed_entries_read_the_same_from_text_and_structs(spark):
    text, structs = (records(landed.entries(raw_entries(spark, t)), "entry_id") for t in (True, False))
    assert text == structs
    assert [(c["linked"], c["cents"]) for c in text[2]["charges"]] == [("c1", 1250), ("c2", 49)]
    charges = records(allocation.settled_charges(landed.entries(raw_entries(spark, True)), date(2024, 1, 1)), "due_month")
    assert [(r["due_month"], r["charged"]) for r in charges] == [(date(2024, 2, 1), 1250), (None, 49)]


def test_landed_leases_and_tenants(spark):
    raw = spark.createDataFrame(
        [("1", "Monthly", "false", '[{"tenant": "t1"}, {"tenant": "t2"}]'), ("2", "Yearly", "FALSE", "[]"), ("3", "Weekly", "true", '[{"tenant": "t1"}]')],
        "_id string, recurringrentfrequency string, deleted string, tenants string",
    )
    leases = landed.leases(raw)
    assert sorted((r.lease_id, r.tenant_id) for r in funnel.memberships(leases).collect()) == [("1", "t1"), ("1", "t2")]
    kept = landed.on_leases(landed.payments(raw_payments(spark)), leases, FREQUENCIES)
    assert {r["lease_id"] for r in records(kept)} == {"1"}
    people = spark.createDataFrame(
        [("t1", '{"invitationAcceptedAt": "2024-01-05T10:00:00", "invitationLastSentAt": null}'), ("t2", '{"invitationAcceptedAt": null}'), ("t3", None), ("t4", "")],
        "_id string, portalinfo string",
    )
    portal = {r["tenant_id"]: r["portal"] for r in records(landed.tenants(people))}
    assert portal["t1"]["accepted_at"] == datetime(2024, 1, 5, 10)
    assert [portal[t]["accepted_at"] for t in ("t2", "t3", "t4")] == [None, None, None]


def test_landed_daily_accounts_and_returns(spark):
    raw = spark.createDataFrame(
        [(1, day("2024-01-25"), "ACTIVE", "a", "Monthly", 1, "2023-12-01")],
        "lease_id long, snapshot_date date, status string, dbtenant string, rent_frequency string, merchant_account_flag int, dbt_first_invoice_date string",
    )
    dates = records(first_payers.activation_dates(landed.daily(raw), FREQUENCIES))
    assert dates == [{"lease_id": "1", "activated": date(2024, 1, 25), "lease_first_invoice": date(2023, 12, 1)}]
    second = spark.createDataFrame([(1, day("2024-01-25"), "ACTIVE")], "lease_id long, _date date, status string")
    assert landed.lease_status(second).columns == ["lease_id", "snapshot_date", "status"]
    crm = spark.createDataFrame([("a", "Alpha", "FALSE", "S"), ("b", "Beta", "TRUE", "S")], "app_db_tenant_id_c string, name string, test_account_fivetran_c string, tier string")
    assert [(r["account"], r["segment"], r["is_test"]) for r in records(landed.accounts(crm, "tier"), "account")] == [("a", "S", False), ("b", "S", True)]
    back = spark.createDataFrame([(datetime(2024, 1, 25, 5), 0.25)], "created timestamp_ntz, fee double")
    assert records(landed.returns(back))[0]["created"] == date(2024, 1, 25)


def test_landed_events_filter_and_read_properties(spark):
    rows = [
        ("invitation_sent", datetime(2024, 1, 5), '{"sentToId": "t1", "dbTenant": "a", "env": "production", "isTestUser": "false"}'),
        ("invitation_sent", datetime(2023, 1, 5), '{"sentToId": "t1"}'),
        ("invitation_pageview", datetime(2024, 1, 6), '{"sentToId": null}'),
        ("login", datetime(2024, 1, 6), "{}"),
    ]
    raw = spark.createDataFrame(rows, "event string, timestamp timestamp_ntz, properties string")
    got = records(landed.events(raw, [INVITE, PAGE_VIEW], date(2024, 1, 1), date(2024, 1, 6)), "ts")
    assert [(r["event"], r["sent_to_id"], r["is_test"]) for r in got] == [(INVITE, "t1", False), (PAGE_VIEW, None, None)]


def test_landed_frames_feed_the_operators(spark):
    df = landed.payments(raw_payments(spark))
    row = records(mix.mix_decomposition(df, date(2024, 1, 1), date(2024, 2, 1)).withColumn("cycle", month_label("period")), "cycle")
    assert [(r["cycle"], r["overall_share"]) for r in row] == [("2024-01", 100.0), ("2024-02", 0.0)]


def test_csv_sink_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(date(2024, 1, 1), 5, None), (date(2024, 2, 1), 7, 0.5)], "period date, paid long, share double")
    path = str(tmp_path / "csv")
    marts.write_csv(df, path)
    header = next(p for p in Path(path).glob("*.csv") if p.stat().st_size).read_text().splitlines()[0]
    assert header == "PERIOD,PAID,SHARE"
    back = marts.read_csv(spark, path, "PERIOD date, PAID long, SHARE double")
    assert records(back, "PERIOD") == records(marts.upper_names(df), "PERIOD")


def test_bundle_keeps_null_keys(spark, tmp_path):
    df = spark.createDataFrame([(date(2024, 1, 1), None)], "period date, share double")
    path = str(tmp_path / "bundle")
    marts.write_bundle({"trend": df, "other": df.drop("share")}, path)
    line = next(p for p in Path(path, "dataset=trend").glob("*.json") if p.stat().st_size).read_text().strip()
    assert json.loads(line) == {"PERIOD": "2024-01-01", "SHARE": None}
    back = marts.read_dataset(spark, path, "trend", "PERIOD date, SHARE double")
    assert records(back) == [{"PERIOD": date(2024, 1, 1), "SHARE": None}]


def test_run_stores_shared_frames_once_and_writes_both_sinks(spark, tables, tmp_path):
    names = ["c01_activation_kpi", "c05_retained_members", "r16_paid_share"]
    assert run(StarTables(spark, tables), TEST_WINDOWS, f"{tmp_path}/out", names) == names
    # The run's folder is gone, and later reports build their own frames.
    assert not list(Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).glob("paycadence-*"))
    for name in names:
        fresh = REPORTS[name](spark, tables)
        keys = [c.upper() for c in fresh.columns]
        want = records(marts.upper_names(fresh), *keys)
        assert records(marts.read_csv(spark, f"{tmp_path}/out/csv/{name}", marts.upper_names(fresh).schema), *keys) == want
        assert records(marts.read_dataset(spark, f"{tmp_path}/out/json", name, marts.upper_names(fresh).schema), *keys) == want


def test_each_run_has_its_own_shared_frames(spark, tables, tmp_path):
    stored = []

    class Watched(StarTables):
        def share(self, name, build):
            stored.append((name, name in self._stored))
            return super().share(name, build)

    t = Watched(spark, tables)
    names = ["c05_retained_members", "c22_heavy_hitters", "c21_leave_one_out"]
    other = replace(TEST_WINDOWS, since=date(1996, 1, 1), until=date(1996, 12, 24), detail=(date(1995, 5, 1), date(1995, 9, 1)))
    for k, windows in enumerate((TEST_WINDOWS, other)):
        run(t, windows, f"{tmp_path}/{k}", names)
        for name in names:
            fresh = marts.upper_names(BUILDERS[name](StarTables(spark, tables), windows))
            assert records(marts.read_csv(spark, f"{tmp_path}/{k}/csv/{name}", fresh.schema), *fresh.columns) == records(fresh, *fresh.columns)
    assert t.folder is None and not t._stored
    assert [known for name, known in stored if name == "detail"] == [False, True] * 2


def test_a_folder_of_one_machine_is_refused_on_a_cluster(spark, monkeypatch):
    context = spark.sparkContext
    monkeypatch.setattr(context, "master", "spark://somewhere:7077")
    with pytest.raises(ValueError, match="one machine"):
        shared_folder(spark)


def test_a_timeline_needs_accounts(spark, tables):
    with pytest.raises(ValueError, match="timeline"):
        BUILDERS["c23_account_timeline"](StarTables(spark, tables), replace(TEST_WINDOWS, timeline=()))


@pytest.fixture(scope="module")
def warehouse(spark, tables):
    """The test tables in the shape of the landed ones, with flags as text and JSON columns."""
    t = StarTables(spark, tables)
    cents = F.col("cents").cast("decimal(18,2)") / 100
    paid = t.payments().select(
        "customer_id", "lease_id", "je_id", F.initcap("method").alias("type"),
        cents.cast("decimal(18,2)").alias("amounttotransfer"), "fee", F.col("created").cast("timestamp_ntz").alias("created"),
    )
    frequency = F.when(F.col("frequency").isin(*t.frequencies), "Monthly").otherwise("Yearly")
    days = t.daily().select(
        "lease_id", "snapshot_date", "status", F.col("account").alias("dbtenant"), frequency.alias("rent_frequency"),
        F.col("merchant_flag").alias("merchant_account_flag"), F.col("account_first_invoice").alias("dbt_first_invoice_date"),
    )
    homes = t.leases().select(
        F.col("lease_id").alias("_id"), frequency.alias("recurringrentfrequency"),
        F.col("deleted").cast("string").alias("deleted"), F.to_json("tenants").alias("tenants"),
    )
    people = t.tenants().select(
        F.col("tenant_id").alias("_id"),
        F.to_json(F.struct(F.col("portal.accepted_at").alias("invitationAcceptedAt"), F.col("portal.last_sent_at").alias("invitationLastSentAt"))).alias("portalinfo"),
    )
    linked = F.transform("charges", lambda c: F.struct(c["linked"].alias("linkedTransaction"), (c["cents"] / 100).cast("decimal(18,2)").alias("amount")))
    ledger = t.entries().select(
        F.col("entry_id").alias("_id"), F.col("account").alias("dbtenant"), "type", F.upper(F.col("deleted").cast("string")).alias("deleted"),
        F.col("due").alias("transactiondate"), F.to_json(F.struct(linked.alias("linkedCharges"))).alias("leasepayment"),
    )
    crm = t.accounts().select(
        F.col("account").alias("app_db_tenant_id_c"), "name", F.upper(F.col("is_test").cast("string")).alias("test_account_fivetran_c"), F.col("segment").alias("tier"),
    )
    properties = F.to_json(
        F.struct(
            F.col("sent_to_id").alias("sentToId"), F.col("account").alias("dbTenant"), "env", F.col("is_test").cast("string").alias("isTestUser"),
            F.col("source").alias("event_source"), F.col("sent_to_type").alias("sentToType"),
        )
    )
    product = t.events([INVITE, PAGE_VIEW]).select("event", F.col("ts").alias("timestamp"), properties.alias("properties"))
    raw = {
        "payments": paid, "returns": t.returns(), "daily": days, "leases": homes, "tenants": people,
        "entries": ledger, "accounts": crm, "events": product,
    }
    return landed.LandedTables(spark, raw, segment="tier")


@pytest.mark.parametrize("name", sorted(BUILDERS))
def test_every_report_can_be_planned_over_landed_tables(spark, tables, warehouse, name):
    windows = Windows.for_cycle(date(2026, 5, 1), leave_out=TEST_WINDOWS.leave_out, timeline=TEST_WINDOWS.timeline)
    assert BUILDERS[name](warehouse, windows).columns == REPORTS[name](spark, tables).columns


# Reports that do not depend on the account of a payment, which the ledger holds here.
SAME = (
    "c06_retention_any c07_retention_ach c19_adoption_trend c24_mix_decomposition c25_volume_and_fee c26_churn_mix "
    "c27_churn_series c28_day_distribution c30_new_active_leases c31_return_rate c32_returns_by_tier "
    "c33_charge_allocation c34_invite_coverage c36_reactivated_charges c38_reactivation_series c39_totals_with_rollup "
    "r01_first_and_returning_mix r13_paid_breakdown r17_method_stickiness"
).split()


@pytest.mark.parametrize("name", ["c33_charge_allocation", "c34_invite_coverage", "c02_event_funnel"])
def test_report_over_variant_columns_equals_that_over_text(spark, warehouse, tmp_path, name):
    raw = dict(warehouse.raw)
    for role, column in (("leases", "tenants"), ("tenants", "portalinfo"), ("entries", "leasepayment"), ("events", "properties")):
        with_variants(raw[role], [column]).write.parquet(f"{tmp_path}/{role}")
        raw[role] = spark.read.parquet(f"{tmp_path}/{role}")
    over_variants, over_text = (BUILDERS[name](t, TEST_WINDOWS) for t in (landed.LandedTables(spark, raw, segment="tier"), warehouse))
    assert records(over_variants, *over_text.columns) == records(over_text, *over_text.columns)


@pytest.mark.parametrize("name", SAME)
def test_report_over_landed_tables_equals_the_star_report(spark, tables, warehouse, name):
    ours = BUILDERS[name](warehouse, TEST_WINDOWS)
    assert records(ours, *ours.columns) == records(REPORTS[name](spark, tables), *ours.columns)


@pytest.mark.parametrize("name", ["c01_activation_kpi", "c03_days_to_event", "c04_censored_transitions", "c06_retention_any", "c20_first_payment_size", "c24_mix_decomposition", "r12_state_transitions"])
def test_times_at_midnight_change_nothing(spark, tables, warehouse, name):
    timed = landed.LandedTables(spark, warehouse.raw, segment="tier", times=True)
    ours, plain = (records(BUILDERS[name](t, TEST_WINDOWS), *REPORTS[name](spark, tables).columns) for t in (timed, warehouse))
    assert ours == plain


def test_two_payments_of_a_day_are_two_events_by_time(spark):
    rows = spark.createDataFrame(
        [("1", date(2024, 1, 1), "Onboarding", date(2024, 1, 5), None, None)],
        "lease_id string, cohort date, label string, activated date, invited_at timestamp_ntz, accepted_at timestamp_ntz",
    )
    raw = raw_payments(spark).filter("lease_id = 1").withColumn("created", F.lit(datetime(2024, 1, 8)) + F.make_dt_interval(hours=F.col("id").cast("int")))
    second = [
        records(funnel.step_dates(rows, landed.payments(raw, times=times), date(2024, 3, 1)))[0]["second_paid"] for times in (False, True)
    ]
    assert second[0] is None and second[1] is not None


class LedgerStar(StarTables):
    """Star tables whose payments belong to the account of their ledger entry, as landed ones do."""

    def payments(self, *args, accounts=False, named=False, **options):
        df = super().payments(*args, **options)
        if not accounts:
            return df
        owner = self.entries().select(F.col("entry_id").alias("je_id"), F.col("account").cast("string").alias("account"))
        return df.drop("account").join(owner, "je_id", "left")

    def accounts(self):
        return super().accounts().withColumn("account", F.col("account").cast("string"))

    def named_accounts(self):
        return self.accounts()

    def daily(self):
        return super().daily().withColumn("account", F.col("account").cast("string"))


BY_ACCOUNT = (
    "c13_payers_by_account_tenure c14_method_by_account_tenure c15_low_mix_batches c21_leave_one_out c22_heavy_hitters "
    "c23_account_timeline c29_account_landings r02_first_payers_by_account_age r03_first_payers_by_newness "
    "r04_first_payers_and_accounts r05_first_payer_paths r10_paid_accounts r14_paid_by_segment"
).split()


@pytest.mark.parametrize("name", BY_ACCOUNT)
def test_report_by_account_over_landed_tables_equals_the_star_report(spark, tables, warehouse, name):
    windows = replace(TEST_WINDOWS, leave_out=(("a", "%a%"), ("b", "%RED%")), timeline=("%e%",), heavy_min_size=1)
    ours = BUILDERS[name](warehouse, windows)
    star = records(BUILDERS[name](LedgerStar(spark, tables), windows), *ours.columns)
    assert star and records(ours, *ours.columns) == star


def test_days_after_the_cohort_are_not_read(spark, warehouse, tmp_path):
    warehouse.raw["daily"].write.parquet(f"{tmp_path}/daily")
    stored = landed.LandedTables(spark, {**warehouse.raw, "daily": spark.read.parquet(f"{tmp_path}/daily")}, segment="tier")
    # Plans shorten long values; a scan is known by the columns it reads, since its folder may be cut off.
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    try:
        for name in ("c05_retained_members", "c12_lease_retention"):
            plan = BUILDERS[name](stored, TEST_WINDOWS)._jdf.queryExecution().executedPlan().toString()
            scans = [line for line in plan.splitlines() if "FileScan" in line and "snapshot_date:date" in line]
            assert scans and all("LessThanOrEqual(snapshot_date,1997-12-24)" in scan for scan in scans)
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_windows_of_a_monthly_cycle():
    w = Windows.for_cycle(date(2026, 5, 1))
    assert (w.since, w.until, w.cutoff) == (date(2025, 9, 1), date(2026, 5, 24), date(2026, 6, 15))
    assert (w.cohorts, w.lookback) == ((date(2025, 1, 1), date(2026, 6, 1)), date(2023, 1, 1))
    assert w.day_ranges == ((date(2025, 2, 1), date(2025, 4, 30)), (date(2026, 2, 1), date(2026, 4, 30)))
    assert (w.gaps[0], w.seasonality[0], w.coverage[1]) == (date(2024, 9, 25), date(2023, 12, 25), date(2026, 5, 31))
    assert w.followed == date(2026, 5, 24) + timedelta(days=135)
