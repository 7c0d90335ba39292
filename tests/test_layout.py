from __future__ import annotations

import pytest
from conftest import records
from pyspark.sql import functions as F

from paycadence.sources import landed, layout

PAYMENTS = "id string, customer_id string, lease_id long, je_id string, type string, amounttotransfer decimal(18,2), fee double, created timestamp_ntz"
ENTRIES = "_id string, dbtenant string, type string, deleted string, transactiondate string, leasepayment string"


@pytest.fixture(scope="module")
def raw(spark):
    """A third of the payments on one entry, some without one, and two rows of one entry."""
    paid = spark.range(300).select(
        F.col("id").cast("string"), F.concat(F.lit("c"), F.col("id") % 9).alias("customer_id"), (F.col("id") % 20).alias("lease_id"),
        F.when(F.col("id") % 3 == 0, "e1").when(F.col("id") % 10 != 1, F.concat(F.lit("e"), F.col("id") % 40)).alias("je_id"),
        F.lit("charge").alias("type"), F.lit(12.5).cast("decimal(18,2)").alias("amounttotransfer"), F.lit(0.5).alias("fee"),
        F.lit("2024-01-05").cast("timestamp_ntz").alias("created"),
    )
    rows = [(f"e{i}", f"a{i % 4}", "leasePayment", "false", "2024-01-24", None) for i in range(30)]
    rows += [("e2", "other", "leasePayment", "false", "2024-01-24", None), (None, "none", "leasePayment", "false", "2024-01-24", None)]
    return paid, spark.createDataFrame(rows, ENTRIES)


@pytest.fixture
def plain_joins(spark):
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    saved = {key: spark.conf.get(key) for key in changed}
    for key, value in changed.items():
        spark.conf.set(key, value)
    yield
    for key, value in saved.items():
        spark.conf.set(key, value)


def test_bucketed_tables_join_without_a_shuffle(spark, raw, plain_joins):
    names = ("layout_payments", "layout_entries")
    try:
        paid, made = (layout.store_bucketed(df, n, k, 4) for df, n, k in zip(raw, names, ("je_id", "_id")))
        joined = landed.with_accounts(landed.payments(paid), landed.entries(made))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        unbucketed = landed.with_accounts(landed.payments(raw[0]), landed.entries(raw[1]))
        assert "Exchange" in unbucketed._jdf.queryExecution().executedPlan().toString()
        order = ("je_id", "customer_id", "lease_id", "account")
        assert records(joined, *order) == records(unbucketed, *order)
        assert joined.filter("je_id is null").count() == raw[0].filter("je_id is null").count() > 0
        assert {r.account for r in joined.filter("je_id = 'e2'").collect()} == {"a2", "other"}
        with pytest.raises(ValueError):
            layout.store_bucketed(raw[0], "layout_none", "nothing", 4)
    finally:
        for n in names:
            spark.sql(f"DROP TABLE IF EXISTS {n}")


def forms(spark, df, columns, schemas, tmp_path):
    """The table with JSON text, with typed structs, and with variants stored as Parquet."""
    path = f"file://{tmp_path}/variants"
    layout.with_variants(df, columns).write.parquet(path)
    typed = df.withColumns({c: F.from_json(c, s) for c, s in zip(columns, schemas)})
    return [df, typed, spark.read.parquet(path)]


def test_entries_leases_and_tenants_read_the_same_from_three_forms(spark, tmp_path):
    body = ['{"linkedCharges": [{"linkedTransaction": "c1", "amount": 12.5}, {"linkedTransaction": "c2", "amount": "0.49"}, {"amount": null}]}',
            '{"linkedCharges": null}', "{}", None, "[1]"]
    df = spark.createDataFrame([(f"e{i}", "a", "leasePayment", "false", "2024-01-24", b) for i, b in enumerate(body)], ENTRIES)
    text, typed, variant = (records(landed.entries(f), "entry_id") for f in forms(spark, df, ["leasepayment"], [landed.LINKED], tmp_path / "entries"))
    assert [[(c["linked"], c["cents"]) for c in r["charges"] or ()] for r in text][0] == [("c1", 1250), ("c2", 49), (None, None)]
    assert text == typed == variant
    df = spark.createDataFrame([("1", "Monthly", "false", '[{"tenant": "t1"}, {"tenant": null}, {}]'), ("2", "Yearly", "FALSE", "[]"), ("3", "Weekly", "true", None)], "_id string, recurringrentfrequency string, deleted string, tenants string")
    text, typed, variant = (records(landed.leases(f), "lease_id") for f in forms(spark, df, ["tenants"], [landed.TENANT_LIST], tmp_path / "leases"))
    assert text == typed == variant
    df = spark.createDataFrame([("t1", '{"invitationAcceptedAt": "2024-01-05T10:00:00", "invitationLastSentAt": null}'), ("t2", "{}"), ("t3", None), ("t4", "")], "_id string, portalinfo string")
    text, typed, variant = (records(landed.tenants(f), "tenant_id") for f in forms(spark, df, ["portalinfo"], [landed.PORTAL], tmp_path / "tenants"))
    assert text == typed == variant


def test_events_read_the_same_from_three_forms(spark, tmp_path):
    rows = [("invite", "2024-01-02 10:00:00", b) for b in ('{"sentToId": 7, "dbTenant": "a", "isTestUser": "false"}', '{"sentToId": null, "isTestUser": true}', "{}", None, "not json")]
    df = spark.createDataFrame(rows, "event string, timestamp string, properties string").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    schema = "struct<sentToId: string, dbTenant: string, env: string, isTestUser: string, event_source: string, sentToType: string>"
    text, typed, variant = (records(landed.events(f, ["invite"]), "sent_to_id", "is_test") for f in forms(spark, df, ["properties"], [schema], tmp_path))
    assert text == typed == variant and len(text) == 5
    assert [r["sent_to_id"] for r in text].count(None) == 4


def test_a_json_null_is_told_from_a_missing_path(spark, tmp_path):
    rows = [(1, '{"a": null}'), (2, "{}"), (3, None), (4, '{"a": {"b": 1}}'), (5, "bad json"), (6, "null")]
    df = spark.createDataFrame(rows, "id int, v string")
    want = {1: "null", 2: "missing", 3: "missing", 4: "value", 5: "missing", 6: "missing"}
    for form in (df, layout.with_variants(df, ["v"])):
        assert {r.id: r.s for r in form.select("id", layout.path_state(form, "v", "$.a").alias("s")).collect()} == want
    structs = df.select("id", F.from_json("v", "struct<a: string>").alias("v"))
    seen = {r.id: r.s for r in structs.select("id", layout.path_state(structs, "v", "$.a").alias("s")).collect()}
    assert seen[1] == seen[2] == "null" and seen[4] == "value" and seen[3] == "missing"
