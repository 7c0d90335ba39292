"""Canonical frames built from the star-schema test tables.

Each method selects only the columns it needs and keeps range filters on the
stored timestamp column, so both reach the parquet scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Tables
from .canonical import ACH, ACTIVE, ALL_METHODS, CARD, CASH, INVITE, PAGE_VIEW, PAYMENT_ENTRY

# The priorities that stand for the four recurring rent frequencies.
FREQUENCIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")


# Stored columns that the adapters read. Stating them avoids a job that infers the schema.
SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_extendedprice double, l_tax double, "
    "l_returnflag string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_type string, p_size int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int",
    "events": "ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def _midnight(day: date) -> Column:
    """A timestamp without time zone; a datetime literal would depend on the session's zone."""
    return F.lit(day).cast("timestamp_ntz")


def _day_range(column: str, since: date | None, until: date | None) -> list[Column]:
    """Inclusive day range on a timestamp column, free of casts around the column."""
    out = []
    if since is not None:
        out.append(F.col(column) >= _midnight(since))
    if until is not None:
        out.append(F.col(column) < _midnight(until + timedelta(days=1)))
    return out


class StarTables(Tables):
    """Adapters over one directory of parquet tables."""

    frequencies = FREQUENCIES

    def __init__(self, spark: SparkSession, directory: str):
        super().__init__(spark)
        self.directory = directory
        self._tables: dict[str, DataFrame] = {}

    def read(self, name: str) -> DataFrame:
        """The columns of a stored table that the adapters use."""
        if name not in self._tables:
            reader = self.spark.read.schema(SCHEMAS[name])
            self._tables[name] = reader.parquet(f"{self.directory}/{name}.parquet")
        return self._tables[name]

    def payments(
        self,
        since: date | None = None,
        until: date | None = None,
        recurring: bool = False,
        customers: bool = True,
        accounts: bool = False,
        named: bool = False,
        methods: Sequence[str] | None = ALL_METHODS,
    ) -> DataFrame:
        """The payer and the rent frequency come from ``orders``; accounts are parts, or suppliers if ``named``."""
        lines = self.read("lineitem")
        for condition in _day_range("l_shipdate", since, until):
            lines = lines.filter(condition)
        cents = F.rint(F.col("l_extendedprice") * 100).cast("bigint")
        fee = (cents * F.rint(F.col("l_tax") * 100).cast("bigint")).cast("decimal(18,0)") / 10000
        lines = lines.filter(F.col("l_extendedprice") > 0).select(
            F.col("l_orderkey").alias("lease_id"),
            F.col("l_orderkey").alias("je_id"),
            F.col("l_suppkey" if named else "l_partkey").alias("account"),
            F.when(F.col("l_returnflag") == "A", CARD)
            .when(F.col("l_returnflag") == "R", ACH)
            .otherwise(CASH)
            .alias("method"),
            cents.alias("cents"),
            fee.cast("decimal(18,4)").alias("fee"),
            F.col("l_shipdate").cast("date").alias("created"),
        )
        # The stored flags stand for the three methods and nothing else.
        if methods is not None and set(methods) < set(ALL_METHODS):
            lines = lines.filter(F.col("method").isin(*methods))
        if not customers and not recurring:
            return lines
        orders = self.read("orders")
        if recurring:
            orders = orders.filter(F.col("o_orderpriority").isin(*self.frequencies))
        orders = orders.select(F.col("o_orderkey").alias("lease_id"), F.col("o_custkey").alias("customer_id"))
        return lines.join(orders, "lease_id", "inner")

    def daily(self) -> DataFrame:
        """Lease snapshots, one per month from activation, 1 to 12 of them."""
        key = F.col("o_orderkey")
        first_invoice = F.when(
            F.col("o_custkey") % 29 != 0,
            F.date_add(F.lit(date(1994, 6, 1)), (F.col("o_custkey") * 13 % 2500).cast("int")),
        )
        return (
            self.read("orders")
            .withColumn("_i", F.explode(F.sequence(F.lit(0), (key % 12).cast("int"))))
            .select(
                key.alias("lease_id"),
                F.add_months(F.col("o_orderdate").cast("date"), F.col("_i")).alias("snapshot_date"),
                F.when((key % 7 == 0) & (F.col("_i") == 0), "FUTURE").otherwise(ACTIVE).alias("status"),
                F.col("o_custkey").alias("account"),
                F.col("o_orderpriority").alias("frequency"),
                F.when(F.col("o_orderstatus") != "F", 1).otherwise(0).alias("merchant_flag"),
                first_invoice.alias("account_first_invoice"),
            )
        )

    def leases(self) -> DataFrame:
        """Leases with their payers: the customer and a neighbour; some lists empty or null."""
        key, customer = F.col("o_orderkey"), F.col("o_custkey")
        pair = F.array(
            F.struct(customer.alias("tenant")), F.struct((customer + 1 + key % 3).alias("tenant"))
        )
        return self.read("orders").select(
            key.alias("lease_id"),
            F.col("o_orderpriority").alias("frequency"),
            (key % 41 == 0).alias("deleted"),
            F.when(key % 31 == 0, F.slice(pair, 1, 0)).when(key % 37 != 0, pair).alias("tenants"),
        )

    def tenants(self) -> DataFrame:
        key = F.col("c_custkey")
        day = F.date_add(F.lit(date(1995, 1, 1)), (key * 37 % 2400).cast("int"))
        accepted = day.cast("timestamp_ntz") + F.make_dt_interval(hours=(key % 24).cast("int"))
        sent = accepted - F.make_dt_interval(days=(key % 30).cast("int"))
        return self.read("customer").select(
            key.alias("tenant_id"),
            F.struct(
                F.when(F.col("c_mktsegment") != "BUILDING", accepted).alias("accepted_at"),
                F.when(key % 11 != 0, sent).alias("last_sent_at"),
            ).alias("portal"),
        )

    def entries(self) -> DataFrame:
        """Ledger entries; each payment entry settles one to four entries that follow it."""
        key = F.col("o_orderkey")
        total = F.rint(F.col("o_totalprice") * 100).cast("bigint")

        def charge(i: Column) -> Column:
            cents = ((total - total % (i + 2)) / (i + 2)).cast("bigint")
            return F.struct((key + i).alias("linked"), cents.alias("cents"))

        charges = F.transform(F.sequence(F.lit(0), (key % 4).cast("int")), charge)
        due = F.date_format("o_orderdate", "yyyy-MM-dd")
        return self.read("orders").select(
            key.alias("entry_id"),
            F.col("o_custkey").alias("account"),
            F.when(key % 5 == 0, "leaseCharge").otherwise(PAYMENT_ENTRY).alias("type"),
            (key % 19 == 0).alias("deleted"),
            F.when(key % 23 != 0, due).otherwise("n/a").alias("due"),
            charges.alias("charges"),
        )

    def named_accounts(self) -> DataFrame:
        return self.read("supplier").select(
            F.col("s_suppkey").alias("account"),
            F.col("s_name").alias("name"),
            F.col("s_nationkey").cast("string").alias("segment"),
            F.lit(False).alias("is_test"),
        )

    def accounts(self) -> DataFrame:
        return self.read("part").select(
            F.col("p_partkey").alias("account"),
            F.col("p_name").alias("name"),
            F.col("p_type").alias("segment"),
            (F.col("p_size") == 7).alias("is_test"),
        )

    def _event_time(self) -> Column:
        """Event times, stretched from 30 days in 2024 to the 2,400 days of the payments."""
        return _midnight(date(1995, 1, 1)) + (F.col("ts") - _midnight(date(2024, 1, 1))) * 80

    def _property(self) -> Column:
        return F.get_json_object("props", "$.k").cast("int")

    def events(self, names: Sequence[str], since: date | None = None, until: date | None = None) -> DataFrame:
        """Product events; recipient, account and origin are read from the JSON properties."""
        stored = {INVITE: "view", PAGE_VIEW: "click"}
        k = F.col("_k")
        recipient = F.col("user_id") * 10 + k % 10
        rows = (
            self.read("events")
            .filter(F.col("event_type").isin(*[stored[n] for n in names]))
            .withColumn("_k", self._property())
            .select(
                F.when(F.col("event_type") == "view", INVITE).otherwise(PAGE_VIEW).alias("event"),
                self._event_time().alias("ts"),
                recipient.alias("sent_to_id"),
                recipient.alias("account"),
                F.when(k % 10 < 8, "production").otherwise("staging").alias("env"),
                (k == 99).alias("is_test"),
                F.when(F.col("value") >= 2, "Product").otherwise("Import").alias("source"),
                F.when(k < 90, "TENANT").otherwise("OWNER").alias("sent_to_type"),
            )
        )
        for condition in _day_range("ts", since, until):
            rows = rows.filter(condition)
        return rows

    def returns(self) -> DataFrame:
        """Returned payments with their fee tier."""
        k = self._property()
        return (
            self.read("events")
            .filter(F.col("event_type") == "error")
            .select(
                self._event_time().cast("date").alias("created"),
                F.when(k % 3 == 0, 0.25).when(k % 3 == 1, 0.40).otherwise(0.15).cast("decimal(18,4)").alias("fee"),
            )
        )
