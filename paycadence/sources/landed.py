"""Canonical frames from landed warehouse tables.

Column names on the left of each mapping are the stored ones. Flags stored as
text become booleans, identifiers become strings, and semi-structured columns
(JSON text, variants or typed structs) become typed fields, so no operator has to cast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import Tables
from .canonical import ALL_METHODS, FREQUENCIES
from .layout import is_variant

# Schemas of the semi-structured columns when they are stored as JSON text.
TENANT_LIST = "array<struct<tenant: string>>"
PORTAL = "struct<invitationAcceptedAt: string, invitationLastSentAt: string>"
LINKED = "struct<linkedCharges: array<struct<linkedTransaction: string, amount: decimal(18,2)>>>"


def is_true(column: Column | str) -> Column:
    """Boolean from a boolean or from 'true'/'FALSE' text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.lower(c.cast("string")) == "true"


def typed(df: DataFrame, column: str, schema: str) -> Column:
    """The column as a struct or array: parsed if stored as text, read from a variant, as it is otherwise."""
    if isinstance(df.schema[column].dataType, T.StringType):
        return F.from_json(column, schema)
    if is_variant(df, column):
        return F.try_variant_get(column, "$", schema)
    return F.col(column)


def in_cents(amount: Column | str) -> Column:
    """Whole cents of an amount with at most two decimals."""
    c = F.col(amount) if isinstance(amount, str) else amount
    return (c.cast("decimal(18,2)") * 100).cast("bigint")


def payments(
    raw: DataFrame,
    since: date | None = None,
    until: date | None = None,
    methods: Sequence[str] | None = None,
    exact: bool = False,
    times: bool = False,
) -> DataFrame:
    """Positive payments between two days; ``methods`` keeps these types, without regard to case unless ``exact``.

    ``created`` is a date, or the stored time if ``times``.
    """
    df = raw.filter(F.col("amounttotransfer") > 0)
    kind = F.col("type") if exact else F.lower("type")
    if methods is not None:
        df = df.filter(kind.isin(*methods))
    if since is not None:
        df = df.filter(F.col("created") >= F.lit(since))
    if until is not None:
        df = df.filter(F.col("created") < F.lit(until + timedelta(days=1)))
    return df.select(
        F.col("customer_id").cast("string"),
        F.col("lease_id").cast("string"),
        F.col("je_id").cast("string"),
        kind.alias("method"),
        in_cents("amounttotransfer").alias("cents"),
        F.col("fee").cast("decimal(18,4)"),
        F.col("created").cast("timestamp_ntz" if times else "date"),
    )


def with_accounts(payments: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds the account of the ledger entry; null for payments without an entry."""
    return payments.join(entries.select(F.col("entry_id").alias("je_id"), "account"), "je_id", "left")


def returns(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("created").cast("date"), F.col("fee").cast("decimal(18,4)"))


def daily(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("lease_id").cast("string"),
        F.col("snapshot_date").cast("date"),
        "status",
        F.col("dbtenant").cast("string").alias("account"),
        F.col("rent_frequency").alias("frequency"),
        F.col("merchant_account_flag").cast("int").alias("merchant_flag"),
        F.col("dbt_first_invoice_date").cast("date").alias("account_first_invoice"),
    )


def lease_status(raw: DataFrame) -> DataFrame:
    """The second daily lease table, which holds only a status per lease and day."""
    return raw.select(
        F.col("lease_id").cast("string"), F.col("_date").cast("date").alias("snapshot_date"), "status"
    )


def leases(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("_id").cast("string").alias("lease_id"),
        F.col("recurringrentfrequency").alias("frequency"),
        is_true("deleted").alias("deleted"),
        typed(raw, "tenants", TENANT_LIST).alias("tenants"),
    )


def tenants(raw: DataFrame) -> DataFrame:
    """A JSON null inside the portal object reads as null, like a missing key."""
    portal = raw.select(F.col("_id").cast("string").alias("tenant_id"), typed(raw, "portalinfo", PORTAL).alias("p"))
    return portal.select(
        "tenant_id",
        F.struct(
            F.try_to_timestamp(F.col("p.invitationAcceptedAt").cast("string")).cast("timestamp_ntz").alias("accepted_at"),
            F.try_to_timestamp(F.col("p.invitationLastSentAt").cast("string")).cast("timestamp_ntz").alias("last_sent_at"),
        ).alias("portal"),
    )


def entries(raw: DataFrame) -> DataFrame:
    linked = raw.select("*", typed(raw, "leasepayment", LINKED).alias("_p"))
    return linked.select(
        F.col("_id").cast("string").alias("entry_id"),
        F.col("dbtenant").cast("string").alias("account"),
        "type",
        is_true("deleted").alias("deleted"),
        F.col("transactiondate").cast("string").alias("due"),
        F.transform(
            "_p.linkedCharges",
            lambda c: F.struct(
                c["linkedTransaction"].cast("string").alias("linked"),
                in_cents(c["amount"]).alias("cents"),
            ),
        ).alias("charges"),
    )


def accounts(raw: DataFrame, segment: str | None = None) -> DataFrame:
    return raw.select(
        F.col("app_db_tenant_id_c").cast("string").alias("account"),
        "name",
        (F.col(segment) if segment else F.lit(None).cast("string")).alias("segment"),
        is_true("test_account_fivetran_c").alias("is_test"),
    )


def events(
    raw: DataFrame, names: Sequence[str], since: date | None = None, until: date | None = None
) -> DataFrame:
    """Product events by name and time; properties are read as text, so a JSON null is null."""
    df = raw.filter(F.col("event").isin(*names))
    if since is not None:
        df = df.filter(F.col("timestamp") >= F.lit(since))
    if until is not None:
        df = df.filter(F.col("timestamp") < F.date_add(F.lit(until), 1))

    def prop(name: str) -> Column:
        if isinstance(raw.schema["properties"].dataType, T.StringType):
            return F.get_json_object("properties", f"$.{name}")
        if is_variant(raw, "properties"):
            return F.try_variant_get("properties", f"$.{name}", "string")
        return F.col(f"properties.{name}").cast("string")

    return df.select(
        "event",
        F.col("timestamp").cast("timestamp_ntz").alias("ts"),
        prop("sentToId").alias("sent_to_id"),
        prop("dbTenant").alias("account"),
        prop("env").alias("env"),
        is_true(prop("isTestUser")).alias("is_test"),
        prop("event_source").alias("source"),
        prop("sentToType").alias("sent_to_type"),
    )


def on_leases(payments: DataFrame, leases: DataFrame, frequencies) -> DataFrame:
    """Payments on leases with one of the rent frequencies."""
    keep = leases.filter(F.col("frequency").isin(*frequencies)).select("lease_id")
    return payments.join(keep, "lease_id", "left_semi")


class LandedTables(Tables):
    """Adapters over landed warehouse tables, given by role.

    Roles: payments, returns, daily, leases, tenants, entries, accounts, events, and
    optionally lease_status. Roles that no wanted report needs may be left out. With
    ``exact_types`` payment types must be stored in lower case to count. With ``times``
    payments keep their time of day: two of one day are two events, and a cut-off day
    ends at its midnight, as in a comparison of times with a date.
    """

    frequencies = FREQUENCIES

    def __init__(
        self,
        spark: SparkSession,
        raw: Mapping[str, DataFrame],
        segment: str | None = None,
        exact_types: bool = False,
        times: bool = False,
    ):
        super().__init__(spark)
        self.exact_types, self.times = exact_types, times
        self.raw = raw
        self.segment = segment

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
        """The payer is stored with the payment; the account comes from the ledger entry if asked for."""
        df = payments(self.raw["payments"], since, until, methods, self.exact_types, self.times)
        if recurring:
            df = on_leases(df, self.leases(), self.frequencies)
        return with_accounts(df, self.entries()) if accounts else df

    def daily(self) -> DataFrame:
        return daily(self.raw["daily"])

    def lease_status(self) -> DataFrame:
        if "lease_status" in self.raw:
            return lease_status(self.raw["lease_status"])
        return super().lease_status()

    def leases(self) -> DataFrame:
        return leases(self.raw["leases"])

    def tenants(self) -> DataFrame:
        return tenants(self.raw["tenants"])

    def entries(self) -> DataFrame:
        return entries(self.raw["entries"])

    def accounts(self) -> DataFrame:
        return accounts(self.raw["accounts"], self.segment)

    def events(self, names: Sequence[str], since: date | None = None, until: date | None = None) -> DataFrame:
        return events(self.raw["events"], names, since, until)

    def returns(self) -> DataFrame:
        return returns(self.raw["returns"])
