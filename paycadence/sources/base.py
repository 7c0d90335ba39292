"""What every set of adapters offers to the reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .canonical import ALL_METHODS


class Tables:
    """Canonical frames of one source; see ``sources.canonical`` for their columns.

    ``frequencies`` are the recurring rent frequencies. Inside ``sharing`` frames that
    several reports use are stored once; outside, each report builds its own.
    """

    frequencies: Sequence[str]

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder: str | None = None
        self._stored: dict[str, DataFrame] = {}

    @contextmanager
    def sharing(self, folder: str) -> Iterator[None]:
        """Shared frames are stored in this folder, for one run and its windows only."""
        self.folder, self._stored = folder, {}
        try:
            yield
        finally:
            self.folder, self._stored = None, {}

    def share(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A frame that several reports use."""
        if self.folder is None:
            return build()
        if name not in self._stored:
            df, path = build(), f"{self.folder}/{name}"
            df.write.mode("overwrite").parquet(path)
            self._stored[name] = self.spark.read.schema(df.schema).parquet(path)
        return self._stored[name]

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
        """Positive payments between two days, both included; ``methods=None`` takes any type.

        ``recurring`` keeps payments on leases with a recurring rent. Say which of the
        payer and the account are needed, so that nothing is joined in vain; ``named``
        asks for accounts that ``named_accounts`` describes.
        """
        raise NotImplementedError

    def daily(self) -> DataFrame:
        raise NotImplementedError

    def lease_status(self) -> DataFrame:
        """lease_id, snapshot_date and status."""
        return self.daily().select("lease_id", "snapshot_date", "status")

    def leases(self) -> DataFrame:
        raise NotImplementedError

    def recurring_leases(self) -> DataFrame:
        """lease_id of leases with a recurring rent."""
        return self.leases().filter(F.col("frequency").isin(*self.frequencies)).select("lease_id")

    def tenants(self) -> DataFrame:
        raise NotImplementedError

    def entries(self) -> DataFrame:
        raise NotImplementedError

    def accounts(self) -> DataFrame:
        raise NotImplementedError

    def named_accounts(self) -> DataFrame:
        return self.accounts()

    def events(self, names: Sequence[str], since: date | None = None, until: date | None = None) -> DataFrame:
        raise NotImplementedError

    def returns(self) -> DataFrame:
        raise NotImplementedError
