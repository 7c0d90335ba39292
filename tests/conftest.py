from __future__ import annotations

import os
import sys
from datetime import date
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from paycadence.session import session  # noqa: E402

TABLES = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("checkpoints")
    spark = session("local[4]", 4, **{"spark.checkpoint.dir": f"file://{shared}"})
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def tables():
    if not Path(TABLES).is_dir():
        pytest.skip(f"no tables at {TABLES}")
    return TABLES


def day(text: str) -> date:
    return date.fromisoformat(text)


PAYMENTS = "customer_id string, lease_id string, je_id string, account string, method string, cents bigint, created date"


def payments(spark, rows):
    """Rows of (customer, lease, account, method, cents, 'yyyy-mm-dd'); the lease is its own entry."""
    full = [(c, l, l, a, m, n, day(d)) for c, l, a, m, n, d in rows]
    return spark.createDataFrame(full, PAYMENTS)


def simple_payments(spark, rows):
    """Rows of (customer, method, cents, 'yyyy-mm-dd')."""
    return payments(spark, [(c, f"lease-{c}", "acct", m, n, d) for c, m, n, d in rows])


def records(df, *order):
    out = [row.asDict() for row in df.collect()]
    return sorted(out, key=lambda r: tuple(str(r[o]) for o in order)) if order else out
