"""Times reports on one machine and prints one JSON line.

BENCH_SF_DIR  directory of the tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_ONLY    comma separated report names, or "all" (default: HEADLINE)
BENCH_RUNS    timed runs per report, the best one counts (default 2)

Each report is written to the no-op sink, so every row is computed and none is kept.
"""

from __future__ import annotations

import json
import os
import time

from paycadence.plans.reports import REPORTS
from paycadence.session import session


# One or two reports of every family.
HEADLINE = (
    "c01_activation_kpi c02_event_funnel c03_days_to_event c04_censored_transitions c06_retention_any "
    "c07_retention_ach c11_eligible_retention c12_lease_retention c14_method_by_account_tenure "
    "c15_low_mix_batches c16_activation_lag c19_adoption_trend c20_first_payment_size c21_leave_one_out "
    "c22_heavy_hitters c24_mix_decomposition c25_volume_and_fee c26_churn_mix c27_churn_series "
    "c28_day_distribution c29_account_landings c31_return_rate c33_charge_allocation c34_invite_coverage "
    "c35_reactivation_gaps c36_reactivated_charges c39_totals_with_rollup r01_first_and_returning_mix "
    "r07_activation_kpi_wide r12_state_transitions r13_paid_breakdown r17_method_stickiness d04_year_over_year"
).split()


def timed(spark, name: str, directory: str) -> float:
    begin = time.perf_counter()
    REPORTS[name](spark, directory).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    only = os.environ.get("BENCH_ONLY", "")
    names = sorted(REPORTS) if only == "all" else [n for n in only.split(",") if n] or HEADLINE
    spark = session(f"local[{cpus}]", int(cpus), spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    timed(spark, names[0], directory)
    seconds = {n: round(min(timed(spark, n, directory) for _ in range(runs)), 3) for n in names}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total wall time of the reports, best run each",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": directory.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
