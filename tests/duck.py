"""Times the SQL checks in DuckDB: python tests/duck.py [directory]"""

from __future__ import annotations

import sys
import time

import check

from paycadence.plans.oracles import ORACLES

if __name__ == "__main__":
    con = check.connect(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")
    con.execute("SET threads = 8")
    total = 0.0
    for name in sorted(ORACLES):
        best = float("inf")
        for _ in range(2):
            begin = time.perf_counter()
            con.execute(ORACLES[name]).fetchall()
            best = min(best, time.perf_counter() - begin)
        total += best
        print(f"{name} {best:.3f}")
    print(f"total {total:.3f}")
