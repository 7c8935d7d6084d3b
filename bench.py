"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is executed in full with the ``noop`` sink (every row computed,
nothing collected to the driver), after one warm-up run of the flagship on
the smoke data. The best of ``BENCH_REPEAT`` (default 2) runs is reported.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "daily_valuation_long",
    "daily_valuation_long_l",
    "daily_valuation_wide",
    "holdings_report",
    "positions_asof",
    "price_gaps",
    "ledger_normalize",
    "ledger_import_distinct",
    "upsert_transactions",
    "daily_close_paris",
    "backfill_points_kept",
    "null_audit",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    names = sys.argv[1:] or HEADLINE

    from coffer.plans.catalog import REGISTRY
    from coffer.session import build_session

    spark = build_session("coffer-bench", cpus=cpus, shuffle_partitions=int(cpus) * 2)
    REGISTRY["daily_valuation_long"].build(spark, "/root/testdata/sf0.001").write.format("noop").mode(
        "overwrite"
    ).save()

    times: dict[str, float | None] = {}
    errors: dict[str, str] = {}
    for n in names:
        best = None
        try:
            for _ in range(repeat):
                t0 = time.perf_counter()
                REGISTRY[n].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
                dt = time.perf_counter() - t0
                best = dt if best is None else min(best, dt)
            times[n] = round(best, 3)
        except Exception as e:  # noqa: BLE001 — record the failure, keep benchmarking the rest
            times[n] = None
            errors[n] = f"{type(e).__name__}: {str(e)[:200]}"
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(v for v in times.values() if v is not None), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                "cpus": int(cpus),
                **({"errors": errors} if errors else {}),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
