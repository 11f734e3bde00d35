"""Times the warehouse build, the upkeep jobs and the reports; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Each query runs to the end over its whole result (``noop`` sink). ``build`` is the full load:
CSV files, staging, operational tables and star schema. Queries that need an older warehouse
get it before the clock starts.
"""

from __future__ import annotations

import json
import os
import sys
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "fact_full", "fact_unmatched", "dim_employee_full", "scd2_point_in_time", "multi_version_employees",
    "kpis", "yearly_trend", "top_employees", "top_employees_by_sk", "project_bottlenecks",
    "project_bottlenecks_by_id", "department_performance", "attrition_risk", "attrition_distribution",
    "attrition_top15", "employee_directory", "employee_exists", "upsert_project", "new_employees",
    "fact_incremental", "scd2_apply", "validate_employees", "intake_reviews", "dq_unique", "dq_not_null",
    "dq_referential", "dq_scd2", "synth_employees", "synth_assignments", "synth_reviews",
]


def main() -> None:
    from checks import stores
    from checks.queries import all_queries
    from staffmart.session import build_session

    spark = build_session("bench", f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS,
                          spark__driver__memory="12g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    known, times = all_queries(), {}

    def clock(name: str, run) -> None:
        start = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name:28s} {times[name]:8.2f}", file=sys.stderr, flush=True)

    spark.range(1).write.format("noop").mode("overwrite").save()
    clock("build", lambda: stores.warehouse(spark, SF_DIR))
    stores.base_warehouse(spark, SF_DIR)
    for name in HEADLINE:
        clock(name, lambda: known[name](spark, SF_DIR).write.format("noop").mode("overwrite").save())
    print(json.dumps({"metric": "warehouse build, upkeep and reports, total time",
                      "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "cores": int(CPUS)}))


if __name__ == "__main__":
    main()
