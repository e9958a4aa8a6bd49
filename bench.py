"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the cores. Each query is built
and run to the end twice (results go to a sink that drops them); the better
time counts, including the building of the plan.
"""

from __future__ import annotations

import json
import os
import sys
import time

from meritpool.catalog.queries import QUERIES
from meritpool.session import local_session

HEADLINE = [
    "teacher_summary", "summary_one_period", "points_by_student", "snapshot_replace",
    "results_recent", "results_shown", "results_export", "card_items", "card_latest",
    "table_counts", "missing_names", "enrollments_insert_absent", "assignments_insert_absent",
    "grade_pick", "result_import", "criteria_upsert", "changes_results", "dq_all_row_rules",
    "dq_unique", "dq_references",
]


def timed(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.shuffle.partitions", cpus)
    seconds = {}
    for name in names:
        seconds[name] = round(min(timed(spark, name, folder) for _ in range(2)), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
