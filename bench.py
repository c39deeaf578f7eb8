"""Time every registered query once warm and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (8).
"""

from __future__ import annotations

import json
import os
import time

from quarrylens import session
from workload import queries as registered

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = (
    "profile_columns", "profile_approx", "profile_samples", "health_score", "quality_duplicates",
    "quality_outliers", "quality_outliers_large", "quality_recommendations", "orphan_records",
    "value_overlap", "discover_relationships", "scrub_text", "scrub_pages", "pii_hit_counts",
    "mask_values", "masked_query", "response_audit", "upsert_replace", "scan_csv", "token_search",
    "vector_knn", "dataset_summary", "catalog_search", "build_documents", "sql_log_check",
)


def run(spark, name: str) -> float:
    start = time.perf_counter()
    frame = registered.QUERIES[name](spark, SF_DIR)
    frame.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = session.local_session(CPUS, int(CPUS) if CPUS.isdigit() else 8)
    times: dict[str, float] = {}
    start = time.perf_counter()
    registered.store(spark, SF_DIR)
    times["catalog_build"] = time.perf_counter() - start
    for name in HEADLINE:
        run(spark, name)
        times[name] = run(spark, name)
    print(
        json.dumps(
            {
                "metric": "total warm time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": {n: round(t, 3) for n, t in times.items()},
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
