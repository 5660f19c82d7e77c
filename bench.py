"""Times headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) select
data and cores. Each query runs twice on a warm session and writes its whole
result to a sink that discards it; the faster run counts.
"""

from __future__ import annotations

import json
import os
import re
import time

from rotaflow.session import local_session
from suite.queries import QUERIES, Given

HEADLINE = (
    "fleet_status",
    "classify_status",
    "status_distribution",
    "status_episodes",
    "current_status",
    "first_exceedance_detail",
    "baseline_from_early",
    "deviation_pct",
    "rolling_stats",
    "engineer_features",
    "band_excess",
    "ffill",
    "chronological_split",
    "latest_24_stats",
    "dq_validate",
    "classify_status_edge",
    "anomaly_payload",
    "debounce_anomalies",
    "normalise_vendor_log",
    "baseline_from_curve_test",
    "anomaly_summary",
    "anomaly_timeline_pivot",
    "compare_pumps",
    "anomaly_page",
    "stream_status",
)


def timed(spark, folder: str, name: str) -> float:
    started = time.perf_counter()
    QUERIES[name](Given(spark, folder)).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    timed(spark, folder, "fleet_status")
    seconds = {
        name: round(min(timed(spark, folder, name) for _ in range(2)), 3) for name in HEADLINE
    }
    scale = re.search(r"sf([\d.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else folder,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
