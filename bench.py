"""Time the headline queries: one JSON line on stdout.

Reads ``BENCH_SF_DIR`` (default the 0.1 tables) and runs on ``local[BENCH_CPUS]``. Every query is
computed in full and discarded; nothing is kept between queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

from plumbline.plans import registry
from plumbline.session import get_spark

HEADLINES = [
    "prevalence_by_year",
    "robust_scores",
    "probability_metrics",
    "metrics_by_region",
    "grid_derivatives",
    "run_drift",
    "trailing_totals",
    "derived_rows",
    "regrid_bilinear",
    "zonal_errors",
    "region_cell_areas",
    "region_overlaps",
    "nearest_analogs",
    "lead_curves",
    "merged_slices",
    "grounded_numbers",
    "question_keys",
    "held_out_predictions",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = get_spark(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.load()
    names = sys.argv[1:] or HEADLINES
    seconds = {}
    for name in names:
        start = time.perf_counter()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "driver_memory": "12g",
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
