"""Time headline queries: ``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the local threads.

Prints one JSON line. ``publish`` and ``land`` are the one-off writes of the published tables
and of the landed extracts, which the other queries then read; both count in the total.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

import turnout.checked  # noqa: F401  registers the queries
from turnout.plans import registry
from turnout.plans.standin import StandIn
from turnout.session import build_session

HEADLINE = [
    "participations_by_year", "unique_by_year", "unique_vs_repeat_by_year", "faculty_by_year",
    "programme_by_year", "programme_faculty_heatmap", "unique_by_programme_year",
    "repeat_by_programme_year", "split_faculty", "split_affiliation", "split_gender",
    "split_ethnicity", "split_residency", "split_iwi", "department_range", "degree_range",
    "curricula_unique", "studio_timeseries", "studio_purpose_by_month",
    "studio_equipment_by_month", "journey_events", "journey_total", "events_per_participant",
    "journey_table", "journey_events_by_total", "journey_edges", "journey_nodes",
    "journey_matrix", "load_people", "load_programme_tags", "load_studio", "load_tags",
    "load_training", "enrich_participation", "build_published", "surrogate_id",
    "latest_admit_term", "exact_duplicates", "prune_versions", "content_fingerprint",
]


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp(prefix="turnout-bench-"),
        "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "12g"),
    })
    spark.sparkContext.setLogLevel("ERROR")
    tables = StandIn(spark, folder)
    seconds = {"publish": timed(tables.publish), "land": timed(tables.land)}
    for name in HEADLINE:
        seconds[name] = timed(
            lambda: registry.run(name, spark, folder).write.format("noop").mode("overwrite").save()
        )
    print(json.dumps({
        "metric": "total time of headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
