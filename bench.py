"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time

os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 12g pyspark-shell")

from sentinelle.plans import registry  # noqa: E402
from sentinelle.session import local_session  # noqa: E402

HEADLINES = (
    "activity_score_by_window",
    "incident_timeseries_7d",
    "count_by_region_top12",
    "coverage_by_language_merged",
    "chokepoint_activity",
    "spatial_join_grid",
    "fire_filter_reasons",
    "conflict_tally",
    "conflict_tempo_verdicts",
    "control_assessment",
    "dedup_first_occurrence",
    "incident_rollup",
    "correlation_pair_score",
    "correlate_greedy_assign",
    "keyword_classify",
    "bundle_item_reasons",
    "gazetteer_resolve",
    "timeseries_sliding_7d",
    "asof_previous_event",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "12g")
    spark.sparkContext.setLogLevel("ERROR")
    known = registry.queries()
    run = lambda name: known[name](spark, sf).write.format("noop").mode("overwrite").save()
    run(HEADLINES[0])  # the first query pays for the session
    took = {}
    for name in HEADLINES:
        began = time.perf_counter()
        run(name)
        took[name] = round(time.perf_counter() - began, 3)
    reports = spark.read.parquet(f"{sf}/events.parquet").count()
    rates = {"correlated_reports_per_sec": round(reports / took["correlate_greedy_assign"])}
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "rates": rates, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    sys.exit(main())
