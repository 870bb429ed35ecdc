"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "energy_window_populations", "energy_rank", "boltzmann_strict", "energy_report",
    "protocol_arithmetic", "carry_thermal_correction", "gibbs", "temperature_scan",
    "greedy_dedup", "similar_pairs", "refined_populations", "weighted_peaks",
    "default_spectrum", "reference_on_grid", "similarity", "fit_shift_fwhm", "edm_spectrum",
    "pca_variance", "kmeans", "silhouette", "xyz_roundtrip", "log_frequencies", "protocol_table",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from rotamera.plans import catalogue
    from rotamera.session import build_session
    spark = build_session("bench", f"local[{cpus}]", int(cpus),
                          **{"spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g")})
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalogue.queries()
    # start the JVM's and the Python workers' machinery outside the measured time
    queries["default_spectrum"](spark, "/root/testdata/sf0.001").write.format("noop").mode(
        "overwrite").save()
    took: dict[str, float] = {}
    for n in names:
        t0 = time.perf_counter()
        queries[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[n] = round(time.perf_counter() - t0, 3)
        print(f"{n}: {took[n]}", file=sys.stderr, flush=True)
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3),
                      "unit": "sec", "queries": took, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
