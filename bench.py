"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (names).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from squallframe import catalog
from squallframe.session import build_session

HEADLINE = [
    "s1_track_scan", "p16_date_imputation", "j5_window_extract", "j7_coordinate_window", "j8_day_offset_join",
    "j10_interval_overlap", "j12_best_link", "j13_points_in_outlines", "j22_track_outline_km",
    "a2_zone_share", "a5_weighted_composite", "a14_conservative_allocation", "a15_cell_accumulation",
    "a19_quantiles", "w1_storm_steps", "w3_running_maximum", "w6_compound_hazard", "w10_candidate_grades",
    "w17_gaussian_blur", "w18_log_pchip", "w21_bilinear_sample", "q10_attribution_by_year", "q14_rain_agreement",
    "e2e_asset_layer", "q7_window_alignment", "j14_place_resolution",
]
# Not among them as it takes minutes: BENCH_QUERIES=e2e_loss_attribution times the whole attribution.


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", cpus, **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    registered = catalog.queries()
    registered["p1_basin_season_filter"](spark, folder).write.format("noop").mode("overwrite").save()  # warm the session
    times = {}
    for name in names:
        start = time.perf_counter()
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
