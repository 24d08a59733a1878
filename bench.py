"""Seconds per headline query on the bundled tables; prints one JSON line.

BENCH_SF_DIR picks the data, BENCH_CPUS the local cores, BENCH_QUERIES a comma list
of query names (default: the headline set, ``all`` for every query)."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from junctura import catalog  # noqa: E402
from junctura.session import build_session  # noqa: E402

HEADLINE = [
    "flagship_rank_below_screen", "j1_nearest_within_buffer", "j1_nearest_refined_grid", "j3_radius_counts", "j10_decayed_neighbour_sums",
    "j11_a12_f12_merge_near_duplicates", "j12_point_in_polygon", "j25_k_nearest_sites", "j27_sites_along_paths", "a1_j14_p9_panel_counts",
    "a2_a3_a6_j17_history_counts", "a4_a7_a8_a9_w4_w5_trend", "a10_node_road_attributes", "a18_year_history", "a31_w6_w7_inspection_stats",
    "a36_f7_f8_intersection_labels", "j20_w10_traffic_legs", "j21_reports_by_site", "w1_rank_and_percentile", "e2_auprc_auroc", "e4_spearman",
    "e5_bootstrap_intervals", "e7_paired_delta", "e9_a38_fold_averages", "w9_j15_combined_list", "t2_m14_top_contributions",
    "k3_p16_feature_lines", "q4_a15_contract", "s5_p1_p8_state_extract", "m8_m4_out_of_fold_tweedie",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    catalog.load_all()
    pick = os.environ.get("BENCH_QUERIES", "")
    names = list(catalog.QUERIES) if pick == "all" else pick.split(",") if pick else HEADLINE
    spark = build_session(f"local[{cpus}]", cpus, app="junctura-bench", driver_memory=os.environ.get("BENCH_DRIVER_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["j12_point_in_polygon"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm the JVM
    times: dict[str, float] = {}
    for n in names:
        t = time.time()
        catalog.QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t, 3)
        print(f"{n}: {times[n]}", file=sys.stderr)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
