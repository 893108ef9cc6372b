"""Wall time of the headline queries. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = [
    "d01_dense_panel", "e02_endpoint_flow", "e16_joint_counts", "e17_conditional_information", "e17_information_by_unit",
    "e20_support", "e42_repeated_rows", "f12_spearman", "f13_bh_adjust", "g05_floor_pair", "h02_bootstrap_information",
    "h03_subsample_information", "h05_joint_bootstrap", "i01_temporal_blocks", "i02_series_permutation", "i04_matched_blocks",
    "i05_state_matched", "i06_local_null", "i12_long_panel_calibration", "j03_moran_local", "k01_state_mean",
    "k06_tune_state_mean", "k09_rolling_months", "k11_group_effects", "k14_domain_period_matrix", "e04_station_prepass",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from tallyfloor import catalog

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", str(max(8, int(cpus)))).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    chosen = sys.argv[1:] or HEADLINES
    times = {}
    for name in chosen:
        start = time.time()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
