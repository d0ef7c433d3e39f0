"""Times headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from larkspur import catalog_queries

HEADLINES = ("join_hash", "join_merge", "join_4way", "join_many_to_many", "agg_group", "agg_over_join", "top_n", "top_n_agg", "sort_ordinal_alias", "filter_cmp_all", "filter_or_not", "range_propagation", "stats_hist_equidepth")


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    known, seconds = catalog_queries.queries(), {}
    for name in HEADLINES:
        known[name](spark, folder).write.format("noop").mode("overwrite").save()  # compiles code and warms the cache of files
        began = time.perf_counter()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 4)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
