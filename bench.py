"""Times the recommendation pipeline and headline operators and prints one JSON line.

``end_to_end`` goes from the base tables to enriched recommendation lists (cleaning, indexing,
splitting, histories, vectors, retrieval, blending). The other entries are single operators on
the staged tables of that same pass. Every pass starts from nothing; the first one is a warm-up.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from shelfwise.plans import catalogue
from shelfwise.plans.world import World

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
# keep-last, user statistics, k-core, item features, interactions, histories, anchor sampling, top-K by
# both paths, history similarity, ranking metrics, blend sweep, names, density, borders, crawl state
OPERATORS = ["cln_4", "cln_9", "cln_14", "fea_8", "spl_6", "spl_14", "smp_5", "vec_11", "vec_11_blocks", "xfe_10",
             "evl_3", "evl_8", "map_3", "map_15", "map_19", "log_2", "log_13"]


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def one_pass(spark: SparkSession, operators: list[str]) -> dict[str, float]:
    World.forget()
    start = time.perf_counter()
    run(World.of(spark, SF_DIR).results)
    times = {"end_to_end": time.perf_counter() - start}
    w = World.of(spark, SF_DIR)
    for table in ("base", "labelled", "clustered", "points", "cells", "users"):
        getattr(w, table)                                           # inputs of the operators, not timed
    for key in operators:
        start = time.perf_counter()
        run(catalogue.QUERIES[key](spark, SF_DIR))
        times[key] = time.perf_counter() - start
    return times


def main() -> None:
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("shelfwise-bench")
             .config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC")
             # one partition per core already; merging small ones would leave cores idle on small data
             .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "16g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    operators = sys.argv[1:] or OPERATORS
    passes = []
    for i in range(RUNS + 1):
        passes.append(one_pass(spark, operators))
        print({k: round(v, 2) for k, v in passes[-1].items()}, file=sys.stderr, flush=True)
    times = {k: round(statistics.median(p[k] for p in passes[1:] or passes), 3) for k in passes[0]}
    print(json.dumps({"metric": "pipeline_and_operators_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(CPUS)}))


if __name__ == "__main__":
    main()
