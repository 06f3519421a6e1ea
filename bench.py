"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints
one JSON line. A query's time is that of its plan and of writing all its rows to
a sink that drops them. ``first`` has its first run, in which code is loaded and
compiled; ``queries`` the least of the three runs after that."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from blocksearch.queries import QUERIES

HEADLINE = ["search_topk", "topk_per_query", "preprocess_text", "blocks_dedup", "change_counts", "hash_embedding", "semantic_search", "vector_round4", "tree_flatten", "shard_index", "delete_by_key"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["vector_norms"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    first, took = {}, {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(round(time.perf_counter() - began, 3))
        first[name], took[name] = runs[0], min(runs[1:])
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "first": first, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
