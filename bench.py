"""Times the headline queries and prints one JSON line."""

import importlib
import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "auroc_loss_vs_quality", "doc_min_k", "pair_unique_ngram_coverage", "pair_lcs_ratio", "reward_trio_profile", "dataset_summary", "grpo_advantage",
    "conversation_filter_reasons", "policy_loss", "p1_found", "p2_found", "p3_mix", "p4_found", "p5_found", "p6_ids", "p7_pack", "p8_found",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = importlib.import_module("__spark_entry__").queries()
    spark.range(1000).count()
    took = {}
    for name in HEADLINE:
        if name in queries:
            began = time.time()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf)}))


if __name__ == "__main__":
    main()
