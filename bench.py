"""Time the headline queries; prints one JSON line."""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import QUERIES  # noqa: E402

HEADLINE = (
    "k2_top_terms",
    "a3_describe_lengths",
    "a9_post_count_histogram",
    "w2_word_count_ecdf",
    "t7_clean_tokens",
    "f6_frequency_cutoff",
    "f11_mask_all_levels",
    "f12_mask_text",
    "a11_token_frequencies",
    "k3_top_pairs",
    "a17_mean_tfidf",
    "m1_fold_tfidf",
    "w1_cap_per_author",
    "w3_stratified_folds",
    "j4_author_fold_lookup",
    "m6_evaluate",
    "m4_grid",
)


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tamis-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # Sorts are spared where the built side of a join partition is known to be small.
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{path}/documents.parquet").selectExpr("sum(length(text))").collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(path.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
