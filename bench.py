"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

All queries run once to warm up, then each runs twice and the better time counts. Results go
to a sink that drops them, so every column is computed. Names given as arguments select
other queries, ``all`` selects every one.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from acceptance.queries import QUERIES  # noqa: E402


HEADLINE = (
    "accuracy_by_model",
    "row_correctness",
    "score_fanout",
    "score_fanout_pandas",
    "score_conversations",
    "envelope_roundtrip",
    "dead_letter_counts",
    "expanded_steps",
    "bound_inputs",
    "plan_results",
    "mixed_plan_outcomes",
    "reject_reasons",
    "accepted_answers",
    "coerce_label",
    "result_rows",
    "result_accuracy",
    "stream_results",
    "csv_corpus",
)


def seconds(fn, spark, sf_dir):
    start = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("verdict-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = QUERIES if sys.argv[1:] == ["all"] else sys.argv[1:] or HEADLINE
    for name in names:
        seconds(QUERIES[name], spark, sf_dir)
    times = {}
    for name in names:
        times[name] = round(min(seconds(QUERIES[name], spark, sf_dir) for _ in range(2)), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
