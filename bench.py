"""Headline queries, timed after one warm-up run each; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local threads.
``fixture`` is a grouped sum over six rows in memory, through the session's gate:
the first run, after the others have warmed the engine, and the median of five more.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "flagship_grouped_sum", "filter_and_flatten", "case_conditional_sum", "group_by_multi", "spill_style_expanded_groupby", "count_distinct", "two_level_aggregate",
    "row_number_external_sort", "running_sum_rows", "top_k", "order_multi_key", "in_subquery_semi", "not_exists_anti", "star_join_revenue_by_nation", "union_distinct", "rollup", "cte_grouped_sum",
)


def fixture(spark: SparkSession) -> dict[str, float]:
    from tidelake.operators.session import LakeSession

    session, times = LakeSession(spark), []
    session.register("lake_table", [("A", 10), ("B", 20), ("A", 30), ("B", 40), ("B", 50), ("C", 60)], "category string, value int")
    for _ in range(6):
        start = time.perf_counter()
        session.execute("SELECT category, SUM(value) AS total FROM lake_table GROUP BY category ORDER BY category").frame.collect()
        times.append(1000 * (time.perf_counter() - start))
    return {"first_ms": round(times[0], 1), "warm_median_ms": round(statistics.median(times[1:]), 1)}


def main() -> None:
    from tidelake import queries as lake

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found, times = lake.queries(), {}
    for name in HEADLINE:
        for turn in range(3):
            start = time.perf_counter()
            found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            if turn:
                times[name] = min(took, times.get(name, took))
    total, small = round(sum(times.values()), 3), fixture(spark)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": {k: round(v, 4) for k, v in times.items()}, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "fixture": small}))
    spark.stop()


if __name__ == "__main__":
    main()
