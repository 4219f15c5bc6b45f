"""Headline timings: BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line.

Each query runs to a no-op sink, once to warm up and then twice; the better
of the two counts.  ``rows_per_sec`` gives clean and validate throughput.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from plumbline.plans import queries as registry  # noqa: E402
from plumbline.session import build_session  # noqa: E402

HEADLINE = {
    "clean": "cln_25_clean_table",
    "validate": "val_12_validate",
    "count_and_bounds": "met_13_date_bounds",
    "totals": "met_08_totals",
    "by_market": "met_07_revenue_by_market",
    "by_two_dimensions": "met_07_aggregate",
    "timeseries": "met_09_timeseries",
    "filtered": "met_12_membership",
    "drill": "met_15_drill",
    "rollup": "met_16_rollup",
    "funnel_product": "jn_04_funnel_product",
    "funnel_totals": "jn_05_funnel_totals",
    "period_over_period": "ins_06_period_over_period",
    "movers": "ins_09_movers",
    "benchmark": "ins_07_benchmark_vs_parent",
    "dictionary": "dic_01_measure_columns",
    "value_counts": "prf_01_value_counts",
    "duplicates": "ucl_06_count_duplicate_rows",
}


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(
        "plumbline-bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false", spark__driver__memory="12g",
        spark__sql__files__maxPartitionBytes="16m")
    spark.sparkContext.setLogLevel("OFF")
    registry.load()
    timings: dict[str, float] = {}
    for label, name in HEADLINE.items():
        fn, took = registry.QUERIES[name], []
        for _ in range(3):
            spark.catalog.clearCache()  # no run reads what another has kept
            start = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        timings[label] = round(min(took[1:]), 3)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    print(json.dumps({
        "metric": "headline queries, total of best warm runs",
        "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
        "sf": Path(sf_dir).name.removeprefix("sf"),
        "rows_per_sec": {k: round(lines / timings[k]) for k in ("clean", "validate")},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
