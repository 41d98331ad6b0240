"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The lineage tables the queries read are landed once first and timed on their own (`landing`);
every query is then timed from its call to its last row written to the no-op sink.
"""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from heddle.plans import catalog
from heddle.plans.registry import Inputs
from heddle.session import forget

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
LANDED = ["b_line", "b_entity", "b_transition", "b_property", "b_cell", "b_notebook", "b_execution", "b_guid_name", "b_rawref", "b_view_flow", "b_left", "b_right", "b_model_order"]
HEADLINE = [
    "impact_reach",
    "impact_by_object",
    "trace_paths",
    "gaps_scan",
    "coverage_model",
    "graph_longest_path",
    "trace_undirected_component",
    "ref_qualify",
    "code_table_access",
    "code_cell_features",
    "plan_access",
    "flow_view_flatten",
    "flow_dedup",
    "run_compare",
    "src_pipeline_activities",
    "src_delta_log_schema",
    "map_sim_levenshtein",
    "map_sim_dice",
    "edit_delete_bridge",
    "change_validate",
    "diff_versions",
    "sink_lineage_push_payload",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.driver.memory", "20g")
        .config("spark.sql.shuffle.partitions", str(2 * int(CPUS)))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or HEADLINE
    inputs = Inputs(spark, SF_DIR)
    times: dict[str, float] = {}
    start = time.time()
    for name in LANDED:
        inputs(name)
    times["landing"] = round(time.time() - start, 3)
    for name in wanted:
        start = time.time()
        catalog.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/"))}))
    forget(spark)
    spark.stop()


if __name__ == "__main__":
    main()
