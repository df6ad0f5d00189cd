"""Times the derivation of the corpus and the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Every plan is run to the end with the ``noop`` sink, so no result passes through
the driver.  The tables are built twice into separate folders and timed one by one
the second time (``build_*``); each query is run once to warm up and reported as the
median of three runs.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from strandline.plans.derive import DerivedCorpus
from strandline.plans.queries import corpus_of, queries
from strandline.session import build_session

BUILDS = (
    "topic_nodes",
    "topic_dictionary",
    "periods",
    "vocabulary",
    "similarity_links",
    "paths",
    "labels",
    "pivots",
    "individuals",
)
HEADLINE = (
    "term_freq",
    "topic_period",
    "label_per_period",
    "period_terms",
    "period_compare",
    "labels_any_emerging",
    "f_contains",
    "search_all",
    "set_union",
    "set_intersect",
    "set_minus",
    "path_future",
    "path_past",
    "path_both",
    "sort_desc",
    "rep_topics",
    "rep_terms",
    "rep_describe",
    "facet_terms",
    "facet_bounds",
    "g_roots",
    "g_topics_by_beta",
    "g_single_edges",
    "g_multi_edges",
    "g_edge_style",
    "g_nodes",
    "g_timeline_nodes",
    "g_graph_shape",
    "g_isolated",
)
RUNS = 3


def seconds(action: Callable[[], object]) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        app_name="strandline-bench",
        master=f"local[{cpus}]",
        shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
        **{"spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")

    took: dict[str, float] = {}
    # the second corpus is the one the queries read
    for corpus in (DerivedCorpus(spark, sf_dir), corpus_of(spark, sf_dir)):
        for table in BUILDS:
            took[f"build_{table}"] = seconds(lambda: corpus.table(table))

    registered = queries()
    for name in HEADLINE:

        def run(query=registered[name]) -> None:
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()

        run()
        took[name] = statistics.median(seconds(run) for _ in range(RUNS))

    print(
        json.dumps(
            {
                "metric": "corpus derivation plus headline queries, total seconds",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": {name: round(value, 3) for name, value in took.items()},
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
