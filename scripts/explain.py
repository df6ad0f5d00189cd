"""Prints the plan of registered queries: python scripts/explain.py sf_dir query ..."""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from strandline.plans.queries import queries  # noqa: E402
from strandline.session import build_session  # noqa: E402


def main() -> None:
    sf_dir, *names = sys.argv[1:]
    spark = build_session(
        master="local[8]",
        shuffle_partitions=8,
        **{"spark.ui.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in names:
        print("=====", name)
        queries()[name](spark, sf_dir).explain()


if __name__ == "__main__":
    main()
