"""One key holding most rows: AQE must split its partition, results stay whole."""

from __future__ import annotations

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from strandline import PivotSet
from strandline import schema as S
from strandline.operators import graphs

F_ = S.FUTURE
N = 60_000

# Thresholds low enough for a small test to count as skewed; no broadcast joins.
SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.shuffle.partitions": "16",
}


@contextmanager
def settings(spark, values):
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def mostly(key: int):
    """Two thirds of the rows have this key, the others one each."""
    return F.when(F.col("id") % 3 > 0, key).otherwise(F.col("id")).cast("long")


def stored(spark, df, name):
    """As a table of several files, so that a hot partition has several map outputs."""
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/{name}"
    df.repartition(16).write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


@pytest.fixture(scope="module")
def paths(spark):
    rows = spark.range(N).select(
        F.lit(F_).alias("direction"),
        F.lit(0.5).alias("beta"),
        mostly(1).alias("ti"),
        F.lit(1).cast("long").alias("tj"),
        (F.col("id") + N).alias("tk"),
        F.lit(0).alias("pj"),
        F.lit(1).alias("pk"),
        (F.col("id") / (2 * N) + 0.5).alias("sim"),
    )
    return stored(spark, rows, "skew_paths")


@pytest.fixture(scope="module")
def pivots(spark):
    """Two thirds of the rows are copies of one pivot."""
    rows = spark.range(N).select(
        F.lit(F_).alias("direction"),
        F.lit(0.5).alias("beta"),
        mostly(1).alias("topic_id"),
        *[
            F.lit(None).cast(field.dataType).alias(field.name)
            for field in S.PIVOTS.fields[3:]
        ],
    )
    return stored(spark, rows, "skew_pivots")


def executed_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_hot_root_is_split(spark, make_corpus, paths, pivots):
    corpus = make_corpus()
    corpus._opened["paths"] = paths
    with settings(spark, SMALL):
        edges = graphs.PivotGraphs(corpus, pivots).edges()
        assert len(edges.collect()) == N
        assert "skew=true" in executed_plan(edges)


def test_copies_of_a_pivot_are_split_in_path(spark, make_corpus, paths, pivots):
    corpus = make_corpus()
    corpus._opened["paths"] = paths
    mine = PivotSet(corpus, pivots)
    target = PivotSet(corpus, pivots.limit(1).withColumn("topic_id", F.lit(N + 1).cast("long")))
    with settings(spark, SMALL):
        kept = mine.path(target).rows
        # the only path to N + 1 starts at the hot root
        assert len(kept.collect()) == 2 * N // 3
        assert "skew=true" in executed_plan(kept)


def test_a_topic_reached_by_most_graphs_is_split_in_path(spark, make_corpus, paths, pivots):
    corpus = make_corpus()
    turned = paths.select(
        "direction", "beta", F.col("tk").alias("ti"), "tj", F.col("ti").alias("tk"), "pj", "pk", "sim"
    )
    backwards = turned.withColumn("direction", F.lit(S.PAST))
    corpus._opened["paths"] = backwards
    past = pivots.withColumn("direction", F.lit(S.PAST))
    mine = PivotSet(corpus, past.withColumn("topic_id", F.col("topic_id") + N).distinct())
    with settings(spark, SMALL):
        kept = mine.path(PivotSet(corpus, past)).rows
        assert kept.count() == mine.rows.count()
        kept = mine.path(PivotSet(corpus, past)).rows
        kept.collect()
        assert "skew=true" in executed_plan(kept)


def test_copies_are_combined_before_the_shuffle_of_set_operations(spark, make_corpus, pivots):
    corpus = make_corpus()
    mine = PivotSet(corpus, pivots)
    # the multiples of three, and the hot key 1
    assert mine.intersect(mine).rows.count() == N // 3 + 1
    assert mine.minus(mine).rows.count() == 0
    plan = executed_plan(mine.minus(mine.live(1)).rows)
    assert "Join" not in plan and plan.count("Exchange") == 1
