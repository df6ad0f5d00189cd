"""Tables that are kept: co-located edges, counts of terms, summaries of pivots."""

from __future__ import annotations

import pytest
from conftest import pivot_row, values
from pyspark.sql import functions as F
from test_skew import settings

from strandline import Corpus, PivotSet
from strandline import schema as S
from strandline.operators import facets, graphs, terms
from strandline.operators.colocated import ColocatedEdges, ColocatedGraphs
from strandline.operators.summaries import PivotSummaries
from strandline.operators.term_counts import TermCounts, counts_of
from strandline.sources.workspace import Workspace

NO_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
BUCKETS, HOT = 8, 4000


# --- co-located edges ---------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark, make_corpus):
    """Root 1 has two thirds of the edges; an edge of it is there twice."""
    edges = [("future", 0.5, 1, 1, 10_000 + i, 0, 1, 0.6) for i in range(HOT)]
    edges += [("future", 0.5, i, i, i + 1, 0, 1, 0.7) for i in range(2, 2 + HOT // 4)]
    edges += [("past", 0.3, i, i, i - 1, 1, 0, 0.4) for i in range(2, 2 + HOT // 4)]
    edges += [edges[0], ("future", 0.5, None, 1, 2, 0, 1, 0.6), ("future", None, 7, 1, 2, 0, 1, 0.6)]
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/kept_paths"
    made = make_corpus(paths=edges, labels=[(0.5, 1, ["a"], [], [], None), (0.5, 3, [], ["b"], [], [])])
    made.paths().write.mode("overwrite").parquet(folder)
    made._opened["paths"] = spark.read.parquet(folder)
    return made


@pytest.fixture(scope="module")
def roots(spark):
    wanted = [(0.5, 1), (0.5, 3), (0.5, 3), (0.3, 3), (0.3, 4), (0.5, 999_999), (None, 7), (0.5, None)]
    return spark.createDataFrame(wanted, "beta double, topic_id long")


@pytest.fixture(scope="module", params=[500, 1_000_000], ids=["sliced", "whole"])
def stored(request, spark, corpus):
    return ColocatedEdges.build(corpus, Workspace(spark), buckets=BUCKETS, rows_per_slice=request.param)


@pytest.mark.parametrize("table", ["edges", "bidirectional_edges", "styled_edges", "nodes", "timeline_edges"])
@pytest.mark.parametrize("merged", [False, True])
def test_colocated_graphs_equal_the_others(corpus, roots, stored, table, merged):
    mine = getattr(ColocatedGraphs(corpus, roots, stored), table)(merged)
    other = getattr(graphs.PivotGraphs(corpus, roots), table)(merged)
    assert mine.columns == other.columns
    assert values(mine) == values(other) and mine.count() > 0


def test_colocated_shapes_count_copies(corpus, roots, stored):
    known = roots.dropna()
    shapes = ColocatedGraphs(corpus, known, stored).shapes()
    assert values(shapes) == values(graphs.PivotGraphs(corpus, known).shapes())
    assert shapes.filter("root = 1").first()["n_future"] == HOT + 1


def exchanges_over(plan: str, scan: str) -> int:
    """Exchanges between the scan and the first join above it (the lines of a plan go
    from the top down, and a child is further to the right)."""
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if scan in line)
    depth, count = lines[at].index("Scan"), 0
    for line in reversed(lines[:at]):
        place = len(line) - len(line.lstrip(" :+-*()0123456789"))
        if place >= depth:
            continue
        depth = place
        if "Join" in line:
            return count
        count += "Exchange" in line
    raise AssertionError("no join")


def test_the_edges_are_not_shuffled(spark, corpus, roots, stored):
    with settings(spark, {**NO_BROADCAST, "spark.sql.shuffle.partitions": str(BUCKETS), "spark.sql.adaptive.enabled": "false"}):
        mine = ColocatedGraphs(corpus, roots, stored)._edges()
        plan = mine._jdf.queryExecution().executedPlan().toString()
        other = graphs.PivotGraphs(corpus, roots)._edges()._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "SortMergeJoin" in plan
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "Bucketed: true" in line)
    assert exchanges_over(plan, scan.strip(" :+-*()0123456789")[:60]) == 0
    paths = next(line for line in other.splitlines() if "kept_paths" in line)
    assert exchanges_over(other, paths.strip(" :+-*()0123456789")[:60]) == 1


def test_a_hot_root_is_in_many_buckets(spark, corpus):
    sliced = ColocatedEdges.build(corpus, Workspace(spark), buckets=BUCKETS, rows_per_slice=200)
    assert values(sliced.sliced) == [("0.5", 1, (HOT + 1 + 199) // 200)]
    hot = sliced.edges.filter("ti = 1").groupBy(F.input_file_name()).count()
    per_file = [r["count"] for r in hot.collect()]
    assert len(per_file) == BUCKETS and max(per_file) < HOT // 2
    # a bucket is one file, whatever the number of tasks that wrote
    assert len(sliced.edges.inputFiles()) == BUCKETS


def test_colocated_edges_of_nothing(spark, make_corpus, roots):
    empty = ColocatedEdges.build(make_corpus(), Workspace(spark), buckets=2)
    assert ColocatedGraphs(make_corpus(), roots, empty).edges().count() == 0


def test_no_roots(corpus, roots, stored):
    assert ColocatedGraphs(corpus, roots.limit(0), stored).edges().count() == 0


# --- counts of terms ----------------------------------------------------------------

P1, P2, P3 = "1998-2000", "2000-2002", "2002-2004"
BATCHES = {
    "a": ([(1, P1, 3.0, "gene"), (1, P1, 2.0, "cell"), (2, P1, 5.0, "gene")], [(1, ["gene", "cell"]), (2, ["gene", "gene", None])]),
    "b": ([(3, P2, 1.0, "acid"), (3, P3, 1.0, "acid"), (4, None, 1.0, "acid")], [(3, ["acid", "cell"]), (4, ["acid"]), (5, []), (6, None)]),
    "c": ([(7, P2, 1.0, "virus")], [(7, ["virus", "gene"]), (8, ["virus"])]),
}


@pytest.fixture
def batches(make_corpus):
    return {k: make_corpus(topic_nodes=nodes, topic_dictionary=topics) for k, (nodes, topics) in BATCHES.items()}


def in_whole(make_corpus, names) -> Corpus:
    nodes = [row for k in names for row in BATCHES[k][0]]
    return make_corpus(topic_nodes=nodes, topic_dictionary=[row for k in names for row in BATCHES[k][1]])


def reports(source, module=None):
    if module:
        return values(module.term_frequency(source, 4)), values(module.label_per_period(source, 4)), values(module.label_per_period(source, 9, [P2]))
    return values(source.term_frequency(4)), values(source.label_per_period(4)), values(source.label_per_period(9, [P2]))


def test_appending_equals_counting_all(spark, make_corpus, batches):
    stored = TermCounts(spark, Workspace(spark).path("counts"))
    for n, name in enumerate(BATCHES, 1):
        stored.append(name, batches[name])
        assert reports(stored) == reports(in_whole(make_corpus, list(BATCHES)[:n]), terms)
    merged = stored.compacted(Workspace(spark).path("counts"))
    assert reports(merged) == reports(stored)
    assert merged.counts().count() == merged.counts().select("overall", "period", "term").distinct().count()


def test_a_batch_again_replaces_its_first_version(spark, make_corpus, batches):
    stored = TermCounts(spark, Workspace(spark).path("counts"))
    for name in ("a", "b", "a"):
        stored.append(name, batches[name])
    assert reports(stored) == reports(in_whole(make_corpus, "ab"), terms)
    with pytest.raises(ValueError, match="name"):
        stored.append("x/y", batches["a"])


def test_only_the_new_period_is_read(spark, batches):
    """Neither earlier batches' files nor their counts are inputs of an append."""
    folder = Workspace(spark)
    stored = TermCounts(spark, folder.path("counts"))
    stored.append("a", batches["a"])
    for name in ("topic_nodes", "topic_dictionary"):
        batches["b"].table(name).write.parquet(folder.path(f"b_{name}"))
    new = Corpus.of(**{name: spark.read.parquet(folder.path(f"b_{name}")) for name in ("topic_nodes", "topic_dictionary")})
    assert all("/b_topic_" in f for f in counts_of(new).inputFiles())
    before = set(stored.counts().inputFiles())
    stored.append("b", new)
    assert before < set(stored.counts().inputFiles())


def test_an_empty_batch(spark, make_corpus):
    stored = TermCounts(spark, Workspace(spark).path("counts"))
    stored.append("none", make_corpus())
    assert stored.term_frequency().count() == 0 and stored.label_per_period().count() == 0


# --- summaries ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def pivots(spark, make_corpus):
    rows = [
        pivot_row(
            ("future", "past")[i % 3 % 2], 0.5, i, start_year=1990 + i % 7, end_year=2000 + i % 11, liveliness=i % 5,
            split_degree=1e6 + i / 7, convergence_degree=None if i % 4 else 1.0 + i, relative_evolution=None,
        )
        for i in range(300)
    ]
    return make_corpus(pivots=[*rows, rows[3], pivot_row("future", 0.5, 301, start_year=None)])


def close(df):
    rows = [[round(v, 6) if isinstance(v, float) else v for v in r] for r in df.collect()]
    return sorted(rows, key=repr)


@pytest.mark.parametrize("parts", [1, 16])
def test_summaries_equal_a_full_pass(spark, pivots, parts):
    rows = pivots.pivots().repartition(parts, "topic_id").withColumn("part", F.spark_partition_id())
    stored = PivotSummaries.build(rows, Workspace(spark), "summaries")
    whole = PivotSet.load(pivots)
    assert close(stored.describe()) == close(whole.describe())
    assert close(stored.describe("start_year", "stable")) == close(whole.describe("start_year", "stable"))
    assert stored.describe().columns == whole.describe().columns and stored.describe().dtypes == whole.describe().dtypes
    assert close(stored.bounds()) == close(whole.bounds()) and stored.bounds().dtypes == whole.bounds().dtypes
    assert all("/summaries/" in f for report in (stored.describe(), stored.bounds()) for f in report.inputFiles())


def test_summaries_of_some_groups(spark, pivots):
    rows = pivots.pivots().withColumn("part", (F.col("topic_id") % 4).cast("int"))
    stored = PivotSummaries.build(rows, Workspace(spark), "summaries")
    some = PivotSet.load(Corpus.of(pivots=rows.filter("part IN (1, 2)").select(*S.PIVOT_COLUMNS)))
    assert close(stored.describe(parts=[1, 2])) == close(some.describe())
    assert close(stored.bounds([1, 2])) == close(facets.bounds(some.rows))
    with pytest.raises(ValueError, match="numeric"):
        stored.describe("stable")


def test_summaries_of_one_row_and_of_none(spark, make_corpus):
    for rows in ([pivot_row("past", 0.3, 1)], []):
        corpus = make_corpus(pivots=rows)
        stored = PivotSummaries.build(corpus.pivots().withColumn("part", F.lit(0)), Workspace(spark), "summaries")
        whole = PivotSet.load(corpus)
        assert close(stored.describe()) == close(whole.describe())
        assert close(stored.bounds()) == close(whole.bounds())
