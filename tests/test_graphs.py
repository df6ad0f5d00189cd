from __future__ import annotations

import pytest
from conftest import pivot_row, values
from pyspark.sql import functions as F

from strandline import schema as S
from strandline.functions import edge_strength, rounded_similarity
from strandline.operators import graphs, lookups

F_, P_ = S.FUTURE, S.PAST

# A diamond 1 -> {11, 12} -> 21 seen from 1 (future) and from 21 (past), and from
# 11 in both directions; 99 has no edges.
DIAMOND = [
    (F_, 0.5, 1, 1, 11, 0, 1, 0.6),
    (F_, 0.5, 1, 1, 12, 0, 1, 0.7),
    (F_, 0.5, 1, 11, 21, 1, 2, 0.8),
    (F_, 0.5, 1, 12, 21, 1, 2, 0.9),
    (F_, 0.5, 1, 12, 21, 1, 2, 0.9),  # stored twice
    (P_, 0.5, 21, 21, 11, 2, 1, 0.8),
    (P_, 0.5, 21, 21, 12, 2, 1, 0.9),
    (P_, 0.5, 21, 11, 1, 1, 0, 0.6),
    (P_, 0.5, 21, 12, 1, 1, 0, 0.7),
    (F_, 0.5, 11, 11, 21, 1, 2, 0.8),
    (P_, 0.5, 11, 11, 1, 1, 0, 0.6),
    (F_, 0.3, 7, 7, 17, 0, 1, 0.35),
]
NODES = [
    (1, "1998-2000", 1.0, "a"),
    (11, "2000-2002", 1.0, "b"),
    (21, "2002-2004", 1.0, "c"),
    (99, "2000-2002", 1.0, "d"),
]
LABELS = [
    (0.5, 1, ["a"], [], [], []),
    (0.5, 11, [], ["b"], [], []),
    (0.5, 21, [], [], ["c"], []),
    (0.3, 7, [], [], [], ["z"]),
]


@pytest.fixture(scope="module")
def corpus(make_corpus):
    return make_corpus(
        pivots=[
            pivot_row(F_, 0.5, 1),
            pivot_row(P_, 0.5, 21),
            pivot_row(F_, 0.5, 11),
            pivot_row(P_, 0.5, 11),
            pivot_row(F_, 0.5, 99),
        ],
        paths=DIAMOND,
        topic_nodes=NODES,
        labels=LABELS,
        individuals=[(0.5, 99, ["d", "e"], 1), (0.3, 99, ["d"], 1), (0.5, 98, ["q"], 0)],
    )


def of(corpus, *topic_ids, beta=0.5):
    rows = corpus.pivots().select("beta", "topic_id")
    wanted = rows.filter(F.col("topic_id").isin(*topic_ids) & (F.col("beta") == beta))
    return graphs.PivotGraphs(corpus, wanted)


def test_roots_are_distinct_over_sides(corpus):
    assert values(graphs.roots(corpus.pivots())) == [(0.5, i) for i in (1, 11, 21, 99)]


def test_edges_point_from_older_to_newer(corpus):
    assert values(of(corpus, 1).edges()) == [
        (0.5, 1, F_, 1, 11, 0.6),
        (0.5, 1, F_, 1, 12, 0.7),
        (0.5, 1, F_, 11, 21, 0.8),
        (0.5, 1, F_, 12, 21, 0.9),
    ]
    assert values(of(corpus, 21).edges()) == [
        (0.5, 21, P_, 1, 11, 0.6),
        (0.5, 21, P_, 1, 12, 0.7),
        (0.5, 21, P_, 11, 21, 0.8),
        (0.5, 21, P_, 12, 21, 0.9),
    ]


def test_a_root_found_on_one_side_shows_both_directions(corpus):
    assert values(of(corpus, 11).bidirectional_edges()) == [
        (0.5, 11, 1, 11, 0.6),
        (0.5, 11, 11, 21, 0.8),
    ]


def test_merged_graphs_collapse_shared_edges(corpus):
    both = of(corpus, 1, 21)
    assert both.edges().count() == 8
    assert both.edges(merged=True).count() == 8  # kept per direction
    assert values(both.bidirectional_edges(merged=True)) == [
        (0.5, 1, 11, 0.6),
        (0.5, 1, 12, 0.7),
        (0.5, 11, 21, 0.8),
        (0.5, 12, 21, 0.9),
    ]


def test_timeline_is_named_and_ordered(corpus):
    graph = of(corpus, 21)
    assert values(graph.timeline_nodes()) == [
        (0.5, 21, 0, "1998-2000"),
        (0.5, 21, 1, "2000-2002"),
        (0.5, 21, 2, "2002-2004"),
    ]
    assert values(graph.timeline_edges()) == [(0.5, 21, 0, 1), (0.5, 21, 1, 2)]
    assert values(of(corpus, 1, 11, 21).timeline_edges(merged=True)) == [(0.5, 0, 1), (0.5, 1, 2)]


def test_nodes_without_labels_have_no_row(corpus):
    assert values(of(corpus, 1).nodes()) == [
        (0.5, 1, 1, ("a",), (), (), ()),
        (0.5, 1, 11, (), ("b",), (), ()),
        (0.5, 1, 21, (), (), ("c",), ()),
    ]
    assert of(corpus, 1, 11, 21).nodes(merged=True).count() == 3


def test_shapes(corpus):
    assert values(of(corpus, 1, 11, 21, 99).shapes()) == [
        (0.5, 1, 4 + 1, 0, "future"),
        (0.5, 11, 1, 1, "both"),
        (0.5, 21, 0, 4, "past"),
        (0.5, 99, 0, 0, "none"),
    ]


def test_isolated_topics_are_found_per_topic(corpus):
    assert values(of(corpus, 1, 99).isolated()) == [(0.5, 99, ("d", "e"), 1, "2000-2002")]


def test_topics_by_beta_keeps_every_id_in_bounded_lists(spark):
    rows = [(0.5, i) for i in range(25)] + [(0.5, 3), (0.3, 7)]
    listed = graphs.topics_by_beta(spark.createDataFrame(rows, "beta double, topic_id long"), 10)
    assert values(listed) == [
        (0.3, 0, (7,)),
        (0.5, 0, tuple(range(10))),
        (0.5, 1, tuple(range(10, 20))),
        (0.5, 2, tuple(range(20, 25))),
    ]


def test_subgraphs_by_list_and_by_table(spark, corpus):
    listed = graphs.subgraphs_of(corpus.paths(0.5), [11, 7, 11])
    assert {tuple(r)[:5] for r in listed.collect()} == {
        (F_, 0.5, 11, 11, 21),
        (P_, 0.5, 11, 11, 1),
    }
    table = spark.createDataFrame([(11,), (7,), (11,)], "topic_id long")
    assert values(graphs.subgraphs_of(corpus.paths(0.5), table)) == values(listed)
    assert graphs.subgraphs_of(corpus.paths(0.5), table).columns == S.PATH_COLUMNS


def test_label_search_takes_any_of_the_terms(corpus):
    found = lookups.topics_labelled_with_any(corpus, "emerging", ["nope", "b"], 0.5)
    assert values(found) == [(0.5, 11)]


@pytest.mark.parametrize(
    "sim, rounded",
    [(0.285, 0.28), (0.575, 0.57), (0.125, 0.12), (0.135, 0.14), (0.5, 0.5), (1.0, 1.0)],
)
def test_rounding_agrees_with_numpy(spark, sim, rounded):
    import numpy as np

    got = spark.range(1).select(rounded_similarity(F.lit(sim)).alias("r")).first().r
    assert got == np.round(sim, 2) == rounded


def test_strength_spans_one_to_ten_and_is_null_at_one(spark):
    rows = [(0.5, 0.5), (1.0, 0.5), (0.75, 0.5), (1.0, 1.0)]
    df = spark.createDataFrame(rows, "sim double, beta double")
    got = [r.w for r in df.select(edge_strength(F.col("sim"), F.col("beta")).alias("w")).collect()]
    assert got == [1.0, 10.0, 5.5, None]


def test_selected_topics_bring_their_threshold(make_corpus, spark):
    paths = [("future", beta, ti, ti, 9, 0, 1, 0.9) for beta in (0.3, 0.5) for ti in (1, 2)]
    corpus = make_corpus(paths=paths)
    found = spark.createDataFrame([(0.3, 1), (0.5, 2), (0.3, 1)], "beta double, topic_id long")
    rows = graphs.subgraphs_of(corpus.paths(), found)
    assert sorted((r.beta, r.ti) for r in rows.collect()) == [(0.3, 1), (0.5, 2)]
    assert rows.columns == corpus.paths().columns
    assert graphs.subgraphs_of(corpus.paths(), found.select("topic_id")).count() == 4
