from __future__ import annotations

import pytest
from conftest import values

from strandline.operators import lookups, terms
from strandline.operators.term_counts import counts_of
from strandline.plans.views import register_views


@pytest.fixture(scope="module")
def corpus(make_corpus):
    return make_corpus(
        topic_dictionary=[
            (1, ["gene", "cell"]),
            (2, ["gene", "virus", "acid"]),
            (3, ["cell", "acid"]),
            (4, []),
            (5, None),
        ],
        topic_nodes=[
            (1, "1998-2000", 3.0, "gene"),
            (1, "1998-2000", 2.0, "cell"),
            (2, "2000-2002", 5.0, "gene"),
            (2, "2000-2002", 5.0, "acid"),
            (2, "2002-2004", 1.0, "virus"),
            (3, "1998-2000", 1.0, "cell"),
        ],
        vocabulary=[(10, "gene"), (11, "cell")],
        similarity_links=[(1, 2, 0.5), (3, 2, 0.9), (1, 3, 0.9)],
    )


def test_ranks_break_ties_by_term_without_gaps(corpus):
    got = [tuple(r) for r in terms.term_frequency(corpus).collect()]
    assert got == [("acid", 2, 1), ("cell", 2, 2), ("gene", 2, 3), ("virus", 1, 4)]
    assert [r.term for r in terms.term_frequency(corpus, top=2).collect()] == ["acid", "cell"]


def test_label_per_period_counts_topic_period_pairs(corpus):
    got = [tuple(r) for r in terms.label_per_period(corpus).collect()]
    assert got == [
        ("1998-2000", 1, "acid", 1),
        ("1998-2000", 2, "cell", 2),
        ("1998-2000", 3, "gene", 1),
        ("2000-2002", 1, "acid", 1),
        ("2000-2002", 3, "gene", 1),
        ("2000-2002", 4, "virus", 1),
        ("2002-2004", 1, "acid", 1),
        ("2002-2004", 3, "gene", 1),
        ("2002-2004", 4, "virus", 1),
    ]
    assert {r.term for r in terms.label_per_period(corpus, top=1).collect()} == {"acid"}


def test_terms_of_one_period_in_rank_order(corpus):
    got = [tuple(r) for r in terms.terms_for_period(corpus, 1998, 2).collect()]
    assert got == [(1, "acid", 1), (2, "cell", 2)]
    assert terms.terms_for_period(corpus, 1900, 5).count() == 0


def test_compare_periods_numbers_terms_per_period(corpus):
    got = values(terms.compare_periods(corpus, ["2000-2002", "2002-2004"], 2))
    assert got == [
        ("2000-2002", 1, 1, "acid", 1),
        ("2000-2002", 2, 3, "gene", 1),
        ("2002-2004", 1, 1, "acid", 1),
        ("2002-2004", 2, 3, "gene", 1),
    ]


def test_periods(corpus):
    assert values(terms.topic_periods(corpus)) == [
        (1, "1998-2000"),
        (2, "2000-2002"),
        (2, "2002-2004"),
        (3, "1998-2000"),
    ]
    assert [tuple(r) for r in terms.period_list(corpus).collect()] == [
        ("1998-2000", 0),
        ("2000-2002", 1),
        ("2002-2004", 2),
    ]


def test_lookups(corpus):
    assert values(lookups.topic_node(corpus, 3)) == [(3, "1998-2000", 1.0, "cell")]
    assert values(lookups.vocabulary_entry(corpus, 11)) == [(11, "cell")]
    assert values(lookups.topic_terms(corpus, 2)) == [(2, ("gene", "virus", "acid"))]
    first = [(r.topic_id, r.term) for r in lookups.first_nodes(corpus, 4).collect()]
    assert first == [(1, "gene"), (1, "cell"), (2, "acid"), (2, "gene")]
    assert [tuple(r) for r in lookups.strongest_links(corpus, 2).collect()] == [
        (1, 3, 0.9),
        (3, 2, 0.9),
    ]


def test_views_answer_sql_under_stored_column_names(spark, corpus):
    names = register_views(spark, corpus, prefix="t_")
    assert "t_labelPerPeriod" in names
    # view names are case-insensitive
    got = spark.sql(
        "SELECT d.idTopic, size(topic) AS n, p.period"
        " FROM T_TOPICDICTIONARY_UNIQUE_10 d JOIN t_topicPeriod p ON p.idTopic = d.idTopic"
    )
    assert values(got) == [
        (1, 2, "1998-2000"),
        (2, 3, "2000-2002"),
        (2, 3, "2002-2004"),
        (3, 2, "1998-2000"),
    ]
    top = spark.sql("SELECT term FROM t_freqLabels ORDER BY rank LIMIT 1").first()
    assert top.term == "acid"


def test_periods_of_topics_are_not_broadcast(corpus):
    """There is a row per topic: only the list of top terms may pass through the driver."""
    plan = terms.label_per_period(corpus)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1 and plan.count("SortMergeJoin") == 1
    plan = counts_of(corpus)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
