from __future__ import annotations

import pytest
from conftest import keys, pivot_row, values
from pyspark.sql import functions as F

from strandline import PivotSet
from strandline import schema as S

F_, P_ = S.FUTURE, S.PAST


def ids(pivots):
    return [k[2] for k in keys(pivots)]


# --- term filters -----------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(make_pivots):
    return make_pivots(
        pivot_row(F_, 0.5, 1, emerging=["gene", "cell"], stable=["virus"]),
        pivot_row(F_, 0.5, 2, decaying=["gene"], emerging=None),
        pivot_row(F_, 0.5, 3, specific=["gene"], stable=None),
        pivot_row(P_, 0.5, 4, stable=["gene"]),
        pivot_row(P_, 0.5, 5, stable=["Gene"], specific=["general"]),
        pivot_row(P_, 0.5, 6, stable=None, emerging=None, decaying=None, specific=None),
    )


def test_each_label_filter_reads_its_own_array(labelled):
    assert ids(labelled.emerge("gene")) == [1]
    assert ids(labelled.decay("gene")) == [2]
    assert ids(labelled.specific("gene")) == [3]
    assert ids(labelled.stable("gene")) == [4]


def test_contains_looks_into_all_arrays_past_nulls(labelled):
    assert ids(labelled.contains("gene")) == [1, 2, 3, 4]


def test_terms_match_exactly_and_case_sensitively(labelled):
    assert ids(labelled.contains("Gene")) == [5]
    assert ids(labelled.contains("gen")) == []


# --- range filters ------------------------------------------------------------


@pytest.fixture(scope="module")
def measured(make_pivots):
    return make_pivots(
        *[
            pivot_row(
                side,
                0.5,
                n + base,
                start_year=2000 + n,
                end_year=2004 + n,
                liveliness=n,
                split_degree=1.0 + n / 10,
                convergence_degree=1.0 + n / 10,
                relative_evolution=n / 10,
                pivot_evolution=n / 10,
            )
            for side, base in ((F_, 0), (P_, 100))
            for n in range(5)
        ],
        pivot_row(
            F_,
            0.5,
            50,
            start_year=None,
            end_year=None,
            liveliness=None,
            split_degree=None,
            convergence_degree=None,
            relative_evolution=None,
            pivot_evolution=None,
        ),
    )


@pytest.mark.parametrize(
    "method, value",
    [("live", 2), ("split", 1.2), ("conv", 1.2), ("revol", 0.2), ("pevol", 0.2)],
)
def test_range_filters_keep_the_bound_on_both_sides_and_drop_null(measured, method, value):
    assert ids(getattr(measured, method)(value, 0)) == [2, 3, 4, 102, 103, 104]
    assert ids(getattr(measured, method)(value, 1)) == [0, 1, 2, 100, 101, 102]
    # any restriction other than 0 is an upper bound
    assert ids(getattr(measured, method)(value, 7)) == [0, 1, 2, 100, 101, 102]


def test_period_bounds_start_from_below_and_end_from_above(measured):
    assert ids(measured.period(2003, 0)) == [3, 4, 103, 104]
    assert ids(measured.period(2005, 1)) == [0, 1, 100, 101]


def test_search_equals_the_chain_of_filters(measured, labelled):
    found = measured.search(
        period=(2001, 2008),
        live=(1, 4),
        split=(1.1, 1.4),
        conv=(1.0, 1.3),
        revol=(0.1, 0.4),
        pevol=(0.2, 0.4),
        side="past",
    )
    chain = (
        measured.past()
        .period(2001, 0)
        .period(2008, 1)
        .live(1, 0)
        .live(4, 1)
        .split(1.1, 0)
        .split(1.4, 1)
        .conv(1.0, 0)
        .conv(1.3, 1)
        .revol(0.1, 0)
        .revol(0.4, 1)
        .pevol(0.2, 0)
        .pevol(0.4, 1)
    )
    assert keys(found) == keys(chain) != []
    assert found.sides == chain.sides == {P_}
    assert ids(labelled.search(contains="gene", emerging="cell")) == [1]
    assert ids(labelled.search(stable="gene")) == [4]
    assert ids(labelled.search(decaying="gene")) == [2]
    assert ids(labelled.search(specific="gene")) == [3]
    assert keys(labelled.search()) == keys(labelled)


# --- sides and set operations ----------------------------------------------------

A, B, C = (pivot_row(F_, 0.5, i, stable=["x", None] if i == 2 else ["x"]) for i in (1, 2, 3))
D = pivot_row(P_, 0.5, 4)


def test_projections_split_the_set(make_pivots):
    both = make_pivots(A, B, D)
    assert ids(both.future()) == [1, 2] and both.future().sides == {F_}
    assert ids(both.past()) == [4] and both.past().sides == {P_}
    assert both.future().past().sides == frozenset() and keys(both.future().past()) == []
    assert keys(both.future().union(both.past())) == keys(both)


def test_union_is_a_bag_and_missing_sides_are_the_identity(make_pivots):
    both = make_pivots(A, B, D)
    union = both.union(both.future())
    assert ids(union) == [1, 1, 2, 2, 4]
    assert union.sides == {F_, P_}
    assert both.past().union(both.past()).sides == {P_}


def test_intersect_is_distinct_null_safe_and_needs_both_sides(make_pivots):
    with_null = pivot_row(F_, 0.5, 9, start_year=None, stable=None)
    left = make_pivots(A, A, B, D, with_null)
    right = make_pivots(A, A, C, D, with_null)
    assert ids(left.intersect(right)) == [1, 9, 4]
    one_sided = left.intersect(right.future())
    assert ids(one_sided) == [1, 9] and one_sided.sides == {F_}
    nothing = left.past().intersect(right.future())
    assert nothing.sides == frozenset() and keys(nothing) == []


def test_minus_deduplicates_shared_sides_only(make_pivots):
    left = make_pivots(A, A, B, B, D, D)
    # make_pivots has both sides, the past one empty: it is shared, so D is deduplicated too
    assert ids(left.minus(make_pivots(A))) == [2, 4]
    assert left.minus(make_pivots(A)).sides == {F_, P_}


def test_minus_passes_a_side_the_other_lacks(make_pivots):
    left = make_pivots(A, A, B, B, D, D)
    assert ids(left.minus(make_pivots(A).future())) == [2, 4, 4]
    assert ids(left.future().minus(left.past())) == [1, 1, 2, 2]
    assert left.future().minus(left).sides == {F_}


def test_intersect_is_double_minus(make_pivots):
    left, right = make_pivots(A, B, D), make_pivots(B, C, D)
    assert keys(left.intersect(right)) == keys(left.minus(left.minus(right)))


# --- path ----------------------------------------------------------------------------

# future graph of 1: 1 -> 11 -> 21, and 1 -> 12;  past graph of 21: 11, 1
PATHS = [
    (F_, 0.5, 1, 1, 11, 0, 1, 0.6),
    (F_, 0.5, 1, 11, 21, 1, 2, 0.7),
    (F_, 0.5, 1, 1, 12, 0, 1, 0.8),
    (F_, 0.5, 11, 11, 21, 1, 2, 0.7),
    (F_, 0.3, 2, 2, 11, 0, 1, 0.4),
    (P_, 0.5, 21, 21, 11, 2, 1, 0.7),
    (P_, 0.5, 21, 11, 1, 1, 0, 0.6),
    (P_, 0.5, 11, 11, 1, 1, 0, 0.6),
    # direction of time violated: never a path
    (F_, 0.5, 31, 31, 21, 2, 1, 0.9),
    (P_, 0.5, 5, 5, 11, 0, 1, 0.9),
]


@pytest.fixture(scope="module")
def linked(make_pivots):
    return make_pivots(
        *[pivot_row(F_, 0.5, i) for i in (1, 1, 11, 12, 21, 31)],
        pivot_row(F_, 0.3, 2),
        *[pivot_row(P_, 0.5, i) for i in (1, 5, 11, 21)],
        paths=PATHS,
    )


def only(pivots, *topic_ids):
    return pivots.where(F.col("topic_id").isin(*topic_ids))


def test_path_follows_the_future_and_keeps_copies(linked):
    reaching = linked.future().path(only(linked, 21).future())
    assert ids(reaching) == [1, 1, 11]
    assert reaching.sides == {F_}


def test_path_follows_the_past(linked):
    assert ids(linked.past().path(only(linked, 1).past())) == [11, 21]


def test_path_needs_the_same_threshold_and_time_order(linked):
    # 2 reaches 11 only at 0.3, where 11 is no pivot; 31 -> 21 and 5 -> 11 run backwards
    assert ids(linked.path(linked)) == [1, 1, 11, 11, 21]


def test_path_without_targets_is_present_but_empty(linked):
    result = linked.path(only(linked, 999))
    assert keys(result) == [] and result.sides == {F_, P_}


def test_path_on_a_missing_side_is_missing(linked):
    assert linked.path(linked.future()).sides == {F_}
    assert linked.past().path(linked.future()).sides == frozenset()


def test_path_result_keeps_the_column_order(linked):
    result = linked.path(linked)
    assert result.rows.columns == S.PIVOT_COLUMNS
    assert keys(result.union(linked)) == sorted(keys(result) + keys(linked))
    assert keys(result.intersect(linked)) == sorted(set(keys(result)))


# --- ordering and reports ----------------------------------------------------------------


def test_sort_orders_each_side(measured):
    down = measured.where(F.col("liveliness").isNotNull()).sort("liveliness", "desc").rows
    got = [(r.direction, r.liveliness) for r in down.collect()]
    assert got == [(s, n) for s in (F_, P_) for n in (4, 3, 2, 1, 0)]
    up = measured.past().sort("pivot_evolution").rows
    assert [r.topic_id for r in up.collect()] == [100, 101, 102, 103, 104]
    assert [r.topic_id for r in measured.past().sort("topic_id", "x").rows.collect()][0] == 104


def test_show_takes_the_first_rows_of_each_side(measured):
    assert [r.topic_id for r in measured.show(2).collect()] == [0, 1, 100, 101]
    assert measured.show(None).count() == 11
    assert measured.future().past().show(3).count() == 0


def test_show_labels_is_distinct(make_pivots):
    pivots = make_pivots(A, A, B, D)
    assert pivots.show_labels(10).count() == 3
    assert pivots.show_labels(1).count() == 2
    assert pivots.show_labels(1).columns == ["direction", "beta", "topic_id", *S.LABEL_KINDS]


def test_topic_and_term_reports_count_a_topic_once_per_side(make_pivots):
    pivots = make_pivots(
        pivot_row(F_, 0.3, 1),
        pivot_row(F_, 0.5, 1),
        pivot_row(F_, 0.5, 2),
        pivot_row(P_, 0.5, 2),
        topic_dictionary=[(1, ["a", "b"]), (2, ["b"]), (3, ["c"])],
    )
    assert values(pivots.describe_topics(None)) == [
        (F_, 1, ("a", "b")),
        (F_, 2, ("b",)),
        (P_, 2, ("b",)),
    ]
    assert pivots.describe_topics(1).count() == 2
    terms = [tuple(r) for r in pivots.describe_terms().collect()]
    assert terms == [(F_, "b", 2), (F_, "a", 1), (P_, "b", 1)]


def test_describe_gives_typed_summary_rows(measured):
    rows = {
        (r.direction, r.metric): r for r in measured.describe("liveliness", "stable").collect()
    }
    assert set(rows) == {(F_, "liveliness"), (P_, "liveliness")}  # arrays have no summary
    future = rows[(F_, "liveliness")]
    assert (future["count"], future["mean"], future["min"], future["max"]) == (5, 2.0, 0.0, 4.0)
    assert future["stddev"] == pytest.approx(1.5811388)
    assert {r.metric for r in measured.describe().collect()} == set(S.METRICS)
    with pytest.raises(ValueError):
        measured.describe("stable")


def test_facets_skip_null_arrays_and_take_true_maxima(labelled, make_pivots):
    assert values(labelled.term_choices()) == [
        ("decaying", "gene"),
        ("emerging", "cell"),
        ("emerging", "gene"),
        ("specific", "gene"),
        ("specific", "general"),
        ("stable", "Gene"),
        ("stable", "gene"),
        ("stable", "virus"),
    ]
    assert [r.term for r in labelled.keyword_choices().collect()] == [
        "Gene",
        "cell",
        "gene",
        "general",
        "virus",
    ]
    two_sides = make_pivots(
        pivot_row(F_, 0.5, 1, start_year=2000, split_degree=1.5),
        pivot_row(F_, 0.5, 2, start_year=2001, split_degree=3.0),
        pivot_row(P_, 0.5, 3, start_year=2000, convergence_degree=2.0, end_year=2009),
    )
    assert tuple(two_sides.bounds().first()) == (1, 3.0, 2.0, 2000, 2009)
    assert tuple(two_sides.where(F.lit(False)).bounds().first()) == (0, 1.0, 1.0, None, None)


# --- algebraic properties on the derived corpus -----------------------------------------------


@pytest.fixture(scope="module")
def derived(spark, sf_dir):
    from strandline.plans.queries import corpus_of

    return PivotSet.load(corpus_of(spark, sf_dir))


def test_filters_commute(derived):
    one = derived.contains("red plate").live(2).period(1996)
    other = derived.period(1996).live(2).contains("red plate")
    assert keys(one) == keys(other) != []


def test_set_identities(derived):
    a, b = derived.live(2), derived.contains("small widget")
    assert keys(a.intersect(b)) == keys(b.intersect(a)) == keys(a.minus(a.minus(b))) != []
    assert keys(derived.future().union(derived.past())) == keys(derived)
    assert len(keys(a.union(b))) == len(keys(a)) + len(keys(b))


def test_path_result_is_a_subset(derived):
    reached = derived.path(derived.live(2))
    assert set(keys(reached)) < set(keys(derived))
    assert len(keys(reached)) == len(set(keys(reached)))


def test_a_missing_side_has_no_rows_whatever_was_passed(make_pivots):
    both = make_pivots(pivot_row("future", 0.5, 1), pivot_row("past", 0.5, 2))
    assert keys(PivotSet(both.corpus, both.rows, ["future"])) == [("future", 0.5, 1)]
    assert keys(PivotSet(both.corpus, both.rows, [])) == []


def test_describe_counts_nothing_on_an_empty_side(make_pivots):
    pivots = make_pivots(pivot_row("future", 0.5, 1, liveliness=3))
    rows = {r["direction"]: r for r in pivots.describe("liveliness").collect()}
    assert (rows["future"]["count"], rows["future"]["mean"]) == (1, 3.0)
    assert tuple(rows["past"])[2:] == (0, None, None, None, None)
    assert [r["direction"] for r in pivots.future().describe("liveliness").collect()] == ["future"]


def test_close_thresholds_stay_apart(make_pivots):
    a, b = 0.3000001, 0.3000004
    rows = [pivot_row("future", beta, t) for beta in (a, b) for t in (1, 2)]
    pivots = make_pivots(*rows, paths=[("future", a, 1, 1, 2, 0, 1, 0.9)], labels=[(a, 2, ["x"], [], [], []), (b, 2, ["y"], [], [], [])])
    assert keys(pivots.path(pivots)) == [("future", a, 1)]
    edges = pivots.graphs().edges().collect()
    assert [(e["beta"], e["source"], e["target"]) for e in edges] == [(a, 1, 2)], "bit-equal"
    assert [(r["beta"], list(r["stable"])) for r in pivots.graphs().nodes().collect()] == [(a, ["x"])]
