"""The registered queries: ``name -> f(spark, sf_dir) -> DataFrame``.

Every query runs over the whole corpus derived from the tables in ``sf_dir``.
Arrays leave a query as one comma-separated string and doubles rounded to six
places, so that results can be compared by value with another engine.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from strandline.functions import joined
from strandline.functions.columns import AT_LEAST, AT_MOST
from strandline.operators import PivotSet, graphs, lookups, terms
from strandline.operators.colocated import ColocatedEdges, ColocatedGraphs
from strandline.operators.label_index import LabelIndex
from strandline.operators.summaries import PivotSummaries
from strandline.operators.term_counts import TermCounts
from strandline.plans import derive
from strandline.plans.export import export_corpus
from strandline.plans.views import register_views
from strandline.session import tune
from strandline.sources.corpus import Corpus
from strandline.sources.readers import ExportedLayout, open_exported

Query = Callable[[SparkSession, str], DataFrame]

# Arguments of the queries; the oracle uses the same values.
TERM, OTHER_TERM = "red plate", "small widget"
SEARCH_TERMS = ("red plate", "small widget", "blue bolt", "hot gear", "new ring")
SEARCH_BETA = 0.3
# first period, suppliers 0, 1, 4; second and third period, suppliers 2 and 3
TOPIC_IDS = (1, 13, 42, 10_000_000_000_021, 20_000_000_000_034)
NODE_ID, VOCABULARY_ID = 13, 3
START_YEAR, PERIODS = 1996, ("1995-1997", "1997-1999")
TOP_ROWS, TOP_TERMS = 20, 10
TOPICS_PER_PERIOD = 20

_corpora: dict[tuple[str, str], derive.DerivedCorpus] = {}
_lock = threading.Lock()


def corpus_of(spark: SparkSession, sf_dir: str) -> derive.DerivedCorpus:
    """The corpus of a data directory, derived once per application."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    with _lock:
        if key not in _corpora:
            tune(spark)
            _corpora[key] = derive.DerivedCorpus(spark, key[1])
        return _corpora[key]


def flat(df: DataFrame) -> DataFrame:
    def plain(field):
        if isinstance(field.dataType, ArrayType):
            return joined(field.name).alias(field.name)
        if isinstance(field.dataType, DoubleType):
            return F.round(field.name, 6).alias(field.name)
        return F.col(field.name)

    return df.select(*[plain(field) for field in df.schema.fields])


def _on_corpus(build: Callable[[derive.DerivedCorpus], DataFrame]) -> Query:
    return lambda spark, sf_dir: flat(build(corpus_of(spark, sf_dir)))


def _on_pivots(build: Callable[[PivotSet], PivotSet | DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = build(PivotSet.load(corpus_of(spark, sf_dir)))
        return flat(result.rows if isinstance(result, PivotSet) else result)

    return run


def _on_graphs(build: Callable[[graphs.PivotGraphs], DataFrame]) -> Query:
    return _on_pivots(lambda pivots: build(pivots.graphs()))


def _on_selected(build: Callable[[graphs.PivotGraphs], DataFrame]) -> Query:
    """Graphs of a selected set of pivots only."""
    return _on_pivots(lambda pivots: build(pivots.emerge(TERM).graphs()))


def _on_every_topic(build: Callable[[graphs.PivotGraphs], DataFrame]) -> Query:
    """Graphs rooted in every topic at every threshold, linked or not."""

    def run(corpus: derive.DerivedCorpus) -> DataFrame:
        thresholds = F.array(*[F.lit(beta) for beta in derive.BETAS])
        root_rows = corpus.topic_dictionary().select("topic_id", F.explode(thresholds).alias("beta"))
        return build(graphs.PivotGraphs(corpus, root_rows))

    return _on_corpus(run)


_exported_tables: set[tuple[str, str, str]] = set()


def _exported(fmt: str, table: str) -> Query:
    """Read a table back from a copy in the exported layout, written once per corpus."""

    def run(corpus: derive.DerivedCorpus) -> DataFrame:
        layout = ExportedLayout(
            root=corpus.workspace.path(f"exported_{fmt}_{table}"),
            betas=derive.BETAS,
            topics_per_period=TOPICS_PER_PERIOD,
            fmt=fmt,
        )
        with _lock:
            key = (corpus.workspace.root, fmt, table)
            if key not in _exported_tables:
                export_corpus(corpus, layout, [table])
                _exported_tables.add(key)
        return open_exported(corpus.spark, layout).table(table)

    return _on_corpus(run)


_indexes: dict[tuple[str, str], LabelIndex] = {}


def index_of(corpus: derive.DerivedCorpus, table: str) -> LabelIndex:
    """The label index of a table, written once per corpus."""
    with _lock:
        key = (corpus.workspace.root, table)
        if key not in _indexes:
            id_column = "ti" if table == "labels" else "topic_id"
            _indexes[key] = LabelIndex.build(corpus.table(table), corpus.workspace, f"index_{table}", id_column)
        return _indexes[key]


def _on_index(table: str, build: Callable[[LabelIndex], DataFrame]) -> Query:
    return _on_corpus(lambda corpus: build(index_of(corpus, table)))


_kept: dict[tuple[str, str], object] = {}


def _once(corpus: derive.DerivedCorpus, name: str, build: Callable[[], object]):
    """What ``build`` writes for a corpus, written once."""
    with _lock:
        key = (corpus.workspace.root, name)
        if key not in _kept:
            _kept[key] = build()
        return _kept[key]


def _on_colocated(build: Callable[[graphs.PivotGraphs], DataFrame], term: str | None = TERM) -> Query:
    """Graphs of the pivots with an emerging term, or of all, from co-located edges."""

    def run(corpus: derive.DerivedCorpus) -> DataFrame:
        stored = _once(corpus, "colocated", lambda: ColocatedEdges.build(corpus, corpus.workspace))
        pivots = PivotSet.load(corpus)
        return build(ColocatedGraphs(corpus, (pivots.emerge(term) if term else pivots).rows, stored))

    return _on_corpus(run)


def _period_by_period(corpus: derive.DerivedCorpus) -> TermCounts:
    """Term counts, appended in the order of the periods (one for each calendar window)."""
    stored = TermCounts(corpus.spark, corpus.workspace.path("term_counts"))
    for period in corpus.periods().orderBy("period").collect():
        nodes = corpus.topic_nodes().filter(F.col("period") == period["period"])
        # a derived topic belongs to one period
        mine = corpus.topic_dictionary().join(nodes.select("topic_id").distinct(), "topic_id", "left_semi")
        stored.append(period["period"], Corpus.of(topic_nodes=nodes, topic_dictionary=mine))
    return stored


def _on_term_counts(build: Callable[[TermCounts], DataFrame]) -> Query:
    return _on_corpus(lambda c: build(_once(c, "term_counts", lambda: _period_by_period(c))))


def _on_summaries(build: Callable[[PivotSummaries], DataFrame]) -> Query:
    def run(corpus: derive.DerivedCorpus) -> DataFrame:
        rows = index_of(corpus, "pivots").rows
        return build(_once(corpus, "summaries", lambda: PivotSummaries.build(rows, corpus.workspace, "pivot_summaries")))

    return _on_corpus(run)


def _label_search_edges(corpus: derive.DerivedCorpus) -> DataFrame:
    found = lookups.topics_labelled_with_any(corpus, "emerging", SEARCH_TERMS, SEARCH_BETA)
    return graphs.subgraphs_of(corpus.paths(SEARCH_BETA), found)


def _label_search_all(corpus: derive.DerivedCorpus) -> DataFrame:
    """Graphs of the labelled topics, each at the thresholds at which it has the label."""
    found = lookups.topics_labelled_with_any(corpus, "emerging", SEARCH_TERMS)
    return graphs.subgraphs_of(corpus.paths(), found)


def _sql_labels_of_threshold(corpus: derive.DerivedCorpus) -> DataFrame:
    register_views(corpus.spark, corpus, prefix="strandline_one_", beta=SEARCH_BETA)
    return corpus.spark.sql("SELECT Ti AS ti, stable, emerging, decaying, specific FROM strandline_one_labels")


def _in_order(p: PivotSet, column: str, order: str) -> DataFrame:
    """The first rows of each side, numbered as they come out of the sort."""
    sides = []
    for side in ("future", "past"):
        first = (p.future() if side == "future" else p.past()).sort(column, order).rows.limit(TOP_ROWS)
        numbered = first.withColumn("place", F.monotonically_increasing_id() + 1)
        sides.append(numbered.select("direction", "place", "beta", "topic_id", column))
    return sides[0].unionByName(sides[1])


def _terms_in_order(df: DataFrame) -> DataFrame:
    return df.withColumn("terms", joined("terms", stored_order=True))


def _sql_period_terms(corpus: derive.DerivedCorpus) -> DataFrame:
    register_views(corpus.spark, corpus, prefix="strandline_")
    return corpus.spark.sql(
        "SELECT period, rank, term, freq FROM strandline_labelPerPeriod"
        f" WHERE period = '{terms.period_label(START_YEAR)}' ORDER BY rank"
    )


def queries() -> dict[str, Query]:
    return {
        # sources
        "pivots_load": _on_pivots(lambda p: p),
        "paths_scan": _on_corpus(lambda c: c.paths(0.5)),
        "src_json": _exported("json", "pivots"),
        "src_json_paths": _exported("json", "paths"),
        "src_json_labels": _exported("json", "labels"),
        "src_parquet": _exported("parquet", "pivots"),
        **{
            f"src_{fmt}_{table}": _exported(fmt, table)
            for fmt in ("json", "parquet")
            for table in ("topic_nodes", "topic_dictionary", "vocabulary", "similarity_links", "individuals")
        },
        "links_top": _on_corpus(lambda c: lookups.strongest_links(c, TOP_ROWS)),
        # table filters
        "node_lookup": _on_corpus(lambda c: lookups.topic_node(c, NODE_ID)),
        "vocab_lookup": _on_corpus(lambda c: lookups.vocabulary_entry(c, VOCABULARY_ID)),
        "topic_lookup": _on_corpus(lambda c: lookups.topic_terms(c, NODE_ID)),
        "topic_lookup_ordered": _on_corpus(lambda c: _terms_in_order(lookups.topic_terms(c, NODE_ID))),
        "nodes_top": _on_corpus(lambda c: lookups.first_nodes(c, TOP_ROWS)),
        "labels_any_emerging": _on_corpus(
            lambda c: lookups.topics_labelled_with_any(c, "emerging", SEARCH_TERMS)
        ),
        # the same searches through the label index
        "ix_any_emerging": _on_index(
            "labels", lambda i: i.ids(SEARCH_TERMS, ["emerging"]).select("beta", F.col("ti").alias("topic_id"))
        ),
        "ix_emerge": _on_index("pivots", lambda i: i.rows_with(TERM, "emerging")),
        "ix_contains": _on_index("pivots", lambda i: i.rows_with(TERM)),
        "ix_all": _on_index("pivots", lambda i: i.rows_with_all(emerging=TERM, stable=OTHER_TERM)),
        "ix_counts": _on_index("pivots", lambda i: i.counts()),
        # pivot filters
        "f_emerge": _on_pivots(lambda p: p.emerge(TERM)),
        "f_decay": _on_pivots(lambda p: p.decay(TERM)),
        "f_stable": _on_pivots(lambda p: p.stable(TERM)),
        "f_specific": _on_pivots(lambda p: p.specific(TERM)),
        "f_contains": _on_pivots(lambda p: p.contains(TERM)),
        "f_period_from": _on_pivots(lambda p: p.period(1996, AT_LEAST)),
        "f_period_to": _on_pivots(lambda p: p.period(2000, AT_MOST)),
        "f_live": _on_pivots(lambda p: p.live(3, AT_LEAST)),
        "f_live_to": _on_pivots(lambda p: p.live(2, AT_MOST)),
        "f_split": _on_pivots(lambda p: p.split(1.2, AT_LEAST)),
        "f_split_to": _on_pivots(lambda p: p.split(1.5, AT_MOST)),
        "f_conv": _on_pivots(lambda p: p.conv(1.1, AT_LEAST)),
        "f_conv_to": _on_pivots(lambda p: p.conv(1.1, AT_MOST)),
        "f_revol": _on_pivots(lambda p: p.revol(0.5, AT_LEAST)),
        "f_revol_to": _on_pivots(lambda p: p.revol(0.4, AT_MOST)),
        "f_pevol": _on_pivots(lambda p: p.pevol(0.6, AT_LEAST)),
        "f_pevol_to": _on_pivots(lambda p: p.pevol(0.5, AT_MOST)),
        "search_all": _on_pivots(
            lambda p: p.search(
                contains=TERM,
                emerging=OTHER_TERM,
                period=(1995, 2000),
                side="future",
                live=(1, 3),
                split=(1.0, 3.0),
                conv=(1.0, 2.0),
                revol=(0.1, 0.7),
                pevol=(0.1, 0.8),
            )
        ),
        "search_kinds": _on_pivots(
            lambda p: p.search(stable=TERM, decaying=OTHER_TERM, period=(1995, 2001), live=(1, 9))
        ),
        "search_specific": _on_pivots(lambda p: p.search(specific=TERM, side="past")),
        # projection and set operations
        "proj_future": _on_pivots(lambda p: p.future()),
        "proj_past": _on_pivots(lambda p: p.past()),
        "set_union": _on_pivots(lambda p: p.contains(TERM).union(p.future().emerge(TERM))),
        "set_intersect": _on_pivots(lambda p: p.contains(TERM).intersect(p.contains(OTHER_TERM))),
        "set_minus": _on_pivots(lambda p: p.contains(TERM).minus(p.future().emerge(TERM))),
        "set_intersect_missing": _on_pivots(lambda p: p.contains(TERM).intersect(p.past())),
        "set_union_missing": _on_pivots(lambda p: p.past().contains(TERM).union(p.future().emerge(TERM))),
        # paths
        "path_future": _on_pivots(lambda p: p.future().path(p.future().emerge(OTHER_TERM))),
        "path_past": _on_pivots(lambda p: p.past().path(p.past().decay(OTHER_TERM))),
        "path_both": _on_pivots(lambda p: p.contains(TERM).path(p.live(2))),
        # ordering
        "sort_asc": _on_pivots(lambda p: p.sort("pivot_evolution")),
        "sort_desc": _on_pivots(lambda p: p.sort("liveliness", "desc")),
        "sort_asc_order": _on_pivots(lambda p: _in_order(p, "pivot_evolution", "asc")),
        "sort_desc_order": _on_pivots(lambda p: _in_order(p, "liveliness", "desc")),
        # reports
        "rep_show": _on_pivots(lambda p: p.show(TOP_ROWS)),
        "rep_labels": _on_pivots(lambda p: p.show_labels(TOP_ROWS)),
        "rep_topics": _on_pivots(lambda p: p.emerge(TERM).describe_topics(n=None)),
        "rep_topics_ordered": _on_pivots(lambda p: _terms_in_order(p.emerge(TERM).describe_topics(n=None))),
        "rep_describe_empty": _on_pivots(lambda p: p.where(F.col("direction") == "past").describe()),
        "rep_terms": _on_pivots(lambda p: p.emerge(TERM).describe_terms()),
        "rep_describe": _on_pivots(lambda p: p.describe()),
        "rep_describe_cols": _on_pivots(
            lambda p: p.describe("start_year", "end_year", "split_degree", "stable")
        ),
        # term frequencies
        "topic_period": _on_corpus(terms.topic_periods),
        "period_list": _on_corpus(terms.period_list),
        "term_freq": _on_corpus(terms.term_frequency),
        "label_per_period": _on_corpus(terms.label_per_period),
        "period_terms": _on_corpus(lambda c: terms.terms_for_period(c, START_YEAR, TOP_ROWS)),
        "period_compare": _on_corpus(lambda c: terms.compare_periods(c, PERIODS, TOP_TERMS)),
        "sql_period_terms": _on_corpus(_sql_period_terms),
        "sql_labels_of_threshold": _on_corpus(_sql_labels_of_threshold),
        # the same from counts that grow with each period
        "inc_term_freq": _on_term_counts(lambda t: t.term_frequency()),
        "inc_label_per_period": _on_term_counts(lambda t: t.label_per_period()),
        "inc_period_terms": _on_term_counts(
            lambda t: t.label_per_period(periods=[terms.period_label(START_YEAR)]).limit(TOP_ROWS).select("rank", "term", "freq")
        ),
        # reports from stored summaries
        "sum_describe": _on_summaries(lambda s: s.describe()),
        "sum_describe_cols": _on_summaries(lambda s: s.describe("start_year", "end_year", "split_degree")),
        "sum_bounds": _on_summaries(lambda s: s.bounds()),
        # facets
        "facet_terms": _on_pivots(lambda p: p.term_choices()),
        "facet_keywords": _on_pivots(lambda p: p.keyword_choices()),
        "facet_bounds": _on_pivots(lambda p: p.bounds()),
        # graphs
        "g_roots": _on_pivots(lambda p: p.roots()),
        "g_topics_by_beta": _on_pivots(lambda p: graphs.topics_by_beta(p.roots())),
        "g_single_edges": _on_graphs(lambda g: g.edges()),
        "g_multi_edges": _on_graphs(lambda g: g.edges(merged=True)),
        "g_multi_topics": _on_corpus(lambda c: graphs.subgraphs_of(c.paths(), TOPIC_IDS)),
        "g_label_search": _on_corpus(_label_search_edges),
        "g_label_search_all": _on_corpus(_label_search_all),
        "g_sel_edges": _on_selected(lambda g: g.edges()),
        "g_sel_multi_edges": _on_selected(lambda g: g.edges(merged=True)),
        "g_sel_nodes": _on_selected(lambda g: g.nodes()),
        "g_sel_timeline_nodes": _on_selected(lambda g: g.timeline_nodes()),
        "g_sel_shape": _on_selected(lambda g: g.shapes()),
        # the same graphs from co-located edges
        "co_sel_edges": _on_colocated(lambda g: g.edges()),
        "co_sel_multi_edges": _on_colocated(lambda g: g.edges(merged=True)),
        "co_sel_nodes": _on_colocated(lambda g: g.nodes()),
        "co_sel_timeline_nodes": _on_colocated(lambda g: g.timeline_nodes()),
        "co_sel_shape": _on_colocated(lambda g: g.shapes()),
        "co_single_edges": _on_colocated(lambda g: g.edges(), term=None),
        "g_bidir": _on_graphs(lambda g: g.bidirectional_edges()),
        "g_multi_bidir": _on_graphs(lambda g: g.bidirectional_edges(merged=True)),
        "g_edge_style": _on_graphs(lambda g: g.styled_edges()),
        "g_nodes": _on_graphs(lambda g: g.nodes()),
        "g_multi_nodes": _on_graphs(lambda g: g.nodes(merged=True)),
        "g_timeline_nodes": _on_graphs(lambda g: g.timeline_nodes()),
        "g_multi_timeline_nodes": _on_graphs(lambda g: g.timeline_nodes(merged=True)),
        "g_timeline_edges": _on_graphs(lambda g: g.timeline_edges()),
        "g_multi_timeline_edges": _on_graphs(lambda g: g.timeline_edges(merged=True)),
        "g_graph_shape": _on_every_topic(lambda g: g.shapes()),
        "g_isolated": _on_every_topic(lambda g: g.isolated()),
    }
