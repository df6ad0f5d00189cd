"""Node, edge and timeline tables of evolution graphs.

Everything is computed for all roots at once: a fixed number of joins, whatever
the number of pivots.  ``merged=False`` keeps one graph per (beta, root);
``merged=True`` overlays the graphs of all roots of a threshold.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline import schema as S
from strandline.functions import (
    distinct_keys,
    edge_strength,
    rounded_similarity,
    threshold_key,
)
from strandline.sources.corpus import Corpus


def roots(rows: DataFrame) -> DataFrame:
    """Distinct (beta, topic_id) over the sides present."""
    return rows.select("beta", "topic_id").distinct()


def topics_by_beta(root_rows: DataFrame, block: int = 1000) -> DataFrame:
    """Topic ids grouped by threshold, one list per block of consecutive ids.

    A threshold may have any number of topics, so its ids are not collected into
    a single row: a list holds at most ``block`` ids, and together the lists hold
    all of them.
    """
    id_block = F.expr(f"topic_id div {block}").alias("id_block")
    return (
        root_rows.select("beta", "topic_id")
        .distinct()
        .groupBy("beta", id_block)
        .agg(F.sort_array(F.collect_list("topic_id")).alias("topic_ids"))
    )


def subgraphs_of(paths: DataFrame, topics: Iterable[int] | DataFrame) -> DataFrame:
    """Path rows of the graphs rooted in the given topics.

    A DataFrame of ids (column ``topic_id``) becomes a semi-join, a Python list a
    literal IN; in both a repeated id does not repeat rows.  If the DataFrame has a
    ``beta``, a topic selects its graph at that threshold only.
    """
    if isinstance(topics, DataFrame):
        wanted, on = topics.select(F.col("topic_id").alias("ti")), ["ti"]
        if "beta" in topics.columns:
            wanted = topics.select(threshold_key().alias("threshold"), F.col("topic_id").alias("ti"))
            paths, on = paths.withColumn("threshold", threshold_key()), ["threshold", "ti"]
        found = paths.join(distinct_keys(wanted, *on), on, "left_semi")
        return found.select(*[c for c in paths.columns if c != "threshold"])
    return paths.filter(F.col("ti").isin(*topics))


def _as_double(df: DataFrame) -> DataFrame:
    return df.withColumn("beta", F.col("beta").cast("double"))


class PivotGraphs:
    """Graphs of the given roots: a DataFrame with ``beta`` and ``topic_id``.

    Edges are found by a semi-join on distinct roots, so copies of a root do not
    matter, and a root whose graph holds much of the table is split by AQE.  Inside,
    the threshold is an exact key; it leaves as the double it came as.
    """

    def __init__(self, corpus: Corpus, root_rows: DataFrame) -> None:
        self.corpus = corpus
        self.root_rows = root_rows.select(threshold_key().alias("beta"), "topic_id")

    def _paths(self) -> DataFrame:
        return self.corpus.paths().withColumn("beta", threshold_key())

    def _edges(self) -> DataFrame:
        wanted = self.root_rows.withColumnRenamed("topic_id", "ti")
        return self._paths().join(distinct_keys(wanted, "beta", "ti"), ["beta", "ti"], "left_semi")

    @staticmethod
    def _graph_key(merged: bool) -> list[Column]:
        return [F.col("beta")] if merged else [F.col("beta"), F.col("ti").alias("root")]

    @staticmethod
    def _oriented() -> list[Column]:
        """Every edge from the older to the newer topic."""
        future = F.col("direction") == S.FUTURE
        return [
            F.when(future, F.col("tj")).otherwise(F.col("tk")).alias("source"),
            F.when(future, F.col("tk")).otherwise(F.col("tj")).alias("target"),
            F.col("sim"),
        ]

    def edges(self, merged: bool = False) -> DataFrame:
        """Distinct edges of the future and of the past graphs."""
        key = self._graph_key(merged)
        return _as_double(self._edges().select(*key, "direction", *self._oriented()).distinct())

    def bidirectional_edges(self, merged: bool = False) -> DataFrame:
        """Distinct edges of both directions together (parallel edges collapse)."""
        key = self._graph_key(merged)
        return _as_double(self._edges().select(*key, *self._oriented()).distinct())

    def styled_edges(self, merged: bool = False) -> DataFrame:
        """Edges with the rounded similarity and a strength from 1 to 10."""
        return self.bidirectional_edges(merged).select(
            "*",
            rounded_similarity(F.col("sim")).alias("sim_rounded"),
            edge_strength(F.col("sim"), F.col("beta")).alias("strength"),
        )

    def nodes(self, merged: bool = False) -> DataFrame:
        """Topics of the graphs with their labels; a topic without labels has no row."""
        topics = (
            self._edges()
            .select(*self._graph_key(merged), F.explode(F.array("tj", "tk")).alias("topic_id"))
            .distinct()
        )
        label_rows = (
            self.corpus.labels()
            .withColumn("beta", threshold_key())
            .withColumnRenamed("ti", "topic_id")
        )
        labelled = topics.join(label_rows, ["beta", "topic_id"])
        return _as_double(labelled.select(*topics.columns, *S.LABEL_KINDS))

    def timeline_nodes(self, merged: bool = False) -> DataFrame:
        """Periods the graphs touch, with their labels."""
        ordinals = (
            self._edges()
            .select(*self._graph_key(merged), F.explode(F.array("pj", "pk")).alias("period_idx"))
            .distinct()
        )
        named = ordinals.join(self.corpus.periods(), "period_idx")
        return _as_double(named.select(*ordinals.columns, "period"))

    def timeline_edges(self, merged: bool = False) -> DataFrame:
        """Distinct pairs of linked periods, earlier one first."""
        pairs = self._edges().select(
            *self._graph_key(merged),
            F.least("pj", "pk").alias("from_idx"),
            F.greatest("pj", "pk").alias("to_idx"),
        )
        return _as_double(pairs.distinct())

    def shapes(self) -> DataFrame:
        """Per root: edge counts of both directions and which of them are non-empty."""

        def edges_in(direction: str) -> Column:
            return F.count_if(F.col("direction") == direction)

        counted = (
            self._edges()
            .groupBy("beta", F.col("ti").alias("topic_id"))
            .agg(edges_in(S.FUTURE).alias("n_future"), edges_in(S.PAST).alias("n_past"))
        )
        n_future = F.coalesce("n_future", F.lit(0).cast("bigint"))
        n_past = F.coalesce("n_past", F.lit(0).cast("bigint"))
        shape = (
            F.when((n_future > 0) & (n_past > 0), "both")
            .when(n_future > 0, S.FUTURE)
            .when(n_past > 0, S.PAST)
            .otherwise("none")
        )
        shaped = roots(self.root_rows).join(counted, ["beta", "topic_id"], "left").select(
            "beta",
            F.col("topic_id").alias("root"),
            n_future.alias("n_future"),
            n_past.alias("n_past"),
            shape.alias("shape"),
        )
        return _as_double(shaped)

    def isolated(self) -> DataFrame:
        """Roots without any edge: their terms and period instead of a graph."""
        linked = self._edges().select("beta", F.col("ti").alias("topic_id")).distinct()
        individuals = self.corpus.individuals().withColumn("beta", threshold_key())
        alone = (
            roots(self.root_rows)
            .join(linked, ["beta", "topic_id"], "left_anti")
            .join(individuals, ["beta", "topic_id"])
            .join(self.corpus.periods(), "period_idx")
        )
        return _as_double(alone.select("beta", "topic_id", "terms", "period_idx", "period"))
