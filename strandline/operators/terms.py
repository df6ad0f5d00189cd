"""Term frequencies over topics and periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.sources.corpus import Corpus

TOP = 50
PERIOD_YEARS = 2
# A top-k list up to this length is small by construction and may be broadcast.
BROADCAST_ROWS = 10_000


def period_label(start_year: int) -> str:
    return f"{start_year}-{start_year + PERIOD_YEARS}"


def topic_periods(corpus: Corpus) -> DataFrame:
    """Distinct (topic_id, period)."""
    return corpus.topic_nodes().select("topic_id", "period").distinct()


def _topic_terms(corpus: Corpus) -> DataFrame:
    return corpus.topic_dictionary().select("topic_id", F.explode("terms").alias("term"))


def term_frequency(corpus: Corpus, top: int = TOP) -> DataFrame:
    """The ``top`` most frequent terms over all topics, with their rank.

    Ranking all terms would sort them in one partition.  The order (frequency,
    then term) is total, so the cut can come first: a distributed top-k, after
    which the rank window sees only ``top`` rows.
    """
    frequent = (
        _topic_terms(corpus)
        .groupBy("term")
        .agg(F.count("*").alias("freq"))
        .orderBy(F.desc("freq"), "term")
        .limit(top)
    )
    rank = F.rank().over(Window.orderBy(F.desc("freq"), "term"))
    return frequent.select("term", "freq", rank.alias("rank"))


def label_per_period(
    corpus: Corpus, top: int = TOP, periods: Sequence[str] | None = None
) -> DataFrame:
    """How many topics of each period use each of the ``top`` terms.

    The periods of a topic are gathered with one shuffle on the topic id, which the
    join then reuses; a topic has few distinct periods, and they are combined
    before the shuffle.  There is a row per topic, which compressed files make look
    small, so the join is asked to merge: a broadcast would pass them through the
    driver.  The top list is broadcast, so no term, however frequent, gathers its
    topics in one task.
    """
    nodes = corpus.topic_nodes()
    if periods is not None:
        nodes = nodes.filter(F.col("period").isin(*periods))
    periods_of = nodes.groupBy("topic_id").agg(
        F.collect_set(F.struct("period")).alias("periods")
    )
    frequent = term_frequency(corpus, top).select("term", "rank")
    if top <= BROADCAST_ROWS:
        frequent = F.broadcast(frequent)
    return (
        _topic_terms(corpus)
        .join(frequent, "term")
        .join(periods_of.hint("merge"), "topic_id")
        .select("rank", "term", F.inline("periods"))
        .groupBy("period", "rank", "term")
        .agg(F.count("*").alias("freq"))
        .orderBy("period", "rank")
    )


def terms_for_period(corpus: Corpus, start_year: int, n: int, top: int = TOP) -> DataFrame:
    """The first ``n`` terms, by overall rank, of the period that starts in a year."""
    return (
        label_per_period(corpus, top, [period_label(start_year)])
        .orderBy("rank")
        .limit(n)
        .select("rank", "term", "freq")
    )


def compare_periods(corpus: Corpus, periods: Sequence[str], n: int, top: int = TOP) -> DataFrame:
    """The first ``n`` terms, by overall rank, of each of the periods."""
    by_rank = Window.partitionBy("period").orderBy("rank")
    return (
        label_per_period(corpus, top, periods)
        .withColumn("place", F.row_number().over(by_rank))
        .filter(F.col("place") <= n)
        .select("period", "place", "rank", "term", "freq")
    )


def period_list(corpus: Corpus) -> DataFrame:
    """Period labels in order, with their ordinals."""
    return corpus.periods().orderBy("period")
