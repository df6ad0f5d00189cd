"""Point lookups, ordered listings and label search on the corpus tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import mentions_any
from strandline.sources.corpus import Corpus


def topic_node(corpus: Corpus, topic_id: int) -> DataFrame:
    return corpus.topic_nodes().filter(F.col("topic_id") == topic_id)


def vocabulary_entry(corpus: Corpus, term_id: int) -> DataFrame:
    return corpus.vocabulary().filter(F.col("id") == term_id)


def topic_terms(corpus: Corpus, topic_id: int) -> DataFrame:
    return corpus.topic_dictionary().filter(F.col("topic_id") == topic_id)


def first_nodes(corpus: Corpus, n: int = 20) -> DataFrame:
    """The first n topic nodes by id, heaviest term first."""
    return corpus.topic_nodes().orderBy("topic_id", F.desc("weight"), "term").limit(n)


def strongest_links(corpus: Corpus, n: int = 20) -> DataFrame:
    """The n most similar pairs of topics."""
    return corpus.similarity_links().orderBy(F.desc("sim"), "s", "t").limit(n)


def topics_labelled_with_any(
    corpus: Corpus, kind: str, keywords: Iterable[str], beta: float | None = None
) -> DataFrame:
    """Topics that have at least one of the keywords among the labels of a kind."""
    rows = corpus.labels()
    if beta is not None:
        rows = rows.filter(F.col("beta") == float(beta))
    return rows.filter(mentions_any(keywords, kind)).select(
        "beta", F.col("ti").alias("topic_id")
    )
