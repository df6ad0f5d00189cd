"""Temp views for label analysis in SQL, under the column names of exported files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline import schema as S
from strandline.operators import terms
from strandline.sources.corpus import Corpus


def _stored(df: DataFrame, names: dict[str, str]) -> DataFrame:
    kept = {c: n for c, n in names.items() if c in df.columns}
    extra = [c for c in df.columns if c not in names]
    return df.select(*[F.col(c).alias(n) for c, n in kept.items()], *extra)


def register_views(
    spark: SparkSession,
    corpus: Corpus,
    prefix: str = "",
    top: int = terms.TOP,
    beta: float | None = None,
) -> list[str]:
    """Create (lazy) views over the corpus and the two term reports; returns their names.

    With ``beta`` the labels are those of one threshold, a row per topic.
    """
    labels = corpus.labels()
    if beta is not None:
        labels = labels.filter(F.col("beta") == F.lit(float(beta)))
    periods = terms.topic_periods(corpus).withColumnRenamed("topic_id", "idTopic")
    views = {
        S.VIEW_TOPIC_NODES: _stored(corpus.topic_nodes(), S.EXPORTED_TOPIC_NODES),
        S.VIEW_TOPIC_DICTIONARY: _stored(
            corpus.topic_dictionary(), S.EXPORTED_TOPIC_DICTIONARY
        ),
        S.VIEW_LABELS: _stored(labels, S.EXPORTED_LABELS),
        S.VIEW_TOPIC_PERIOD: periods,
        S.VIEW_FREQUENT: terms.term_frequency(corpus, top),
        S.VIEW_PER_PERIOD: terms.label_per_period(corpus, top),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in views]
