"""Term statistics that are kept, and grow by what is appended.

A *batch* is a set of new topics, as a rule those of a new period: their nodes and
their terms.  Appending it counts its rows alone and writes one folder of counts.  The
reports add the counts of all batches up, which are as many rows as there are terms and
periods, not topics; they equal ``operators.terms`` over all topics together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.operators import terms
from strandline.sources.corpus import Corpus

# ``overall`` rows count a term's topics, the others its topics in one period.
_COUNTS = T.StructType(
    [
        T.StructField("overall", T.BooleanType()),
        T.StructField("period", T.StringType()),
        T.StructField("term", T.StringType()),
        T.StructField("freq", T.LongType()),
        T.StructField("batch", T.StringType()),
    ]
)


def counts_of(topics: Corpus) -> DataFrame:
    """(overall, period, term, freq) of a batch: its nodes and its dictionary.

    A topic in several periods counts in each, and once overall; one without a node
    counts overall only.  A term that a topic lists twice counts twice, as in
    ``terms.term_frequency``.
    """
    nodes = topics.topic_nodes()
    periods_of = nodes.groupBy("topic_id").agg(F.collect_set(F.struct("period")).alias("periods"))
    listed = topics.topic_dictionary().select("topic_id", F.explode("terms").alias("term"))
    overall = F.array(F.struct(F.lit(True).alias("overall"), F.lit(None).cast("string").alias("period")))
    within = F.transform("periods", lambda p: F.struct(F.lit(False).alias("overall"), p["period"].alias("period")))
    places = F.when(F.col("periods").isNull(), overall).otherwise(F.concat(overall, within))
    placed = listed.join(periods_of.hint("merge"), "topic_id", "left").select("term", F.inline(places))
    return placed.groupBy("overall", "period", "term").agg(F.count("*").alias("freq"))


class TermCounts:
    """Counts of all batches below ``root``, a folder all executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def append(self, batch: str, topics: Corpus) -> None:
        """Count a batch of topics that no other batch has.

        Neither the topics nor the counts of other batches are read.  The same batch again
        takes the place of its first version, so an append that failed is run again.
        """
        if not batch or any(c in batch for c in "/=\\"):
            raise ValueError(f"not a name for a batch: {batch!r}")
        counts_of(topics).write.mode("overwrite").parquet(f"{self.root}/batch={batch}")

    def counts(self) -> DataFrame:
        stored = self.spark.read.schema(_COUNTS).parquet(self.root)
        return stored.select("overall", "period", "term", "freq")

    def _added(self, rows: DataFrame, *keys: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.sum("freq").alias("freq"))

    def term_frequency(self, top: int = terms.TOP) -> DataFrame:
        """As ``terms.term_frequency``: the cut comes before the rank."""
        total = self._added(self.counts().filter("overall"), "term")
        frequent = total.orderBy(F.desc("freq"), "term").limit(top)
        rank = F.rank().over(Window.orderBy(F.desc("freq"), "term"))
        return frequent.select("term", "freq", rank.alias("rank"))

    def label_per_period(self, top: int = terms.TOP, periods: Sequence[str] | None = None) -> DataFrame:
        """As ``terms.label_per_period``, without the topics."""
        rows = self.counts().filter("NOT overall")
        if periods is not None:
            rows = rows.filter(F.col("period").isin(*periods))
        frequent = self.term_frequency(top).select("term", "rank")
        if top <= terms.BROADCAST_ROWS:
            frequent = F.broadcast(frequent)
        found = rows.join(frequent, "term")
        return self._added(found, "period", "rank", "term").orderBy("period", "rank")

    def compacted(self, root: str) -> TermCounts:
        """The same counts in a new folder, as one batch; this one stays as it is."""
        merged = TermCounts(self.spark, root)
        added = self._added(self.counts(), "overall", "period", "term")
        added.write.mode("overwrite").parquet(f"{merged.root}/batch=compacted")
        return merged
