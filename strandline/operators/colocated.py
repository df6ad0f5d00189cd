"""Graphs whose edges are stored where the join on their roots needs them.

The edges are a bucketed table on (threshold, root, slice), so selecting the graphs of
some roots shuffles the selected roots and never the edges, however often it is done.

A bucket is read by one task, and Spark does not split it as it splits a skewed
shuffle partition.  So a root with more edges than ``rows_per_slice`` is cut into
slices, which fall into different buckets; a small table says into how many.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline import schema as S
from strandline.functions import distinct_keys, threshold_key
from strandline.operators.graphs import PivotGraphs
from strandline.sources.corpus import Corpus
from strandline.sources.workspace import Workspace

_PLACE = ("beta", "ti", "slice")
_SLICED = T.StructType(
    [
        T.StructField("beta", T.StringType()),
        T.StructField("ti", T.LongType()),
        T.StructField("slices", T.LongType()),
    ]
)


@dataclass(frozen=True)
class ColocatedEdges:
    """``edges`` has the columns of the paths, the threshold as its exact key, and
    ``slice``; ``sliced`` has the roots with more than one slice."""

    edges: DataFrame
    sliced: DataFrame

    @classmethod
    def build(
        cls,
        corpus: Corpus,
        workspace: Workspace,
        name: str = "colocated",
        buckets: int | None = None,
        rows_per_slice: int = 1_000_000,
    ) -> ColocatedEdges:
        """Write the edges of a corpus in ``buckets`` (default: the session's number of
        shuffle partitions, which is sized for the largest shuffle).

        Edges with the same end points share a slice, and stay rows of their own.  A NULL
        threshold or root is in no graph, as in a join.  Roots with several slices are at
        most one for ``rows_per_slice`` edges; the join with them is left to Spark.
        """
        spark = workspace.spark
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        paths = corpus.paths().withColumn("beta", threshold_key())
        large = paths.groupBy("beta", "ti").agg(F.count("*").alias("n")).filter(F.col("n") > rows_per_slice)
        workspace.write(f"{name}_sliced", large.select("beta", "ti", F.ceil(F.col("n") / rows_per_slice).alias("slices")))
        sliced = workspace.read(f"{name}_sliced", _SLICED)
        piece = F.coalesce(F.pmod(F.xxhash64("direction", "tj", "tk"), F.col("slices")), F.lit(0).cast("bigint"))
        placed = paths.join(sliced, ["beta", "ti"], "left").select(*S.PATH_COLUMNS, piece.alias("slice"))
        # the catalog keeps how a table is bucketed; the name is this application's alone
        table = f"strandline_{uuid.uuid4().hex}"
        writer = placed.repartition(buckets, *_PLACE).write.bucketBy(buckets, *_PLACE).sortBy(*_PLACE)
        writer.option("path", workspace.path(f"{name}_edges")).format("parquet").saveAsTable(table)
        return cls(spark.table(table), sliced)

    def of_roots(self, wanted: DataFrame) -> DataFrame:
        """The edges of the graphs of (beta, ti), the threshold as its exact key; copies
        of a root do not repeat edges."""
        known = distinct_keys(wanted, "beta", "ti").join(self.sliced, ["beta", "ti"], "left")
        last = F.coalesce("slices", F.lit(1).cast("bigint")) - F.lit(1).cast("bigint")
        places = known.select("beta", "ti", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("slice"))
        return self.edges.join(places, list(_PLACE), "left_semi").select(*S.PATH_COLUMNS)


class ColocatedGraphs(PivotGraphs):
    """The graph tables of ``PivotGraphs``, from co-located edges."""

    def __init__(self, corpus: Corpus, root_rows: DataFrame, stored: ColocatedEdges) -> None:
        super().__init__(corpus, root_rows)
        self.stored = stored

    def _edges(self) -> DataFrame:
        return self.stored.of_roots(self.root_rows.withColumnRenamed("topic_id", "ti"))
