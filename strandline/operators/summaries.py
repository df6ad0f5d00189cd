"""Stored summaries of pivots: reports over all of them without reading them.

For every file group and side of a pivot table, one row holds the count, mean, sum of
squared deviations, minimum and maximum of each number, and the start years.  Two
summaries merge into that of both groups, so a report over all pivots, or over some
groups, reads as many rows as there are groups.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline import schema as S
from strandline.operators import facets
from strandline.sources.workspace import Workspace

MEASURED = ("start_year", "end_year", *S.METRICS)
_MEASURE = T.StructType(
    [
        T.StructField("metric", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("m2", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
    ]
)
_SUMMARIES = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("direction", T.StringType()),
        T.StructField("years", T.ArrayType(T.IntegerType())),
        T.StructField("measures", T.ArrayType(_MEASURE)),
    ]
)


def _measure(column: str) -> Column:
    n = F.count(column)
    return F.struct(
        F.lit(column).alias("metric"),
        n.alias("n"),
        F.avg(column).alias("mean"),
        (F.var_pop(column) * n).alias("m2"),
        F.min(column).cast("double").alias("low"),
        F.max(column).cast("double").alias("high"),
    )


def _both(left: Column, right: Column) -> Column:
    """The moments of two groups together; neither is empty, or the left one is."""
    n = left["n"] + right["n"]
    step = right["mean"] - left["mean"]
    return F.struct(
        n.alias("n"),
        (left["mean"] + step * right["n"] / n).alias("mean"),
        (left["m2"] + right["m2"] + step * step * left["n"] * right["n"] / n).alias("m2"),
    )


class PivotSummaries:
    """Summaries of the file groups of a pivot table; see ``build``."""

    def __init__(self, stored: DataFrame) -> None:
        self.stored = stored

    @classmethod
    def build(cls, rows: DataFrame, workspace: Workspace, name: str) -> PivotSummaries:
        """Write the summaries of a pivot table with a column ``part``, its file group.

        NULL numbers and years are not counted.  An empty table has no summaries.
        """
        years = F.sort_array(F.collect_set("start_year")).alias("years")
        measures = F.array(*[_measure(c) for c in MEASURED]).alias("measures")
        workspace.write(name, rows.groupBy("part", "direction").agg(years, measures))
        return cls(workspace.read(name, _SUMMARIES))

    def _of(self, parts: Iterable[int] | None) -> DataFrame:
        return self.stored if parts is None else self.stored.filter(F.col("part").isin(list(parts)))

    def describe(self, *columns: str, parts: Iterable[int] | None = None) -> DataFrame:
        """As ``PivotSet.describe`` of all pivots, or of those of some file groups.

        Groups are merged in their order, so the result does not depend on which task ends
        first.  A side without pivots counts 0 and has NULL measures.
        """
        chosen = [c for c in (columns or S.METRICS) if c in MEASURED]
        if not chosen:
            raise ValueError("describe needs at least one numeric column")
        entries = self._of(parts).select("part", "direction", F.inline("measures"))
        gathered = entries.filter(F.col("metric").isin(chosen) & (F.col("n") > 0)).groupBy("direction", "metric").agg(
            F.sort_array(F.collect_list(F.struct("part", "n", "mean", "m2"))).alias("groups"),
            F.min("low").alias("min"),
            F.max("high").alias("max"),
        )
        nothing = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
        merged = gathered.select("direction", "metric", "min", "max", F.aggregate("groups", nothing, _both).alias("all"))
        sides = F.explode(F.array(*[F.lit(side) for side in S.DIRECTIONS])).alias("direction")
        metrics = F.explode(F.array(*[F.lit(c) for c in chosen])).alias("metric")
        named = self.stored.sparkSession.range(1).select(sides).select("direction", metrics)
        return named.join(merged, ["direction", "metric"], "left").select(
            "direction",
            "metric",
            F.coalesce("all.n", F.lit(0).cast("bigint")).alias("count"),
            F.col("all.mean").alias("mean"),
            F.when(F.col("all.n") > 1, F.sqrt(F.col("all.m2") / (F.col("all.n") - 1))).alias("stddev"),
            "min",
            "max",
        )

    def bounds(self, parts: Iterable[int] | None = None) -> DataFrame:
        """As ``facets.bounds``."""

        def highest(column: str) -> Column:
            return F.max(F.get(F.filter("measures", lambda m: m["metric"] == column), F.lit(0))["high"])

        years = F.array_distinct(F.flatten(F.collect_list("years")))
        per_side = self._of(parts).groupBy("direction").agg(
            (F.size(years) - 1).cast("bigint").alias("liveliness"),
            highest("split_degree").alias("split"),
            highest("convergence_degree").alias("convergence"),
            F.min(F.array_min("years")).alias("first_year"),
            highest("end_year").cast("int").alias("last_year"),
        )
        return facets.over_sides(per_side)
