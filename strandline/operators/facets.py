"""Valid filter values of a set of pivots: the data behind a query form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline import schema as S


def term_choices(rows: DataFrame) -> DataFrame:
    """Distinct (kind, term) over both sides, sorted; NULL arrays add nothing."""
    by_kind = F.array(
        *[F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("terms")) for kind in S.LABEL_KINDS]
    )
    return (
        rows.select(F.inline(by_kind))
        .select("kind", F.explode("terms").alias("term"))
        .distinct()
        .orderBy("kind", "term")
    )


def keyword_choices(rows: DataFrame) -> DataFrame:
    """Distinct terms of all four kinds, sorted."""
    return (
        rows.select(F.explode(F.array(*S.LABEL_KINDS)).alias("terms"))
        .select(F.explode("terms").alias("term"))
        .distinct()
        .orderBy("term")
    )


def bounds(rows: DataFrame) -> DataFrame:
    """One row of slider bounds over both sides.

    The bound of liveliness is the number of distinct start years of a side minus
    one.  Grouping by start year first leaves a handful of rows per task, so the
    two sides are not two hot groups.
    """
    per_year = rows.groupBy("direction", "start_year").agg(
        F.max("split_degree").alias("split"),
        F.max("convergence_degree").alias("convergence"),
        F.max("end_year").alias("end_year"),
    )
    per_side = per_year.groupBy("direction").agg(
        (F.count("start_year") - 1).alias("liveliness"),
        F.max("split").alias("split"),
        F.max("convergence").alias("convergence"),
        F.min("start_year").alias("first_year"),
        F.max("end_year").alias("last_year"),
    )
    return over_sides(per_side)


def over_sides(per_side: DataFrame) -> DataFrame:
    """Bounds of both sides; a missing one counts as liveliness 0 and degree 1."""
    return per_side.agg(
        F.greatest(F.max("liveliness"), F.lit(0).cast("bigint")).alias("max_liveliness"),
        F.greatest(F.max("split"), F.lit(1.0)).alias("max_split_degree"),
        F.greatest(F.max("convergence"), F.lit(1.0)).alias("max_convergence_degree"),
        F.min("first_year").alias("first_year"),
        F.max("last_year").alias("last_year"),
    )
