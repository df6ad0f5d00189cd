"""Key tables for semi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_keys(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct keys that do not bring the partitioning of a join on them.

    Copies of a key are combined before the first shuffle.  AQE splits a skewed
    partition only between inputs that come straight from the join's own exchange,
    which an aggregate partitioned on the join keys would replace.  Deduplicating
    on the keys plus a value computed from them gives the same rows in another
    partitioning, so the join gets its exchange: one more shuffle of distinct keys
    keeps the other, larger side splittable.
    """
    marker = F.pmod(F.xxhash64(*columns), F.lit(2)).alias("_marker")
    return df.select(*columns, marker).distinct().drop("_marker")
