"""Column expressions shared by the operators (all JVM-side)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Restriction flag of the range filters (fixed values): 0 keeps values at or
# above the bound, anything else keeps values at or below it.
AT_LEAST, AT_MOST = 0, 1


def mentions(keyword: str, *array_columns: str) -> Column:
    """True when ``keyword`` is in at least one of the arrays (exact, case-sensitive).

    SQL's three-valued OR is what is wanted: a NULL array does not hide a hit in
    another one, and a row without any hit is not kept.
    """
    condition = F.array_contains(array_columns[0], keyword)
    for column in array_columns[1:]:
        condition = condition | F.array_contains(column, keyword)
    return condition


def mentions_any(keywords: Iterable[str], array_column: str) -> Column:
    """True when the array holds at least one of the keywords; one pass over it."""
    return F.arrays_overlap(F.col(array_column), F.array(*[F.lit(k) for k in keywords]))


def in_range(column: str, value: float, restriction: int) -> Column:
    bounded = F.col(column)
    return bounded >= F.lit(value) if restriction == AT_LEAST else bounded <= F.lit(value)


def joined(array_column: str, separator: str = ",", stored_order: bool = False) -> Column:
    """Array as one string, in sorted order or in the order it is stored in."""
    items = F.col(array_column)
    return F.array_join(items if stored_order else F.sort_array(items), separator)


def threshold_key(beta: str | Column = "beta") -> Column:
    """A threshold as a string, for use as a join or grouping key.

    Spark normalises floating-point keys separately in every operator, so an
    aggregate and a join on a double never share an exchange; on a string they do.
    The string is the shortest that reads back as the same double, so different
    thresholds stay different; adding zero makes one of the two zeros.
    """
    value = F.col(beta) if isinstance(beta, str) else beta
    return (value.cast("double") + F.lit(0.0)).cast("string")


def rounded_similarity(sim: Column) -> Column:
    """Two decimals, half-even on the scaled value.

    Neither ``round`` nor ``bround`` agrees with this on values such as 0.575,
    because both go through the shortest decimal form of the double.
    """
    return F.rint(sim * F.lit(100.0)) / F.lit(100.0)


def edge_strength(sim: Column, beta: Column) -> Column:
    """Similarity above the threshold, scaled to 1..10; NULL at beta = 1."""
    room = F.when(beta != 1.0, F.lit(1.0) - beta)
    return (rounded_similarity(sim) - beta) * F.lit(9.0) / room + F.lit(1.0)


def fixed_point_mean(value: Column) -> Column:
    """Mean of values in [0, 1] summed in units of 1e-9.

    A sum of doubles depends on the order in which tasks deliver their partial
    sums, so a recomputed partition could change the last bit and break the
    value-based set operations.  Integer sums do not depend on the order.
    """
    units = F.rint(value * F.lit(1e9)).cast("bigint")
    return F.sum(units).cast("double") / F.lit(1e9) / F.count(value)
