"""``PivotSet``: an immutable, lazily evaluated algebra over sets of pivots."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from strandline import schema as S
from strandline.functions import distinct_keys, in_range, mentions, threshold_key
from strandline.functions.columns import AT_LEAST, AT_MOST
from strandline.operators import facets, graphs
from strandline.sources.corpus import Corpus

Range = tuple[float, float]


class PivotSet:
    """A bag of pivot rows plus the sides (future, past) that are present.

    Both sides live in one DataFrame with a ``direction`` column, so every operator
    is one plan over one scan.  A side that was projected away is *missing*, which
    set operations treat differently from a present but empty side.
    """

    def __init__(
        self, corpus: Corpus, rows: DataFrame, sides: Iterable[str] = S.DIRECTIONS
    ) -> None:
        self.corpus = corpus
        self.rows = rows.select(*S.PIVOT_COLUMNS)
        self.sides = frozenset(sides)
        if self.sides < set(S.DIRECTIONS):  # a missing side has no rows, whatever was passed
            self.rows = self.rows.filter(F.col("direction").isin(*sorted(self.sides)))

    @classmethod
    def load(cls, corpus: Corpus) -> PivotSet:
        return cls(corpus, corpus.pivots())

    def _with(self, rows: DataFrame, sides: Iterable[str] | None = None) -> PivotSet:
        return PivotSet(self.corpus, rows, self.sides if sides is None else sides)

    def where(self, condition: Column) -> PivotSet:
        return self._with(self.rows.filter(condition))

    # --- term filters -------------------------------------------------------

    def emerge(self, keyword: str) -> PivotSet:
        return self.where(mentions(keyword, "emerging"))

    def decay(self, keyword: str) -> PivotSet:
        return self.where(mentions(keyword, "decaying"))

    def stable(self, keyword: str) -> PivotSet:
        return self.where(mentions(keyword, "stable"))

    def specific(self, keyword: str) -> PivotSet:
        return self.where(mentions(keyword, "specific"))

    def contains(self, keyword: str) -> PivotSet:
        return self.where(mentions(keyword, *S.LABEL_KINDS))

    # --- range filters: restriction 0 keeps >= value, anything else <= value ---

    def period(self, year: int, restriction: int = AT_LEAST) -> PivotSet:
        column = "start_year" if restriction == AT_LEAST else "end_year"
        return self.where(in_range(column, year, restriction))

    def live(self, value: float, restriction: int = AT_LEAST) -> PivotSet:
        return self.where(in_range("liveliness", value, restriction))

    def split(self, value: float, restriction: int = AT_LEAST) -> PivotSet:
        return self.where(in_range("split_degree", value, restriction))

    def conv(self, value: float, restriction: int = AT_LEAST) -> PivotSet:
        return self.where(in_range("convergence_degree", value, restriction))

    def revol(self, value: float, restriction: int = AT_LEAST) -> PivotSet:
        return self.where(in_range("relative_evolution", value, restriction))

    def pevol(self, value: float, restriction: int = AT_LEAST) -> PivotSet:
        return self.where(in_range("pivot_evolution", value, restriction))

    def search(
        self,
        *,
        contains: str | None = None,
        stable: str | None = None,
        emerging: str | None = None,
        decaying: str | None = None,
        specific: str | None = None,
        period: tuple[int, int] | None = None,
        side: str | None = None,
        live: Range | None = None,
        split: Range | None = None,
        conv: Range | None = None,
        revol: Range | None = None,
        pevol: Range | None = None,
    ) -> PivotSet:
        """All criteria at once, as one conjunctive filter; ranges include both ends."""
        conditions: list[Column] = []
        if contains is not None:
            conditions.append(mentions(contains, *S.LABEL_KINDS))
        by_kind = dict(stable=stable, emerging=emerging, decaying=decaying, specific=specific)
        conditions += [mentions(term, kind) for kind, term in by_kind.items() if term is not None]
        if period is not None:
            conditions.append(in_range("start_year", period[0], AT_LEAST))
            conditions.append(in_range("end_year", period[1], AT_MOST))
        for metric, bounds in zip(S.METRICS, (live, split, conv, revol, pevol)):
            if bounds is not None:
                conditions.append(F.col(metric).between(*bounds))
        found = self if side is None else self._project(side)
        return found.where(reduce(Column.__and__, conditions)) if conditions else found

    # --- projection of sides --------------------------------------------------

    def future(self) -> PivotSet:
        return self._project(S.FUTURE)

    def past(self) -> PivotSet:
        return self._project(S.PAST)

    def _project(self, side: str) -> PivotSet:
        return self._with(self._side(side), self.sides & {side})

    def _side(self, *sides: str) -> DataFrame:
        if set(sides) >= set(S.DIRECTIONS):
            return self.rows
        return self.rows.filter(F.col("direction").isin(*sides) if sides else F.lit(False))

    # --- set operations, side by side -----------------------------------------

    def union(self, other: PivotSet) -> PivotSet:
        """Bag union; a missing side is the identity."""
        return self._with(self.rows.unionByName(other.rows), self.sides | other.sides)

    def intersect(self, other: PivotSet) -> PivotSet:
        """Distinct, null-safe; a side missing on either operand is missing."""
        shared = self.sides & other.sides
        members = self._membership(other, shared).filter("in_self AND in_other")
        return self._with(members, shared)

    def minus(self, other: PivotSet) -> PivotSet:
        """EXCEPT DISTINCT on shared sides; a side the other lacks passes unchanged."""
        shared = self.sides & other.sides
        rows = self._membership(other, shared).filter("in_self AND NOT in_other")
        rows = rows.select(*S.PIVOT_COLUMNS)
        untouched = self.sides - shared
        if untouched:
            rows = rows.unionByName(self._side(*untouched))
        return self._with(rows)

    def _membership(self, other: PivotSet, shared: Iterable[str]) -> DataFrame:
        """Distinct rows of the shared sides with the operands they occur in.

        Grouping is null-safe and combines copies before its only shuffle; the
        built-in set operations join first, which sends all copies of a row to one
        task.
        """
        mine = self._side(*shared).withColumn("mine", F.lit(True))
        theirs = other._side(*shared).withColumn("mine", F.lit(False))
        return (
            mine.unionByName(theirs)
            .groupBy(*S.PIVOT_COLUMNS)
            .agg(
                F.bool_or("mine").alias("in_self"),
                F.bool_or(~F.col("mine")).alias("in_other"),
            )
        )

    # --- path filter ------------------------------------------------------------

    def path(self, other: PivotSet) -> PivotSet:
        """Pivots from which a graph path leads to a pivot of ``other``.

        Per threshold and side: future graphs are followed to later topics, past
        graphs to older ones.  Two semi-joins on distinct keys, so the multiplicity
        of the rows kept does not change and no pair of pivots is ever built; a
        topic that many graphs reach, or a row with many copies, can be split.
        """
        shared = self.sides & other.sides
        threshold = threshold_key().alias("threshold")
        targets = other._side(*shared).select(
            "direction", threshold, F.col("topic_id").alias("tk")
        )
        future, past = F.col("direction") == S.FUTURE, F.col("direction") == S.PAST
        onward = (future & (F.col("ti") < F.col("tk"))) | (past & (F.col("tk") < F.col("ti")))
        in_shared = F.col("direction").isin(*shared) if shared else F.lit(False)
        reached = ["direction", "threshold", "tk"]
        hits = (
            self.corpus.paths()
            .filter(in_shared & onward)
            .select("direction", threshold, "ti", "tk")
            .join(distinct_keys(targets, *reached), reached, "left_semi")
            .withColumnRenamed("ti", "topic_id")
        )
        key = ["direction", "threshold", "topic_id"]
        kept = (
            self._side(*shared)
            .withColumn("threshold", threshold_key())
            .join(distinct_keys(hits, *key), key, "left_semi")
        )
        return self._with(kept, shared)

    # --- ordering ---------------------------------------------------------------

    def sort(self, column: str, order: str = "asc") -> PivotSet:
        """Each side ordered by a column; ids break ties so that a value shared by
        most rows does not end up in one range partition."""
        key = F.asc(column) if order == "asc" else F.desc(column)
        return self._with(self.rows.orderBy("direction", key, "beta", "topic_id"))

    # --- reports ------------------------------------------------------------------

    def _first_per_side(self, df: DataFrame, n: int | None, *order: str) -> DataFrame:
        """The first n rows of each side; every slice is a distributed top-n."""
        if n is None:
            return df
        slices = [
            df.filter(F.col("direction") == side).orderBy(*order).limit(n)
            for side in sorted(self.sides)
        ]
        return reduce(DataFrame.unionByName, slices) if slices else df.filter(F.lit(False))

    def show(self, n: int | None = 20) -> DataFrame:
        return self._first_per_side(self.rows, n, *S.PIVOT_COLUMNS[1:])

    def show_labels(self, n: int | None = 20) -> DataFrame:
        columns = ["direction", "beta", "topic_id", *S.LABEL_KINDS]
        return self._first_per_side(self.rows.select(*columns).distinct(), n, *columns[1:])

    def _topics(self) -> DataFrame:
        selected = self.rows.select("direction", "topic_id").distinct()
        return selected.join(self.corpus.topic_dictionary(), "topic_id").select(
            "direction", "topic_id", "terms"
        )

    def describe_topics(self, n: int | None = 20) -> DataFrame:
        return self._first_per_side(self._topics(), n, "topic_id")

    def describe_terms(self) -> DataFrame:
        """How many of the selected topics use each term, most frequent first."""
        return (
            self._topics()
            .select("direction", F.explode("terms").alias("term"))
            .groupBy("direction", "term")
            .agg(F.count("*").alias("n_topics"))
            .orderBy("direction", F.desc("n_topics"), "term")
        )

    def describe(self, *columns: str) -> DataFrame:
        """count, mean, sample stddev, min and max per side and numeric column.

        All columns are aggregated in one pass over the rows.  A side that is present
        but empty counts 0 and has NULL measures; a missing side has no rows.  Columns
        that are not numeric are left out.
        """
        chosen = [
            c
            for c in (columns or S.METRICS)
            if isinstance(self.rows.schema[c].dataType, NumericType)
        ]
        measures: dict[str, Callable[[str], Column]] = {
            "mean": F.avg,
            "stddev": F.stddev_samp,
            "min": F.min,
            "max": F.max,
        }
        if not chosen:
            raise ValueError("describe needs at least one numeric column")
        aggregates = []
        for c in chosen:
            aggregates.append(F.count(c).alias(f"{c}:count"))
            aggregates += [
                measure(c).cast("double").alias(f"{c}:{name}") for name, measure in measures.items()
            ]
        sides = F.array(*[F.lit(side) for side in sorted(self.sides)]).cast("array<string>")
        present = self.rows.sparkSession.range(1).select(F.explode(sides).alias("direction"))
        per_side = present.join(self.rows.groupBy("direction").agg(*aggregates), "direction", "left")
        entries = F.array(
            *[
                F.struct(
                    F.lit(c).alias("metric"),
                    F.coalesce(F.col(f"`{c}:count`"), F.lit(0)).cast("bigint").alias("count"),
                    *[F.col(f"`{c}:{name}`").alias(name) for name in measures],
                )
                for c in chosen
            ]
        )
        return per_side.select("direction", F.inline(entries))

    # --- facets and graphs ----------------------------------------------------------

    def term_choices(self) -> DataFrame:
        return facets.term_choices(self.rows)

    def keyword_choices(self) -> DataFrame:
        return facets.keyword_choices(self.rows)

    def bounds(self) -> DataFrame:
        return facets.bounds(self.rows)

    def roots(self) -> DataFrame:
        return graphs.roots(self.rows)

    def graphs(self) -> graphs.PivotGraphs:
        return graphs.PivotGraphs(self.corpus, self.rows)
