"""An inverted index of labels: term -> postings of the rows that have it.

A table of labelled topics (pivots or labels) is written in *parts*, folders that hold
ranges of topic ids, and for every term, kind of label and part the ids that have the
term there, as steps between ascending ids.  The postings are written in ranges of
terms, so a lookup opens the file or two of its term.

A term search reads the postings of its terms first.  What asks for ids is answered from
them alone; what asks for rows reads the parts that the postings name, and no others.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline import schema as S
from strandline.functions import mentions
from strandline.sources.workspace import Workspace


class LabelIndex:
    """Rows of a label table by their terms; see ``build``."""

    def __init__(self, rows: DataFrame, postings: DataFrame, columns: Sequence[str], id_column: str) -> None:
        self.rows, self.postings, self.columns, self.id_column = rows, postings, tuple(columns), id_column

    @classmethod
    def build(cls, table: DataFrame, workspace: Workspace, name: str, id_column: str = "topic_id", parts: int = 64) -> LabelIndex:
        """Write the rows of ``table`` in ``parts`` ranges of ids, and their postings.

        The other columns that are no labels and no metrics, the side and the threshold,
        are keys of the postings.  A NULL list of labels, and a NULL in one, is not
        indexed; a term that a list repeats is indexed once.  Rows with the same keys are
        one posting, but stay rows of their own.  An empty table has no postings.
        """
        keys = [c for c in ("direction", "beta") if c in table.columns]
        placed = table.repartitionByRange(parts, F.col(id_column)).withColumn("part", F.spark_partition_id())
        workspace.write(f"{name}_rows", placed, partition_by=["part"])
        schema = T.StructType([*table.schema.fields, T.StructField("part", T.IntegerType())])
        rows = workspace.read(f"{name}_rows", schema)
        pairs = F.flatten(F.array(*[_labelled(kind) for kind in S.LABEL_KINDS]))
        exploded = rows.select("part", *keys, F.col(id_column).alias("id"), F.explode(pairs).alias("label")).filter("label.term IS NOT NULL")
        # at most the ids of one part come together
        ids = exploded.groupBy(F.col("label.term").alias("term"), F.col("label.kind").alias("kind"), *keys, "part").agg(
            F.sort_array(F.collect_set("id")).alias("ids")
        )
        steps = F.transform("ids", lambda x, i: F.when(i == 0, 0).otherwise(x - F.get("ids", i - 1)))
        workspace.write(
            f"{name}_postings", ids.select("term", "kind", *keys, "part", F.get("ids", F.lit(0)).alias("first"), steps.alias("steps")), sort_by=["term", "kind", "part"]
        )
        fields = [T.StructField("term", T.StringType()), T.StructField("kind", T.StringType())]
        fields += [table.schema[k] for k in keys]
        fields += [T.StructField("part", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("steps", T.ArrayType(T.LongType()))]
        return cls(rows, workspace.read(f"{name}_postings", T.StructType(fields)), table.columns, id_column)

    def _of(self, terms: Iterable[str], kinds: Sequence[str]) -> DataFrame:
        """Postings of any of the terms; both filters reach the scan."""
        return self.postings.filter(F.col("term").isin(list(terms)) & F.col("kind").isin(list(kinds)))

    def ids(self, terms: Iterable[str], kinds: Sequence[str] = S.LABEL_KINDS) -> DataFrame:
        """Distinct keys and ids of the rows with any of the terms; no row is read."""
        found = self._of(terms, kinds)
        keys = [c for c in found.columns if c in ("direction", "beta")]
        # running sums of the steps give back the ids of a posting
        added = F.aggregate(
            "steps",
            F.struct(F.col("first").alias("at"), F.array().cast("array<bigint>").alias("ids")),
            lambda acc, s: F.struct((acc["at"] + s).alias("at"), F.array_append(acc["ids"], acc["at"] + s).alias("ids")),
            lambda acc: acc["ids"],
        )
        return found.select(*keys, F.explode(added).alias(self.id_column)).distinct()

    def counts(self, kinds: Sequence[str] = S.LABEL_KINDS) -> DataFrame:
        """(term, kind, postings): in how many indexed keys each term is a label."""
        some = self.postings.filter(F.col("kind").isin(list(kinds)))
        return some.groupBy("term", "kind").agg(F.sum(F.size("steps")).cast("bigint").alias("postings"))

    def parts_with(self, terms: Iterable[str], kinds: Sequence[str] = S.LABEL_KINDS) -> list[int]:
        """Parts that hold a row with any of the terms: no more numbers than there are parts."""
        return sorted(r["part"] for r in self._of(terms, kinds).select("part").distinct().collect())

    def rows_with(self, term: str, *kinds: str) -> DataFrame:
        """The rows that have the term among labels of the kinds (default: any), from
        the parts that have some."""
        kinds = kinds or S.LABEL_KINDS
        return self._within(self.parts_with([term], kinds), mentions(term, *kinds))

    def rows_with_all(self, **terms: str) -> DataFrame:
        """The rows that have, for every kind given, its term: parts that lack one of
        them are left out before anything is read."""
        if not terms:
            return self.rows.select(*self.columns)
        shared = set.intersection(*[set(self.parts_with([term], [kind])) for kind, term in terms.items()])
        return self._within(sorted(shared), reduce(Column.__and__, [mentions(term, kind) for kind, term in terms.items()]))

    def _within(self, parts: list[int], condition: Column) -> DataFrame:
        pruned = F.col("part").isin(parts) if parts else F.lit(False)
        return self.rows.filter(pruned & condition).select(*self.columns)


def _labelled(kind: str) -> Column:
    """The distinct terms of a kind, each with the name of the kind."""
    terms = F.array_distinct(F.coalesce(F.col(kind), F.array().cast("array<string>")))
    return F.transform(terms, lambda term: F.struct(F.lit(kind).alias("kind"), term.alias("term")))
