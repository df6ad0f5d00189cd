"""Readers for corpus directories: JSON lines or Parquet."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandline import schema as S
from strandline.sources.corpus import Corpus


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str,
    canonical: StructType,
    names: dict[str, str] | None = None,
    keys: Sequence[str] = (),
    optional: Sequence[str] = (),
) -> DataFrame:
    """Read a stored table and return it under the canonical names and types.

    ``names`` maps canonical to stored names (default: equal).  JSON is read with
    the schema given, so no inference job runs; Parquet brings its own types,
    which are cast, so files that store e.g. years as bigint read as well.

    Errors are not turned into NULL: a broken JSON line fails the job, a Parquet
    column that is missing fails at once unless it is ``optional``, and a NULL in
    one of the ``keys`` of a JSON table fails the job, since JSON does not tell a
    missing column from a missing value.  For other JSON columns see
    ``check_columns``.
    """
    names = names or {c: c for c in canonical.fieldNames()}
    if fmt == "json":
        stored = spark.read.schema(S.exported_schema(canonical, names)).json(path, mode="FAILFAST")
    elif fmt == "parquet":
        stored = spark.read.parquet(path)
        missing = [n for c, n in names.items() if n not in stored.columns and c not in optional]
        if missing:
            raise ValueError(f"{path} has no column {', '.join(missing)}")
    else:
        raise ValueError(f"format must be 'json' or 'parquet', not {fmt!r}")

    def column(name: str, stored_name: str) -> Column:
        if stored_name not in stored.columns:
            return F.lit(None).cast(canonical[name].dataType)
        value = F.col(stored_name).cast(canonical[name].dataType)
        if fmt == "json" and name in keys:
            failure = F.raise_error(f"{path}: a row without {stored_name}")
            value = F.coalesce(value, failure.cast(canonical[name].dataType))
        return value

    return stored.select(*[column(name, stored_name).alias(name) for name, stored_name in names.items()])


def check_columns(df: DataFrame, columns: Sequence[str]) -> None:
    """Raises if a column has no value in any row of a table that has rows: it may be
    stored under another name.  One aggregation."""
    counted = df.agg(F.count("*").alias("rows"), *[F.count(c).alias(f"n_{c}") for c in columns]).first()
    empty = [c for c in columns if not counted[f"n_{c}"]]
    if counted["rows"] and empty:
        raise ValueError(f"no row has a value of {', '.join(empty)}")


@dataclass(frozen=True)
class ExportedLayout:
    """Where an exported corpus keeps its tables.

    Graphs are stored in one directory per threshold,
    ``evolutionPath/<beta>_<topics>_<floor>_<terms>``.
    """

    root: str
    betas: Sequence[float]
    topics_per_period: int
    fmt: str = "json"
    floor: str = "0.0"
    terms_per_topic: int = 10
    topic_nodes: str = "topicNodes"
    topic_dictionary: str = "topicDictionary_unique_10"
    vocabulary: str = "vocabulary"
    similarity_links: str = "similarityLinks"
    statistics: str = "statistics"
    individuals: str = "Global_individuals_future"

    def at(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def graphs(self, beta: float, name: str) -> str:
        folder = f"{beta}_{self.topics_per_period}_{self.floor}_{self.terms_per_topic}"
        return self.at(f"evolutionPath/{folder}/{name}")


def _stack(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def open_exported(spark: SparkSession, layout: ExportedLayout) -> Corpus:
    """A corpus over exported directories.

    Threshold and direction are literals of each branch of the union, so a filter
    on them removes whole branches at planning time: no file of another threshold
    is opened.
    """

    def table(name: str, canonical: StructType, names: dict[str, str]) -> DataFrame:
        keys = S.keys_of(canonical)
        return read_table(spark, layout.at(name), layout.fmt, canonical, names, keys, S.OPTIONAL)

    def pivots() -> DataFrame:
        sides = [
            table(f"{layout.statistics}_{direction}", S.PIVOTS, S.EXPORTED_PIVOTS).withColumn(
                "direction", F.lit(direction)
            )
            for direction in S.DIRECTIONS
        ]
        return _stack(sides).select(*S.PIVOT_COLUMNS)

    def graphs(name: str, canonical: StructType, names: dict[str, str]) -> DataFrame:
        return _stack(
            [
                read_table(
                    spark, layout.graphs(beta, name), layout.fmt, canonical, names, S.keys_of(canonical)
                ).withColumn("beta", F.lit(float(beta)))
                for beta in layout.betas
            ]
        )

    def paths() -> DataFrame:
        sides = [
            graphs(direction, S.PATHS, S.EXPORTED_PATHS).withColumn("direction", F.lit(direction))
            for direction in S.DIRECTIONS
        ]
        return _stack(sides).select(*S.PATH_COLUMNS)

    return Corpus(
        {
            "pivots": pivots,
            "paths": paths,
            "labels": lambda: graphs("labels", S.LABELS, S.EXPORTED_LABELS).select(
                *S.LABEL_COLUMNS
            ),
            "individuals": lambda: graphs(
                layout.individuals, S.INDIVIDUALS, S.EXPORTED_INDIVIDUALS
            ).select(*S.INDIVIDUALS.fieldNames()),
            "topic_nodes": lambda: table(
                layout.topic_nodes, S.TOPIC_NODES, S.EXPORTED_TOPIC_NODES
            ),
            "topic_dictionary": lambda: table(
                layout.topic_dictionary, S.TOPIC_DICTIONARY, S.EXPORTED_TOPIC_DICTIONARY
            ),
            "vocabulary": lambda: table(layout.vocabulary, S.VOCABULARY, S.EXPORTED_VOCABULARY),
            "similarity_links": lambda: table(
                layout.similarity_links, S.SIMILARITY_LINKS, S.EXPORTED_SIMILARITY_LINKS
            ),
        }
    )
