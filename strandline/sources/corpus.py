"""A corpus: the tables every operator reads."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TABLES = (
    "pivots",
    "paths",
    "labels",
    "individuals",
    "topic_nodes",
    "topic_dictionary",
    "vocabulary",
    "similarity_links",
    "periods",
)


class Corpus:
    """Lazily opened tables under canonical names (see ``strandline.schema``)."""

    def __init__(self, loaders: Mapping[str, Callable[[], DataFrame]]) -> None:
        unknown = set(loaders) - set(TABLES)
        if unknown:
            raise ValueError(f"unknown tables: {sorted(unknown)}")
        self._loaders = dict(loaders)
        self._opened: dict[str, DataFrame] = {}

    @classmethod
    def of(cls, **tables: DataFrame) -> Corpus:
        return cls({name: (lambda df=df: df) for name, df in tables.items()})

    def table(self, name: str) -> DataFrame:
        if name not in self._opened:
            if name not in self._loaders:
                raise KeyError(f"this corpus has no table {name!r}")
            self._opened[name] = self._loaders[name]()
        return self._opened[name]

    def pivots(self) -> DataFrame:
        return self.table("pivots")

    def paths(self, beta: float | None = None, direction: str | None = None) -> DataFrame:
        """Edges of all graphs, or of one threshold / direction (partition pruning)."""
        edges = self.table("paths")
        if beta is not None:
            edges = edges.filter(F.col("beta") == F.lit(float(beta)))
        if direction is not None:
            edges = edges.filter(F.col("direction") == F.lit(direction))
        return edges

    def labels(self) -> DataFrame:
        return self.table("labels")

    def individuals(self) -> DataFrame:
        return self.table("individuals")

    def topic_nodes(self) -> DataFrame:
        return self.table("topic_nodes")

    def topic_dictionary(self) -> DataFrame:
        return self.table("topic_dictionary")

    def vocabulary(self) -> DataFrame:
        return self.table("vocabulary")

    def similarity_links(self) -> DataFrame:
        return self.table("similarity_links")

    def periods(self) -> DataFrame:
        """Distinct period labels with their ordinal in sorted order.

        A corpus may store them; otherwise they come from the topic nodes.  The
        window has no partition key, but it runs over the distinct labels only:
        one row per calendar window, whatever the size of the corpus.
        """
        if "periods" in self._loaders:
            return self.table("periods")
        labels = self.topic_nodes().select("period").distinct()
        ordinal = F.row_number().over(Window.orderBy("period")) - 1
        return labels.select("period", ordinal.alias("period_idx"))
