"""Writes a copy of a corpus in the exported directory layout.

Used to check the readers against data they did not write themselves.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline import schema as S
from strandline.sources.corpus import Corpus
from strandline.sources.readers import ExportedLayout


def _write(df: DataFrame, names: dict[str, str], layout: ExportedLayout, path: str) -> None:
    stored = df.select(*[F.col(c).alias(n) for c, n in names.items()])
    stored.write.mode("error").format(layout.fmt).save(path)


def export_corpus(corpus: Corpus, layout: ExportedLayout, tables: Iterable[str]) -> None:
    plain = {
        "topic_nodes": (layout.topic_nodes, S.EXPORTED_TOPIC_NODES),
        "topic_dictionary": (layout.topic_dictionary, S.EXPORTED_TOPIC_DICTIONARY),
        "vocabulary": (layout.vocabulary, S.EXPORTED_VOCABULARY),
        "similarity_links": (layout.similarity_links, S.EXPORTED_SIMILARITY_LINKS),
    }
    per_threshold = {
        "labels": ("labels", S.EXPORTED_LABELS),
        "individuals": (layout.individuals, S.EXPORTED_INDIVIDUALS),
    }
    for table in tables:
        df = corpus.table(table)
        if table in plain:
            folder, names = plain[table]
            _write(df, names, layout, layout.at(folder))
        elif table == "pivots":
            for direction in S.DIRECTIONS:
                side = df.filter(F.col("direction") == direction)
                path = layout.at(f"{layout.statistics}_{direction}")
                _write(side, S.EXPORTED_PIVOTS, layout, path)
        elif table == "paths":
            for beta in layout.betas:
                for direction in S.DIRECTIONS:
                    graphs = corpus.paths(beta, direction)
                    _write(graphs, S.EXPORTED_PATHS, layout, layout.graphs(beta, direction))
        else:
            folder, names = per_threshold[table]
            for beta in layout.betas:
                rows = df.filter(F.col("beta") == float(beta))
                _write(rows, names, layout, layout.graphs(beta, folder))
