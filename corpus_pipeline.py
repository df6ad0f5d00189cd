"""From raw documents to token ids, in five stages.

Each stage works on all documents the one before kept and returns the columns of
``documents``; the last returns the ids.  ``run`` writes the result of each stage to
the cluster's shared folder and reads it back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import host_rules, line_templates, prob_minhash, rank_bpe, wu_manber
from strandline.llm.queries import WORD_BPE
from strandline.llm.scratch import documents, keep


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what ``host_rules`` rejects.

    NULL and empty texts are too short and go.  Repeated rows are judged alike.
    """
    return host_rules.accepted(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines of templates that recur, except in the first document of each.

    A document goes if that leaves it without words: everything it said is in other
    documents.  A document without dropped lines stays as it is, NULL texts included.
    ``n_chars`` follows the text.
    """
    cleaned, lines = line_templates.without_recurring_lines(docs)
    some = (F.col(f"`{lines}`.n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    columns = [
        F.when(F.col(f"`{lines}`.n_dropped") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")).alias("n_chars")
        if c == "n_chars"
        else F.col(f"`{c}`")
        for c, kind in docs.dtypes
    ]
    return cleaned.filter(some).select(*columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates; texts without words all stay."""
    return prob_minhash.without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that have a window of ten words of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits, found = wu_manber.occurrences(docs, benchmark)
    return hits.filter(F.size(F.col(f"`{found}`.spans")) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with digests of the ids and of the decoded text."""
    return rank_bpe.round_trip(docs, public_tokenizers.path(WORD_BPE), with_ids=True)


STAGES = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("near-duplicates", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: SQL cannot express line templates, near-duplicate classes or BPE in reasonable time.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
