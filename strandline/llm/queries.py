"""The queries of the text operators, as the driver registers them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import (
    context_tree,
    host_rules,
    infill,
    line_templates,
    multiset,
    ordinal,
    prob_minhash,
    rank_bpe,
    repair,
    surrogates,
    token_counts,
    walsh_codes,
    wu_manber,
)
from strandline.llm.scratch import documents
from strandline.llm.twins import TWINS

#: Vocabulary files of the public tokenizers.
WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without recurring lines; see ``line_templates``."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    cleaned, lines = line_templates.without_recurring_lines(docs)
    return cleaned.select("doc_id", "text", F.col(lines)["n_lines"].alias("n_lines"), F.col(lines)["n_dropped"].alias("n_dropped"))


def op2_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every document and whether it is kept; see ``host_rules.judged``."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    scored, q = host_rules.judged(docs, carry=("doc_id",))
    m = F.col(q)
    columns = (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", "host_docs", "host_failures", "host_verdict",
    )
    return scored.select("doc_id", *[m[c].alias(c) for c in columns])


def op3_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document; see ``prob_minhash.near_duplicates``."""
    return prob_minhash.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))


def op4_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside benchmark windows; see ``wu_manber.occurrences``."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits, found = wu_manber.occurrences(documents(spark, sf_dir), benchmark, carry=("doc_id",))
    n_hit = wu_manber.n_hit(found)
    return hits.select(
        "doc_id",
        F.col(found)["n_words"].alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(F.col(found)["items"]).cast("bigint").alias("n_items"),
        wu_manber.digest(found).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op5_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade of every document, and whether it is kept."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = ordinal.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored, grade = ordinal.scores(docs, model)
    columns = ("expected_grade", "tail_probability", "kept")
    return scored.select("doc_id", *[F.col(grade)[c].alias(c) for c in columns])


#: The key that surrogates are derived from; a deployment sets its own.
PII_KEY = "strandline"


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with personal data replaced by surrogates."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    cleaned, count = surrogates.with_surrogates(docs, PII_KEY)
    return cleaned.select("doc_id", "text", F.col(count).alias("n_entities"))


def op7_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    return rank_bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path(WORD_BPE))


def op8_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by single words and by context-tree weighting."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = context_tree.held_out_by_id()
    return context_tree.scores(docs, context_tree.train(docs, "text", held_out), held_out)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE))


def op10_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read back from the shards."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    shards = repair.write_shards(docs, public_tokenizers.path(WORD_BPE), end_id=1)
    return repair.documents_in(shards).withColumnRenamed("id", "doc_id")


def op11_walsh_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every sound vector under codebooks learnt from all of them."""
    return walsh_codes.vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every rearranged document and of the text restored from it."""
    return infill.fill_in_middle(documents(spark, sf_dir))


def op13_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return multiset.fingerprints(documents(spark, sf_dir))


_QUERIES: tuple[Query, ...] = (op1_line_templates, op2_host_rules, op3_prob_minhash, op4_wu_manber, op5_ordinal, op6_surrogates, op7_rank_bpe, op8_context_tree, op9_token_counts, op10_repair, op11_walsh_codes, op12_fill_in_middle, op13_multiset_hash)


def queries() -> dict[str, Query]:
    return {query.__name__: query for query in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(TWINS)
