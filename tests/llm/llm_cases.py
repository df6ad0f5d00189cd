"""Fixtures and texts that the tests of the text operators share."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)

#: Columns of the input that are called like those the operators make.
CLASHING = ("quality", "host_key", "of_host", "lines", "found", "n_tokens", "ids", "key", "row", "t", "c0", "n_entities", "grade", "gone")


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, source]) rows."""

    def make(rows, clashing=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", None if r[1] is None else len(r[1])) for r in rows]
        if not clashing:
            return spark.createDataFrame(full, DOCS)
        extra = [T.StructField(c, T.StringType()) for c in CLASHING]
        return spark.createDataFrame([(*r, *CLASHING) for r in full], T.StructType([*DOCS.fields, *extra]))

    return make


@pytest.fixture
def prose():
    """Texts of invented words, different for every seed."""

    def make(seed, n):
        source = random.Random(seed)
        syllables = "ba be di do fu ga hi ko la me no pu ra si to vu wa xe yo zu".split()
        return " ".join("".join(source.choices(syllables, k=source.randint(1, 4))) for _ in range(n))

    return make


#: Texts that are easy to get wrong.
ODD = [
    None, "", " ", "\n\n", "a", "\x1c\x85　 x", "é" * 300, "<|endoftext|>it's<|startoftext|> we'll",
    "word " * 3000, "日本語 текст 🙂 ﬁn Å İstanbul ΣΑΣ", "line\nline\nline\n", "x" * 1000,
]
