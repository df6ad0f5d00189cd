"""The inverted label index: same rows as the filters, and which files are read."""

from __future__ import annotations

import importlib
import sys

import pytest
from conftest import pivot_row
from pyspark.sql import functions as F

from strandline import schema as S
from strandline.operators.label_index import LabelIndex
from strandline.sources.workspace import Workspace

PARTS = 16


@pytest.fixture(scope="module")
def pivots(make_corpus):
    rows = [
        pivot_row(
            ("future", "past")[i % 2], (0.3, 0.5)[i % 3 % 2], 1000 + i,
            emerging=[f"t{i // 10}", "common"], stable=["red", None, "red"] if i == 77 else [f"s{i % 7}"],
            decaying=None if i % 11 == 0 else [], specific=["rare"] if i in (5, 300) else [],
        )
        for i in range(400)
    ]
    return make_corpus(pivots=rows + [rows[5]]).pivots()


@pytest.fixture(scope="module")
def index(spark, pivots):
    return LabelIndex.build(pivots, Workspace(spark), "index", parts=PARTS)


def rows_of(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("term", ["rare", "red", "common", "t3", "s2", "nowhere"])
def test_rows_equal_those_of_the_filter(index, pivots, term):
    any_kind = F.lit(False)
    for kind in S.LABEL_KINDS:
        any_kind = any_kind | F.coalesce(F.array_contains(kind, F.lit(term)), F.lit(False))
    assert rows_of(index.rows_with(term)) == rows_of(pivots.filter(any_kind))
    assert index.rows_with(term).columns == pivots.columns
    found = pivots.filter(F.array_contains("emerging", F.lit(term)))
    assert rows_of(index.rows_with(term, "emerging")) == rows_of(found)


def test_only_matching_parts_are_read(index):
    """Rows come from as many files as there are parts with the term."""
    every = len(index.rows.inputFiles())
    assert every == PARTS
    for term, most in (("rare", 2), ("red", 1), ("t3", 2), ("nowhere", 0)):
        parts = index.parts_with([term])
        assert len(parts) <= most
        read = index.rows_with(term).select(F.input_file_name().alias("file")).distinct().count()
        assert read == len(parts)
        plan = index.rows_with(term)._jdf.queryExecution().toString()
        assert not parts or "PartitionFilters: [" in plan and "part#" in plan
    assert len(index.parts_with(["common"])) == PARTS


def test_ids_come_from_the_postings_alone(index, pivots):
    terms = ["t1", "rare", "s3"]
    condition = F.lit(False)
    for kind in ("emerging", "specific"):
        condition = condition | F.coalesce(F.arrays_overlap(kind, F.array(*map(F.lit, terms))), F.lit(False))
    found = index.ids(terms, ["emerging", "specific"])
    assert rows_of(found) == rows_of(pivots.filter(condition).select("direction", "beta", "topic_id").distinct())
    assert all("index_postings" in f for f in found.inputFiles())


def test_counts_and_conjunctions(index, pivots):
    counts = {(r["term"], r["kind"]): r["postings"] for r in index.counts().collect()}
    assert counts["common", "emerging"] == 400 and counts["rare", "specific"] == 2 and counts["red", "stable"] == 1
    both = pivots.filter("array_contains(emerging, 't7') AND array_contains(stable, 's2')")
    assert both.count() > 0
    assert rows_of(index.rows_with_all(emerging="t7", stable="s2")) == rows_of(both)
    assert index.rows_with_all(emerging="t7", stable="nowhere").count() == 0
    assert rows_of(index.rows_with_all()) == rows_of(pivots)


def test_an_empty_table(spark, make_corpus):
    index = LabelIndex.build(make_corpus().pivots(), Workspace(spark), "index", parts=4)
    assert index.rows_with("a").count() == 0 and index.ids(["a"]).count() == 0 and index.counts().count() == 0


def test_entry_works_without_the_text_operators(monkeypatch):
    """Whatever they need may be missing: the other queries are still there."""
    saved = {name: sys.modules.pop(name) for name in list(sys.modules) if name.startswith(("strandline.llm", "corpus_pipeline", "__spark_entry__"))}
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)
    try:
        entry = importlib.import_module("__spark_entry__")
        names = set(entry.queries())
        assert "f_contains" in names and "pipeline" not in names and not any(n.startswith("op") for n in names)
        assert set(entry.oracle_sql()) <= names
    finally:
        for name in list(sys.modules):
            if name.startswith(("strandline.llm", "corpus_pipeline", "__spark_entry__")):
                del sys.modules[name]
        sys.modules.update(saved)
