"""The pipeline on planted cases, stage by stage against plain Python."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
from llm_cases import DOCS, make_docs, prose  # noqa: F401
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from strandline.llm import queries


@pytest.fixture(scope="module")
def names():
    return set(queries.queries())


def test_all_queries_are_registered(names):
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 14)) and len(names) == 13
    assert names | {"pipeline"} <= set(contract.queries())
    assert set(queries.oracle_sql()) <= names


@pytest.fixture
def planted(spark, tmp_path, prose):  # noqa: F811
    """A data directory, and the ids that are clean."""

    def lines(seed, n=4):
        return "\n".join(prose(1000 * seed + k, 40) for k in range(n))

    source = random.Random(4)
    clean = {i: lines(i) for i in range(30)}
    rows = dict(clean)
    rows |= {100: None, 101: "", 102: "too short", 103: "again and again " * 60}
    banner = "this banner of the site is on every page of it"
    for i in range(5):
        rows[i] = clean[i] + "\n" + banner
    rows |= {200: clean[20], 201: clean[22].replace(" ", "  ")}
    words = clean[21].split(" ")
    words[source.randrange(len(words))] = "changed"
    rows[202] = " ".join(words)
    passage = prose(77, 14)
    rows[300] = lines(300) + " " + passage.upper() + " " + prose(78, 10)
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in rows.items()], DOCS).write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    spark.createDataFrame([(1, passage), (2, prose(79, 20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows, clean, banner


def test_stages_take_effect_one_after_the_other(spark, planted):
    folder, rows, clean, banner = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, left = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
        path = f"{folder}/stage{k}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        left[name] = {r["doc_id"]: r for r in docs.collect()}
    quality, lined, near, decontaminated, encoded = left.values()
    assert set(rows) - set(quality) == {100, 101, 102, 103}
    assert set(lined) == set(quality), "a pair of copies is not a recurring line"
    assert lined[0]["text"].endswith(banner) and not any(banner in lined[i]["text"] for i in range(1, 5))
    assert all(lined[i]["text"] == clean[i] and lined[i]["n_chars"] == len(clean[i]) for i in range(1, 30))
    assert set(lined) - set(near) == {200, 201, 202}
    assert set(near) - set(decontaminated) == {300}
    assert set(decontaminated) == set(encoded) == set(clean)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, r in encoded.items():
        ids = library.encode(decontaminated[i]["text"], add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    again = corpus_pipeline.run(spark, folder)
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in again.collect()) == sorted((i, r["ids_sha256"]) for i, r in encoded.items())


@pytest.mark.parametrize("rows", [[], [(None, None)] * 2 + [(1, "")]])
def test_stages_with_nothing_to_do(spark, make_docs, planted, rows):  # noqa: F811
    docs = make_docs(rows, clashing=True)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, planted[0])
        assert out.columns == docs.columns, name
        assert out.count() == (0 if name == "quality rules" else len(rows)), name
