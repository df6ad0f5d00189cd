"""BPE, token counts and Re-Pair shards against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_cases import ODD, make_docs, prose  # noqa: F401
from tokenizers import Tokenizer

from strandline.llm import rank_bpe, repair, token_counts

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def texts():
    source = random.Random(3)
    letters = "aAbB'sS'LL<|endoftext|>  \n\t\x1c\x85　éÉÀç1234ΣσςİıßŒ漢字한글ȩ́!?.,_-🙂\x00\x7f½²ﬁ"
    return ODD + ["".join(source.choices(letters, k=source.randint(0, 60))) for _ in range(500)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_round_trip_equals_the_library(make_docs, texts):
    library = Tokenizer.from_file(WORD)
    docs = make_docs([*enumerate(texts), (None, "a"), (None, "a")], clashing=True)
    out = rank_bpe.round_trip(docs, WORD, carry=("doc_id", "text", "ids"), with_ids=True)
    rows = out.collect()
    assert len(rows) == len(texts) + 2 and out.columns[2] == "ids_in"
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids"]) == (len(ids), ids)
        assert (r["ids_sha256"], r["decoded_sha256"]) == (sha(" ".join(map(str, ids))), sha(decoded))


def test_scan_and_queue_merge_alike():
    merger = rank_bpe.coder(open(WORD, "rb").read()).merger
    source = random.Random(1)
    for _ in range(300):
        ids = [merger.within[c] for c in source.choices("etaoinshr", k=source.randint(1, 80))]
        assert merger._scan(list(ids)) == merger._queue(list(ids))


def test_missed_words_take_the_model_alone(texts):
    """Visible ASCII needs no whole encoding; its words are merged, and remembered, by themselves."""
    lengths = token_counts.Lengths(open(BYTE, "rb").read())
    encode, whole = lengths.library.encode, []

    class Watched:
        def encode(self, piece, **more):
            whole.append(piece)
            return encode(piece, **more)

    lengths.library = Watched()
    for text in [*texts, "He said: they'll pay $12,000.50 (it's 'so')! <|end a_b's"]:
        assert lengths.count(text or "") == len(encode(text or "", add_special_tokens=False).ids)
    assert whole and not any(piece.strip(" ") and piece.isascii() and piece.isprintable() for piece in whole)


def test_counts_equal_the_library(make_docs, texts):
    library = Tokenizer.from_file(BYTE)
    got = token_counts.token_counts(make_docs(list(enumerate(texts)), clashing=True), BYTE, limit=20).collect()
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["n_tokens"] for r in got} == want
    assert all(r["n_bytes"] == len((texts[r["doc_id"]] or "").encode()) and r["over_limit"] == (r["n_tokens"] > 20) for r in got)
    assert token_counts.token_counts(make_docs([]), BYTE).count() == 0


def test_packed_ids_are_merged_by_the_library(texts):
    """Re-Pair encodes with the library; its words are not merged again in Python."""
    words = rank_bpe.WordCoder(open(WORD, "rb").read())
    library = Tokenizer.from_file(WORD)
    for text in texts:
        text = text or ""
        got = np.frombuffer(words.packed_ids(text), "<u4").tolist()
        assert got == library.encode(text, add_special_tokens=False).ids
    assert "merger" not in vars(words)


def test_texts_reach_workers_in_small_batches(spark, make_docs):
    """A batch of texts is bounded in bytes, whatever the session came with."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    docs = make_docs(list(enumerate(["word " * 100_000] * 40)))
    rank_bpe.round_trip(docs, WORD)
    sizes = docs.coalesce(1).mapInArrow(lambda batches: (b.select(["doc_id"]).slice(0, 1) for b in batches), "doc_id long").count()
    assert sizes > 1


def test_caches_keep_what_is_used(monkeypatch):
    made = []
    cache = rank_bpe.Remembered(lambda k: made.append(k) or k, 3)
    for round_ in range(20):
        cache.turn()
        assert [cache[k] for k in ("often", round_)] == ["often", round_]
    assert made.count("often") == 1 and len(cache) + len(cache.older) < 10


def documents_of(seed, n):
    source = np.random.default_rng(seed)
    phrases = [source.integers(0, 49_000, k) for k in source.integers(1, 12, 60)]
    return [np.concatenate([*(phrases[i] for i in source.integers(0, 60, source.integers(0, 40))), [1]]).astype(np.uint32) for _ in range(n)]


def test_a_vocabulary_beyond_the_format_is_an_error():
    ids = np.array([70_000, 70_001, 1], np.uint32)
    with pytest.raises(ValueError, match="65536"):
        repair.compress(ids, np.array([3], np.int64), 70_002)
    assert repair.Shard(repair.compress(ids % 65_536, np.array([3], np.int64), 65_536)).all().tolist() == [4464, 4465, 1]


@pytest.mark.parametrize("docs", [documents_of(1, 300), [np.array([1], np.uint32)], [np.array([5] * 5001, np.uint32)], []])
def test_shards_give_back_all_ranges(docs):
    ids = np.concatenate(docs) if docs else np.empty(0, np.uint32)
    stored = repair.compress(ids, np.array([len(d) for d in docs], np.int64), 49_408)
    shard = repair.Shard(stored)
    assert (shard.all() == ids).all()
    assert all((shard.document(k) == d).all() for k, d in enumerate(docs))
    source = random.Random(2)
    for _ in range(50 if len(ids) else 0):
        a = source.randrange(len(ids))
        b = source.randrange(a, len(ids) + 1)
        assert (shard.ids(a, b) == ids[a:b]).all()
    if len(docs) > 100:
        assert len(shard.symbols) < 0.5 * len(ids), "phrases are found"
        for rule, size in zip(shard.rules, shard.expansions):
            assert size == len(shard._expanded(rule))


def test_offsets_and_checksums_over_many_shards(make_docs, texts):
    library = Tokenizer.from_file(WORD)
    rows = [(1000 - i, t) for i, t in enumerate(texts)] + [(None, "null id"), (5, "tie"), (5, "tie")]
    shards = repair.write_shards(make_docs(rows, clashing=True), WORD, end_id=1, shard=200)
    assert shards.count() > 10
    got = repair.documents_in(shards).collect()
    assert len(got) == len(rows)
    by_start = sorted(got, key=lambda r: r["start"])
    assert [r["id"] for r in by_start] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    at = 0
    for r in by_start:
        assert r["start"] == at
        at += r["n_tokens"]
    texts_of = {1000 - i: t for i, t in enumerate(texts)}
    for r in got:
        if r["id"] in texts_of:
            ids = library.encode(texts_of[r["id"]] or "", add_special_tokens=False).ids + [1]
            assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_no_documents_no_shards(make_docs):
    assert repair.documents_in(repair.write_shards(make_docs([]), WORD, end_id=1)).count() == 0
