"""Fill-in-middle against plain Python, and restored from output and form alone."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from llm_cases import ODD, make_docs, prose  # noqa: F401

from strandline.llm import infill

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(doc_id, text):
    """(n, form, prefix, middle, output)"""
    text = text or ""
    units = UNITS.findall(text)
    assert "".join(units) == text
    digest = sha(f"42:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h[3] % 100 < 80:
        return n, "spm", prefix, middle, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", prefix, middle, f"<P>{prefix}<S>{suffix}<M>{middle}"


def expected(rows):
    out = []
    for doc_id, text in rows:
        n, form, prefix, middle, output = plain(doc_id, text)
        chars = [None if x is None else len(x) for x in (prefix, middle)]
        out.append((doc_id, n, form, *chars, sha(output), sha(text or "")))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    source = random.Random(5)
    letters = "ab<P><S>MP<>é🙂 \n\t\x0b\x1c\x85　"
    texts = ODD + ["".join(source.choices(letters, k=source.randint(0, 80))) for _ in range(150)]
    found = [(10 * i + k, t) for i, t in enumerate(texts) for k in range(4)]
    return found + [(None, "one two three"), (None, None), (7, "other text of id 7"), (7, "")] + [(11, "copy of a row")] * 40


def test_digests_equal_plain_python(make_docs, rows):
    docs = make_docs(rows, clashing=True).repartition(6)
    found = infill.fill_in_middle(docs)
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert rows_of(found) == expected(rows)
    assert {r[2] for r in expected(rows)} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("chunk", [1, 2, 3, 50])
def test_sentinels_across_small_pieces(make_docs, rows, chunk):
    some = rows[::7]
    found = infill.fill_in_middle(make_docs(some), policy=infill.InfillPolicy(chunk=chunk))
    assert rows_of(found) == expected(some)


def test_outputs_are_the_rearranged_texts(make_docs, rows):
    found = infill.outputs(make_docs(rows))
    assert rows_of(found) == sorted(((d, *(p := plain(d, t))[:2], p[4]) for d, t in rows), key=repr)


def test_very_long_texts_travel_in_pieces(make_docs):
    blank, words = "x" * 5_000_000, "word " * 800_000
    rows = [(i, t) for i in range(6) for t in (blank, words)]
    docs = make_docs(rows)
    pieces = infill.output_pieces(docs)
    longest = pieces.selectExpr("max(octet_length(piece)) AS n").first()["n"]
    assert longest <= infill.InfillPolicy().chunk + 3
    assert rows_of(infill.fill_in_middle(docs)) == expected(rows)


def test_no_documents(make_docs):
    assert infill.fill_in_middle(make_docs([])).collect() == []
    assert infill.outputs(make_docs([])).collect() == []


def test_one_exchange(make_docs):
    plan = infill.fill_in_middle(make_docs([(1, "a b")]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
