"""Multiset fingerprints against plain Python."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from llm_cases import ODD, make_docs, prose  # noqa: F401
from pyspark.sql import functions as F

from strandline.llm import multiset as M

MASK = (1 << 32) - 1


def vector(paragraph):
    lanes = []
    for k in range(M.LANES // 8):
        digits = hashlib.sha256(f"{k}:{paragraph}".encode()).hexdigest()
        lanes += [int(digits[8 * j : 8 * j + 8], 16) for j in range(8)]
    return [(v & 0xFFFF0002) - 1 for v in lanes]


def plain(text):
    total = [0] * M.LANES
    for p in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", p):
            total = [(a + b) & MASK for a, b in zip(total, vector(p))]
    return total


def digits(lanes):
    return "".join(f"{x:08x}" for x in lanes)


def like(a, b):
    if a == b:
        return 1.0
    x, y = ([v - 65536 if v >= 32768 else v for v in (w & 0xFFFF for w in lanes)] for lanes in (a, b))
    if not any(a) or not any(b):
        return 0.0
    dot = lambda p, q: sum(i * j for i, j in zip(p, q))
    return max(0.0, min(1.0, 2.0 * dot(x, y) / (dot(x, x) + dot(y, y))))


def expected(rows):
    key = lambda r: hashlib.sha256((f"={r[0]}" if r[0] is not None else "null").encode() + b"\n" + (r[1] or "").encode()).digest()
    order = sorted({(r[0] is None, r[0] or 0, key(r), r[1] or "", r[0]) for r in rows})
    following = {order[i][2]: order[(i + 1) % len(order)] for i in range(len(order))}
    out = []
    for r in rows:
        text, other = r[1] or "", following[key(r)]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[3][:half]
        a, b, c = plain(text), plain(edited), plain(other[3])
        out.append((r[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), digits(a), digits(b), like(a, b), like(a, c), other[4]))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def lined(source, n):
    return "\n".join(" ".join(source.choices("ab cd é 🙂 xyz".split(), k=source.randint(0, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    source = random.Random(4)
    texts = ODD + [lined(source, source.randint(1, 12)) for _ in range(40)]
    found = [(source.randrange(-50, 90), t) for t in texts]  # some ids have several texts
    return found + [(None, "no id\nat all"), (None, None)] + [(5, "copy\nof a row")] * 60


def test_equals_plain_python(make_docs, rows):
    found = M.fingerprints(make_docs(rows, clashing=True).repartition(7))
    assert found.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "next_id"]
    assert rows_of(found) == expected(rows)


def test_one_document_follows_itself_and_none_give_none(make_docs):
    assert rows_of(M.fingerprints(make_docs([(1, "a\nb c d")]))) == expected([(1, "a\nb c d")])
    assert M.fingerprints(make_docs([])).collect() == []
    same = [(1, "all\nrows alike")] * 30
    assert rows_of(M.fingerprints(make_docs(same))) == expected(same)


def test_order_of_paragraphs_does_not_matter_but_their_number_does(spark):
    df = spark.createDataFrame([("a\nb\nb\n\nc", "c\n \nb\na\nb", "a\nb\nc")], "x string, y string, z string")
    x, y, z = df.select(*[M.hexadecimal(M.fingerprint(F.col(c))) for c in "xyz"]).first()
    assert x == y != z


def test_insert_delete_and_unite(spark):
    df = spark.createDataFrame([("a\nb", "c\nd\nd", "d\na\nb\nc\nd")], "x string, y string, whole string")
    x, y, whole = (M.fingerprint(F.col(c)) for c in ("x", "y", "whole"))
    row = df.select(
        (M.inserted(x, F.col("y")) == whole).alias("insert"),
        (M.deleted(whole, F.col("x")) == y).alias("delete"),
        (M.united(x, y) == whole).alias("unite"),
        (M.deleted(x, F.col("x")) == M.nothing()).alias("all"),
    ).first()
    assert all(row)


def test_likeness_follows_the_shared_paragraphs(spark):
    source = random.Random(9)
    lines = ["".join(source.choices("abcdefgh", k=20)) for _ in range(60)]
    pairs = [("\n".join(lines[:30]), "\n".join(lines[30 - k : 60 - k])) for k in (0, 10, 20, 30)]
    df = spark.createDataFrame(pairs, "x string, y string")
    found = [r[0] for r in df.select(M.likeness(M.fingerprint(F.col("x")), M.fingerprint(F.col("y")))).collect()]
    assert found[3] == 1.0
    assert all(abs(f - e) < 0.25 for f, e in zip(found, (0, 1 / 3, 2 / 3, 1)))


def test_likeness_of_extreme_lanes(spark):
    low = f"array_repeat({-(1 << 31)}, {M.LANES})"
    df = spark.range(1).select(F.expr(low).alias("x"), M.nothing().alias("zero"), F.array_repeat(F.lit(1), M.LANES).alias("one"))
    found = df.select(M.likeness(F.col("x"), F.col("one")), M.likeness(F.col("x"), F.col("zero")), M.likeness(F.col("one"), F.col("one"))).first()
    assert tuple(found) == (0.0, 0.0, 1.0)


def test_very_long_text(make_docs):
    rows = [(1, "z" * 5_000_000), (2, "w\n" * 20_000), (3, "a\nb")]
    assert rows_of(M.fingerprints(make_docs(rows))) == expected(rows)


def test_plan_has_no_python_and_shares_the_exchange_of_texts(make_docs, rows):
    found = M.fingerprints(make_docs(rows))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
