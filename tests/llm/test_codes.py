"""Vector codes against plain Python."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from strandline.llm import walsh_codes as W

VECTORS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
        T.StructField("code", T.StringType()),
        T.StructField("v", T.StringType()),
        T.StructField("c0", T.StringType()),
    ]
)


@pytest.fixture
def table(spark):
    return lambda rows: spark.createDataFrame([(*r, "x", "y", "z") for r in rows], VECTORS)


def plain(rows, policy):
    """The same codes, distances taken one by one."""
    sound = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not sound:
        return []
    longest = max(len(r[1]) for r in sound)
    dimension = -(-longest // policy.parts) * policy.parts
    width = dimension // policy.parts
    whole = [[math.floor(policy.scale * float(np.float32(x))) for x in r[1]] + [0] * (dimension - len(r[1])) for r in sound]
    order = sorted(range(len(sound)), key=lambda i: (sound[i][0] is None, sound[i][0] or 0, [float(np.float32(x)) for x in sound[i][1]]))
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(whole[i], p) for i in order[: policy.entries]] for p in range(policy.parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(policy.rounds):
        for p, book in enumerate(books):
            members = {}
            for v in whole:
                members.setdefault(nearest(cut(v, p), book)[1], []).append(cut(v, p))
            for k, parts in members.items():
                book[k] = [sum(c) // len(parts) for c in zip(*parts)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[nearest(cut(v, p), books[p]) for p in range(policy.parts)] for v in whole]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for r, e in zip(sound, errors):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    return sorted(
        ((r[0], "".join(f"{k:02x}" for _, k in f), e, by_label[r[2]], digest) for r, f, e in zip(sound, found, errors)), key=repr
    )


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_transform_multiplies_distances_and_is_in_sequency_order():
    x = np.random.default_rng(1).integers(-999, 999, (20, 13))
    t = W.transformed(x)
    assert t.shape == (20, 16)
    assert ((t[0] - t[1]) ** 2).sum() == 16 * ((x[0] - x[1]) ** 2).sum()
    signs = W.walsh_hadamard(np.eye(16, dtype=np.int64))[W.sequency_order(16)]
    assert [(a[1:] != a[:-1]).sum() for a in signs] == list(range(16))


@pytest.mark.parametrize("width", [1, 2, 3, 16])
def test_nearest_equals_every_distance_with_ties(width):
    source = np.random.default_rng(width)
    entries = source.integers(-4, 4, (40, width))
    entries[7] = entries[3]
    parts = source.integers(-4, 4, (300, width))
    index, distance = W.nearest(W.transformed(parts), W.transformed(entries))
    whole = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (index == whole.argmin(axis=1)).all()
    assert (distance == W.padded(width) * whole.min(axis=1)).all()


def test_codes_equal_plain_python(table):
    source = random.Random(2)
    vector = lambda n=8: [source.uniform(-1, 1) for _ in range(n)]
    rows = [(source.randrange(300), vector(), source.choice([None, 1, 2])) for _ in range(150)]
    same = vector()
    rows += [(7, same, 1)] * 3 + [(1000 + i, same, 3) for i in range(120)]  # repeated rows, a very common vector
    rows += [(None, vector(), 1), (3, None, 1), (4, [], None), (5, vector(6), 2), (6, vector()[:7] + [None], 2)]
    rows += [(8, [math.nan] + vector(7), 2), (9, [math.inf] + vector(7), 2), (10, [-math.inf] + vector(7), 2)]
    policy = W.CodePolicy(entries=16)
    found = W.vector_codes(table(rows).repartition(5), policy=policy)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert rows_of(found) == plain(rows, policy)


def test_fewer_rows_than_entries_and_none(table):
    rows = [(2, [0.5] * 8, None), (1, [0.25] * 8, None)]
    assert rows_of(W.vector_codes(table(rows))) == plain(rows, W.CodePolicy())
    assert W.vector_codes(table([])).collect() == []
    assert W.vector_codes(table([(1, None, 1), (2, [None], 1)])).collect() == []


def test_components_that_would_leave_64_bits_fail(table):
    with pytest.raises(Exception, match="64 bits"):
        W.vector_codes(table([(1, [1e9] * 8, 1), (2, [0.0] * 8, 1)])).collect()
