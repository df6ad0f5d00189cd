"""Near-duplicates and connected components."""

from __future__ import annotations

import random
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import ODD, make_docs, prose  # noqa: F401
from pyspark.sql import functions as F

from strandline.llm import prob_minhash as P
from strandline.llm.components import components
from strandline.llm.hashing import hash_words, words_of_texts


def shingles(text):
    w = (text or "").encode().lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    """The larger of the set and the probability Jaccard similarity, by their definitions."""
    sets = len(a.keys() & b.keys()) / len(a.keys() | b.keys())
    if max(*a.values(), *b.values()) == 1:
        return sets
    every = a.keys() | b.keys()
    return max(sets, sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in every) for i in a.keys() & b.keys()))


def brute_links(rows):
    sets = [shingles(t) for _, t in rows]
    return [
        (i, j) for i in range(len(rows)) for j in range(i)
        if sets[i] and sets[j] and sets[i].keys() & sets[j].keys() and similarity(sets[i], sets[j]) >= 0.8 - 1e-9
    ]


def brute_classes(rows):
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in brute_links(rows):
        label[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    return {i: min(g) for g in groups.values() for i in g}


def changed(text, seed, share):
    source = random.Random(seed)
    return " ".join(f"new{source.random()}" if source.random() < share else w for w in text.split())


def test_word_hashes_do_not_depend_on_where_a_word_is():
    texts = [b"one two  three", b"", b"two\nthree one", b" one"]
    hashes, begin = words_of_texts(texts)
    assert list(begin) == [0, 3, 3, 6, 7]
    one, two, three = hashes[:3]
    assert list(hashes[3:]) == [two, three, one, one] and len({one, two, three}) == 3


def test_long_buffers_are_hashed_in_slices():
    text = b" ".join(b"word%d" % i for i in range(300_000))
    hashes, starts = hash_words(text)
    again, _ = hash_words(text[starts[250_000] : starts[250_000] + 50])
    assert len(hashes) == 300_000 and hashes[250_000] == again[0]
    assert len(np.unique(hashes)) == 300_000


def test_signatures_estimate_probability_jaccard():
    random_ = np.random.default_rng(5)
    common, a, b = (random_.integers(0, 1 << 63, n).astype(np.uint64) for n in (600, 200, 200))
    sets = [np.sort(np.concatenate([common, x])) for x in (a, b)]
    hashes, text = np.concatenate(sets), np.repeat([0, 1], 800)
    registers = P.signatures(hashes, text, np.ones(1600), 2, 4096)
    assert abs((registers[0] == registers[1]).mean() - 0.6) < 0.04
    weights = np.where(np.isin(hashes, common), 3.0, 1.0)
    registers = P.signatures(hashes, text, weights, 2, 4096)
    assert abs((registers[0] == registers[1]).mean() - 1800 / 2200) < 0.04


def test_classes_equal_brute_force(make_docs, prose):
    rows = [(i, prose(i, 40 + i)) for i in range(12)]
    rows += [(100 + i, changed(prose(3, 150), i, 0.01)) for i in range(8)]
    rows += [(200 + i, changed(prose(4, 120), i, 0.04)) for i in range(30)]  # links only between some
    rows += [(300, rows[2][1]), (301, rows[2][1].replace(" ", "\n")), (302, "Ab cd"), (303, "aB  CD"), (304, "ab")]
    rows += [(400 + i, prose(60, 60) + " " + prose(61 + i, 60)) for i in range(6)]  # a shared passage is no copy
    got = {r["doc_id"]: r["class_id"] for r in P.near_duplicates(make_docs(rows)).collect()}
    assert got == brute_classes(rows)


def test_copies_that_differ_only_in_repetitions_are_linked(make_docs, prose):
    rows = []
    for i in range(16):
        words = prose(500 + i, 104).split()
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:24] * 64 + words[24:]))]
        assert len(shingles(rows[-2][1])) == 100 and len(shingles(rows[-1][1])) == 104
    got = {r["doc_id"]: r["class_id"] for r in P.near_duplicates(make_docs(rows)).collect()}
    assert got == brute_classes(rows) == {i: i - i % 2 for i in range(32)}


def test_copies_that_differ_only_in_weights_are_linked(make_docs, prose):
    """Alike by their weights: most of both is one passage, repeated; their sets are not alike."""
    rows = []
    for i in range(10):
        passage = prose(700 + i, 30)
        rows += [(2 * i + k, " ".join([passage] * 40) + " " + prose(800 + 2 * i + k, 40)) for k in (0, 1)]
        a, b = (shingles(t) for _, t in rows[-2:])
        assert len(a.keys() & b.keys()) < 0.8 * len(a.keys() | b.keys())
    got = {r["doc_id"]: r["class_id"] for r in P.near_duplicates(make_docs(rows)).collect()}
    assert got == brute_classes(rows) == {i: i - i % 2 for i in range(20)}


def test_weights_reach_the_signatures(prose):
    texts = [prose(1, 80).encode(), (prose(1, 80) + " " + prose(2, 5)).encode() * 3]
    hashes, text, counts = P.distinct(*P.shingles(*words_of_texts(texts), 5))
    assert set(counts[text == 0]) == {1} and max(counts[text == 1]) > 1
    policy = P.NearPolicy()
    batch = pa.RecordBatch.from_pydict({"node": [b"a", b"b"], "first": [1, 2], "t": [t.decode() for t in texts]})
    (out,) = P._signed(policy)(iter([batch]))
    plain, twice = (np.array(k) for k in out.column("keys").to_pylist())
    assert len(plain) == policy.bands and len(twice) == 2 * policy.bands
    assert (twice[: policy.bands] != twice[policy.bands :]).any()


@pytest.mark.parametrize("seed", range(5))
def test_probability_jaccard_equals_its_definition(seed):
    source = random.Random(seed)
    a, b = (Counter(source.choices(range(1, 12), k=source.randint(1, 40))) for _ in "ab")
    if a.keys() & b.keys():
        arrays = [x for c in (a, b) for x in (np.array(sorted(c), np.uint64), np.array([c[k] for k in sorted(c)]))]
        every = a.keys() | b.keys()
        expected = sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in every) for i in a.keys() & b.keys())
        assert abs(P.probability_jaccard(*arrays) - expected) < 1e-12
        shared = sorted(a.keys() & b.keys())
        x, y = (np.array([c[i] / sum(c.values()) for i in shared]) for c in (a, b))
        bound = P.probability_bound(np.zeros(len(shared), int), x, y, 1)[0]
        assert expected - 1e-12 <= bound <= np.minimum(x, y).sum() + 1e-12


def hot_bucket(prose, n):
    """Texts around one text, most of them too far from each other to be linked, with pairs that are."""
    rows = []
    for i in range(n):
        text = changed(prose(4, 150), i, 0.06)
        rows.append((2 * i, text))
        if i % 4 == 0:
            rows.append((2 * i + 1, changed(text, 10_000 + i, 0.008)))
    return rows


def test_a_hot_bucket_keeps_its_links(make_docs, prose):
    """Proposals are linear in the members; of the exact links, 0.9 or more are inside a class."""
    rows = hot_bucket(prose, 400)
    ids = [r[0] for r in rows]
    links = brute_links(rows)
    got = {r["doc_id"]: r["class_id"] for r in P.near_duplicates(make_docs(rows)).collect()}
    recall = sum(got[ids[i]] == got[ids[j]] for i, j in links) / len(links)
    print(f"recall of {len(links)} links among {len(rows)} texts of one bucket: {recall:.3f}")
    assert len(links) >= 80 and recall >= 0.9


def test_a_round_has_no_more_pairs_than_bucket_entries(spark, make_docs, prose):
    """Every member of a bucket meets its representative, never all the others."""
    near = P.NearDuplicates(make_docs(hot_bucket(prose, 200)))
    seen = []
    within = near._links
    near._links = lambda pairs, sets: (seen.append([tuple(r) for r in pairs.collect()]), within(pairs, sets))[1]
    nodes = near._nodes()
    near.labels(nodes)
    entries = sum(len(r["keys"]) for r in nodes.collect())
    assert len(seen) == 1 + near.policy.rounds
    for turn, pairs in enumerate(seen):
        # in further rounds a node is in refined buckets as well, as many as it has others
        assert len(set(pairs)) == len(pairs) <= entries * (1 if turn == 0 else 2)
        assert all(a != b for a, b in pairs)


def test_recall_on_given_documents(spark):
    folder = "/root/testdata/sf0.01/documents.parquet"
    if not Path(folder).exists():
        pytest.skip("test tables not present")
    docs = spark.read.parquet(folder)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets = [shingles(t) for _, t in rows]
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    meets = Counter((i, j) for h in holders.values() for k, i in enumerate(h) for j in h[:k])
    # 0.4 shared of the smaller set is the least that either similarity of 0.8 could come from without weights
    links = [(i, j) for (i, j), n in meets.items() if n >= 0.4 * min(len(sets[i]), len(sets[j])) and similarity(sets[i], sets[j]) >= 0.8]
    found = {r["doc_id"]: r for r in P.near_duplicates(docs.select("doc_id", "text")).collect()}
    recall = sum(found[rows[i][0]]["class_id"] == found[rows[j][0]]["class_id"] for i, j in links) / max(len(links), 1)
    print(f"recall of {len(links)} links on sf0.01: {recall:.4f}")
    assert links and recall >= 0.99


def test_odd_texts_and_survivors(make_docs, prose):
    rows = [*enumerate(ODD), (50, prose(1, 60)), (49, prose(1, 60)), (None, prose(1, 60)), (49, prose(1, 60)), (60, None)]
    docs = make_docs(rows, clashing=True)
    got = sorted((r["doc_id"] is None, r["doc_id"], r["class_id"]) for r in P.near_duplicates(docs).collect() if r["doc_id"] is not None)
    assert len(got) == len(rows) - 1 and all(c == (49 if i in (49, 50) else i) for _, i, c in got)
    kept = P.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(len(ODD)), 49, 60]
    assert P.near_duplicates(make_docs([])).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_brute_force(spark, seed):
    source = random.Random(seed)
    links = [(source.randrange(60), source.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
    label = {}
    for a, b in links:
        label.setdefault(a, {a}), label.setdefault(b, {b})
        if label[a] is not label[b]:
            label[a] |= label[b]
            for n in label[b]:
                label[n] = label[a]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[n] in members for n, members in label.items() if len(members) > 1)
    for members in label.values():
        if len(members) > 1:
            assert len({got[n] for n in members}) == 1
    groups = {frozenset(m) for m in label.values() if len(m) > 1}
    assert len({got[n] for m in groups for n in m}) == len(groups)


def ring_of_hot_texts(prose, n):
    """Texts around one text, each with one that is just alike enough to it: a bucket of many classes."""
    rows = []
    for i in range(n):
        text = changed(prose(4, 150), i, 0.05)
        rows += [(2 * i, text), (2 * i + 1, changed(text, 10_000 + i, 0.02))]
    return rows


def test_a_bucket_of_many_classes_loses_no_link(make_docs, prose):
    """No further round, so all but the links to the first members are left to the exact rest."""
    rows = ring_of_hot_texts(prose, 40)
    rows += [(1000 + i, f"{t} " + " ".join([prose(900, 12)] * 3)) for i, t in rows[:6]]  # with weights
    policy = P.NearPolicy(rounds=0, block_texts=16)
    got = {r["doc_id"]: r["class_id"] for r in P.near_duplicates(make_docs(rows), policy=policy).collect()}
    assert got == brute_classes(rows)


def test_the_filter_keeps_all_that_is_asked_for(spark):
    docs = spark.range(3000).select(F.md5(F.col("id").cast("string")).alias("k"), "id")
    some = docs.filter("id % 7 = 0").select("k")
    kept = {r["id"] for r in P.maybe_in(docs, some, "k").collect()}
    assert {i for i in range(3000) if i % 7 == 0} <= kept and len(kept) < 450
    assert P.maybe_in(docs, some.limit(0), "k").count() == 0
