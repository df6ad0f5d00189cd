"""Near-duplicates by ProbMinHash signatures of weighted shingles.

Each shingle of a text sends out arrivals of a Poisson process whose rate is its
weight, the number of times it occurs; each arrival falls on a random register, which
remembers the shingle of its earliest one.  A shingle stops once its next arrival comes
later than the latest register of the text.  Two texts agree in a register with a
probability equal to the probability Jaccard of their weighted shingles.

A text that repeats shingles has a second signature with all weights one, so that a
text and one that repeats a passage of it meet as well.  (A text without repetitions
has one signature, which is both.)  Two texts are linked if the probability Jaccard of
their weighted shingles, or the Jaccard similarity of the sets, is large enough.

Bands of registers make buckets, the members of a bucket are compared with one of them
at a time, and exact similarities of the shingles decide.  Where that leaves a bucket
with several classes, all pairs of them are compared.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.components import merged, with_names
from strandline.llm.hashing import LOWER, mix, words_of_texts
from strandline.llm.scratch import discard, exactly, keep, pieces, ship, unused

NOTHING = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class NearPolicy:
    """A pair with the least similarity shares no band with probability
    (1 - similarity^rows)^bands, 2e-5 by default."""

    width: int = 5
    similarity: float = 0.8
    bands: int = 36
    rows: int = 6
    #: Further rounds of proposals after the first one; a round that links nothing is the last.
    rounds: int = 1
    #: What is left is compared in blocks of about so many texts, or shingles if that is less.
    block_texts: int = 512
    block_shingles: int = 1 << 20

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def shingles(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, text by text, and where each text begins.

    A text with fewer words, but not none, has one shingle of all its words.
    """
    counts = np.diff(first)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    begin = np.concatenate([[0], np.cumsum(n)])
    text = np.repeat(np.arange(len(n)), n)
    at = first[text] + np.arange(begin[-1]) - begin[text]
    hashes = np.zeros(begin[-1], np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            there = at + k < first[text + 1]
            word = np.where(there, words[np.minimum(at + k, max(len(words) - 1, 0))], np.uint64(k + 1)) if len(words) else hashes
            hashes = mix(hashes * _STEP + word)
    return hashes, begin


def distinct(hashes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, ascending, and how often each occurs: (hash, text, count)."""
    text = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return hashes[new], text[new], np.diff(np.append(at, len(hashes)))


def signatures(hashes: np.ndarray, text: np.ndarray, weights: np.ndarray, n_texts: int, registers: int) -> np.ndarray:
    """(n_texts, registers): 32 bits of the shingle that came first at each register.

    Arrivals are drawn for all shingles of all texts together, one further arrival of
    each in every round; a shingle whose arrival is later than the latest register of
    its text leaves.
    """
    state = np.full(n_texts * registers, NOTHING, np.uint64)
    time = np.zeros(len(hashes))
    base = text.astype(np.int64) * registers
    drawn = hashes.copy()
    while len(hashes):
        with np.errstate(over="ignore"):
            drawn = drawn + _STEP
        random = mix(drawn)
        time = time - np.log1p(-(random >> np.uint64(11)) * 2.0**-53) / weights
        register = (mix(random) >> np.uint64(32)).astype(np.int64) * registers >> 32
        arrival = time.astype(np.float32).view(np.uint32).astype(np.uint64)
        np.minimum.at(state, base + register, (arrival << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF)))
        latest = (state.reshape(n_texts, registers).max(axis=1) >> np.uint64(32))[text]
        stay = np.flatnonzero(arrival <= latest)
        hashes, text, weights, time, base, drawn = (x[stay] for x in (hashes, text, weights, time, base, drawn))
    return (state & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(n_texts, registers)


def band_keys(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n_texts, bands): a hash of the band's number and registers."""
    keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(registers), 1))
    cut = registers.reshape(len(registers), bands, rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(rows):
            keys = mix(keys * _STEP + cut[:, :, k])
    return keys


def _signed(policy: NearPolicy):
    """(node, first id, copies) and ``keys``: the band keys of the signature, or of both."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end in pieces(batch, "t"):
                part = batch.slice(first, end - first)
                texts = [t.encode().translate(LOWER) for t in part.column("t").to_pylist()]
                hashes, text, counts = distinct(*shingles(*words_of_texts(texts), policy.width))
                keys = _keys(hashes, text, np.ones(len(hashes)), len(texts), policy)
                # the second signature, of texts that repeat shingles
                again = np.zeros(len(texts), bool)
                again[text[counts > 1]] = True
                there = again[text]
                weighted = _keys(hashes[there], (np.cumsum(again) - 1)[text[there]], counts[there].astype(float), int(again.sum()), policy)
                rows = iter(weighted)
                lists = [np.concatenate([k, next(rows)]) if twice else k for k, twice in zip(keys, again)]
                begin = np.concatenate([[0], np.cumsum(policy.bands * (1 + again))]).astype(np.int32)
                flat = np.concatenate(lists) if lists else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.ListArray.from_arrays(begin, pa.array(flat, pa.int64()))], [*part.schema.names[:-1], "keys"]
                )

    return sign


def _keys(hashes: np.ndarray, text: np.ndarray, weights: np.ndarray, n_texts: int, policy: NearPolicy) -> np.ndarray:
    registers = signatures(hashes, text, weights, n_texts, policy.registers)
    return band_keys(registers, policy.bands, policy.rows).view(np.int64)


def _sets(policy: NearPolicy):
    """The distinct shingles of each text as bytes, and their counts if any is not one."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end in pieces(batch, "t"):
                part = batch.slice(first, end - first)
                texts = [t.encode().translate(LOWER) for t in part.column("t").to_pylist()]
                hashes, text, counts = distinct(*shingles(*words_of_texts(texts), policy.width))
                begin = np.searchsorted(text, np.arange(len(texts) + 1))
                spans = list(zip(begin, begin[1:]))
                sets = [hashes[a:b].tobytes() for a, b in spans]
                often = [counts[a:b].astype(np.uint32).tobytes() if (counts[a:b] > 1).any() else None for a, b in spans]
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), pa.array(sets, pa.binary()), pa.array(often, pa.binary())], ["node", "shingles", "counts"]
                )

    return build


def set_jaccard(one: np.ndarray, two: np.ndarray) -> float:
    both = np.concatenate([one, two])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / max(len(one) + len(two) - shared, 1)


def probability_jaccard(one: np.ndarray, a: np.ndarray, two: np.ndarray, b: np.ndarray) -> float:
    """Of shingles ``one`` with weights ``a`` and ``two`` with weights ``b``: the sum over
    shared shingles i of 1 / sum over all j of max(a_j / a_i, b_j / b_i).

    Which of the two is larger depends on the order of the quotients a_j / b_j alone,
    so sums over the shingles in that order give all of them.
    """
    _, at_one, at_two = np.intersect1d(one, two, assume_unique=True, return_indices=True)
    if not len(at_one):
        return 0.0
    a, b = a.astype(np.float64), b.astype(np.float64)
    x, y = a[at_one], b[at_two]
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    ratio = x / y
    first = np.searchsorted(ratio, ratio, "left")
    before = np.concatenate([[0.0], np.cumsum(y)])[first]
    after = x.sum() - np.concatenate([[0.0], np.cumsum(x)])[first]
    return float((1.0 / ((a.sum() - x.sum() + after) / x + (b.sum() - y.sum() + before) / y)).sum())


def _verify(similarity: float):
    """Keeps pairs that are similar enough as sets or by their weights."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = lambda counts, n: np.ones(n) if counts is None else np.frombuffer(counts, np.uint32)
        for batch in batches:
            links, last, one, one_counts = [], None, None, None
            for a, b, set_a, set_b, counts_a, counts_b in zip(*(batch.column(c) for c in ("a", "b", "set_a", "set_b", "counts_a", "counts_b"))):
                if (a := a.as_py()) != last:
                    last, one, one_counts = a, np.frombuffer(set_a.as_py(), np.uint64), counts_a.as_py()
                two, two_counts = np.frombuffer(set_b.as_py(), np.uint64), counts_b.as_py()
                alike = min(len(one), len(two)) >= similarity * max(len(one), len(two)) and set_jaccard(one, two) >= similarity - 1e-9
                if not alike and (one_counts is not None or two_counts is not None):
                    alike = probability_jaccard(one, weights(one_counts, len(one)), two, weights(two_counts, len(two))) >= similarity - 1e-9
                if alike:
                    links.append((a, b.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return verify


def _shared(hashes: np.ndarray, begin: np.ndarray, weights: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple]:
    """(text, column, x, y) for each text of ``left``: for every shingle that it shares with a
    text of ``right``, the place of that text there and the weights in both.

    Shingles of text t are ``hashes[begin[t]:begin[t + 1]]``, ascending.
    """
    size = np.diff(begin)
    text = np.repeat(np.arange(len(size)), size)
    place = np.full(len(size), -1)
    place[right] = np.arange(len(right))
    held = np.flatnonzero(place[text] >= 0)
    held = held[np.argsort(hashes[held], kind="stable")]
    sorted_hashes, column, weight = hashes[held], place[text[held]], weights[held]
    for t in left:
        mine = slice(begin[t], begin[t + 1])
        low, high = (np.searchsorted(sorted_hashes, hashes[mine], side) for side in ("left", "right"))
        n = high - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        yield t, column[at], np.repeat(weights[mine], n), weight[at]


def common(hashes: np.ndarray, begin: np.ndarray, left: np.ndarray, right: np.ndarray, width: int = 4096) -> np.ndarray:
    """(left, right): how many distinct shingles two texts share, by products of 0/1 matrices
    of ``width`` shingles at a time; a shingle of one text alone has no column."""
    text = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    _, column, often = np.unique(hashes, return_inverse=True, return_counts=True)
    number = np.cumsum(often > 1) - 1
    some = often[column] > 1
    text, column = text[some], number[column[some]]
    order = np.argsort(column, kind="stable")
    text, column = text[order], column[order]
    shared = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        at = slice(*np.searchsorted(column, [first, first + width]))
        there = np.zeros((len(begin) - 1, width), np.float32)
        there[text[at], column[at] - first] = 1
        shared += there[left] @ there[right].T
    return np.rint(shared).astype(np.int64)


def probability_bound(column: np.ndarray, x: np.ndarray, y: np.ndarray, texts: int) -> np.ndarray:
    """No less than the probability Jaccard of a text and each of ``texts`` others, from the
    shares of the weights of what they share (see ``_shared``).

    What only one of the two has is summed as it is; of the rest a sum of maxima is no less
    than either sum.  With equal weights this is the Jaccard similarity of the sets.
    """
    only_x, only_y = (np.maximum(1.0 - np.bincount(column, w, minlength=texts), 0.0)[column] for w in (x, y))
    return np.bincount(column, np.minimum(1.0 / (1.0 / x + only_y / y), 1.0 / (only_x / x + 1.0 / y)), minlength=texts)


def _compare(similarity: float):
    """All links between texts of different classes in a pair of blocks of a bucket.

    The probability Jaccard is worked out where its bound does not rule it out.
    """

    def compare(table: pa.Table) -> pa.Table:
        node, label, block = (table.column(c).to_numpy() for c in ("node", "label", "block"))
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        often = table.column("counts").to_pylist()
        counts = [np.ones(len(s)) if c is None else np.frombuffer(c, np.uint32).astype(float) for s, c in zip(sets, often)]
        begin = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        weights = np.concatenate([c / max(c.sum(), 1) for c in counts])
        size, repeats = np.diff(begin), np.array([c is not None for c in often])
        within = block.min() == block.max()
        right = np.arange(len(node)) if within else np.flatnonzero(block == block.max())
        left = right if within else np.flatnonzero(block == block.min())
        links = []
        flat = np.concatenate(sets)
        both = common(flat, begin, left, right)
        other = label[left][:, None] != label[right]
        if within:
            other &= node[left][:, None] < node[right]
        alike = both / np.maximum(size[left][:, None] + size[right] - both, 1) >= similarity - 1e-9
        links += [(node[left[i]], node[right[k]]) for i, k in np.argwhere(other & alike)]
        # those that only weights could link
        open_ = other & ~alike & (both > 0) & (repeats[left][:, None] | repeats[right])
        rows = np.flatnonzero(open_.any(axis=1))
        for i, (t, column, x, y) in zip(rows, _shared(flat, begin, weights, left[rows], right)):
            weighted = open_[i]
            there = weighted[column]
            near = probability_bound(column[there], x[there], y[there], len(right)) >= similarity - 1e-6
            for u in right[weighted & near]:
                if probability_jaccard(sets[t], counts[t], sets[u], counts[u]) >= similarity - 1e-9:
                    links.append((node[t], node[u]))
        return pa.table({c: pa.array([x[k] for x in links], pa.int64()) for k, c in enumerate("ab")})

    return compare


#: What a word has (fixed value).
_INK = r"[^\x20\x09-\x0D]"


#: Bits of the filter that tells most texts without candidates from the others, and of a part of it.
_FILTER_BITS, _PART_BITS = 1 << 26, 1 << 15


def maybe_in(docs: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The rows of ``docs`` but most of those whose ``key`` is not in ``found``.

    A bitmap of fixed size is broadcast, so that texts nobody asks for are not
    shuffled; all rows whose key is in ``found`` stay.
    """
    bit = F.pmod(F.xxhash64(key), F.lit(_FILTER_BITS))
    part = F.expr(f"bit div {_PART_BITS}").alias("part")
    bits = found.select(bit.alias("bit")).select(part, F.expr(f"bit % {_PART_BITS}").alias("bit"))
    bits = bits.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    there = F.expr(f"getbit(cast(conv(hex(substring(bits, cast((bit % {_PART_BITS}) div 8 as int) + 1, 1)), 16, 10) as int), cast(bit % 8 as int)) = 1")
    placed = docs.withColumn("bit", bit).withColumn("part", part)
    return placed.join(F.broadcast(bits), "part").filter(there).select(*docs.columns)


def content(text: Column) -> Column:
    """Digest of a text; NULL without words."""
    return F.when(text.rlike(_INK), F.unhex(F.md5(text)))


class NearDuplicates:
    """Classes of near-duplicate texts; see ``classes``.

    Texts never travel with the rows of documents: what is written and shuffled are
    digests, numbers of nodes, band keys, and the shingles of texts that share a bucket.
    Tables in between are deleted once what needs them is written.
    """

    def __init__(self, docs: DataFrame, text: str = "text", order: str = "doc_id", policy: NearPolicy = NearPolicy()) -> None:
        ship(docs.sparkSession)
        self.policy, self.docs, self.text, self.order = policy, docs, text, order
        self.plain = docs.select(F.col(f"`{order}`").alias("id"), content(F.col(f"`{text}`")).alias("content"), F.col(f"`{text}`").alias("t"))

    @staticmethod
    def _rank(at: Column) -> Column:
        """What makes an id the one that stands for a class: the smallest, NULL last."""
        return F.struct(at.isNull().alias("none"), at.alias("id"))

    def _nodes(self) -> DataFrame:
        """(node, content, first, copies, same, keys): one row for each different text;
        ``copies`` counts its rows and ``same`` those with the first id.  Nodes are
        numbered in the write, so they stay what they are when a task runs again."""
        some = self.plain.filter("content IS NOT NULL").select("content", self._rank(F.col("id")).alias("first"), "t")
        schema = T.StructType([*some.schema.fields[:2], T.StructField("keys", T.ArrayType(T.LongType()))])
        signed = some.mapInArrow(_signed(self.policy), schema)
        ids = signed.groupBy("content", "first").agg(F.count("*").alias("n"), F.first("keys").alias("keys"))
        least = F.min(F.struct("first", "n")).alias("least")
        nodes = ids.groupBy("content").agg(least, F.sum("n").alias("copies"), F.first("keys").alias("keys"))
        number = F.monotonically_increasing_id().alias("node")
        return keep(nodes.select(number, "content", "least.first", F.col("least.n").alias("same"), "copies", "keys"), "near-nodes")

    def _links(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}"), F.col("counts").alias(f"counts_{x}"))
        both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "set_a", "set_b", "counts_a", "counts_b")
        return keep(both.mapInArrow(_verify(self.policy.similarity), "a bigint, b bigint"), "near-verified")

    def labels(self, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(node, label) of every node in a class of more than one, and the links (a, b).

        A bucket names one of its members at a time, and every other member is compared
        with it.  So the pairs of a round are no more than the entries of nodes in
        buckets, whatever the size of a bucket, and no proposal is left out.  In the end
        any two nodes of a bucket are in one class or were compared: see ``_rest``.
        """
        entries = nodes.select("node", F.explode("keys").alias("bucket"))
        shared = entries.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("leader")).filter("n > 1")
        members = keep(entries.join(shared.drop("n"), "bucket"), "near-members")
        candidates = keep(members.select("node").distinct(), "near-candidates")
        # one row of each text: those that have its first id
        chosen = nodes.join(candidates, "node", "left_semi").select("node", "content", exactly(F.col("first.id")).alias("at"))
        chosen = keep(chosen, "near-chosen")
        texts = maybe_in(self.plain, chosen, "content").withColumn("at", exactly(F.col("id"))).join(chosen, ["content", "at"])
        sets = texts.select("node", "t").mapInArrow(_sets(self.policy), "node bigint, shingles binary, counts binary")
        sets = keep(sets.groupBy("node").agg(F.first("shingles").alias("shingles"), F.first("counts").alias("counts")), "near-sets")

        # the first member of a bucket settles most groups
        links = self._links(_pairs(members.filter("leader <> node")), sets)
        # a pair is proposed only between classes, so no later link is an earlier one again
        label, found = merged(links), [links]
        for turn in range(1, self.policy.rounds + 1):
            proposed = self._proposed(nodes, members, label, turn)
            links = self._links(proposed, sets)
            discard(proposed)
            found.append(links)
            if links.isEmpty():
                break
            further = merged(links, label)
            discard(label)
            label = further
        links = self._rest(members, label, sets)
        found.append(links)
        if not links.isEmpty():
            further = merged(links, label)
            discard(label)
            label = further
        named = keep(with_names(label), "near-components")
        # two nodes may propose each other in one round
        pairs = reduce(DataFrame.unionByName, found).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        links = keep(pairs.distinct(), "near-links")
        discard(members, candidates, chosen, sets, label, *found)
        return named, links

    def _proposed(self, nodes: DataFrame, members: DataFrame, label: DataFrame, turn: int) -> DataFrame:
        """(a, b): every node in a bucket of several classes with the representative of
        the bucket, if that is of another class.

        A bucket takes a new representative every turn, from the classes that its first
        member is not in: what is not explained yet.  It is also refined by a second
        band, another one every turn, where pairs that are much alike meet apart from
        others.
        """
        named = members.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
        of_leader = label.select(F.col("node").alias("leader"), F.col("label").alias("leader_label"))
        named = named.join(of_leader, "leader", "left").withColumn("leader_label", F.coalesce("leader_label", "leader"))
        named = keep(named.select("bucket", "node", "label", "leader_label"), "near-named")
        # numbers in an order that is another one every turn, and back
        swap = F.lit(random.Random(turn).getrandbits(62))
        first, back = F.min(F.col("node").bitwiseXOR(swap)), F.col("first").bitwiseXOR(swap)

        def led(buckets: DataFrame) -> DataFrame:
            there = buckets.select("bucket", back.alias("leader")).join(label.withColumnRenamed("node", "leader"), "leader", "left")
            return there.select("bucket", "leader", F.coalesce("label", "leader").alias("of"))

        open_buckets = keep(led(named.filter("label <> leader_label").groupBy("bucket").agg(first.alias("first"))), "near-open")
        within = named.join(open_buckets, "bucket").filter("label <> of").select("node", "leader")

        # refined buckets of the nodes that are in an open one
        live = keep(named.join(open_buckets.select("bucket"), "bucket", "left_semi").select("node", "label").distinct(), "near-live")
        bands = self.policy.bands
        twin = lambda k, i: F.xxhash64(k, F.get("keys", i - i % bands + (i + turn) % bands))
        refined = nodes.select("node", "keys").join(live, "node").select("node", "label", F.explode(F.transform("keys", twin)).alias("bucket"))
        ends = refined.groupBy("bucket").agg(first.alias("first"), F.min("label").alias("least"), F.max("label").alias("most"))
        ends = keep(led(ends.filter("least <> most")), "near-refined")
        apart = refined.join(ends, "bucket").filter("label <> of").select("node", "leader")
        proposed = keep(_pairs(within.unionByName(apart)), "near-proposed")
        discard(named, open_buckets, live, ends)
        return proposed

    def _rest(self, members: DataFrame, label: DataFrame, sets: DataFrame) -> DataFrame:
        """(a, b): the links between nodes of one bucket that are still in different classes.

        The pairs are never rows: a bucket of several classes is cut into blocks by a hash
        of the node, and a task compares two blocks at a time.  So its memory is that of
        two blocks, however many members a bucket has.
        """
        policy = self.policy
        named = members.select("bucket", "node").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
        named = named.join(sets.select("node", (F.octet_length("shingles") / 8).alias("n")), "node")
        sized = named.groupBy("bucket").agg(
            F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("texts"), F.sum("n").alias("shingles")
        )
        blocks = F.ceil(F.greatest(F.col("texts") / policy.block_texts, F.col("shingles") / policy.block_shingles, F.lit(1.0)))
        several = keep(sized.filter("least <> most").select("bucket", blocks.cast("long").alias("blocks")), "near-several")
        block = F.pmod(F.xxhash64("node"), F.col("blocks"))
        entries = keep(named.join(several, "bucket").select("bucket", "node", "label", "blocks", block.alias("block")), "near-entries")
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        paired = entries.select("*", other.alias("other")).join(sets, "node")
        paired = paired.select(
            "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "label", "block", "shingles", "counts"
        )
        compared = paired.groupBy("bucket", "i", "j").applyInArrow(_compare(policy.similarity), "a bigint, b bigint")
        links = keep(compared.distinct(), "near-rest")
        discard(several, entries)
        return links

    def classes(self) -> DataFrame:
        """(content, leads, first, same, leader_first, size, links): every different text
        that has copies or near-duplicates.

        The text that ``leads`` its class is the one with the smallest id; ``first`` is
        the smallest id of this text and ``same`` the number of its rows; ``size`` counts
        the different texts of the class and ``links`` the pairs of them that were found
        to be linked.
        """
        nodes = self._nodes()
        label, links = self.labels(nodes)
        of_class = links.join(label, links["a"] == label["node"]).groupBy("label").agg(F.count("*").alias("links"))
        named = nodes.drop("keys").join(label, "node", "left").filter("label IS NOT NULL OR copies > 1")
        named = keep(named.withColumn("label", F.coalesce("label", "node")), "near-labelled")
        leaders = named.groupBy("label").agg(F.min(F.struct("first", "node")).alias("leader"), F.count("*").alias("size"))
        joined = named.join(leaders, "label").join(of_class, "label", "left")
        found = keep(
            joined.select(
                "content", (F.col("leader.node") == F.col("node")).alias("leads"), "first", "same",
                F.col("leader.first").alias("leader_first"), "size", F.coalesce("links", F.lit(0)).alias("links"),
            ),
            "near-classes",
        )
        discard(nodes, label, links, named)
        return found

    def membership(self) -> DataFrame:
        """A row per document: its id and that of its class (its own without words)."""
        found = self.plain.select("id", "content").join(self.classes(), "content", "left")
        return found.select(
            F.col("id").alias(self.order),
            F.when(F.col("leader_first").isNull(), F.col("id")).otherwise(F.col("leader_first")["id"]).alias("class_id"),
            F.coalesce("size", F.lit(1)).cast("bigint").alias("n_texts"),
            F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        )

    def survivors(self) -> DataFrame:
        """The input columns of one document of each class, and all without words."""
        node, of = unused(self.docs.columns, "near_node"), unused(self.docs.columns, "near_class")
        classes = self.classes()
        # what stays of them: rows of the leader with its first id
        verdicts = classes.select(F.col("content").alias(node), F.struct("leads", F.col("first.id").alias("id"), "same").alias(of))
        id_is = F.col(f"`{self.order}`").eqNullSafe(F.col(f"`{of}`.id"))
        judged = self.docs.withColumn(node, content(F.col(f"`{self.text}`"))).join(verdicts, node, "left")
        leads = F.col(f"`{of}`.leads") & id_is
        once = judged.filter(F.col(f"`{of}`").isNull() | (leads & (F.col(f"`{of}`.same") == 1)))
        columns = [F.col(f"`{c}`") for c in self.docs.columns]
        if classes.filter("leads AND same > 1").isEmpty():
            return once.select(*columns)
        # rows of one id and text: one of them stays
        again = judged.filter(leads & (F.col(f"`{of}`.same") > 1)).dropDuplicates([node])
        return once.select(*columns).unionByName(again.select(*columns))


def _pairs(proposals: DataFrame) -> DataFrame:
    """(a, b): each node with every leader that one of its buckets names."""
    return proposals.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", order: str = "doc_id", policy: NearPolicy = NearPolicy()) -> DataFrame:
    """(id, class_id, n_texts, n_links) for every document; ``n_texts`` counts the
    different texts of its class, ``n_links`` the pairs of them found linked.

    Equal texts are one node; texts that differ in case or white space are linked.  A text without words, NULL or empty, is
    a class of its own.  Repeated rows get the same class.  An id that is NULL never
    names a class that has another id.
    """
    return NearDuplicates(docs, text, order, policy).membership()


def without_near_duplicates(docs: DataFrame, text: str = "text", order: str = "doc_id", policy: NearPolicy = NearPolicy()) -> DataFrame:
    """One document of each class: the one with the smallest id, then the first row."""
    return NearDuplicates(docs, text, order, policy).survivors()
