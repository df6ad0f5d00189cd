"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions, each a node of a binary tree per context; a context
is the last 0 to DEPTH bytes.  A node's decisions are estimated by Krichevsky and
Trofimov's rule, and nodes of all depths are mixed by the weights that context-tree
weighting gives them after the training texts: a node's own estimate counts half, the
estimates of its longer contexts the other half, each in proportion to how well it
predicted.  The probability of a byte is exact for that mixture.

A text is its tokens, A-Z in lower case, with a space between them and an end.  The
corpus is reduced to counts of strings of DEPTH + 1 bytes and of words, combined in
each task before the shuffle.  Subtrees of a context of two bytes are worked out where
their counts meet, the two depths above from sums of them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.hashing import LOWER, mix
from strandline.llm.scratch import keep, most_frequent, pieces, ship

#: At five bytes the model beats single words on held-out texts; at four it does not.
DEPTH = 5
#: Depth of the contexts whose subtrees are worked out apart: there are up to 65,536.
SPLIT = 2
END = 10  # a line feed, which no token has; also what stands before a text
LN2, LN10 = math.log(2.0), math.log(10.0)
#: Words and strings a task counts before it passes its counts on.
HELD_WORDS, HELD_STRINGS = 300_000, 3_000_000
#: Entries of the broadcast tables of strings and words, and the longest such word.
FREQUENT_STRINGS, FREQUENT_WORDS, LONGEST = 1 << 21, 1 << 17, 64
#: Rows of counts that one task works out at a time, about.
SUBTREE_ROWS = 2_000_000
MICRO = 1e6


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words: bytes.split() cuts at the same white space as the words do."""
    return (text or "").encode().translate(LOWER).split()


def strings(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the strings of all texts, and where each text begins (one entry more).

    A code holds the nearest context byte first and the byte itself last.
    """
    before = bytes([END]) * DEPTH
    bodies = [before + b" ".join(t) + bytes([END]) for t in texts]
    x = np.frombuffer(b"".join(bodies), np.uint8).astype(np.uint64)
    begin = np.concatenate([[0], np.cumsum([len(b) for b in bodies])])
    scored = np.ones(len(x), bool)
    for k in range(DEPTH):
        scored[begin[:-1] + k] = False
    at = np.flatnonzero(scored)
    codes = x[at]
    for back in range(1, DEPTH + 1):
        codes |= x[at - back] << np.uint64(8 * (DEPTH - back + 1))
    return codes, begin - DEPTH * np.arange(len(begin))


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.empty(0, int)
    return codes[at], np.add.reduceat(counts, at) if len(at) else counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (in training texts) and of strings (zero where only others have them)."""
    words: Counter[bytes] = Counter()
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def out(pairs: list, codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        n = len(codes)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([w.decode() for w, _ in pairs] + [None] * n, pa.string()),
                pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(codes.astype(np.int64))]),
                pa.concat_arrays([pa.array([c for _, c in pairs], pa.int64()), pa.array(counts.astype(np.int64))]),
            ],
            ["word", "code", "n"],
        )

    nothing = np.empty(0, np.uint64)
    for batch in batches:
        for first, end in pieces(batch, "t"):
            part = batch.slice(first, end - first)
            for held_out in (False, True):
                texts = [tokens(t) for t, h in zip(part.column("t").to_pylist(), part.column("held_out").to_pylist()) if h == held_out]
                if not texts:
                    continue
                if not held_out:
                    for text in texts:
                        words.update(text)
                codes = np.sort(strings(texts)[0])
                at = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
                counts = np.diff(np.append(at, len(codes)))
                held.append((codes[at], np.zeros_like(counts) if held_out else counts))
                size += len(at)
            if size > HELD_STRINGS:
                merged = _summed(*(np.concatenate(x) for x in zip(*held)))
                held, size = [merged], len(merged[0])
                if size > HELD_STRINGS // 2:
                    yield out([], *merged)
                    held, size = [], 0
            if len(words) > HELD_WORDS:
                yield out(list(words.items()), nothing, nothing)
                words.clear()
    merged = _summed(*(np.concatenate(x) for x in zip(*held))) if held else (nothing, nothing)
    yield out(list(words.items()), *merged)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 0.5, by Stirling's series at x + 8."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8.0
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def _kt_block(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log probability that the KT rule gave to n0 zeros and n1 ones."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1.0) - math.log(math.pi)


def _weighted(own: np.ndarray, longer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log of the weighted probability, posterior weight of the node's own estimate)."""
    both = np.logaddexp(own, longer) - LN2
    return both, np.exp(own - LN2 - both)


class Subtrees:
    """The nodes below complete contexts of SPLIT bytes, from sorted codes and counts."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray) -> None:
        self.codes = codes
        self.rows: dict[int, np.ndarray] = {}  # of each code, per depth
        self.keys: dict[int, np.ndarray] = {}
        self.totals: dict[int, np.ndarray] = {}
        for depth in range(DEPTH, SPLIT - 1, -1):
            keys = ((codes >> np.uint64(8 * (DEPTH - depth + 1))) << np.uint64(8)) | (codes & np.uint64(255))
            self.keys[depth], self.rows[depth] = np.unique(keys, return_inverse=True)
            self.totals[depth] = np.bincount(self.rows[depth], weights=counts, minlength=len(self.keys[depth]))
        self.mixed: list[np.ndarray] = []  # per bit: the probability of each code's bit at SPLIT
        self.top: list[tuple[np.ndarray, ...]] = []  # per bit: (key, zeros, ones, log probability) at SPLIT
        for k in range(8):
            self._bit(k)

    def _bit(self, k: int) -> None:
        longer_keys = longer_log = mixed = None
        for depth in range(DEPTH, SPLIT - 1, -1):
            rows, totals = self.keys[depth], self.totals[depth]
            keys = rows >> np.uint64(8 - k)
            new = np.concatenate([[True], keys[1:] != keys[:-1]])
            at, node = np.flatnonzero(new), np.cumsum(new) - 1
            bit = (rows >> np.uint64(7 - k)) & np.uint64(1)
            ones = np.add.reduceat(totals * bit, at)
            zeros = np.add.reduceat(totals, at) - ones
            own = _kt_block(zeros, ones)
            of_code = node[self.rows[depth]]
            code_bit = (self.codes >> np.uint64(7 - k)) & np.uint64(1)
            estimate = (np.where(code_bit == 1, ones[of_code], zeros[of_code]) + 0.5) / ((zeros + ones)[of_code] + 1.0)
            if depth == DEPTH:
                log, mixed = own, estimate
            else:
                mask = np.uint64((1 << k) - 1)
                parents = ((longer_keys >> np.uint64(k + 8)) << np.uint64(k)) | (longer_keys & mask)
                summed = np.bincount(np.searchsorted(keys[at], parents), weights=longer_log, minlength=len(at))
                log, weight = _weighted(own, summed)
                w = weight[of_code]
                mixed = w * estimate + (1.0 - w) * mixed
            longer_keys, longer_log = keys[at], log
        self.mixed.append(mixed)
        self.top.append((longer_keys, zeros, ones, longer_log))


def _partition(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    tables = [(b.column("code").to_numpy(), b.column("n").to_numpy()) for b in batches if len(b)]
    if not tables:
        return np.empty(0, np.uint64), np.empty(0)
    codes, counts = (np.concatenate(x) for x in zip(*tables))
    order = np.argsort(codes)
    return codes[order].astype(np.uint64), counts[order].astype(float)


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per node of depth SPLIT, summed over the longest context byte: (near, node, zeros, ones, log)."""
    codes, counts = _partition(batches)
    if not len(codes):
        return
    columns: list[list[np.ndarray]] = [[], [], [], [], []]
    for k, (keys, zeros, ones, log) in enumerate(Subtrees(codes, counts).top):
        node = (np.uint64(1 << k)) | (keys & np.uint64((1 << k) - 1))
        near = keys >> np.uint64(k + 8 * (SPLIT - 1))
        for column, values in zip(columns, (near, node, zeros, ones, np.rint(log * MICRO))):
            column.append(values.astype(np.int64))
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["near", "node", "zeros", "ones", "log"])


@dataclass
class Upper:
    """Posterior weights and counts of the nodes of depths 0 and 1, by context and node."""

    weight: list[np.ndarray]
    zeros: list[np.ndarray]
    ones: list[np.ndarray]

    @classmethod
    def of(cls, tops: pa.Table) -> Upper:
        near, node = tops["near"].to_numpy(), tops["node"].to_numpy()
        zeros, ones, longer = np.zeros((256, 256)), np.zeros((256, 256)), np.zeros((256, 256))
        zeros[near, node], ones[near, node], longer[near, node] = (tops[c].to_numpy() for c in ("zeros", "ones", "log"))
        log, weight = _weighted(_kt_block(zeros, ones), longer / MICRO)
        zeros0, ones0 = zeros.sum(axis=0), ones.sum(axis=0)
        # a context that never came has nothing to sum: its log probability is 0
        came = np.zeros(256, bool)
        came[near] = True
        _, weight0 = _weighted(_kt_block(zeros0, ones0), log[came].sum(axis=0))
        return cls([weight0[None, :], weight], [zeros0[None, :], zeros], [ones0[None, :], ones])

    def finish(self, codes: np.ndarray, mixed: list[np.ndarray]) -> np.ndarray:
        """Log probability of the byte of each code."""
        out, near, byte = np.zeros(len(codes)), codes >> np.uint64(8 * DEPTH), codes & np.uint64(255)
        for k in range(8):
            node = ((np.uint64(1 << k)) | (byte >> np.uint64(8 - k))).astype(np.int64)
            bit = ((byte >> np.uint64(7 - k)) & np.uint64(1)).astype(np.int64)
            p = mixed[k]
            for depth in (1, 0):
                context = near.astype(np.int64) if depth else np.zeros(len(codes), np.int64)
                zeros, ones = self.zeros[depth][context, node], self.ones[depth][context, node]
                estimate = (np.where(bit == 1, ones, zeros) + 0.5) / (zeros + ones + 1.0)
                w = self.weight[depth][context, node]
                p = w * estimate + (1.0 - w) * p
            out += np.log(p)
        return out


def _finished(upper):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = _partition(batches)
        if len(codes):
            log = upper.value.finish(codes, Subtrees(codes, counts).mixed)
            yield pa.RecordBatch.from_arrays(
                [pa.array(codes.astype(np.int64)), pa.array(counts.astype(np.int64)), pa.array(log)], ["code", "n", "log"]
            )

    return finish


class Table:
    """code -> value by open addressing in arrays."""

    EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)

    def __init__(self, codes: np.ndarray, values: np.ndarray) -> None:
        self.size = 1 << max(4, (2 * len(codes)).bit_length())
        self.keys, self.values = np.full(self.size, self.EMPTY), np.zeros(self.size)
        todo, place = np.arange(len(codes)), self._first(codes)
        while len(todo):
            free = self.keys[place] == self.EMPTY
            self.keys[place[free]] = codes[todo[free]]
            mine = self.keys[place] == codes[todo]
            self.values[place[mine]] = values[todo[mine]]
            todo, place = todo[~mine], (place[~mine] + 1) & (self.size - 1)

    def _first(self, codes: np.ndarray) -> np.ndarray:
        return (mix(codes) & np.uint64(self.size - 1)).astype(np.int64)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, found); 0 where not found."""
        place = self._first(codes)
        found = self.keys[place] == codes
        values = np.where(found, self.values[place], 0.0)
        todo = np.flatnonzero(~found & (self.keys[place] != self.EMPTY))
        place = place[todo]
        while len(todo):
            place = (place + 1) & (self.size - 1)
            hit = self.keys[place] == codes[todo]
            values[todo[hit]], found[todo[hit]] = self.values[place[hit]], True
            on = ~hit & (self.keys[place] != self.EMPTY)
            todo, place = todo[on], place[on]
        return values, found


@lru_cache(maxsize=1)
def _tables(frequent: bytes, words: bytes) -> tuple[Table, dict[bytes, int]]:
    """One pair per worker process and model."""
    a, b = (pa.ipc.open_stream(x).read_all() for x in (frequent, words))
    known = dict(zip([w.encode() for w in b["word"].to_pylist()], b["c"].to_pylist()))
    return Table(a["code"].to_numpy().astype(np.uint64), a["log"].to_numpy()), known


def _stream(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


@dataclass
class Model:
    """``strings``: (code, n, log) of every string of the corpus; ``words``: (word, c) of
    every training word; the number of training texts, tokens and distinct tokens."""

    strings: DataFrame
    words: DataFrame
    texts: int
    n_tokens: int
    distinct: int


def train(docs: DataFrame, text: str, held_out: Column) -> Model:
    """Learns from the texts that are not held out.

    Strings that only held-out texts have are listed with a count of zero, so that
    their probability is known; they teach nothing.
    """
    spark = docs.sparkSession
    ship(spark)
    frame = docs.select(F.col(f"`{text}`").alias("t"), held_out.alias("held_out"))
    counted = keep(frame.mapInArrow(_count, "word string, code bigint, n bigint"), "counted")
    words = counted.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("c"))
    words = keep(words, "words")
    strings = keep(counted.filter("code IS NOT NULL").groupBy("code").agg(F.sum("n").alias("n")), "strings")
    tasks = -(-strings.count() // SUBTREE_ROWS) + 2 * spark.sparkContext.defaultParallelism
    subtree = F.shiftright("code", 8 * (DEPTH - SPLIT + 1))
    placed = keep(strings.repartition(tasks, subtree), "subtrees")
    # read back, a file of one task could be cut or joined with another: deal out again
    dealt = placed.repartition(tasks, subtree)
    tops = dealt.mapInArrow(_tops, "near bigint, node bigint, zeros bigint, ones bigint, log bigint")
    # at most 256 contexts x 255 nodes
    summed = tops.groupBy("near", "node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "log")]).toArrow()
    upper = spark.sparkContext.broadcast(Upper.of(summed))
    logs = keep(dealt.mapInArrow(_finished(upper), "code bigint, n bigint, log double"), "string-logs")
    texts = frame.filter(~F.col("held_out")).count()
    totals = words.agg(F.count("*").alias("v"), F.sum("c").alias("n")).first()
    return Model(logs, words, texts, (totals["n"] or 0) + texts, totals["v"] + (texts > 0))


_MISSED = pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64())]))
_MISSED_WORDS = pa.list_(pa.struct([("key", pa.string()), ("n", pa.int64())]))


def _scored(model_bytes, texts: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = _tables(*model_bytes.value)
        end = math.log10(texts + 1)
        for batch in batches:
            for first, stop in pieces(batch, "t"):
                part = batch.slice(first, stop - first)
                lists = [tokens(t) for t in part.column("t").to_pylist()]
                codes, begin = strings(lists)
                logs, found = table.find(codes)
                sums = np.add.reduceat(logs, begin[:-1])
                missed_codes: list[list[dict]] = [[] for _ in lists]
                lost = np.flatnonzero(~found)
                if len(lost):
                    owner = np.searchsorted(begin, lost, "right") - 1
                    for at in np.split(np.arange(len(lost)), np.flatnonzero(np.diff(owner)) + 1):
                        unique, n = np.unique(codes[lost[at]], return_counts=True)
                        missed_codes[owner[at[0]]] = [{"key": int(u), "n": int(c)} for u, c in zip(unique, n)]
                n_known, base, missed_words = [], [], []
                for text in lists:
                    sum_known, sum_log, missed = int(texts > 0), end, []
                    for word, n in Counter(text).items():
                        c = known.get(word)
                        if c is None:
                            missed.append({"key": word.decode(), "n": n})
                        else:
                            sum_known += n
                            sum_log += n * math.log10(c + 1)
                    n_known.append(sum_known)
                    base.append(sum_log)
                    missed_words.append(missed)
                columns = [
                    *part.columns[:-1],
                    pa.array([len(t) + 1 for t in lists], pa.int64()),
                    pa.array(np.diff(begin)),
                    pa.array(n_known, pa.int64()),
                    pa.array(base, pa.float64()),
                    pa.array(sums),
                    pa.array(missed_words, _MISSED_WORDS),
                    pa.array(missed_codes, _MISSED),
                ]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names[:-1], *_SCORED])

    return score


_SCORED = ("n_tokens", "n_bytes", "n_known", "base", "log", "missed_words", "missed_codes")


def scores(docs: DataFrame, model: Model, held_out: Column, text: str = "text", order: str = "doc_id") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte).

    ``base_score`` and ``score`` are log10 probabilities of the text, by single words
    with one added to each count and by the model.  The most frequent strings and words
    are looked up in broadcast tables of fixed size; what they miss is joined.

    NULL and empty texts are an end alone.  Repeated rows have equal scores.  Without
    training texts every decision has probability one half, and base scores are 0.
    """
    spark = docs.sparkSession
    ship(spark)
    frequent = most_frequent(model.strings, "n", FREQUENT_STRINGS).select("code", "log").toArrow()
    common = most_frequent(model.words.filter(F.length("word") <= LONGEST), "c", FREQUENT_WORDS).toArrow()
    tables = spark.sparkContext.broadcast((_stream(frequent), _stream(common)))
    frame = docs.select(F.col(f"`{order}`").alias("id"), held_out.alias("held_out"), F.col(f"`{text}`").alias("t"))
    kinds = ["bigint", "bigint", "bigint", "double", "double", "array<struct<key:string,n:bigint>>", "array<struct<key:bigint,n:bigint>>"]
    schema = T.StructType([*frame.schema.fields[:2], *[T.StructField(n, T._parse_datatype_string(k)) for n, k in zip(_SCORED, kinds)]])
    first = frame.mapInArrow(_scored(tables, model.texts), schema)
    first = keep(first.withColumn("row", F.monotonically_increasing_id()), "scored")

    def missed(column: str) -> DataFrame:
        return first.select("row", F.explode(column).alias("m")).select("row", F.col("m.key").alias("key"), F.col("m.n").alias("m"))

    words = missed("missed_words").join(model.words.withColumnRenamed("word", "key"), "key")
    words = words.groupBy("row").agg(F.sum("m").alias("more_known"), F.sum(F.col("m") * F.log10(F.col("c") + 1)).alias("more_base"))
    codes = missed("missed_codes").join(model.strings.select(F.col("code").alias("key"), F.col("log").alias("l")), "key")
    codes = codes.groupBy("row").agg(F.sum(F.col("m") * F.col("l")).alias("more_log"))
    whole = first.drop("missed_words", "missed_codes").join(words, "row", "left").join(codes, "row", "left")
    each = math.log10(model.n_tokens + model.distinct + 1)
    log = F.col("log") + F.coalesce("more_log", F.lit(0.0))
    return whole.select(
        F.col("id").alias(order),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.n_tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.lit(each) * F.col("n_tokens")).alias("base_score"),
        (log / F.lit(LN10)).alias("score"),
        (-log / F.lit(LN2) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def held_out_by_id(order: str = "doc_id") -> Column:
    """True for the ids whose crc32, as text, leaves 2 when divided by 7; a NULL id trains."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{order}`").cast("string")), F.lit(7)) == 2, F.lit(False))
