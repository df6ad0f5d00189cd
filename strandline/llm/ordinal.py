"""Quality grades by ordinal cumulative-link regression on hashed text.

One weight per hashed feature, shared by all grades, and ascending thresholds between
them: P(grade <= k) = logistic(threshold_k - score).  A text gets its expected grade
and the probability of the best grade, which selects it.

The fit reads the features of a bounded sample of labelled documents; the tables that
choose the sample, and the scoring, cover all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.hashing import LOWER, hash_words, mix, words_of_texts
from strandline.llm.scratch import pieces, ship, unused

#: Grades (fixed values): toxic, of low quality, good.
TOXIC, LOW, GOOD = 0, 1, 2
GRADES = 3
#: Bytes of a run; value of the feature for the share of different words.
GRAM, SHARE = 4, 4.0


@dataclass(frozen=True)
class FitPolicy:
    """``sample`` bounds the labelled documents that the fit reads."""

    sample: int = 6_000
    bits: int = 18
    epochs: int = 6
    batch: int = 100
    step: float = 0.1
    shrink: float = 1e-6
    #: Sampled documents a feature needs, to have a weight.
    least: int = 5
    #: Least probability of the best grade with which a document is kept.
    tail: float = 0.5


def features(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, value, first) of all texts.

    Features are the lower-cased words, all runs of GRAM bytes of the lower-cased
    text, the last two bytes of each word as written, each by the logarithm of one
    plus its count, and the tenth in which the share of different words lies.
    """
    lowered = [t.translate(LOWER) for t in texts]
    folded, first = words_of_texts(lowered)
    raw = b"\n".join(texts)
    _, starts = hash_words(raw)
    padded = np.frombuffer(b"\n" + raw + b"\n", np.uint8)
    gap = np.isin(padded, np.array([32, *range(9, 14)], np.uint8))
    ends = np.flatnonzero(gap[1:] & ~gap[:-1])  # the padded position of each word's last byte
    last = padded[ends].astype(np.uint64)
    before = np.where(ends - 1 > starts, padded[ends - 1], 0).astype(np.uint64)
    endings = mix((last << np.uint64(8) | before) + np.uint64(1 << 20))

    x = np.frombuffer(b"\n".join(lowered) + b"\n", np.uint8).astype(np.uint64)
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in lowered])])
    grams = np.full(max(len(x) - GRAM + 1, 0), 1 << 60, np.uint64)
    for k in range(GRAM):
        grams |= x[k : k + len(grams)] << np.uint64(8 * k)
    gram_text = np.searchsorted(begin, np.arange(len(grams)), "right") - 1
    inside = np.arange(len(grams)) + GRAM < begin[gram_text + 1]

    text = np.repeat(np.arange(len(texts)), np.diff(first))
    owner = np.concatenate([text, text, gram_text[inside]])
    index = (np.concatenate([folded, endings, mix(grams[inside])]) >> np.uint64(64 - bits)).astype(np.int64)
    unique, counts = np.unique((owner << bits) | index, return_counts=True)
    values = np.log1p(counts)

    words = np.unique((text << bits) | (folded >> np.uint64(64 - bits)).astype(np.int64)) >> bits
    n = np.diff(first)
    some = np.flatnonzero(n)
    tenth = (10 * np.bincount(words, minlength=len(texts))[some] - 1) // n[some]
    share = (some << bits) | (mix((tenth + (1 << 30)).astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
    keys, values = np.concatenate([unique, share]), np.concatenate([values, np.full(len(share), SHARE)])
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    return keys & ((1 << bits) - 1), values, np.searchsorted(keys, np.arange(len(texts) + 1) << bits)


def sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sum of each text's values, 0 for a text without any."""
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[begin[1:]] - total[begin[:-1]]


def logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, scores: np.ndarray) -> np.ndarray:
        """(texts, GRADES - 1): probability of a grade above 0, above 1, ..."""
        return logistic(scores[:, None] - self.thresholds[None, :])


def fit(index: np.ndarray, values: np.ndarray, begin: np.ndarray, grades: np.ndarray, policy: FitPolicy) -> Ordinal:
    """Maximum likelihood by mini-batches with a step per weight (AdaGrad)."""
    size = 1 << policy.bits
    values = np.where(np.bincount(index, minlength=size)[index] >= policy.least, values, np.float32(0))
    weights, seen = np.zeros(size), np.full(size, 1e-3)
    share = (np.array([(grades <= k).sum() for k in range(GRADES - 1)]) + 1.0) / (len(grades) + GRADES)
    base = np.log(share / (1.0 - share))
    # the first threshold and the logarithms of the gaps above it, so they stay in order
    free = np.concatenate([base[:1], np.log(np.maximum(np.diff(base), 0.1))])
    free_seen = np.full(len(free), 1e-3)
    random = np.random.default_rng(0)
    lengths = np.diff(begin)
    for _ in range(policy.epochs):
        order = random.permutation(len(grades))
        for at in range(0, len(order), policy.batch):
            rows = order[at : at + policy.batch]
            n = lengths[rows]
            place = np.repeat(begin[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            idx, val = index[place], values[place]
            edges = np.concatenate([[0], np.cumsum(n)])
            score, y = sums(weights[idx] * val, edges), grades[rows]
            theta = np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])
            upper = np.concatenate([theta, [np.inf]])[y] - score
            lower = np.concatenate([[-np.inf], theta])[y] - score
            up, low = logistic(upper), logistic(lower)
            slope = up + low - 1.0  # of the log likelihood by the score
            chance = np.maximum(up - low, 1e-9)
            grad = np.bincount(idx, np.repeat(slope, n) * val, size) / len(rows) - policy.shrink * weights
            seen += grad * grad
            weights += policy.step * grad / np.sqrt(seen)
            by_theta = np.array(
                [(up * (1 - up) / chance)[y == k].sum() - (low * (1 - low) / chance)[y == k + 1].sum() for k in range(GRADES - 1)]
            )
            by_free = np.concatenate([[by_theta.sum()], [by_theta[k:].sum() * np.exp(free[k]) for k in range(1, GRADES - 1)]]) / len(rows)
            free_seen += by_free * by_free
            free += policy.step * by_free / np.sqrt(free_seen)
    return Ordinal(weights, np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))]))


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): toxic is 0, else quality 0 is 1 and quality 1 is 2.

    Rows without an id or without a decision are left out; of several labels of a
    document the worst counts.
    """
    grade = (
        F.when(F.col("toxic") == 1, TOXIC).when(F.col("quality") == 0, LOW).when(F.col("quality") == 1, GOOD)
    )
    rows = labels.select("doc_id", grade.alias("grade")).filter("doc_id IS NOT NULL AND grade IS NOT NULL")
    return rows.groupBy("doc_id").agg(F.min("grade").alias("grade"))


def _featured(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end in pieces(batch, "t"):
                part = batch.slice(first, end - first)
                index, values, begin = features([(t or "").encode() for t in part.column("t").to_pylist()], bits)
                lists = [
                    pa.ListArray.from_arrays(begin.astype(np.int32), pa.array(x))
                    for x in (index.astype(np.int32), values.astype(np.float32))
                ]
                yield pa.RecordBatch.from_arrays([part.column("at"), part.column("grade"), *lists], ["at", "grade", "index", "value"])

    return run


def train(docs: DataFrame, labels: DataFrame, text: str = "text", order: str = "doc_id", policy: FitPolicy = FitPolicy()) -> Ordinal:
    """Fits to at most ``policy.sample`` labelled documents, those whose ids have the
    smallest hashes.  Without labelled documents nothing is learned: every text has
    score 0 and probability one half of being good."""
    ship(docs.sparkSession)
    at = F.xxhash64("doc_id")
    chosen = graded(labels).select("doc_id", "grade", at.alias("at")).orderBy("at", "doc_id").limit(policy.sample)
    frame = docs.select(F.col(f"`{order}`").alias("doc_id"), F.col(f"`{text}`").alias("t"))
    # at most ``sample`` rows of three numbers
    sampled = frame.join(F.broadcast(chosen), "doc_id").select("at", "grade", "t")
    rows = sampled.mapInArrow(_featured(policy.bits), "at bigint, grade int, index array<int>, value array<float>")
    # again, as an id may have any number of documents
    table = rows.orderBy("at", "grade", F.xxhash64("index")).limit(policy.sample).toArrow().combine_chunks()
    if not table.num_rows:
        return Ordinal(np.zeros(1 << policy.bits), np.array([-1.0, 0.0]))
    lists = table["index"].combine_chunks(), table["value"].combine_chunks()
    index, values = (x.flatten().to_numpy() for x in lists)
    begin = np.concatenate([[0], np.cumsum(lists[0].value_lengths().to_numpy())])
    return fit(index, values, begin, table["grade"].to_numpy(), policy)


def scores(docs: DataFrame, model: Ordinal, text: str = "text", carry: tuple[str, ...] = ("doc_id",), policy: FitPolicy = FitPolicy()) -> tuple[DataFrame, str]:
    """Carried columns and a struct of (expected_grade, tail_probability, kept).

    A NULL or empty text has no features and gets what the thresholds alone say.
    Repeated rows have equal results.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    name, n = unused(list(carry), "grade"), len(carry)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinal = sent.value
        for batch in batches:
            for first, end in pieces(batch, "t"):
                part = batch.slice(first, end - first)
                index, values, begin = features([(t or "").encode() for t in part.column(n).to_pylist()], policy.bits)
                above = ordinal.above(sums(ordinal.weights[index] * values, begin))
                columns = [pa.array(above.sum(axis=1)), pa.array(above[:, -1]), pa.array(above[:, -1] >= policy.tail)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:n], pa.StructArray.from_arrays(columns, ["expected_grade", "tail_probability", "kept"])],
                    [*part.schema.names[:n], "grade"],
                )

    frame = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)], F.col(f"`{text}`").alias("t"))
    result = T._parse_datatype_string("struct<expected_grade:double,tail_probability:double,kept:boolean>")
    schema = T.StructType([*frame.schema.fields[:n], T.StructField("grade", result)])
    out = frame.mapInArrow(score, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], F.col("grade").alias(name)), name
