"""Codes of vectors by product quantisation, found with an integer Walsh-Hadamard transform.

A vector becomes integers, cut into equal parts; each part position has a codebook, and
a part's code is the index of its nearest entry.  To find it, parts and entries are
padded with zeros to a power of two, 2^m, and transformed by the Walsh-Hadamard matrix,
which multiplies every squared distance by 2^m.  Squared differences are added up from
the lowest sequency on.  The entry that is nearest on the first coefficients gives a
bound, its own distance; every entry whose sum has passed the bound is given up.  All of
it is integer arithmetic, so codes and errors are exact.

Codebooks are learnt in a few rounds: tasks assign their rows and add up the parts of
every entry, Spark adds these sums, and the driver holds only the codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.scratch import exactly, keep, ship


@dataclass(frozen=True)
class CodePolicy:
    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024
    #: Parts that are compared with a codebook at once.
    block: int = 256


def sequency_order(size: int) -> np.ndarray:
    """Rows of the Walsh-Hadamard matrix by their number of sign changes."""
    signs = walsh_hadamard(np.eye(size, dtype=np.int64))
    return np.argsort((signs[:, 1:] != signs[:, :-1]).sum(axis=1), kind="stable")


def walsh_hadamard(x: np.ndarray) -> np.ndarray:
    """Transform of every row, by sums and differences; rows have 2^m integers."""
    n, size = x.shape
    half = 1
    while half < size:
        pairs = x.reshape(n, size // (2 * half), 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, size)
        half *= 2
    return x


def transformed(x: np.ndarray) -> np.ndarray:
    """Rows padded with zeros to a power of two, transformed, lowest sequency first."""
    size = padded(x.shape[1])
    whole = np.zeros((len(x), size), np.int64)
    whole[:, : x.shape[1]] = x
    return walsh_hadamard(whole)[:, sequency_order(size)]


def padded(width: int) -> int:
    return 1 << max(width - 1, 0).bit_length()


def largest(width: int) -> int:
    """The largest absolute component whose scaled distances fit into 64 bits: twice it,
    squared, in every one of the padded places, times the scale."""
    return (1 << 30) // padded(width)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, lowest of ties; scaled squared distance) per part.

    Both are transformed.  The first quarter of the coefficients is compared with all
    entries, the rest with those that are left, a quarter at a time.
    """
    n, size = parts.shape
    step = max(size // 4, 1)
    sums = ((parts[:, None, :step] - entries[None, :, :step]) ** 2).sum(axis=2)
    bound = np.full(n, np.iinfo(np.int64).max)
    row, entry = (x.ravel() for x in np.indices(sums.shape))
    sums = sums.ravel()
    for first in range(step, size + step, step):
        # the entry that leads so far: no part is farther from its nearest entry than from that one
        lead = _least(row, entry, sums, n)[0]
        bound = np.minimum(bound, ((parts - entries[lead]) ** 2).sum(axis=1))
        stay = np.flatnonzero(sums <= bound[row])
        row, entry, sums = row[stay], entry[stay], sums[stay]
        if first < size:
            sums = sums + ((parts[row, first : first + step] - entries[entry, first : first + step]) ** 2).sum(axis=1)
    return _least(row, entry, sums, n)


def _least(row: np.ndarray, entry: np.ndarray, sums: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the entry with the least sum, lowest of ties; rows are in order, all there."""
    first = np.searchsorted(row, np.arange(n))
    least = np.minimum.reduceat(sums, first)
    ties = np.where(sums == least[row], entry, np.iinfo(np.int64).max)
    return np.minimum.reduceat(ties, first), least


def assigned(vectors: np.ndarray, books: list[np.ndarray], policy: CodePolicy) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances), a column per part position."""
    width = vectors.shape[1] // policy.parts
    codes = np.empty((len(vectors), policy.parts), np.int64)
    errors = np.empty_like(codes)
    for p, book in enumerate(books):
        entries = transformed(book)
        parts = transformed(vectors[:, p * width : (p + 1) * width])
        for at in range(0, len(parts), policy.block):
            some = slice(at, at + policy.block)
            codes[some, p], errors[some, p] = nearest(parts[some], entries)
    return codes, errors // padded(width)


def _integers(column: pa.Array, dimension: int, policy: CodePolicy) -> np.ndarray:
    """floor(scale * x) of a column of lists, shorter ones padded with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.asarray(column.value_lengths())
    out = np.zeros((len(column), dimension), np.float64)
    out[np.arange(dimension) < lengths[:, None]] = flat
    out = np.floor(out * policy.scale)
    if (np.abs(out) > largest(dimension // policy.parts)).any():
        raise ValueError(f"a component times {policy.scale} is beyond {largest(dimension // policy.parts)}: distances would leave 64 bits")
    return out.astype(np.int64)


class WalshCodes:
    """Codebooks of a table of vectors, and the codes of its rows.

    Rows whose vector is NULL, or has NULL or non-finite components, are left out.
    Vectors of different lengths count as filled up with zeros to the longest, and that
    to a multiple of the number of parts.  Repeated rows are rows of their own.  The
    first entries are those of the smallest ids, NULL last, then of the smallest
    vectors; there are fewer if the table has fewer rows, and none if it is empty.
    """

    def __init__(self, vectors: DataFrame, vector: str = "embedding", order: str = "vec_id", carry: tuple[str, ...] = (), policy: CodePolicy = CodePolicy()) -> None:
        ship(vectors.sparkSession)
        self.policy, self.order, self.carry = policy, order, carry
        v = F.col(f"`{vector}`")
        sound = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
        names = (order, *carry)
        self.frame = vectors.filter(v.isNotNull() & sound).select(
            *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], v.alias("v")
        )
        longest = self.frame.agg(F.max(F.size("v"))).first()[0] or 0
        self.dimension = -(-longest // policy.parts) * policy.parts
        self.books = self._learnt() if self.dimension else []

    def _learnt(self) -> list[np.ndarray]:
        policy, dimension = self.policy, self.dimension
        width = dimension // policy.parts
        # policy.entries rows, whatever the table
        seeds = self.frame.orderBy(F.col("c0").asc_nulls_last(), "v").limit(policy.entries).select("v").toArrow()
        whole = _integers(seeds.column("v").combine_chunks(), dimension, policy)
        books = [whole[:, p * width : (p + 1) * width] for p in range(policy.parts)]
        schema = "part int, entry int, n bigint, sums array<bigint>"
        for _ in range(policy.rounds):
            sums = self.frame.select("v").mapInArrow(_summed(self._sent(books), dimension, policy), schema)
            added = sums.groupBy("part", "entry").agg(
                F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[k]) for k in range(width)]).alias("sums")
            )
            # at most parts x entries rows
            for row in added.collect():
                books[row["part"]][row["entry"]] = [s // row["n"] for s in row["sums"]]
        return books

    def _sent(self, books: list[np.ndarray]):
        """The codebooks for the workers: entries x dimension numbers, whatever the table."""
        return self.frame.sparkSession.sparkContext.broadcast([b.copy() for b in books])

    def codebooks_sha256(self) -> str:
        """Digest of the decimal components by part, entry and place, comma-joined."""
        return hashlib.sha256(",".join(str(x) for book in self.books for x in book.ravel().tolist()).encode()).hexdigest()

    def codes(self) -> DataFrame:
        """(carried columns, ``codes`` of the parts, ``error``) for every row that counts."""
        policy, dimension, n = self.policy, self.dimension, 1 + len(self.carry)
        sent = self._sent(self.books) if dimension else None

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if sent is None:
                    codes, errors = np.zeros((len(batch), policy.parts), np.int64), np.zeros((len(batch), 1), np.int64)
                else:
                    codes, errors = assigned(_integers(batch.column("v"), dimension, policy), sent.value, policy)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(codes.ravel(), pa.int32()), policy.parts).cast(pa.list_(pa.int32()))
                columns = [*batch.columns[:n], lists, pa.array(errors.sum(axis=1))]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:n], "codes", "error"])

        extra = T.StructType.fromDDL("codes array<int>, error bigint").fields
        return self.frame.mapInArrow(encode, T.StructType([*self.frame.schema.fields[:n], *extra]))


def _summed(sent, dimension: int, policy: CodePolicy):
    """Per task and entry, the number and the sum of the parts that are nearest to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = dimension // policy.parts
        books = sent.value
        n = np.zeros((policy.parts, policy.entries), np.int64)
        sums = np.zeros((policy.parts, policy.entries, width), np.int64)
        for batch in batches:
            vectors = _integers(batch.column("v"), dimension, policy)
            codes, _ = assigned(vectors, books, policy)
            for p in range(policy.parts):
                n[p] += np.bincount(codes[:, p], minlength=policy.entries)
                np.add.at(sums[p], codes[:, p], vectors[:, p * width : (p + 1) * width])
        part, entry = np.nonzero(n)
        if len(part):
            lists = [s.tolist() for s in sums[part, entry]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), pa.array(lists, pa.list_(pa.int64()))],
                ["part", "entry", "n", "sums"],
            )

    return run


def vector_codes(vectors: DataFrame, vector: str = "embedding", order: str = "vec_id", label: str = "label", policy: CodePolicy = CodePolicy()) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) for every row with a sound vector.

    ``code`` has two hex digits a part.  ``label_error`` adds up the errors of equal
    labels, NULLs together: counted in each task first, then joined back to the written
    codes, so that a label most rows have can be split.  Only id, vector and label are
    read, so no other column can clash; ``WalshCodes`` tells what counts.
    """
    coded = WalshCodes(vectors, vector, order, (label,), policy)
    digits = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    rows = keep(coded.codes().select("c0", exactly(F.col("c1")).alias("label_key"), digits.alias("code"), "error"), "walsh-codes")
    by_label = keep(rows.groupBy("label_key").agg(F.sum("error").alias("label_error")), "walsh-labels")
    return rows.join(by_label, "label_key").select(
        F.col("c0").alias(order), "code", "error", "label_error", F.lit(coded.codebooks_sha256()).alias("codebooks_sha256")
    )
