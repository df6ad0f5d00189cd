"""Token counts from two tiers of pre-token lengths.

A text is cut into pre-tokens: a run without white space with the space before it,
or a run of white space.  The vocabulary's own splitting never joins two of them, so
the count of a text is the sum of theirs.  The first tier is a compact table of the
most frequent pre-tokens of the corpus, broadcast with a fixed size; the second is a
cache in each worker, filled by encoding what the first misses.  With a byte-level
vocabulary the library's model merges the words of a missed ASCII pre-token; anything
else takes the library's whole way.

No pre-token of a text is shuffled.  To find the frequent ones, each task sends a
summary of fixed size; the summaries decide what is fast, never what is counted.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from strandline.llm.rank_bpe import SPACE, vocabulary
from strandline.llm.scratch import Remembered, keep, most_frequent, ship

#: Entries of the broadcast table, of a task's summary, of a generation of a worker's cache; and the
#: longest pre-token that the first two hold, which bounds their bytes.
FREQUENT, SUMMARY, REMEMBERED, LONGEST = 65_536, 16_384, 300_000, 64

_PRE_TOKEN = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

#: A pre-token of visible ASCII, and its words as the byte-level splitting cuts them; such bytes
#: stand for themselves, a space is written as \u0120.
_VISIBLE = re.compile(" ?[!-~]+")
_WORD = re.compile("'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^ A-Za-z0-9]+")


def _is_byte_level(spec: bytes) -> bool:
    """Whether all that comes before the merges is the byte-level splitting."""
    read = json.loads(spec)
    before = read.get("pre_tokenizer") or {}
    plain = not read.get("normalizer") and not before.get("add_prefix_space") and before.get("use_regex", True)
    return plain and before.get("type") == "ByteLevel" and read["model"].get("type") == "BPE"


class Lengths:
    """Counts the tokens of texts from both tiers."""

    def __init__(self, spec: bytes, table: bytes | None = None) -> None:
        self.library = Tokenizer.from_str(spec.decode())
        self.library.no_truncation()
        self.library.no_padding()
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.at_special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.merged = self.library.model.tokenize if _is_byte_level(spec) else None
        self.lengths = Remembered(self._encoded, REMEMBERED)
        if table:
            read = pa.ipc.open_stream(table).read_all()
            self.frequent = dict(zip(read["piece"].to_pylist(), read["n"].to_pylist()))
            self.lengths.make = self._known

    def _known(self, piece: str) -> int:
        n = self.frequent.get(piece)
        return self._encoded(piece) if n is None else n

    def _encoded(self, piece: str) -> int:
        if self.merged and _VISIBLE.fullmatch(piece):
            words = _WORD.findall(piece)
            if len(words) > 1:
                return sum(map(self.lengths.__getitem__, words))
            return len(self.merged(piece.replace(" ", "\u0120")))
        return len(self.library.encode(piece, add_special_tokens=False))

    def cut(self, text: str) -> tuple[list[str], int]:
        """(pre-tokens, number of special tokens between them)."""
        if self.at_special and self.at_special.search(text):
            parts = self.at_special.split(text)
            return [p for part in parts[::2] for p in _PRE_TOKEN.findall(part)], len(parts) // 2
        return _PRE_TOKEN.findall(text), 0

    def count(self, text: str) -> int:
        self.lengths.turn()
        found, special = self.cut(text)
        return sum(map(self.lengths.__getitem__, found)) + special


@lru_cache(maxsize=2)
def _lengths(spec: bytes, table: bytes | None) -> Lengths:
    """One per worker process, vocabulary and table."""
    return Lengths(spec, table)


def _summaries(spec):
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, counts = _lengths(spec.value, None), Counter()
        for batch in batches:
            for text in batch.column("t"):
                counts.update(lengths.cut(text.as_py() or "")[0])
                if len(counts) > REMEMBERED:
                    counts = Counter(dict(counts.most_common(REMEMBERED // 2)))
        top = [(p, n) for p, n in counts.most_common(SUMMARY) if len(p) <= LONGEST]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in top], pa.string()), pa.array([x[1] for x in top], pa.int64())], ["piece", "n"]
        )

    return summarise


def _measured(spec):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _lengths(spec.value, None)
        for batch in batches:
            n = [lengths.lengths[p] for p in batch.column("piece").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("piece"), pa.array(n, pa.int32())], ["piece", "n"])

    return measure


def frequent_lengths(docs: DataFrame, spec, text: str = "text", most: int = FREQUENT) -> bytes:
    """The table of the most frequent pre-tokens, as Arrow bytes: at most ``most``
    entries of at most LONGEST characters, whatever the corpus."""
    frame = docs.select(F.col(f"`{text}`").alias("t"))
    summed = frame.mapInArrow(_summaries(spec), "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
    top = most_frequent(keep(summed, "summaries"), "n", most).select("piece")
    table = top.mapInArrow(_measured(spec), "piece string, n int").toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def token_counts(
    docs: DataFrame, path: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",), limit: int = 1024
) -> DataFrame:
    """Carried columns, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``.

    NULL counts as the empty text: no bytes, no tokens.  Rows are independent:
    repeated rows have equal results, nothing is shuffled by text.  Carried columns
    with names of the results get an ``_in`` behind their name.
    """
    ship(docs.sparkSession)
    spec = vocabulary(docs, path)
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, spec, text))
    n = len(carry)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _lengths(spec.value, table.value)
        for batch in batches:
            counts = [lengths.count(t.as_py() or "") for t in batch.column(n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], batch.column(n + 1), pa.array(counts, pa.int64())], [*batch.schema.names[:n], "n_bytes", "n_tokens"])

    t = F.col(f"`{text}`")
    frame = docs.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)],
        t.alias("t"),
        F.coalesce(F.octet_length(t), F.lit(0)).cast("bigint").alias("n_bytes"),
    )
    schema = T.StructType([*frame.schema.fields[:n], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    results = {"n_bytes", "n_tokens", "over_limit"}
    return frame.mapInArrow(count, schema).select(
        *[F.col(f"c{i}").alias(c if c.lower() not in results else f"{c}_in") for i, c in enumerate(carry)],
        "n_bytes",
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
