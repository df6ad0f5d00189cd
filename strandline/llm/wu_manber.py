"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every window of ten consecutive words of a benchmark item is a pattern; an item of
fewer words is one pattern.  A text is scanned with a window as long as the pattern:
the block of its last two words is looked up in a shift table.  A block that no
pattern has lets the scan jump by the length of the pattern less one; a block at the
end of some pattern leads to a bucket of candidates, which are told apart by their
first word and then compared word by word.  Patterns of one length share a table.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.scratch import ship, unused

WINDOW = 10
#: Bytes of benchmark text that are searched for in one pass; more means more passes.
BLOCK_BYTES = 16_000_000

# Word characters (fixed values): a-z after lower-casing A-Z, 0-9, and all of non-ASCII.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def _block(words: Sequence[bytes], last: int, width: int) -> bytes:
    return words[last] if width == 1 else words[last - 1] + b" " + words[last]


@dataclass
class Table:
    """Shift table and suffix buckets of the patterns of one length."""

    length: int
    width: int = 2
    shift: dict[bytes, int] = field(default_factory=dict)
    buckets: dict[bytes, dict[bytes, list[tuple[list[bytes], list[str]]]]] = field(default_factory=dict)

    @classmethod
    def of(cls, patterns: dict[tuple[bytes, ...], list[str]], length: int) -> Table:
        table = cls(length, min(2, length))
        for pattern, items in patterns.items():
            for last in range(table.width - 1, length):
                block = _block(pattern, last, table.width)
                table.shift[block] = min(table.shift.get(block, length), length - 1 - last)
            bucket = table.buckets.setdefault(_block(pattern, length - 1, table.width), {})
            bucket.setdefault(pattern[0], []).append((list(pattern), items))
        return table

    def find(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """(position of the first word, items) of every occurrence of a pattern."""
        shift, buckets, length, width = self.shift, self.buckets, self.length, self.width
        furthest = length - width + 1
        last, n = length - 1, len(words)
        while last < n:
            block = words[last] if width == 1 else words[last - 1] + b" " + words[last]
            step = shift.get(block, furthest)
            if step:
                last += step
                continue
            first = last - length + 1
            for pattern, items in buckets[block].get(words[first], ()):
                if words[first : last + 1] == pattern:
                    yield first, items
            last += 1


def tables_of(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> list[Table]:
    """Tables for (item id, text) rows; an item without words has no pattern."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str | None]]] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        words = words_of(text)
        length = min(window, len(words))
        for first in range(len(words) - length + 1 if words else 0):
            by_length[length][tuple(words[first : first + length])].add(item)
    return [
        Table.of({p: sorted(i for i in ids if i is not None) for p, ids in found.items()}, length)
        for length, found in by_length.items()
    ]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open spans, disjoint and ascending."""
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((first, end))
    return out


FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField(
            "spans",
            T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())])),
        ),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
_FOUND_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
        ("items", pa.list_(pa.string())),
    ]
)


def _search(text_at: int, found_at: int | None, tables):
    """Adds the occurrences of one block of items to those of the blocks before."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tables.value
        for batch in batches:
            before = [None] * len(batch) if found_at is None else batch.column(found_at).to_pylist()
            rows = []
            for text, old in zip(batch.column(text_at), before):
                words = words_of(text.as_py())
                spans = [(s["first"], s["end"]) for s in old["spans"]] if old else []
                items = set(old["items"]) if old else set()
                for table in known:
                    for first, ids in table.find(words):
                        spans.append((first, first + table.length))
                        items.update(ids)
                rows.append(
                    {
                        "n_words": len(words),
                        "spans": [{"first": a, "end": b} for a, b in merged(spans)],
                        "items": sorted(items),
                    }
                )
            columns = [c for i, c in enumerate(batch.columns) if i != found_at]
            names = [c for i, c in enumerate(batch.schema.names) if i != found_at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, _FOUND_ARROW)], [*names, "found"])

    return search


def item_blocks(benchmark: DataFrame, item: str, text: str, most: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The benchmark in blocks of about ``most`` bytes, each small enough to broadcast.

    Items go to blocks by a hash of their id and text, so equal rows meet.
    """
    size = benchmark.agg(F.sum(F.octet_length(f"`{text}`"))).first()[0] or 0
    blocks = -(-size // most)
    block = F.pmod(F.xxhash64(f"`{item}`", f"`{text}`"), F.lit(max(blocks, 1)))
    rows = benchmark.select(F.col(f"`{item}`").cast("string").alias("item"), F.col(f"`{text}`").alias("text"))
    for number in range(blocks):
        yield [tuple(r) for r in rows.filter(block == number).collect()]


def occurrences(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    carry: tuple[str, ...] | None = None,
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> tuple[DataFrame, str]:
    """The documents with a struct of what they share with the benchmark.

    The struct has ``n_words``, ``spans`` (disjoint word ranges inside occurrences)
    and ``items`` (ids with an occurrence, as strings, sorted).  A larger benchmark
    than one block is searched for block by block over all documents, each pass
    adding to the struct; no row is shuffled.

    NULL and wordless texts have no words and no occurrences.  NULL or wordless
    items are patterns of nothing; an item without an id marks words but is not
    listed.  Repeated items count once, repeated documents are each searched.  An
    empty benchmark leaves every document clean.
    """
    spark = docs.sparkSession
    ship(spark)
    carried = docs.columns if carry is None else list(carry)
    name = unused([*carried, "__text"], "found")
    # positions, not names: the input's columns may be called anything
    frame = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried)], F.col(f"`{text}`").alias("t"))
    fields = frame.schema.fields
    found_at = None
    for items in item_blocks(benchmark, item, item_text, block_bytes):
        tables = spark.sparkContext.broadcast(tables_of(items, window))
        schema = T.StructType([*fields, T.StructField("found", FOUND)])
        frame = frame.mapInArrow(_search(len(carried), found_at, tables), schema)
        found_at = len(fields)
    if found_at is None:
        nothing = spark.sparkContext.broadcast([])
        schema = T.StructType([*fields, T.StructField("found", FOUND)])
        frame = frame.mapInArrow(_search(len(carried), None, nothing), schema)
    return frame.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carried)], F.col("found").alias(name)), name


def n_hit(found: str) -> Column:
    """Words inside occurrences."""
    return F.aggregate(F.col(f"`{found}`.spans"), F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["first"])


def digest(found: str) -> Column:
    return F.sha2(F.array_join(F.col(f"`{found}`.items"), ","), 256)
