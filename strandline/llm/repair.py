"""Token ids in files compressed by Re-Pair grammars.

Documents go to shards in ascending order of their ids.  In a shard, the most
frequent pairs of adjacent symbols are replaced by new symbols, again and again; a
pair never crosses the end of a document.  A shard stores its rules, how many ids
each rule stands for, its symbols and the sizes of its documents, so any range of ids
is decoded without decoding what is before it.

The shards are rows of a Parquet table, written by Spark: a task that is run again
leaves no half-written shard, and the folder may be on any file system Spark knows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.rank_bpe import coder, vocabulary
from strandline.llm.scratch import keep, ship

MAGIC = b"SLRP0001"
_HEADER = struct.Struct("<8sIIII")  # magic, first rule, rules, symbols, documents
#: Symbols fit into 16 bits: rules take the numbers from the vocabulary's size on.
SYMBOLS = 1 << 16
#: Ids of a shard, about; times pairs are counted; a rule is used this often at least.
SHARD, ROUNDS, FEWEST = 1_000_000, 4, 8
_SLOTS = 18


def _chosen(pairs: np.ndarray, most: int) -> np.ndarray:
    """The most frequent values, the most frequent first."""
    if not len(pairs):
        return pairs
    ordered = np.sort(pairs)
    at = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    counts = np.diff(np.append(at, len(ordered)))
    often = np.flatnonzero(counts >= FEWEST)
    best = often[np.argsort(-counts[often], kind="stable")[:most]]
    return ordered[at[best]]


def _slot(pairs: np.ndarray) -> np.ndarray:
    return (pairs * np.uint32(2654435761)) >> np.uint32(32 - _SLOTS)


def _places(pairs: np.ndarray, allowed: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, rules) of the chosen pairs; where occurrences overlap, every other
    one from the left.  Of chosen pairs that share a slot the most frequent stays."""
    owner = np.full(1 << _SLOTS, -1, np.int32)
    slots = _slot(chosen)
    owner[slots[::-1]] = np.arange(len(chosen), dtype=np.int32)[::-1]
    rule = owner[_slot(pairs)]
    at = np.flatnonzero(allowed & (rule >= 0))
    at = at[chosen[rule[at]] == pairs[at]]
    if not len(at):
        return at, rule[at]
    begins = np.concatenate([[True], np.diff(at) != 1])
    run = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
    at = at[(np.arange(len(at)) - run) % 2 == 0]
    return at, rule[at]


def compress(ids: np.ndarray, sizes: np.ndarray, first_rule: int) -> bytes:
    """A shard of documents of ``sizes`` ids each, all below ``first_rule``."""
    if first_rule > SYMBOLS:
        raise ValueError(f"the format holds vocabularies of at most {SYMBOLS} ids, not {first_rule}")
    symbols = ids.astype(np.uint32)
    last = np.zeros(len(symbols), bool)
    last[np.cumsum(sizes)[sizes > 0] - 1] = True
    rules: list[np.ndarray] = []
    free = first_rule
    for left in range(ROUNDS, 0, -1):
        most = min((SYMBOLS - free) // left, 1 << 14)
        if len(symbols) < 2 or most <= 0:
            break
        pairs = (symbols[:-1] << np.uint32(16)) | symbols[1:]
        allowed = ~last[:-1]
        chosen = _chosen(pairs[allowed], most)
        if not len(chosen):
            break
        at, rule = _places(pairs, allowed, chosen)
        # rules that overlaps left too little to do are not made
        useful = np.flatnonzero(np.bincount(rule, minlength=len(chosen)) >= FEWEST // 2)
        number = np.full(len(chosen), -1, np.int64)
        number[useful] = np.arange(len(useful)) + free
        at, rule = at[number[rule] >= 0], rule[number[rule] >= 0]
        if not len(at):
            break
        symbols[at] = number[rule]
        last[at] = last[at + 1]
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        symbols, last = symbols[stay], last[stay]
        rules.append(np.stack([chosen[useful] >> np.uint32(16), chosen[useful] & np.uint32(0xFFFF)], axis=1))
        free += len(useful)
    table = np.concatenate(rules) if rules else np.empty((0, 2), np.uint32)
    ends = np.flatnonzero(last) + 1
    of_doc = np.zeros(len(sizes), np.int64)
    of_doc[sizes > 0] = np.diff(ends, prepend=0)
    return b"".join(
        [
            _HEADER.pack(MAGIC, first_rule, len(table), len(symbols), len(sizes)),
            table.astype("<u2").tobytes(),
            _expansions(table, first_rule).astype("<u4").tobytes(),
            symbols.astype("<u2").tobytes(),
            sizes.astype("<u4").tobytes(),
            of_doc.astype("<u4").tobytes(),
        ]
    )


def _expansions(table: np.ndarray, first_rule: int) -> np.ndarray:
    """How many ids each rule stands for; a rule only uses rules before it."""
    sizes = np.ones(first_rule + len(table), np.int64)
    done = 0
    while done < len(table):  # a block of rules whose parts are known, as one round made
        known = first_rule + done
        block = np.flatnonzero((table[done:] >= known).any(axis=1))
        end = done + (int(block[0]) if len(block) else len(table) - done)
        sizes[known : first_rule + end] = sizes[table[done:end]].sum(axis=1)
        done = end
    return sizes[first_rule:]


def _gather(ids: np.ndarray, begin: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The ids of each symbol in turn, from the table of what symbols stand for."""
    first = begin[symbols]
    sizes = begin[symbols.astype(np.int64) + 1] - first
    ends = np.cumsum(sizes)
    place = np.arange(ends[-1] if len(ends) else 0)
    return ids[place + np.repeat(first - (ends - sizes), sizes)]


class Shard:
    """A shard read back; ``ids`` decodes any range of ids, ``document`` one document."""

    def __init__(self, stored: bytes) -> None:
        magic, self.first_rule, n_rules, n_symbols, n_docs = _HEADER.unpack_from(stored)
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        at = _HEADER.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(stored, kind, n, at)
            at += found.nbytes
            return found

        self.rules = take("<u2", 2 * n_rules).reshape(n_rules, 2)
        self.expansions = take("<u4", n_rules)
        self.symbols = take("<u2", n_symbols)
        self.sizes = take("<u4", n_docs).astype(np.int64)
        self.of_doc = take("<u4", n_docs).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self._table: tuple[np.ndarray, np.ndarray] | None = None

    def _spelled(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids, begin): what every symbol stands for, one after the other.

        A rule only has rules before it, so a block of rules whose parts are known is
        spelled at once, as many blocks as rounds made them.
        """
        if self._table is None:
            n = self.first_rule
            ids, begin = np.arange(n, dtype=np.int64), np.arange(n + 1, dtype=np.int64)
            done = 0
            while done < len(self.rules):
                known = n + done
                later = np.flatnonzero((self.rules[done:] >= known).any(axis=1))
                end = done + (int(later[0]) if len(later) else len(self.rules) - done)
                more = _gather(ids, begin, self.rules[done:end].ravel())
                begin = np.concatenate([begin, begin[-1] + np.cumsum(self.expansions[done:end], dtype=np.int64)])
                ids = np.concatenate([ids, more])
                done = end
            self._table = ids, begin
        return self._table

    def _expanded(self, symbols: np.ndarray) -> np.ndarray:
        return _gather(*self._spelled(), symbols)

    def ids(self, first: int, end: int) -> np.ndarray:
        """Ids ``first`` to ``end`` of the shard: only symbols that reach into it are expanded."""
        size = np.ones(len(self.symbols), np.int64)
        is_rule = self.symbols >= self.first_rule
        size[is_rule] = self.expansions[self.symbols[is_rule] - self.first_rule]
        before = np.concatenate([[0], np.cumsum(size)])
        a = int(np.searchsorted(before, first, "right")) - 1
        b = int(np.searchsorted(before, end, "left"))
        return self._expanded(self.symbols[a:b])[first - before[a] : end - before[a]]

    def document(self, number: int) -> np.ndarray:
        return self.ids(int(self.starts[number]), int(self.starts[number + 1]))

    def all(self) -> np.ndarray:
        return self._expanded(self.symbols)


def write_shards(docs: DataFrame, path: str, end_id: int, text: str = "text", order: str = "doc_id", shard: int = SHARD) -> DataFrame:
    """Encodes all texts, appends ``end_id`` to each and writes them as shards.

    Returns the table of shards: (part, number, ids, docs, stored).  Documents are in
    ascending order of ``order``, NULLs first; repeated ids follow each other in the
    order of their texts' hash, so a frequent one still spreads over tasks.  ``part``
    and ``number`` order the shards.  A NULL text counts as empty: only ``end_id``.
    """
    ship(docs.sparkSession)
    spec = vocabulary(docs, path)
    frame = docs.select(F.col(f"`{order}`").alias("id"), F.col(f"`{text}`").alias("t"))
    frame = frame.select("id", "t", F.xxhash64("t").alias("tie"), F.monotonically_increasing_id().alias("row"))
    keys = [F.col("id").asc_nulls_first(), F.col("tie"), F.col("row")]
    placed = frame.repartitionByRange(*keys).sortWithinPartitions(*keys)
    id_type = frame.schema["id"].dataType

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = coder(spec.value), end_id.to_bytes(4, "little")
        part, number = TaskContext.get().partitionId(), 0
        ids: list[bytes] = []
        names: list = []
        held = 0

        def stored(kind: pa.DataType) -> pa.RecordBatch:
            sizes = np.array([len(i) // 4 for i in ids], np.int64)
            image = compress(np.frombuffer(b"".join(ids), "<u4"), sizes, len(words.tokens))
            columns = [[part], [number], [int(sizes.sum())], [names], [image]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(kind), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "number", "ids", "docs", "stored"])

        kind = None
        for batch in batches:
            kind = batch.schema.field("id").type
            for name, value in zip(batch.column("id"), batch.column("t")):
                ids.append(words.packed_ids(value.as_py() or "") + end)
                names.append(name.as_py())
                held += len(ids[-1]) // 4
                if held >= shard:
                    yield stored(kind)
                    ids, names, held, number = [], [], 0, number + 1
        if names:
            yield stored(kind)

    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField("number", T.IntegerType()),
            T.StructField("ids", T.LongType()),
            T.StructField("docs", T.ArrayType(id_type)),
            T.StructField("stored", T.BinaryType()),
        ]
    )
    return keep(placed.select("id", "t").mapInArrow(write, schema), "shards")


def offsets(shards: DataFrame) -> DataFrame:
    """(part, number, before): ids of all shards before.  First within each part, then
    over the totals of the parts, of which there are as many as write tasks."""
    earlier = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    within = shards.select("part", "number", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("within"))
    totals = shards.groupBy("part").agg(F.sum("ids").alias("ids"))
    parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = totals.select("part", F.coalesce(F.sum("ids").over(parts), F.lit(0)).alias("start"))
    return within.join(start, "part").select("part", "number", (F.col("start") + F.col("within")).alias("before"))


def read_shards(shards: DataFrame) -> DataFrame:
    """Decodes all shards: (part, number, id, first, n_tokens, ids_crc32) per document,
    with ``first`` counted from the beginning of the shard."""
    ship(shards.sparkSession)
    id_type = shards.schema["docs"].dataType.elementType

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                shard = Shard(batch.column("stored")[row].as_py())
                ids = shard.all().astype("<u4")
                names = batch.column("docs")[row].values
                n = len(names)
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(shard.starts, shard.starts[1:])]
                same = [pa.array([batch.column(c)[row].as_py()] * n, pa.int32()) for c in ("part", "number")]
                yield pa.RecordBatch.from_arrays(
                    [*same, names, pa.array(shard.starts[:-1]), pa.array(shard.sizes), pa.array(crc, pa.int64())],
                    ["part", "number", "id", "first", "n_tokens", "ids_crc32"],
                )

    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField("number", T.IntegerType()),
            T.StructField("id", id_type),
            T.StructField("first", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
    )
    return shards.select("part", "number", "docs", "stored").mapInArrow(read, schema)


def documents_in(shards: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, as read back from the shards."""
    found = read_shards(shards).join(offsets(shards), ["part", "number"])
    return found.select("id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
