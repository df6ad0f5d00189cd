"""Fill-in-middle transformation by secondary sort.

Every text is cut into units (words with the white space before them), two random
boundaries make a prefix, a middle and a suffix, and the three are written in another
order with a sentinel before each.  No task builds a whole output: the units travel in
chunks, *pieces*, keyed by document and place in the output; one exchange by document
with a sort inside its partitions (``repartition`` and ``sortWithinPartitions``, the
DataFrame form of repartitionAndSortWithinPartitions) brings them to a task in order,
which streams them into a digest or into the text.

Restoring reads nothing but that stream and the form: it finds the sentinels, gives
every stretch its place in the text and sorts the pieces again inside the partition.
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

from strandline.llm.hashing import GAPS
from strandline.llm.scratch import pieces, ship

#: Sentinels before prefix, suffix and middle (fixed values).
SENTINELS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
#: Order of the segments in the output of a form.
FORMS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
_PLACE = {"prefix": 0, "middle": 1, "suffix": 2}

_IS_GAP = np.zeros(256, bool)
_IS_GAP[list(GAPS)] = True


@dataclass(frozen=True)
class InfillPolicy:
    """``percent`` of texts are rearranged, ``spm_percent`` of those suffix first."""

    seed: int = 42
    percent: int = 50
    spm_percent: int = 80
    #: Bytes of a piece; a longer unit is cut.
    chunk: int = 32_768


def unit_ends(text: np.ndarray) -> np.ndarray:
    """Where each unit of a UTF-8 text ends, in bytes.

    A unit is white space and the word after it; white space at the end is one too.
    """
    if not len(text):
        return np.empty(0, np.int64)
    gap = _IS_GAP[text]
    ends = np.flatnonzero(~gap & np.append(gap[1:], True)) + 1
    return np.append(ends, len(text)) if gap[-1] else ends


def code_points(text: np.ndarray) -> int:
    return int(((text & 0xC0) != 0x80).sum())


def _draws(policy: InfillPolicy, name: str) -> list[int]:
    digest = hashlib.sha256(f"{policy.seed}:{name}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def rearranged(text: bytes, name: str, policy: InfillPolicy) -> tuple[str, int, list[tuple[str, int, int]], np.ndarray]:
    """(form, number of units, (segment, first byte, end) in output order, unit ends)."""
    array = np.frombuffer(text, np.uint8)
    ends = unit_ends(array)
    h1, h2, h3, h4 = _draws(policy, name)
    if not text or h3 % 100 >= policy.percent or any(s in text for s in SENTINELS.values()):
        return "plain", len(ends), [("", 0, len(text))], ends
    low, high = sorted((h1 % (len(ends) + 1), h2 % (len(ends) + 1)))
    at = [0, *(int(ends[k - 1]) if k else 0 for k in (low, high)), len(text)]
    span = {"prefix": at[0:2], "middle": at[1:3], "suffix": at[2:4]}
    form = "spm" if h4 % 100 < policy.spm_percent else "psm"
    return form, len(ends), [(s, *span[s]) for s in FORMS[form]], ends


def chunks(first: int, end: int, ends: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``size`` bytes that end where a unit does, if one does."""
    while first < end:
        cut = min(first + size, end)
        if cut < end:
            k = int(np.searchsorted(ends, cut, "right")) - 1
            if k >= 0 and ends[k] > first:
                cut = int(ends[k])
        yield first, cut
        first = cut


def _cutter(policy: InfillPolicy, partition_of):
    """Pieces of the output of every text, in any order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = partition_of()
        for batch in batches:
            for first, last in pieces(batch, "t"):
                part = batch.slice(first, last - first)
                rows: list[int] = []
                out: dict[str, list] = {c: [] for c in ("key", "place", "piece", "form", "n", "prefix_chars", "middle_chars")}
                for i, (name, text) in enumerate(zip(part.column("name").to_pylist(), part.column("t").to_pylist())):
                    raw = (text or "").encode()
                    form, n, segments, ends = rearranged(raw, name or "", policy)
                    array = np.frombuffer(raw, np.uint8)
                    chars = {s: code_points(array[a:b]) for s, a, b in segments}
                    identity = hashlib.blake2b(f"{here} {name is None} {name}\n".encode(), digest_size=16)
                    identity.update(raw)
                    place = 0
                    for segment, a, b in segments:
                        for k, (x, y) in enumerate(chunks(a, b, ends, policy.chunk) if b > a else [(a, a)]):
                            head = SENTINELS.get(segment, b"") if k == 0 else b""
                            rows.append(i)
                            values = (identity.digest(), place, head + raw[x:y], form, n, chars.get("prefix"), chars.get("middle"))
                            for column, value in zip(out.values(), values):
                                column.append(value)
                            place += 1
                columns = [part.column("id").take(pa.array(rows, pa.int64())), *[pa.array(v, k) for v, k in zip(out.values(), _PIECE_TYPES)]]
                yield pa.RecordBatch.from_arrays(columns, ["id", *out])

    return cut


_PIECE_TYPES = (pa.binary(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64())
_PIECE = "key binary, place bigint, piece binary, form string, n bigint, prefix_chars bigint, middle_chars bigint"


def _partition() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def output_pieces(docs: DataFrame, text: str = "text", order: str = "doc_id", policy: InfillPolicy = InfillPolicy()) -> DataFrame:
    """Pieces of the output of every document, each document in one partition, in order.

    Columns: the document's id, ``key``, ``place`` in the output, ``piece`` (bytes of
    UTF-8, sentinels included), ``form``, ``n`` units, ``prefix_chars``, ``middle_chars``
    (NULL if plain).  The key is a digest of id, text and the input partition, so rows
    of one id but different texts are apart, and a row that is repeated very often is
    spread over as many keys as it comes from partitions; copies inside one show as
    repeated pieces at the same place.  NULL texts count as empty and have one empty
    piece; a NULL id draws like an empty one.  Only id and text are read, so no other
    column can clash.
    """
    ship(docs.sparkSession)
    at = F.col(f"`{order}`")
    frame = docs.select(at.alias("id"), at.cast("string").alias("name"), F.col(f"`{text}`").alias("t"))
    schema = T.StructType([frame.schema.fields[0], *T.StructType.fromDDL(_PIECE).fields])
    cut = frame.mapInArrow(_cutter(policy, _partition), schema)
    return cut.repartition("key").sortWithinPartitions("key", "place")


class _Stretches:
    """Gives the stretches of a streamed output their places in the text.

    A sentinel may lie across two pieces, so the last two bytes wait for the next.
    """

    def __init__(self, form: str) -> None:
        self.coming = list(FORMS.get(form, ()))
        self.segment, self.held, self.count = 0, b"", 0

    def feed(self, piece: bytes, last: bool = False) -> Iterator[tuple[int, int, bytes]]:
        data = self.held + piece
        while self.coming:
            at = data.find(SENTINELS[self.coming[0]])
            if at < 0:
                break
            if at:
                yield self._out(data[:at])
            self.segment = _PLACE[self.coming.pop(0)]
            data = data[at + 3 :]
        wait = 0 if last or not self.coming else 2
        self.held = data[len(data) - wait :] if wait else b""
        if len(data) > wait:
            yield self._out(data[: len(data) - wait])

    def _out(self, data: bytes) -> tuple[int, int, bytes]:
        self.count += 1
        return self.segment, self.count, data


#: Place of the row that ends a document, after every stretch.
_END = 3


def _values(batch: pa.RecordBatch, columns: tuple[str, ...]) -> Iterator[tuple]:
    """Rows of a batch of pieces, a few megabytes at a time."""
    for first, end in pieces(batch, "piece"):
        part = batch.slice(first, end - first)
        yield from zip(*[part.column(c).to_pylist() for c in columns])


def _output_digests(budget: int = 4_000_000):
    """Streams sorted pieces into a digest of each output, and passes every stretch on
    with its place in the restored text.  After a document comes a row with the digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer: list[tuple] = []
        held = 0
        last_key = None
        state: dict = {}

        def closed() -> list[tuple]:
            if last_key is None:
                return []
            rest = [(last_key, a, b, c, None, 0, *state["carried"]) for a, b, c in state["stretches"].feed(b"", True)]
            return [*rest, (last_key, _END, 0, b"", state["sha"].hexdigest(), state["copies"], *state["carried"])]

        names = ("key", "segment", "at", "piece", "output_sha256", "copies", "id", "form", "n", "prefix_chars", "middle_chars")

        def flush(id_type: pa.DataType) -> pa.RecordBatch:
            types = (pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.string(), pa.int64(), id_type, pa.string(), *[pa.int64()] * 3)
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in buffer], t) for k, t in enumerate(types)], list(names))

        id_type = pa.null()
        for batch in batches:
            id_type = batch.schema.field("id").type
            for row in _values(batch, ("key", "place", "piece", "id", "form", "n", "prefix_chars", "middle_chars")):
                key, place, piece = row[:3]
                if key != last_key:
                    buffer += closed()
                    last_key = key
                    state = {"sha": hashlib.sha256(), "place": -1, "copies": 0, "carried": row[3:]}
                    state["stretches"] = _Stretches(state["carried"][1])
                if place == 0:
                    state["copies"] += 1
                if place == state["place"]:
                    continue  # the same piece of a copy
                state["place"] = place
                state["sha"].update(piece)
                for a, b, c in state["stretches"].feed(piece):
                    buffer.append((key, a, b, c, None, 0, *state["carried"]))
                held += len(piece) + 100
                if held > budget:
                    yield flush(id_type)
                    buffer, held = [], 0
        buffer += closed()
        if buffer:
            yield flush(id_type)

    return run


def _restored_digests():
    """Streams restored stretches into a digest; a row per copy of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256()
        for batch in batches:
            ends, digests = [], []
            for i, (segment, piece) in enumerate(zip(batch.column("segment").to_pylist(), batch.column("piece"))):
                if segment != _END:
                    sha.update(piece.as_buffer() if piece.is_valid else b"")
                    continue
                copies = batch.column("copies")[i].as_py()
                ends += [i] * copies
                digests += [sha.hexdigest()] * copies
                sha = hashlib.sha256()
            took = pa.array(ends, pa.int64())
            names = ("id", "n", "form", "prefix_chars", "middle_chars", "output_sha256")
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(took) for c in names], pa.array(digests, pa.string())], [*names, "restored_sha256"])

    return run


def digests(pieces_of: DataFrame) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) for
    every document of ``output_pieces``.

    The stretches are sorted again for restoration inside their partition, without
    another exchange; a partition's sort spills, and no task holds a whole text.
    """
    carried = [f for f in pieces_of.schema.fields if f.name == "id"]
    inner = "key binary, segment int, at bigint, piece binary, output_sha256 string, copies bigint"
    of_doc = T.StructType.fromDDL("form string, n bigint, prefix_chars bigint, middle_chars bigint").fields
    schema = T.StructType([*T.StructType.fromDDL(inner).fields, *carried, *of_doc])
    placed = pieces_of.mapInArrow(_output_digests(), schema).sortWithinPartitions("key", "segment", "at")
    result = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string"
    return placed.mapInArrow(_restored_digests(), T.StructType([*carried, *T.StructType.fromDDL(result).fields]))


def _assembled():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, parts, copies, place, row = None, [], 0, -1, ()

        def closed(schema) -> Iterator[pa.RecordBatch]:
            if last_key is not None:
                text = b"".join(parts).decode()
                columns = [pa.array([v] * copies, t) for v, t in zip((*row, text), (schema.field("id").type, pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "form", "output"])

        schema = None
        for batch in batches:
            schema = batch.schema
            for key, at, piece, *rest in _values(batch, ("key", "place", "piece", "id", "n", "form")):
                if key != last_key:
                    yield from closed(schema)
                    last_key, parts, copies, place, row = key, [], 0, -1, rest
                copies += at == 0
                if at != place:
                    parts.append(piece)
                    place = at
        if schema is not None:
            yield from closed(schema)

    return run


def outputs(docs: DataFrame, text: str = "text", order: str = "doc_id", policy: InfillPolicy = InfillPolicy()) -> DataFrame:
    """(id, n, form, output): the rearranged text of every document; see ``output_pieces``."""
    found = output_pieces(docs, text, order, policy)
    carried = [f for f in found.schema.fields if f.name == "id"]
    schema = T.StructType([*carried, *T.StructType.fromDDL("n bigint, form string, output string").fields])
    return found.mapInArrow(_assembled(), schema).withColumnRenamed("id", order)


def fill_in_middle(docs: DataFrame, text: str = "text", order: str = "doc_id", policy: InfillPolicy = InfillPolicy()) -> DataFrame:
    """Digests of the output of every document and of the text restored from it.

    An empty table gives no rows; repeated rows stay repeated.
    """
    return digests(output_pieces(docs, text, order, policy)).withColumnRenamed("id", order)
