"""BPE encoding and decoding with a contiguous array of ranks per word.

A word is held as the list of its part boundaries and the list of the ranks of its
adjacent pairs.  The smallest rank is found by a scan, its boundary deleted, and the
ranks left and right of it refreshed, until no pair has a rank.  Words are short, so
the scan beats a queue; a word of more than SHORT symbols uses one.

Texts are cut at white space into pieces, which the vocabulary's own normalisation
and splitting never join, and each worker remembers what the pieces encode to.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from strandline.llm.scratch import Remembered, pieces, ship

SHORT = 200
#: Pieces and words a worker remembers; see ``scratch.Remembered``.
REMEMBERED = 120_000

# Unicode white space as the vocabularies mean it (fixed value).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BLACK = re.compile(f"[^{SPACE}]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")  # white space to str.split(), not to SPACE

# How a lower-case piece of Latin-1 is split into words (fixed value); other pieces are
# left to the library, whose Unicode tables are the ones that count.
_LETTERS, _DIGITS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{SPACE}{_LETTERS}{_DIGITS}]+")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies:
    itself where it is printable Latin-1, else the next free letter from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(free)) for b in range(256)}


class RankMerger:
    """Merges the symbols of a word by the ranks of adjacent pairs.

    ``parts`` holds the id of the part between two boundaries; deleting a boundary
    joins its part to the one before.
    """

    def __init__(self, merges: list, vocabulary: dict[str, int], suffix: str = "") -> None:
        self.vocabulary, self.suffix = vocabulary, suffix
        self.rank: dict[int, int] = {}
        self.joined: list[int] = []
        for merge in merges:
            left, right = merge if isinstance(merge, (list, tuple)) else merge.split(" ")
            self.rank[vocabulary[left] << 24 | vocabulary[right]] = len(self.joined)
            self.joined.append(vocabulary[left + right])
        self.never = len(self.joined)
        # a symbol that is no token gets an id that no pair has
        self.unknown = (1 << 24) - 1
        self.within = {c: i for c, i in vocabulary.items() if len(c) == 1}
        self.final = {c: vocabulary.get(c + suffix, self.unknown) for c in self.within}

    def ids(self, word: str) -> list[int]:
        """Ids of the merged parts; the suffix belongs to the last symbol."""
        if not word:
            return []
        parts = [self.within.get(c, self.unknown) for c in word]
        parts[-1] = self.final.get(word[-1], self.unknown)
        parts = self._scan(parts) if len(parts) <= SHORT else self._queue(parts)
        return parts if self.unknown not in parts else [p for p in parts if p != self.unknown]

    def _scan(self, parts: list[int]) -> list[int]:
        rank, never, joined = self.rank.get, self.never, self.joined
        ranks = [rank(a << 24 | b, never) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == never:
                break
            i = ranks.index(least)
            part = parts[i] = joined[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 24 | part, never)
            if i < len(ranks):
                ranks[i] = rank(part << 24 | parts[i + 1], never)
        return parts

    def _queue(self, parts: list[int]) -> list[int]:
        """The same merges for a long word: smallest rank first, then leftmost."""
        n = len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        todo: list[tuple[int, int, int, int]] = []

        def pair(i: int) -> None:
            j = after[i]
            if j < n and (r := self.rank.get(parts[i] << 24 | parts[j])) is not None:
                heapq.heappush(todo, (r, i, parts[i], parts[j]))

        for i in range(n):
            pair(i)
        while todo:
            r, i, left, right = heapq.heappop(todo)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue
            parts[i], parts[j], after[i] = self.joined[r], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            pair(i)
            if before[i] >= 0:
                pair(before[i])
        return [p for p in parts if p >= 0]


class WordCoder:
    """Encodes and decodes texts as a lower-casing vocabulary with word ends does.

    ``entries`` maps a piece without white space to (number of tokens, ids joined by
    spaces, tokens joined by spaces); ``packed`` to ids as little-endian 32-bit numbers.
    """

    def __init__(self, spec: bytes) -> None:
        tree = json.loads(spec)
        model = tree["model"]
        self.vocabulary: dict[str, int] = model["vocab"]
        self._spec = spec
        self.special = {t["content"]: t["id"] for t in tree["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.vocabulary.items(), *self.special.items()]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.letters = byte_letters()
        library = Tokenizer.from_str(spec.decode())
        self.normalise = library.normalizer.normalize_str
        self.split = library.pre_tokenizer.pre_tokenize_str
        self.entries = Remembered(self._entry, REMEMBERED)
        self.packed = Remembered(self._packed, 2 * REMEMBERED)
        self.words = Remembered(self._word, REMEMBERED)
        # packed ids are merged by the library, whose model takes a word as it is
        self.library_merges = library.model.tokenize
        self.packed_words = Remembered(lambda word: array("I", [t.id for t in self.library_merges(word)]).tobytes(), REMEMBERED)

    @cached_property
    def merger(self) -> RankMerger:
        model = json.loads(self._spec)["model"]
        return RankMerger(model["merges"], self.vocabulary, model["end_of_word_suffix"] or "")

    def words_of(self, piece: str) -> list[str]:
        """The normalised words of a piece, in the letters that stand for bytes."""
        if piece.isascii() and piece.isprintable():
            return [piece.lower()] if piece.isalpha() else _WORD.findall(piece.lower())
        if max(piece) <= "\xff":
            return [w.encode().decode("latin-1").translate(self.letters) for w in _WORD.findall(piece.lower())]
        return [word for word, _ in self.split(self.normalise(piece))]

    def _word(self, word: str) -> tuple[int, str, str]:
        ids = self.merger.ids(word)
        # decoded from the ids, not from the word
        return len(ids), " ".join(map(str, ids)), self.decode(ids)

    def _entry(self, piece: str) -> tuple[int, str, str]:
        if piece in self.special:
            return 1, str(self.special[piece]), self.tokens[self.special[piece]]
        words = [self.words[w] for w in self.words_of(piece)]
        if len(words) == 1:
            return words[0]
        words = [w for w in words if w[0]]
        return sum([w[0] for w in words]), " ".join([w[1] for w in words]), " ".join([w[2] for w in words])

    def _packed(self, piece: str) -> bytes:
        if piece in self.special:
            return self.special[piece].to_bytes(4, "little")
        return b"".join(map(self.packed_words.__getitem__, self.words_of(piece)))

    def _pieces(self, text: str) -> list[str]:
        """White space cut out; a special token in the text is a piece of its own."""
        if "<" in text and self.at_special and self.at_special.search(text):
            out: list[str] = []
            for k, part in enumerate(self.at_special.split(text)):
                out += [part] if k % 2 else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        return _BLACK.findall(text) if _SEPARATORS.search(text) else text.split()

    def encoded(self, text: str) -> list[tuple[int, str, str]]:
        """The entries of all pieces of a text, in order."""
        self.entries.turn()
        self.words.turn()
        return list(map(self.entries.__getitem__, self._pieces(text)))

    def packed_ids(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit numbers."""
        self.packed.turn()
        self.packed_words.turn()
        return b"".join(map(self.packed.__getitem__, self._pieces(text)))

    def ids_of(self, text: str) -> list[int]:
        return [int(i) for entry in self.encoded(text) for i in entry[1].split()]

    def decode(self, ids) -> str:
        """Tokens joined by spaces, word ends and special tokens as they are."""
        return " ".join(self.tokens[i] for i in ids)


@lru_cache(maxsize=2)
def coder(spec: bytes) -> WordCoder:
    """One per worker process and vocabulary."""
    return WordCoder(spec)


def vocabulary(docs: DataFrame, path: str):
    """The vocabulary file (a few MB, whatever the data), sent to every worker: only
    the driver needs to see the path."""
    return docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())


def round_trip(docs: DataFrame, path: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """Encodes and decodes every text: carried columns, ``n_tokens``, ``ids_sha256``
    (decimal ids joined by a space), ``decoded_sha256`` (UTF-8 of the decoded text),
    and with ``with_ids`` the ids themselves.

    Rows are independent: nothing is shuffled, repeated rows stay.  NULL counts as
    the empty text, which has no tokens.  Carried columns with names of the results
    are renamed to an unused name.
    """
    results = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    ship(docs.sparkSession)
    spec = vocabulary(docs, path)
    n = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = coder(spec.value)
        sha = hashlib.sha256
        for batch in batches:
            for first, end in pieces(batch, "t"):
                part = batch.slice(first, end - first)
                counts, of_ids, of_text, ids = [], [], [], []
                for value in part.column(n).to_pylist():
                    entries = words.encoded(value or "")
                    joined = " ".join([e[1] for e in entries])
                    counts.append(sum([e[0] for e in entries]))
                    of_ids.append(sha(joined.encode()).hexdigest())
                    of_text.append(sha(" ".join([e[2] for e in entries]).encode()).hexdigest())
                    if with_ids:
                        ids.append(list(map(int, joined.split())))
                columns = [pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                names = [*part.schema.names[:n], *results]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *columns], names)

    frame = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)], F.col(f"`{text}`").alias("t"))
    types = [T.LongType(), T.StringType(), T.StringType(), *[T.ArrayType(T.IntegerType())] * with_ids]
    schema = T.StructType([*frame.schema.fields[:n], *map(T.StructField, results, types)])
    out = frame.mapInArrow(run, schema)
    clash = {r.lower() for r in results}
    return out.select(
        *[F.col(f"c{i}").alias(c if c.lower() not in clash else f"{c}_in") for i, c in enumerate(carry)], *results
    )
