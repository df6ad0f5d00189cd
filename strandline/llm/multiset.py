"""Document fingerprints by a homomorphic multiset hash of paragraphs.

A paragraph is a line with a character other than white space.  It is hashed to a wide
vector of 32-bit lanes, and the fingerprint of a text is the sum of the vectors of its
paragraphs modulo 2^32.  The sum does not depend on their order, so equal multisets of
paragraphs have equal fingerprints; adding or subtracting the vector of one paragraph
inserts or deletes it, and the fingerprints of two texts add up to that of both.

A lane's entry is a random multiple of 2^16 plus or minus one.  The high half makes
different multisets differ.  The low half of a sum, read as a signed number, is the sum
of the signs alone, a projection whose inner products estimate how many paragraphs two
texts share: that is their likeness.

Everything is a DataFrame or SQL expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.llm.scratch import exactly, keep

#: Lanes of a fingerprint; the likeness of texts that share nothing strays from 0 by
#: about 1 / sqrt(LANES).
LANES = 128
_MASK = (1 << 32) - 1
#: What a paragraph has besides white space (fixed value).
_INK = r"[^\x20\x09-\x0D]"


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda p: p.rlike(_INK))


def _words(paragraph: Column) -> Column:
    """LANES words of eight hex digits, from SHA-256 digests of the numbered paragraph."""
    hashes = F.array(*[F.sha2(F.concat(F.lit(f"{k}:"), paragraph), 256) for k in range(LANES // 8)])
    return F.flatten(F.transform(hashes, lambda h: F.array(*[F.substring(h, 8 * j + 1, 8) for j in range(8)])))


def _entry(word: Column) -> Column:
    """High half of the word; its second lowest bit is the sign of the one."""
    return F.conv(word, 16, 10).cast("bigint").bitwiseAND(0xFFFF0002) - 1


def _narrow(lanes: Column) -> Column:
    return F.transform(lanes, lambda a: F.when(a >= 1 << 31, a - (1 << 32)).otherwise(a).cast("int"))


def _moved(fingerprint: Column, parts: Column, sign: int) -> Column:
    wide = F.transform(fingerprint, lambda a: a.cast("bigint").bitwiseAND(_MASK))
    step = lambda acc, part: F.zip_with(
        acc, _words(part), lambda a, w: (a + _entry(w) if sign > 0 else a - _entry(w)).bitwiseAND(_MASK)
    )
    return _narrow(F.aggregate(parts, wide, step))


def nothing() -> Column:
    """The fingerprint of no paragraphs, and of NULL and of texts of white space."""
    return F.array_repeat(F.lit(0), LANES)


def fingerprint(text: Column) -> Column:
    """Array of LANES ints."""
    return _moved(nothing(), paragraphs(text), 1)


def inserted(of: Column, text: Column) -> Column:
    """The fingerprint after the paragraphs of ``text`` were added, anywhere."""
    return _moved(of, paragraphs(text), 1)


def deleted(of: Column, text: Column) -> Column:
    """The fingerprint after the paragraphs of ``text`` were taken away."""
    return _moved(of, paragraphs(text), -1)


def united(one: Column, two: Column) -> Column:
    """The fingerprint of the paragraphs of both."""
    return _narrow(F.zip_with(one, two, lambda a, b: (a.cast("bigint") + b).bitwiseAND(_MASK)))


def hexadecimal(of: Column) -> Column:
    """A fingerprint as a string, eight lowercase digits a lane."""
    digits = lambda a: F.lpad(F.hex(a.cast("bigint").bitwiseAND(_MASK)), 8, "0")
    return F.lower(F.array_join(F.transform(of, digits), ""))


def likeness(one: Column, two: Column) -> Column:
    """2 x shared / (all paragraphs of both), estimated from two fingerprints.

    1 for equal fingerprints, and about 0 for texts that share no paragraph; each
    paragraph counts as often as it occurs.
    """

    def sign_sum(a: Column) -> Column:
        low = a.cast("bigint").bitwiseAND(0xFFFF)
        return F.when(low >= 1 << 15, low - (1 << 16)).otherwise(low)

    def product(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0).cast("bigint"), lambda acc, v: acc + v)

    def of_sums(sums: Column) -> Column:
        x, y = sums["x"], sums["y"]
        share = 2.0 * product(x, y) / (product(x, x) + product(y, y)).cast("double")
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))

    sums = F.struct(F.transform(one, sign_sum).alias("x"), F.transform(two, sign_sum).alias("y"))
    none = (one == nothing()) | (two == nothing())
    return F.when(one == two, 1.0).when(none, 0.0).otherwise(F.transform(F.array(sums), of_sums)[0])


def _chain(keyed: DataFrame) -> DataFrame:
    """(key, copies, before, before_chars): each different document and the one whose next it is.

    Only ids and keys are put in order.  Ranges of them are written, neighbours found
    inside each range, and the ends of the ranges, a row each, linked by a window.
    """
    some = keyed.groupBy("key").agg(
        F.first("id").alias("id"), F.first(F.char_length("t")).alias("chars"), F.count("*").alias("copies")
    )
    some = keep(some.select(F.col("id").isNull().alias("none"), "id", "key", "chars", "copies"), "multiset-keys")
    order = ("none", "id", "key")
    placed = keep(some.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "multiset-ranges")
    me = F.struct("none", "id", "key", "chars")
    ends = placed.groupBy("range").agg(F.max(me).alias("last"))
    # as many rows as ranges; the document before the first one is the last one
    by_range = Window.orderBy("range")
    everything = by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    linked = ends.select(
        "range", F.coalesce(F.lag("last").over(by_range), F.last("last").over(everything)).alias("outside")
    )
    inside = placed.select(
        "range", "key", "copies", F.lag(F.struct("key", "chars")).over(Window.partitionBy("range").orderBy(*order)).alias("inside")
    )
    before = F.coalesce("inside", F.struct(F.col("outside.key").alias("key"), F.col("outside.chars").alias("chars")))
    return keep(
        inside.join(linked, "range").select("key", "copies", before["key"].alias("before"), before["chars"].alias("before_chars")),
        "multiset-chain",
    )


def with_edits(docs: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """(id, n_chars, text, next_id, edited, print, edited_print, next_print) for every document.

    The edited text is the document's with its last floor(n_chars / 2) code points
    replaced by the first as many, or all, of the next document's; after the last
    document comes the first.  Documents are ordered by id, NULL last, then by a digest
    of id and text.  Repeated rows of one id and text are the same document: all have
    the same next one.  A NULL text counts as empty.  No column of ``docs`` but the id
    and the text is read, so none can clash.
    """
    signed = docs.select(F.col(f"`{order}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    signed = signed.withColumn("key", F.unhex(F.sha2(F.concat(exactly(F.col("id")), F.lit("\n"), F.col("t")), 256)))
    chain = _chain(signed)
    # both joins below read all of these columns, so they share one exchange of the texts
    signed = signed.withColumn("print", fingerprint(F.col("t")))
    head = F.left(F.col("t"), F.floor(F.col("before_chars") / 2).cast("int"))
    found = signed.join(chain, "key").select(
        "copies", F.col("before").alias("key"), F.col("id").alias("next_id"), head.alias("head"), F.col("print").alias("next_print")
    )
    parts = ("next_id", "head", "next_print")
    once = found.filter("copies = 1").select("key", *parts)
    # repeated rows: one stands for all; combined in each task before it is sent
    again = found.filter("copies > 1").groupBy("key").agg(*[F.first(c).alias(c) for c in parts])
    both = signed.join(once.unionByName(again), "key")
    n = F.char_length("t")
    edited = F.concat(F.left(F.col("t"), (n - F.floor(n / 2)).cast("int")), F.col("head"))
    joined = both.select("id", n.cast("bigint").alias("n_chars"), F.col("t").alias("text"), "next_id", "print", "next_print", edited.alias("edited"))
    return joined.withColumn("edited_print", fingerprint(F.col("edited")))


def fingerprints(docs: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """A row per document: fingerprints of its text and edited text, and likenesses.

    ``with_edits`` tells what NULLs, ties, repeated rows and clashing columns give; an
    empty table gives no rows.
    """
    found = with_edits(docs, text, order)
    one = F.col("print")
    return found.select(
        F.col("id").alias(order),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        hexadecimal(one).alias("fingerprint"),
        hexadecimal(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(one, F.col("edited_print")).alias("near_edited"),
        likeness(one, F.col("next_print")).alias("near_next"),
        F.col("next_id"),
    )
