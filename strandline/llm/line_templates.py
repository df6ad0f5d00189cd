"""Line deduplication by a log-template tree.

A line is parsed down a tree of fixed depth: first by its number of tokens, then by
its leading tokens, where a token with a digit counts as a wildcard.  In a leaf that
enough documents reach, a token is constant if enough documents have it at its
position, else it is a variable field; the line with its variable fields replaced is
its template.  Lines of templates that recur across documents are dropped everywhere
but in the first document.  Long lines that are equal in every token recur from fewer
documents on, whatever their template.

The tree is never built in one place: leaves, constants and templates are counts,
each combined in its task before it is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import distinct_keys
from strandline.llm.host_rules import let
from strandline.llm.scratch import discard, exactly, keep, unused

WILD = "<*>"


@dataclass(frozen=True)
class TemplatePolicy:
    """``depth`` leading tokens lead to a leaf; a template recurs in ``min_docs``
    documents or more; lines of fewer than ``min_tokens`` tokens are left alone; a
    template with a smaller share of constants than ``constant_share`` is too general,
    and its lines stand for themselves: only lines equal in every token, digits too,
    recur.  Lines of ``exact_tokens`` tokens or more that are equal in every token
    recur in ``exact_docs`` documents or more."""

    depth: int = 3
    min_docs: int = 3
    min_tokens: int = 3
    constant_share: float = 0.6
    exact_tokens: int = 50
    exact_docs: int = 2


def _parsed(text: str, policy: TemplatePolicy, masked: bool) -> Column:
    """Array of struct(n, leaf, form, line and, if asked for, masked) for the lines of a
    text, in order: ``form`` hashes the masked tokens, ``line`` the tokens as they are.

    Lines are split at single blanks, which takes no regular expression, so other white
    space is made blank in the text; only lines with a digit have tokens to mask."""
    plain = "array_remove(split(l, ' '), '')"
    tokens = f"if(l rlike '[0-9]', transform(ws, w -> if(w rlike '[0-9]', '{WILD}', w)), ws)"
    fields = (
        "named_struct('n', size(ts),"
        f" 'leaf', xxhash64(size(ts), slice(ts, 1, {policy.depth})),"
        " 'form', xxhash64(whole), 'line', xxhash64(array_join(ws, ' '))" + (", 'masked', whole)" if masked else ")")
    )
    blank = rf"regexp_replace(`{text}`, '[\\x09\\x0B-\\x0D]', ' ')"
    return F.expr(rf"transform(split({blank}, '\n', -1), l -> {let('ws', plain, let('ts', tokens, let('whole', "array_join(ts, ' ')", fields)))})")


def _long(lines: Column, policy: TemplatePolicy) -> Column:
    return F.filter(lines, lambda line: line["n"] >= policy.min_tokens)


def without_recurring_lines(
    docs: DataFrame, text: str = "text", order: str = "doc_id", policy: TemplatePolicy = TemplatePolicy()
) -> tuple[DataFrame, str]:
    """The documents with their text cleaned, and a struct of (n_lines, n_dropped).

    The first document of a template, by ``order`` with NULLs last, then by its text's
    hash, keeps its lines.  A NULL text stays NULL and has no lines; an empty text has
    one blank line; blank lines are never dropped.  Repeated rows count as one document
    and have equal results: if one is first, all are.
    """
    name, key = unused(docs.columns, "lines"), unused(docs.columns, "line_key")
    gone_at, split_at = unused(docs.columns, "lines_gone"), unused(docs.columns, "lines_split")
    identity = F.concat(exactly(F.col(f"`{order}`")), F.lit(":"), F.hex(F.xxhash64(f"`{text}`")))
    keyed = docs.filter(F.col(f"`{text}`").isNotNull()).select(
        F.struct(F.col(f"`{order}`").isNull().alias("none"), F.col(f"`{order}`").alias("id"), identity.alias("key")).alias("doc"),
        F.col(f"`{text}`").alias("t"),
    )
    # texts are parsed once: the masked lines are written, each once a text, beside the hashes
    parsed = keyed.select("doc", _parsed("t", policy, True).alias("parsed"))
    hashes = F.transform("parsed", lambda line: F.struct(*[line[c].alias(c) for c in ("n", "leaf", "form", "line")]))
    said = F.array_distinct(F.transform(_long(F.col("parsed"), policy), lambda line: F.struct(*[line[c].alias(c) for c in ("leaf", "form", "masked")])))
    entries = keep(parsed.select("doc", hashes.alias("lines"), said.alias("said")), "lines")

    leaves = F.array_distinct(F.transform(_long(F.col("lines"), policy), lambda line: line["leaf"]))
    busy = keep(
        entries.select(F.explode(leaves).alias("leaf")).groupBy("leaf").count().filter(F.col("count") >= policy.min_docs).select("leaf"),
        "leaves",
    )
    forms = _forms(entries, busy)
    templates = _templates(forms, policy)

    at = F.posexplode("lines").alias("pos", "line")
    occurrences = entries.select("doc", at).select("doc", "pos", "line.n", "line.leaf", "line.form", "line.line")
    template = F.coalesce("template", F.xxhash64("line", F.lit("itself")))
    by_template = occurrences.join(templates, ["leaf", "form"]).select(
        "doc", "pos", template.alias("template"), F.lit(policy.min_docs).alias("least")
    )
    by_line = occurrences.filter(F.col("n") >= policy.exact_tokens).select(
        "doc", "pos", F.xxhash64("line", F.lit("exactly")).alias("template"), F.lit(policy.exact_docs).alias("least")
    )
    placed = keep(by_template.unionByName(by_line), "placed")
    recurring = (
        placed.select("template", "doc", "least")
        .distinct()
        .groupBy("template")
        .agg(F.count("*").alias("docs"), F.min("doc").alias("first"), F.min("least").alias("least"))
        .filter(F.col("docs") >= F.col("least"))
    )
    # written, so that the join below brings its own exchange and a hot template can be split
    recurring = keep(recurring, "recurring")
    dropped = keep(
        placed.join(recurring.drop("least"), "template").filter("doc.key <> first.key").select(F.col("doc.key").alias("key"), "pos"), "dropped"
    )
    discard(entries, busy, forms, templates, placed, recurring)
    per_doc = dropped.groupBy(F.col("key").alias(key)).agg(F.collect_set("pos").alias(gone_at))

    joined = docs.withColumn(key, identity).join(per_doc, key, "left")
    gone = F.coalesce(F.col(gone_at), F.array().cast("array<int>"))
    lines = F.split(F.col(f"`{text}`"), "\n", -1)
    kept = F.array_join(
        F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.get(F.col(split_at), i)), "\n"
    )
    counts = F.struct(
        F.coalesce(F.size(lines), F.lit(0)).cast("bigint").alias("n_lines"), F.size(gone).cast("bigint").alias("n_dropped")
    )
    # the lines are split once: as a column, not inside the expression for each line
    joined = joined.withColumn(split_at, F.when(F.size(gone) > 0, lines))
    cleaned = F.when(F.size(gone) > 0, kept).otherwise(F.col(f"`{text}`"))
    columns = [cleaned.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*columns, counts.alias(name)), name


def _forms(entries: DataFrame, busy: DataFrame) -> DataFrame:
    """The different masked lines of busy leaves: (leaf, form, tokens, docs).

    The group key begins with the form, so that its exchange is not that of the join
    and a leaf with very many lines can be split.
    """
    exploded = entries.select(F.inline("said"))
    within = exploded.join(distinct_keys(busy, "leaf"), "leaf", "left_semi")
    counted = within.groupBy(F.xxhash64("form", "leaf").alias("place"), "masked").agg(
        F.min("leaf").alias("leaf"), F.min("form").alias("form"), F.count("*").alias("docs")
    )
    return keep(counted.select("leaf", "form", F.split("masked", " ").alias("tokens"), "docs"), "forms")


def _templates(forms: DataFrame, policy: TemplatePolicy) -> DataFrame:
    """(leaf, form, template): the template of every masked line, as a hash; NULL if it
    is too general."""
    spread = forms.select("leaf", "form", "docs", F.posexplode("tokens").alias("pos", "token"))
    constant = (
        spread.groupBy("leaf", "pos", "token").agg(F.sum("docs").alias("support")).filter(F.col("support") >= policy.min_docs)
    )
    # written, so that a leaf with most lines, one key of this join, can be split
    constant = keep(constant, "constants")
    marked = spread.join(constant, ["leaf", "pos", "token"], "left").select(
        "leaf", "form", "pos", F.when((F.col("support").isNotNull()) & (F.col("token") != WILD), F.col("token")).alias("token")
    )
    in_order = F.sort_array(F.collect_list(F.struct("pos", "token")))
    built = marked.groupBy("form", "leaf").agg(in_order.alias("parts"), F.count("token").alias("constants"))
    general = F.col("constants") >= F.lit(policy.constant_share) * F.size("parts")
    fields = F.array_join(F.transform("parts", lambda p: F.coalesce(p["token"], F.lit(WILD))), " ")
    template = F.when(general, F.xxhash64("leaf", fields))
    found = keep(built.select("leaf", "form", template.alias("template")), "templates")
    discard(constant)
    return found
