"""Host-level quality rules.

Each document is measured and held against four rules.  Failures are counted per
host, the failure rate of each host is shrunk towards an empirical beta prior, and
the verdict on the host is joined back to its documents.

Everything is a DataFrame or SQL expression.  The measures are computed inside the
row: no word, line or window is ever exploded, so the text is not shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.scratch import discard, exactly, keep, unused

#: White space between words, and what counts as a symbol (fixed values).
GAPS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class HostPolicy:
    """Limits of the rules and of the verdicts.

    A document fails with fewer than ``min_words`` words, with more than
    ``max_repeat_percent`` of its words in repeated three-word windows, with more
    than ``max_symbol_percent`` symbols per hundred words, or with more than
    ``max_dup_line_percent`` of its lines equal to an earlier one.  A host is
    *suspect* above the first shrunk failure rate and *blocked* above the second.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbol_percent: int = 10
    max_dup_line_percent: int = 30
    suspect_rate: float = 0.5
    blocked_rate: float = 0.8


def let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeated_words() -> str:
    """Words of ``ws`` that lie in a three-word window found at least twice.

    Most texts are settled by comparing the number of distinct window hashes with
    the number of windows.  For the others the windows themselves are sorted with
    their positions; equal neighbours mark repeated positions, and a position adds
    min(3, distance to the one before) words that were not covered yet.
    """
    hashes = "transform(sequence(0, size(ws) - 3), i -> xxhash64(ws[i], ws[i + 1], ws[i + 2]))"
    windows = (
        "sort_array(transform(sequence(0, size(ws) - 3), i ->"
        " struct(concat(ws[i], ' ', ws[i + 1], ' ', ws[i + 2]) AS w, i AS at)))"
    )
    repeated = (
        "sort_array(transform(filter(sorted, (s, k) -> (k > 0 AND get(sorted, k - 1).w = s.w)"
        " OR (k < size(sorted) - 1 AND get(sorted, k + 1).w = s.w)), s -> s.at))"
    )
    covered = (
        f"aggregate({repeated}, struct(-3 AS last, 0L AS n),"
        " (acc, at) -> struct(at AS last, acc.n + least(3, at - acc.last) AS n), acc -> acc.n)"
    )
    exact = let("sorted", windows, covered)
    settled = let("hs", hashes, f"CASE WHEN size(array_distinct(hs)) = size(hs) THEN 0L ELSE {exact} END")
    return f"CASE WHEN size(ws) < 3 THEN 0L ELSE {settled} END"


def measures(text: str = "text") -> Column:
    """Struct of MEASURES for a text column; a NULL text has no words."""
    gaps, symbols = GAPS.replace("\\", "\\\\"), SYMBOLS.replace("\\", "\\\\")
    whole = f"coalesce(`{text}`, '')"
    words = f"filter(split({whole}, '{gaps}'), w -> w <> '')"
    lines = f"filter(split({whole}, '\\n', -1), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    of_words = let(
        "ws",
        words,
        "named_struct("
        "'n_words', cast(size(ws) AS bigint),"
        " 'word_chars', cast(length(array_join(ws, '')) AS bigint),"
        f" 'n_repeat_words', {_repeated_words()})",
    )
    of_lines = let(
        "ls",
        lines,
        "named_struct('n_lines', cast(size(ls) AS bigint),"
        " 'n_dup_lines', cast(size(ls) - size(array_distinct(ls)) AS bigint))",
    )
    n_symbols = f"cast(length({whole}) - length(regexp_replace({whole}, '{symbols}', '')) AS bigint)"
    both = let(
        "a",
        of_words,
        let(
            "b",
            of_lines,
            f"named_struct('n_words', a.n_words, 'word_chars', a.word_chars, 'n_symbols', {n_symbols},"
            " 'n_lines', b.n_lines, 'n_dup_lines', b.n_dup_lines, 'n_repeat_words', a.n_repeat_words)",
        ),
    )
    return F.expr(both)


def failures(m: Column, policy: HostPolicy) -> dict[str, Column]:
    return {
        "short": m["n_words"] < policy.min_words,
        "repeats": 100 * m["n_repeat_words"] > policy.max_repeat_percent * m["n_words"],
        "symbols": 100 * m["n_symbols"] > policy.max_symbol_percent * m["n_words"],
        "dup_lines": 100 * m["n_dup_lines"] > policy.max_dup_line_percent * m["n_lines"],
    }


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """(a, b) of the beta prior, by the moments of the failure rates of the hosts.

    ``hosts`` has ``n`` documents and ``failed`` of them for each host.  The variance
    between hosts is what is left of the observed one after that of sampling.  Only
    four sums come to the driver.  Without documents the prior is uniform.
    """
    n, failed = F.col("n").cast("double"), F.col("failed").cast("double")
    sums = hosts.agg(
        F.sum(n).alias("n"),
        F.sum(failed).alias("failed"),
        F.count("*").alias("hosts"),
        F.sum(failed * failed / n).alias("squares"),
    ).first()
    if not sums["n"]:
        return 1.0, 1.0
    mean = sums["failed"] / sums["n"]
    spread = mean * (1.0 - mean)
    if spread <= 0.0:  # every document, or none, fails: one pseudo-document of the other kind
        return mean * sums["hosts"] + 1.0, (1.0 - mean) * sums["hosts"] + 1.0
    observed = max(sums["squares"] / sums["n"] - mean * mean, 0.0)
    between = observed - spread * (sums["hosts"] - 1.0) / sums["n"]
    strength = min(max(spread / max(between, spread * 1e-6) - 1.0, 2.0), 1e6)
    return mean * strength, (1.0 - mean) * strength


def host_counts(scored: DataFrame, host_key: str, failed: Column) -> DataFrame:
    """(host, n documents, failed ones), written.

    Counts are combined in each task before the shuffle, so a host with a third of
    all documents costs its reducer no more rows than any other.
    """
    return keep(scored.groupBy(F.col(host_key)).agg(F.count("*").alias("n"), F.count_if(failed).alias("failed")), "host-counts")


def host_verdicts(counted: DataFrame, policy: HostPolicy) -> DataFrame:
    """One row per host: documents, failures, shrunk rate, verdict."""
    a, b = beta_prior(counted)
    rate = (F.col("failed") + F.lit(a)) / (F.col("n") + F.lit(a + b))
    verdict = (
        F.when(rate > policy.blocked_rate, "blocked")
        .when(rate > policy.suspect_rate, "suspect")
        .otherwise("ok")
    )
    return counted.select("*", rate.alias("rate"), verdict.alias("verdict"))


def judged(docs: DataFrame, text: str = "text", host: str = "source", policy: HostPolicy = HostPolicy(), carry: tuple[str, ...] | None = None) -> tuple[DataFrame, str]:
    """The documents with one more struct column, whose name is returned too.

    The struct has the measures, ``base_failed`` (short or repetitive), ``failed``
    (any rule), the host's counts and verdict, and ``kept``.  A document is kept if
    it is not ``base_failed``, its host is not blocked, and, on a suspect host, it
    passes every rule.  ``carry`` names the columns to keep (default: all).

    NULL texts count as empty and NULL hosts as one host of their own.  Repeated
    rows are documents of their own and stay repeated.  No column of the input can
    clash with the new ones: they are in one struct with an unused name.
    """
    name, key = unused(docs.columns, "quality"), unused(docs.columns, "host_key")
    host_at = unused(docs.columns, "of_host")
    carried = docs.columns if carry is None else list(carry)
    measured = docs.select(
        *[F.col(f"`{c}`") for c in carried],
        exactly(F.col(f"`{host}`")).alias(key),
        measures(text).alias(name),
    )
    scored = keep(measured, "host-rules")
    m = F.col(f"`{name}`")
    rules = failures(m, policy)
    failed = rules["short"] | rules["repeats"] | rules["symbols"] | rules["dup_lines"]
    base_failed = rules["short"] | rules["repeats"]
    # the counts are a written table: the join brings its own exchange, and a hot host can be split
    hosts = host_verdicts(host_counts(scored, key, failed), policy)
    of_host = F.struct("n", "failed", "rate", "verdict").alias(host_at)
    joined = scored.join(hosts.select(key, of_host), key)
    h = F.col(host_at)
    kept = ~base_failed & (h["verdict"] != "blocked") & ((h["verdict"] == "ok") | ~failed)
    out = F.struct(
        *[m[c].alias(c) for c in MEASURES],
        base_failed.alias("base_failed"),
        failed.alias("failed"),
        h["n"].alias("host_docs"),
        h["failed"].alias("host_failures"),
        h["verdict"].alias("host_verdict"),
        kept.alias("kept"),
    )
    return joined.select(*[F.col(f"`{c}`") for c in carried], out.alias(name)), name


def accepted(docs: DataFrame, text: str = "text", host: str = "source", policy: HostPolicy = HostPolicy()) -> DataFrame:
    """The documents that ``judged`` keeps, with their columns.

    For whole texts: they are measured twice instead of being written or sent to their
    hosts.  Only hosts that are not ok are joined, to documents that pass on their own.
    """
    key, name, verdict = (unused(docs.columns, n) for n in ("host_key", "quality", "of_host"))
    m = F.col(f"`{name}`")
    rules = failures(m, policy)
    failed = rules["short"] | rules["repeats"] | rules["symbols"] | rules["dup_lines"]
    at = exactly(F.col(f"`{host}`")).alias(key)
    counted = host_counts(docs.select(at, measures(text).alias(name)), key, failed)
    hosts = host_verdicts(counted, policy)
    bad = keep(hosts.filter("verdict <> 'ok'").select(key, F.col("verdict").alias(verdict)), "bad-hosts")
    discard(counted)
    passed = docs.select("*", at, measures(text).alias(name)).filter(~(rules["short"] | rules["repeats"]))
    joined = passed.withColumn(name, failed).join(bad, key, "left")
    kept = F.col(verdict).isNull() | ((F.col(verdict) == "suspect") & ~m)
    return joined.filter(kept).select(*[F.col(f"`{c}`") for c in docs.columns])
