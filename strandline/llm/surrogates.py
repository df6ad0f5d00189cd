"""Personal data replaced by surrogates.

Entities are found by patterns.  Each gets a surrogate derived from a secret key and
its value: of the same type, in the same format, for names of the same gender and
script.  Names are also replaced where they stand alone in a document that has them
with a title or first name.  Equal entities get equal surrogates in all documents.  Surrogates are checked
against each other and against all real entities, and drawn again until different
entities have different surrogates, none of which is real.

Everything is a DataFrame or SQL expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.host_rules import let
from strandline.llm.scratch import exactly, keep, unused

# First names by gender and script, and syllables of family names (fixed values).
GIVEN = {
    ("m", "latin"): "James John Robert Michael David Thomas Daniel Peter Paul Martin Hans Jürgen Pierre Jean Carlos Juan José Luis",
    ("f", "latin"): "Mary Anna Emma Laura Sarah Julia Elizabeth Susan Linda Karen Sabine Ursula Marie Claire Carmen Lucía María Elena",
    ("m", "cyrillic"): "Иван Пётр Алексей Дмитрий Сергей Андрей Николай Михаил",
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана",
    ("m", "greek"): "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης Πέτρος",
    ("f", "greek"): "Μαρία Ελένη Κατερίνα Άννα Σοφία Δέσποινα",
}
SYLLABLES = {
    "latin": "ba bel cor dan den dor fal gar hol kes lan mar nor pel ros tam",
    "cyrillic": "ба бе вол гор дан зар кар лов мар нов пет рос сав тим хар яр",
    "greek": "αλ βα γρ δημ κα λα μαν νικ παπ ρα σα τσι φω χρι ζα ιω",
}
# Titles before names (fixed values).
TITLES = {
    "m": "Mr Herr Monsieur Señor Sr Don г-н κύριος",
    "f": "Mrs Ms Miss Frau Madame Mme Mlle Señora Sra Doña г-жа κυρία",
}
# Titles that say nothing of gender, alone or after others (fixed values).
RANKS = "Dr Prof Professor Doctor Doktor Rev Capt Ing"

#: Around a bare name: it is a whole word.
_NOT_AFTER, _NOT_BEFORE = r"(?<![\p{L}\p{M}])", r"(?![\p{L}\p{M}])"
#: Where a title or first name can begin; tried before the long lists of them.
_BEGINS = r"(?<!\p{L})(?=[\p{Lu}гκ])"


def _any(words: str) -> str:
    return "|".join(sorted(words.split(), key=lambda w: (-len(w), w)))


_TITLES = _any(" ".join([*TITLES.values(), RANKS]))
#: A word with a capital that is no title itself.
_NAME = rf"(?!(?:{_TITLES}){_NOT_BEFORE})\p{{Lu}}\p{{L}}+"


def _patterns() -> dict[str, str]:
    """Types and their patterns; of matches that begin together, the first type wins."""
    given = _any(" ".join(GIVEN.values()))
    octet = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
    return {
        "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
        "secret": r"(?i:\b(?:password|passwd|pwd|secret|token|api_?key)\s{0,3}[=:]\s{0,3}[\"']?)(?=[+/_.~-]*[A-Za-z0-9])[A-Za-z0-9+/_.~-]{6,}",
        "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
        "card": r"(?<![\d-])[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\d-])",
        "ip": rf"(?<![\d.])(?:{octet}\.){{3}}{octet}(?!\d|\.\d)",
        "phone": r"(?<![\d+])\+?\d{0,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<!\d)\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\d-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
        "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
        "name": rf"{_BEGINS}(?:(?:(?:{_TITLES})\.? )+{_NAME}(?: {_NAME})?|(?:{given}) {_NAME})",
    }


PATTERNS = _patterns()
TYPES = tuple(PATTERNS)
FOUND = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every match has: a digit, an at sign, an assignment, a title or a first name.
HINT = rf"[0-9@=:]|{_BEGINS}(?:{_any(' '.join([*TITLES.values(), RANKS, *GIVEN.values()]))})[. ]"


def _sql(pattern: str) -> str:
    """A pattern as an SQL string literal."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _whole(pattern: str) -> str:
    return _sql(f"^(?:{pattern})$")


def matches(text: str) -> str:
    """SQL: all entities of a text, in order, as they are written."""
    return f"CASE WHEN {text} rlike {_sql(HINT)} THEN regexp_extract_all({text}, {_sql(FOUND)}, 0) ELSE array() END"


def parts(match: str) -> str:
    """SQL: the parts of a match, as struct(kind, value); kind '' is literal text.

    A name is its titles, first name and family name, apart, so that the family name
    is the same entity wherever it occurs; a secret is its label and its value.
    """
    script = f"CASE WHEN w rlike {_sql(r'\p{IsCyrillic}')} THEN 'cyrillic' WHEN w rlike {_sql(r'\p{IsGreek}')} THEN 'greek' ELSE 'latin' END"
    women = f"array({', '.join(_sql(w) for g, s in GIVEN for w in GIVEN[g, s].split() if g == 'f')})"
    title_m, title_f, title = (f"^(?:{t})[.]?$" for t in (_any(TITLES["m"]), _any(TITLES["f"]), _TITLES))
    # the first title with a gender, else the first name
    first = f"filter(ws, w -> NOT w rlike {_sql(title)})[0]"
    gender = (
        f"CASE WHEN exists(ws, w -> w rlike {_sql(title_f)}) THEN 'f' WHEN exists(ws, w -> w rlike {_sql(title_m)}) THEN 'm'"
        f" WHEN array_contains({women}, {first}) THEN 'f' ELSE 'm' END"
    )
    word = (
        "named_struct('kind', CASE"
        f" WHEN w rlike {_sql(title)} THEN ''"
        f" WHEN i = size(ws) - 1 AND size(ws) > 1 THEN concat('family:', {script})"
        f" ELSE concat('given:', {gender}, ':', {script}) END, 'value', w)"
    )
    # named parts are joined by spaces again: every second part is a space
    name = let("ws", f"split({match}, ' ')", f"transform(ws, (w, i) -> {word})")
    spaced = f"flatten(transform({name}, (p, i) -> CASE WHEN i = 0 THEN array(p) ELSE array(named_struct('kind', '', 'value', ' '), p) END))"
    label = "[A-Za-z0-9+/_.~-]{6,}$"
    secret = (
        f"array(named_struct('kind', '', 'value', regexp_replace({match}, {_sql(label)}, '')),"
        f" named_struct('kind', 'secret', 'value', regexp_extract({match}, {_sql(label)}, 0)))"
    )
    labelled = f"{match} rlike {_whole(PATTERNS['secret'])}"
    kinds = " ".join(
        f"WHEN {match} rlike {_whole(PATTERNS[t])} THEN '{t}'" for t in TYPES if t not in ("name", "secret")
    )
    return (
        f"CASE WHEN {labelled} THEN {secret} WHEN {match} rlike {_whole(PATTERNS['name'])} THEN {spaced}"
        f" ELSE array(named_struct('kind', CASE {kinds} ELSE 'other' END, 'value', {match})) END"
    )


def _in_format(value: str) -> str:
    """SQL: ``value`` with every digit and ASCII letter replaced from the digest ``h``;
    hexadecimal values stay hexadecimal."""
    place = "1 + pmod(i, 128)"
    letter = f"CASE WHEN {value} rlike '^[0-9a-fA-F]+$' THEN translate(substr(h, {place}, 1), '0123456789', 'abcdefabcd') ELSE translate(substr(h, {place}, 1), '0123456789abcdef', 'ghijklmnopqrstuv') END"
    one = (
        f"transform(sequence(0, length({value}) - 1), i -> let_c)"
    )
    c = f"substr({value}, i + 1, 1)"
    choice = (
        f"CASE WHEN {c} rlike '[0-9]' THEN translate(substr(h, {place}, 1), 'abcdef', '012345')"
        f" WHEN {c} rlike '[a-z]' THEN {letter} WHEN {c} rlike '[A-Z]' THEN upper({letter}) ELSE {c} END"
    )
    return f"array_join({one.replace('let_c', choice)}, '')"


def _luhn(digits: str) -> str:
    """SQL: the sum of Luhn's check over digits, the last of which counts once."""
    digit = f"cast(substr({digits}, length({digits}) - i, 1) AS int)"
    doubled = f"CASE WHEN i % 2 = 1 THEN (2 * {digit}) DIV 10 + (2 * {digit}) % 10 ELSE {digit} END"
    return f"aggregate(transform(sequence(0, length({digits}) - 1), i -> {doubled}), 0L, (a, d) -> a + d)"


def surrogate(secret: str) -> Column:
    """The surrogate of ``kind`` and ``value`` at ``attempt``.

    From the third attempt on each is longer than the one before, so no kind runs out
    of surrogates; IP addresses become ones of the documentation block 2001:db8::/32.
    """
    longer = "greatest(cast(attempt AS int) - 1, 0)"
    more_digits = f"repeat('0', {longer})"  # each 0 is replaced like the digits of the value
    digest = f"sha2(concat_ws('|', {_sql(secret)}, kind, value, cast(attempt AS string)), 512)"
    number = "pmod(conv(substr(h, {a}, 6), 16, 10), {n})"
    email = f"concat({_in_format(chr(96) + 'local' + chr(96))}, '@', substr(h, 100, least(8 + {longer}, 29)), '.example')".replace("`local`", "substring_index(value, '@', 1)")
    ip = "concat_ws('.', {})".format(
        ", ".join([f"cast(240 + cast({number.format(a=1, n=16)} AS int) AS string)", *[f"cast(cast({number.format(a=a, n=256)} AS int) AS string)" for a in (11, 21, 31)]])
    )
    ip = f"CASE WHEN {longer} = 0 THEN {ip} ELSE concat('2001:db8', array_join(transform(sequence(0, 5), i -> concat(':', substr(h, 4 * i + 1, 4))), '')) END"
    # a card keeps its first digit, its grouping, and whether its check digit is right
    digits = "regexp_replace(value, '[^0-9]', '')"
    drawn = f"concat(substr(ds, 1, 1), substr(translate(h, 'abcdef', '012345'), 1, length(ds) - 2 + {longer}))"
    check = f"cast(pmod(10 - {_luhn('concat(body, ' + chr(39) + '0' + chr(39) + ')')} % 10 + CASE WHEN {_luhn('ds')} % 10 = 0 THEN 0 ELSE 5 END, 10) AS string)"
    regrouped = (
        "concat(array_join(transform(sequence(1, length(value)), i -> CASE WHEN substr(value, i, 1) rlike '[0-9]'"
        " THEN substr(nd, length(regexp_replace(substr(value, 1, i), '[^0-9]', '')), 1) ELSE substr(value, i, 1) END), ''),"
        " substr(nd, length(ds) + 1))"
    )
    card = let("ds", digits, let("body", drawn, let("nd", f"concat(body, {check})", regrouped)))
    # a key keeps its prefix of four letters
    key = f"concat(substr(value, 1, 4), {_in_format(f'concat(substr(value, 5), {more_digits})')})"

    # a telephone number keeps its country code, a bank account its country
    phone = let("cc", r"regexp_extract(value, '^[+][0-9]{1,3}(?=[ .(-])', 0)", f"concat(cc, {_in_format(f'concat(substr(value, length(cc) + 1), {more_digits})')})")
    iban = f"concat(substr(value, 1, 2), {_in_format(f'concat(substr(value, 3), {more_digits})')})"

    def picked(words: str, at: int) -> str:
        listed = words.split()
        return f"element_at(array({', '.join(map(_sql, listed))}), cast({number.format(a=at, n=len(listed))} AS int) + 1)"

    more = {s: f"array_join(transform(sequence(1, 2 + cast(attempt AS int)), i -> element_at(array({', '.join(map(_sql, SYLLABLES[s].split()))}), cast(conv(substr(h, pmod(i, 128) + 1, 1), 16, 10) AS int) + 1)), '')" for s in SYLLABLES}
    family = " ".join(f"WHEN kind = 'family:{s}' THEN initcap({more[s]})" for s in SYLLABLES)
    # beyond the list of first names, syllables make further ones
    given = " ".join(
        f"WHEN kind = 'given:{g}:{s}' THEN CASE WHEN attempt = 0 THEN {picked(GIVEN[g, s], 1)} ELSE concat({picked(GIVEN[g, s], 1)}, {more[s]}) END"
        for g, s in GIVEN
    )
    body = (
        f"CASE WHEN kind = 'email' THEN {email} WHEN kind = 'ip' THEN {ip} WHEN kind = 'card' THEN {card}"
        f" WHEN kind = 'key' THEN {key} WHEN kind = 'phone' THEN {phone} WHEN kind = 'iban' THEN {iban} {family} {given} ELSE {_in_format(f'concat(value, {more_digits})')} END"
    )
    return F.expr(let("h", digest, body))


def mapping(entities: DataFrame, secret: str) -> DataFrame:
    """(kind, value, surrogate) for distinct entities (kind, value).

    A drawn surrogate is refused if it is a real value, if an entity settled before
    has it, or if an entity with a smaller value drew it too; what is refused is
    drawn again with the next attempt.  Each round settles all but the collisions, and
    later attempts draw longer surrogates, so the rounds end.
    """
    real = entities.select("kind", F.col("value").alias("surrogate"))
    todo = entities.select("kind", "value", F.lit(0).alias("attempt"))
    settled: DataFrame | None = None
    while True:
        drawn = keep(todo.withColumn("surrogate", surrogate(secret)), "drawn")
        first = drawn.groupBy("kind", "surrogate").agg(F.min("value").alias("value"))
        good = first.join(real, ["kind", "surrogate"], "left_anti")
        if settled is not None:
            good = good.join(settled, ["kind", "surrogate"], "left_anti")
        good = keep(good.select("kind", "value", "surrogate"), "good")
        settled = good if settled is None else keep(settled.unionByName(good), "settled")
        refused = drawn.join(good, ["kind", "value"], "left_anti")
        todo = keep(refused.select("kind", "value", (F.col("attempt") + 1).alias("attempt")), "refused")
        if todo.isEmpty():
            return settled


def with_surrogates(docs: DataFrame, secret: str, text: str = "text", order: str = "doc_id") -> tuple[DataFrame, str]:
    """The documents with entities replaced, and a column with their number.

    A NULL text stays NULL without entities; an empty one stays empty.  Documents that
    are equal in id and text, repeated rows too, are found once and get equal results.
    Bare mentions of the names found in a document count as entities.  The rest of the
    text between entities is left as it is.
    """
    taken = ("n_entities", "pii_key", "pii_map", "pii_bare", "pii_names", "pii_done")
    name, key, map_at, bare_at, names_at, done_at = (unused(docs.columns, n) for n in taken)
    identity = F.concat(exactly(F.col(f"`{order}`")), F.lit(":"), F.hex(F.xxhash64(f"`{text}`")))
    found = docs.filter(F.col(f"`{text}`").rlike(HINT)).select(identity.alias("key"), F.expr(matches(f"`{text}`")).alias("found"))
    listed = found.select("key", F.explode("found").alias("m")).select("key", F.explode(F.expr(parts("m"))).alias("p"))
    mentions = keep(listed.select("key", "p.kind", "p.value").filter("kind <> ''"), "mentions")
    named = mapping(mentions.select("kind", "value").distinct(), secret)
    pairs = F.struct(F.concat_ws(":", "kind", "value").alias("entity"), F.col("surrogate"))
    per_doc = (
        mentions.join(named, ["kind", "value"])
        .groupBy(F.col("key").alias(key))
        .agg(
            F.map_from_entries(F.collect_set(pairs)).alias(map_at),
            # a word that is a family name and a first name counts as the family name
            F.array_sort(F.collect_set(F.when(F.col("kind").rlike("^(?:family|given):"), F.struct("value", "kind", "surrogate")))).alias("all"),
        )
        .withColumn("one", F.expr("filter(all, (x, i) -> i = 0 OR x.value <> all[i - 1].value)"))
        .withColumn(bare_at, F.expr("map_from_entries(transform(one, x -> struct(x.value, x.surrogate)))"))
        .withColumn(names_at, F.expr(f"CASE WHEN size(one) > 0 THEN concat({_sql(_NOT_AFTER + '(?:')}, array_join(one.value, '|'), {_sql(')' + _NOT_BEFORE)}) END"))
        .drop("all", "one")
    )
    joined = docs.withColumn(key, identity).join(per_doc, key, "left")
    part = f"CASE WHEN p.kind = '' THEN p.value ELSE `{map_at}`[concat_ws(':', p.kind, p.value)] END"
    replaced = f"array_join(transform({parts('m')}, p -> {part}), '')"
    # a text between matches: what is around bare names, and their surrogates, in turn
    bare = let(
        "xs",
        f"regexp_extract_all(b, `{names_at}`, 0)",
        let("ys", f"split(b, `{names_at}`, -1)", f"named_struct('n', size(xs), 't', array_join(flatten(transform(ys, (y, j) -> CASE WHEN j = 0 THEN array(y) ELSE array(`{bare_at}`[xs[j - 1]], y) END)), ''))"),
    )
    bare = f"CASE WHEN `{names_at}` IS NULL THEN named_struct('n', 0, 't', b) ELSE {bare} END"
    # text between the matches and surrogates, in turn
    between = f"split(`{text}`, {_sql(FOUND)}, -1)"
    whole = let(
        "ms",
        matches(f"`{text}`"),
        let(
            "bs",
            f"transform({between}, b -> {bare})",
            "named_struct('text', array_join(flatten(transform(bs, (b, i) -> CASE WHEN i = 0 THEN array(b.t)"
            f" ELSE transform(slice(ms, i, 1), m -> {replaced}) || array(b.t) END)), ''),"
            " 'n', size(ms) + aggregate(bs, 0, (n, b) -> n + b.n))",
        ),
    )
    joined = joined.withColumn(done_at, F.when(F.col(map_at).isNotNull(), F.expr(whole)))
    cleaned = F.when(F.col(map_at).isNotNull(), F.col(done_at)["text"]).otherwise(F.col(f"`{text}`"))
    count = F.coalesce(F.col(done_at)["n"], F.lit(0)).cast("bigint")
    columns = [cleaned.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*columns, count.alias(name)), name
