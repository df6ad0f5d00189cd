"""Host rules, line templates, decontamination."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from llm_cases import ODD, make_docs, prose  # noqa: F401

from strandline.llm import host_rules, line_templates, wu_manber

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_measures(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    found = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if found[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines), len(lines) - len(set(lines)), len(covered)


TEXTS = [*ODD, "a b a b a b a", "a b c x a b c y b c x a", "# <b> $5 | & %\n# <b> $5 | & %", "x\vy\fz\rw"]


def test_measures_equal_brute_force(make_docs, prose):
    texts = [*TEXTS, *[prose(i, 300) + " " + prose(i, 20) for i in range(5)]]
    docs = make_docs(list(enumerate(texts)))
    rows = docs.select("doc_id", host_rules.measures().alias("m")).collect()
    for row in rows:
        assert tuple(row["m"][c] for c in host_rules.MEASURES) == brute_measures(texts[row["doc_id"]]), row["doc_id"]


def test_hosts_are_judged_with_a_prior(make_docs, prose):
    good = [(i, prose(i, 80), f"good{i % 4}") for i in range(80)]
    poor = [(100 + i, "too short", "poor") for i in range(30)] + [(200, prose(200, 80), "poor"), (201, prose(201, 80) + " #" * 40, "poor")]
    single = [(300, "too short", "single"), (301, prose(301, 80) + " #" * 40, "good1"), (302, prose(302, 80), None)]
    scored, q = host_rules.judged(make_docs(good + poor + single, clashing=True))
    got = {r["doc_id"]: r[q] for r in scored.collect()}
    assert len(got) == len(good) + len(poor) + len(single)
    assert all(got[i]["kept"] for i in range(80)) and not any(got[100 + i]["kept"] for i in range(30))
    assert got[200]["host_verdict"] == "blocked" and not got[200]["kept"]
    assert got[300]["host_verdict"] != "blocked", "one failure of one document is not evidence enough"
    assert got[301]["failed"] and got[301]["kept"], "a symbol-heavy text of a good host stays"
    assert got[302]["host_docs"] == 1 and got[302]["kept"]


@pytest.mark.parametrize("rows", [[], [(None, None, None)] * 3])
def test_rules_with_nothing_to_judge(make_docs, rows):
    scored, q = host_rules.judged(make_docs(rows))
    assert [r[q]["kept"] for r in scored.collect()] == [False] * len(rows)


def cleaned(docs):
    out, lines = line_templates.without_recurring_lines(docs)
    return {r["doc_id"]: (r["text"], r[lines]["n_lines"], r[lines]["n_dropped"]) for r in out.collect()}


def test_recurring_templates_go_but_stay_in_the_first_document(make_docs, prose):
    footer = "Page {} of 10 was printed by the archive of the town"
    rows = [(i, f"{prose(i, 12)}\n{footer.format(i)}\n{prose(i + 50, 12)}") for i in range(5)]
    rows += [(9, "copy of the same\ncopy of the same"), (10, prose(77, 9) + "\nAre."), (11, prose(78, 9) + "\nAre."), (12, "Are.")]
    got = cleaned(make_docs(rows, clashing=True))
    assert got[0] == (rows[0][1], 3, 0)
    for i in range(1, 5):
        first, _, last = rows[i][1].split("\n")
        assert got[i] == (f"{first}\n{last}", 3, 1)
    assert all(got[r[0]] == (r[1], r[1].count("\n") + 1, 0) for r in rows[5:])


def test_words_become_variable_fields_too(make_docs):
    names = ["anton", "berta", "carla", "dora", "emil"]
    rows = [(i, f"the request of user {n} was refused by the server today") for i, n in enumerate(names)]
    got = cleaned(make_docs(rows))
    assert [got[i][2] for i in range(5)] == [0, 1, 1, 1, 1]
    assert got[1][0] == ""


def test_numeric_rows_recur_only_if_their_values_do(make_docs):
    rows = [(i, f"{1980 + i} {i}.2 {3 * i}.1\n{i} apples {7 * i} {9 * i}") for i in range(6)]
    rows += [(10 + i, f"2019 14.2   33.1\n{40 + i} 1 2 {i}") for i in range(4)]
    got = cleaned(make_docs(rows))
    assert all(got[i] == (rows[i][1], 2, 0) for i in range(6)), "equal shapes, different values"
    assert got[10] == (rows[6][1], 2, 0)
    assert all(got[10 + i] == (f"{40 + i} 1 2 {i}", 2, 1) for i in range(1, 4)), "the same values"


def test_long_passages_recur_from_two_documents_on(make_docs, prose):
    passage, short = prose(30, 50), prose(31, 49)
    rows = [(i, f"{prose(i, 60)}\n{passage}\n{short}\n{prose(i + 10, 60)}") for i in (1, 2)]
    rows += [(3, prose(32, 55)), (3, prose(32, 55)), (4, prose(33, 55) + " 1"), (5, prose(33, 55) + " 2")]
    got = cleaned(make_docs(rows))
    assert got[1] == (rows[0][1], 4, 0)
    assert got[2] == (f"{prose(2, 60)}\n{short}\n{prose(12, 60)}", 4, 1)
    assert all(got[i][2] == 0 for i in (3, 4, 5)), "repeated rows are one document, and these lines differ in a token"


def test_lines_are_parsed_at_any_white_space_without_a_regex_split(make_docs):
    texts = ["a\tb \x0b c\x0cd\re\n\n  x1\ty \xa0z  \n", "no digit here\nitem 12 of\t3b", "", "\t \r"]
    parsed = make_docs(list(enumerate(texts))).select("text", line_templates._parsed("text", line_templates.TemplatePolicy(), True).alias("lines"))
    assert "x09-\\x0D]+, -1)" not in parsed._jdf.queryExecution().optimizedPlan().toString(), "a pattern is compiled for each line"
    for row in parsed.collect():
        words = [[w for w in re.split(r"[\x20\x09-\x0D]+", line) if w] for line in row.text.split("\n")]
        masked = [["<*>" if re.search("[0-9]", w) else w for w in line] for line in words]
        assert [(l.n, l.masked) for l in row.lines] == [(len(w), " ".join(w)) for w in masked]


def test_texts_are_parsed_once(make_docs, monkeypatch):
    keep, plans = line_templates.keep, {}

    def watched(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return keep(df, name)

    monkeypatch.setattr(line_templates, "keep", watched)
    rows = [(i, f"the same line of words {i}\nsaid twice here now\nsaid twice here now\nonly {'in ' * i}this text") for i in range(5)]
    got = cleaned(make_docs(rows))
    assert [name for name, plan in plans.items() if "regexp_replace" in plan] == ["lines"]
    assert [got[i][2] for i in range(5)] == [0, 3, 3, 3, 3]


def test_odd_texts_repeated_rows_and_no_rows(make_docs):
    rows = list(enumerate(ODD)) + [(None, "same line of words here")] * 4 + [(i, "same line of words here") for i in (50, 51)]
    got = cleaned(make_docs(rows))
    assert all(got[i][0] == t for i, t in enumerate(ODD))
    assert (got[50][2], got[51][2], got[None][2]) == (0, 1, 1), "NULL ids come last, and repeated rows are treated alike"
    assert cleaned(make_docs([])) == {}


def brute_hits(text, items):
    words = wu_manber.words_of(text)
    hit, found = set(), set()
    for item, body in items:
        pattern = wu_manber.words_of(body)
        m = min(10, len(pattern))
        windows = {tuple(pattern[i : i + m]) for i in range(len(pattern) - m + 1)} if m else set()
        for i in range(len(words) - m + 1 if m else 0):
            if tuple(words[i : i + m]) in windows:
                hit.update(range(i, i + m))
                found.add(item)
    return len(words), len(hit), sorted(str(f) for f in found if f is not None)


@pytest.mark.parametrize("block_bytes", [1_000_000, 200])
def test_search_equals_brute_force(spark, make_docs, prose, block_bytes):
    items = [(i, prose(i, 12 + i)) for i in range(12)] + [(20, "short one"), (21, "word"), (22, None), (23, "..."), (None, prose(40, 15)), (5, prose(41, 11))]
    texts = [
        *ODD,
        prose(90, 30) + " " + prose(3, 15).upper() + ", " + prose(91, 10),
        prose(3, 9),
        f"a short-one {prose(40, 15)} {prose(4, 16)} {prose(4, 16)}",
        " ".join(prose(7, 19).split()[4:16]) + " " + prose(41, 11),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = make_docs([*enumerate(texts), (3, texts[3]), (None, texts[-1])], clashing=True)
    out, found = wu_manber.occurrences(docs, benchmark, block_bytes=block_bytes)
    rows = out.select("doc_id", "text", found, wu_manber.n_hit(found).alias("n_hit")).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        assert (r[found]["n_words"], r["n_hit"], r[found]["items"]) == brute_hits(r["text"], items)


def test_search_without_items_or_documents(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    out, found = wu_manber.occurrences(make_docs([(1, "a b")]), none)
    assert [(r[found]["n_words"], r[found]["spans"]) for r in out.collect()] == [(2, [])]
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert wu_manber.occurrences(make_docs([]), some)[0].count() == 0
