"""Patterns in one pass give the rows of trying every pattern on every line."""

import random
import re

import pytest

from vigilog import fixed_values as fixed
from vigilog.operators import pattern_scan as ps
from vigilog.operators import reports

TRICKY = [
    r"failed\s+login", r"(foo|ba+r|quux)\d", r"a?b?c", r"\d+", r"x{2,}y", r"(?:ab){3}", r"[Uu]nion\s+select", r"colou?r", r"^start", r"end$", r"\bword\b",
    r"é+toile", r"a|b", r"(ab|)c", r"\Qa.b\E", r"\p{Lu}oo", r"[a[bc]]d", r"(?<name>key)=\d", r"(?i)MiXed", r"look(?=ahead)", r"(?<!no)behind", r"a\.b", r"tab\there", "kelvin", "strasse", r"\0101bc", "x*+yz"
]


@pytest.fixture
def folder(tmp_path):
    names = iter(range(1000))
    return lambda: str(tmp_path / f"patterns{next(names)}")


def by_every_pattern(lines, patterns):
    grouped = {}
    for category, pattern in patterns:
        grouped.setdefault(category, []).append(pattern)
    return reports.detect_attacks(lines, grouped)


def rows(df):
    return sorted((r["line_id"], r["category"], r["pattern"], r["matches"], r["confidence"]) for r in df.collect())


def test_equals_trying_every_pattern(spark, lines, folder):
    texts = ["Failed  LOGIN failed login", "foo1 bar2 baaar3 quux", "c", "xxxy", "ababab", "UNION select", "color colour", "start", "the end", "a word here", "éétoile",
             "AxB", "a.b Foo", "bd ad", "key=7", "mixed", "lookahead look", "nobehind behind", "tab\there", "\u212aelvin", "\u017ftra\u017f\u017fe", "Abc", "xxyz aab a{2}b", "", None]
    patterns = [(f"c{i % 3}", p) for i, p in enumerate(TRICKY)]
    table = spark.createDataFrame([*patterns, patterns[0], ("c0", None)], "category string, pattern string")
    expected = rows(by_every_pattern(lines(texts), patterns))
    assert rows(ps.detect_attacks_from(lines(texts), table, folder())) == expected
    assert len({r[2] for r in expected}) >= 20


def test_five_thousand_patterns_in_one_pass(spark, lines, folder):
    r = random.Random(1)
    words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    patterns = sorted({("pairs", rf"{r.choice(words)}\s+{r.choice(words)}") for _ in range(5000)} | {("words", w) for w in words[:500]})
    texts = [" ".join(r.choice(words) for _ in range(30)) for _ in range(150)]
    found = ps.detect_attacks_from(lines(texts), spark.createDataFrame(patterns, "category string, pattern string"), folder())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and words[0] not in plan
    compiled = [(c, p, re.compile(p, re.IGNORECASE)) for c, p in patterns]
    expected = sorted((i, c, p, m, min(1.0, len(m) * 0.3 + 0.4)) for i, t in enumerate(texts) for c, p, x in compiled if (m := x.findall(t)))
    assert rows(found) == expected and expected


def test_dictionary_labels(spark, lines, folder):
    texts = ["Accepted password for x", "Failed password for y, Accepted password for z", "nothing", '"Status": {"value": "0"', None, "USER_LOGON then SUCCESS"]
    table = spark.createDataFrame([(c, i, p) for c, ps_ in fixed.EVENT_PATTERNS.items() for i, p in enumerate(ps_)], "category string, ord int, pattern string")
    found = {r["line_id"]: (r["label"], [tuple(x) for x in r["hits"]]) for r in ps.dictionary_labels_from(lines(texts), table, folder()).collect()}
    names = list(fixed.EVENT_PATTERNS)
    for r in reports.dictionary_labels(lines(texts)).collect():
        hits = sorted((c, i) for c in names for i in r[f"{c}_hits"])
        assert found[r["line_id"]] == (r["label"], hits)


def test_without_patterns(spark, lines, folder):
    nothing = spark.createDataFrame([], "category string, ord int, pattern string")
    assert ps.detect_attacks_from(lines(["a"]), nothing, folder()).collect() == []
    assert [r["label"] for r in ps.dictionary_labels_from(lines(["a"]), nothing, folder()).collect()] == ["none"]


@pytest.mark.parametrize("pattern, literals", [
    (r"failed\s+login", ["failed"]), (r"(foo|bar)x", ["bar", "foo"]), (r"a?b", ["b"]), (r"\d+", None), (r"(a|)b", ["b"]), ("plain TEXT", ["plain text"]), ("a{2}b", ["a"]), (r"(abc)*d", ["d"]),
    (r"(abc){2}d", ["abc"]), (r"é", None), (r"\Qx\E", None), (r"[ab]+cd", ["cd"])])
def test_needed_literals(pattern, literals):
    assert ps.needed(pattern) == literals


def test_words_behind_each_other_are_one_literal(tmp_path):
    """Both words somewhere in a line are no candidate; any white space between them is."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    patterns = [r"lorem\s+ipsum", r"a\s*b", r"x  y", r"(?:one\s+two|six\s{2,}ten)!", r"\s+"]
    assert [ps.needed_squeezed(p) for p in patterns] == [["lorem ipsum"], ["a"], ["x  y"], ["one two", "six ten"], [" "]]
    assert ps.needed(patterns[0]) == ["lorem"]
    pq.write_table(pa.table({"category": ["c"] * 5, "ord": [0] * 5, "pattern": patterns}), str(tmp_path / "p.parquet"))
    scan = ps.Automaton(str(tmp_path), ps.needed_squeezed)
    assert scan.candidates("lorem-dolor-ipsum") == set()
    for blank in (" ", "\n", "\t \u00a0", "\u2003\u180e"):
        assert 0 in scan.candidates(f"LOREM{blank}Ipsum")
    assert 2 in scan.candidates("x  y") and 3 in scan.candidates("six \t ten!")


def test_a_line_is_not_copied_for_each_pattern(spark, lines, folder):
    table = spark.createDataFrame([("c", 0, f"w{i}\\s+w{i + 1}") for i in range(50)], "category string, ord int, pattern string")
    text = " ".join(f"w{i}" for i in range(40))
    found = ps.candidate_lists(lines([text, "nothing", None]), table, folder()).collect()
    assert len(found) == 1 and len(found[0]["candidates"]) == 39
