"""Golden rows and properties of the Column expressions."""

import datetime
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vigilog import fixed_values as fixed
from vigilog.functions import fields, patterns, similarity, text, tokens, vectors
from vigilog.operators import reports

SSH = "May 09 12:04:00 ubuntu sshd[7672]: Failed password for usr001 from 203.0.113.11 port 48734 ssh2"
MAC = "2025-05-09 loginwindow[7211]: User login FAILED for user usr002 (UID 586)"


def one(spark, value, function, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(function(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "line, expected",
    [
        (SSH, "may ubuntu sshd failed password for usr001 from port ssh2"),
        (MAC, "-- loginwindow user login f a i l e d for user usr002 (u i d )"),
        (None, ""),
        ("  a b c\x1cd ", "a b c d"),
    ],
)
def test_normalize_text(spark, line, expected):
    assert one(spark, line, text.normalize_text) == expected


@pytest.mark.parametrize(
    "line, expected",
    [
        (SSH, "may ubuntu ssh failed password for usr from port ssh"),
        (MAC, "login user login failed for user usr uid"),
        (None, ""),
    ],
)
def test_preprocess_text(spark, line, expected):
    assert one(spark, line, text.preprocess_text) == expected


def test_preprocess_with_own_patterns_still_removes_times(spark):
    options = {**fixed.SCORING_OPTIONS, "normalization_patterns": []}
    assert one(spark, "at 2025-01-01 10:00:00 x", lambda c: text.preprocess_text(c, options)) == "at x"


@pytest.mark.parametrize("n, expected", [(100, "x" * 100), (101, "x" * 100 + "...")])
def test_preview(spark, n, expected):
    assert one(spark, "x" * n, text.preview) == expected


def test_highlight_is_one_pass_and_longest_first(spark):
    found = one(spark, "login user a.b", lambda c: text.highlight(c, F.array(*map(F.lit, ["log", "login", "a.b", "<"])), "<", ">"))
    assert found == "<login> user <a.b>"
    assert one(spark, "x", lambda c: text.highlight(c, F.array().cast("array<string>"), "<", ">")) == "x"


def test_search_is_a_case_insensitive_regex_and_skips_nulls(spark):
    assert one(spark, "User LOGIN", lambda c: text.matches_search(c, "log.n"))
    assert one(spark, None, lambda c: text.matches_search(c, "log")) is False


def test_row_text_writes_missing_cells(spark):
    row = spark.createDataFrame([(1, None, "b")], "a int, n string, c string")
    assert row.select(text.row_text(["a", "n", "c"])).first()[0] == "1 nan b"


@pytest.mark.parametrize(
    "line, expected",
    [
        ("x sshd[1]: pam_unix", "SSH"), ("sudo: root", "Linux"), ("Logon Type: 3", "Windows"), ("Oracle Audit", "Database"),
        ("nginx[2]: x", "WebServer"), ("vsftpd[2]: x", "FTP"), ("openvpn[1]", "VPN"), ("docker[1]", "Container"),
        ("CRON[1]", "Cron"), ("kernel: x", "System"), ("dovecot", "Email"), ("ldap[1]", "LDAP"),
        ("Login ok", "Application"), ("hello", "Other"),
    ],
)
def test_asset_type(spark, line, expected):
    assert one(spark, line, fields.asset_type) == expected


@pytest.mark.parametrize(
    "line, expected",
    [
        ("Jun  3 04:05:06 host x", datetime.datetime(2025, 6, 3, 4, 5, 6)),
        ("2024-01-02T03:04:05.5Z x", datetime.datetime(2024, 1, 2, 3, 4, 5, 500000)),
        ("a 2024/01/02 03:04:05", datetime.datetime(2024, 1, 2, 3, 4, 5)),
        ("[02/Jan/2024:03:04:05 +0000]", datetime.datetime(2024, 1, 2, 3, 4, 5)),
        ("2024-01-02 03:04:05 x", datetime.datetime(2024, 1, 2, 3, 4, 5)),
        ("01/02/2024 03:04:05", datetime.datetime(2024, 1, 2, 3, 4, 5)),
        ("no time", None),
    ],
)
def test_line_time(spark, line, expected):
    found = one(spark, line, lambda c: F.date_format(fields.line_time(c, 2025), "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    assert found == (expected and expected.strftime("%Y-%m-%d %H:%M:%S.%f"))


def test_entities_of_a_line(spark, lines):
    log = lines(["user=mail@company.com from 10.0.0.1 at db.corp.local postfix/smtpd[5678]: 2024-01-01 10:00:00"])
    found = {(r["type"], r["entity"]) for r in reports.entity_rows(log).collect()}
    assert {("User", "mail"), ("Email", "mail@company.com"), ("IP", "10.0.0.1"), ("Host", "db.corp.local")} <= found
    assert ("File", "/smtpd[5678]") in found and ("Timestamp", "2024-01-01 10:00:00") in found
    assert not any(t == "Host" and e == "10.0.0.1" for t, e in found)


def test_known_hosts_without_a_dot(spark, lines):
    found = reports.entity_rows(lines(["web01 is up"]), known_hosts=["web01"]).collect()
    assert [(r["type"], r["entity"]) for r in found] == [("Host", "web01")]


def test_attack_confidence(spark, lines):
    hits = reports.detect_attacks(lines(["failed login", "failed login failed  login", "ok"])).collect()
    assert {(r["line_id"], r["confidence"], len(r["matches"])) for r in hits} == {(0, 0.7, 1), (1, 1.0, 2), (1, 0.7, 1)}
    assert reports.detect_attacks(lines(["failed login"]), threshold=0.8).count() == 0
    assert reports.detect_attacks(lines(["failed login <script>"]), categories=["XSS"]).count() == 1
    assert reports.detect_attacks(lines(["failed login"]), categories=[]).count() == 0


def test_many_attack_patterns_take_several_passes(spark, lines):
    log = lines(["failed login and <script> union select"])
    assert reports.detect_attacks(log, per_pass=3).exceptAll(reports.detect_attacks(log)).count() == 0
    assert {r["pattern"] for r in reports.detect_attacks(log, per_pass=3).collect()} == {r"failed\s+login", "<script>", r"union\s+select"}


def test_dictionary_labels(spark, lines):
    log = lines(['"Status": {"value": "0"', "Connect Access denied for user", "nothing", "USER_LOGON x SUCCESS"])
    found = {r["line_id"]: r for r in reports.dictionary_labels(log).collect()}
    assert found[0]["label"] == "authentication_success" and found[0]["authentication_success_hits"] == [5]
    assert found[1]["label"] == "authentication_failure" and found[1]["authentication_success_hits"] == [11]
    assert found[2]["label"] == "none" and found[3]["label"] == "authentication_success"


def test_braces_are_literal():
    assert patterns.escape_braces('{"a"}') == r'\{"a"\}'


def test_tokens_of_any_script(spark):
    assert one(spark, "été 10.0 x", tokens.tokenize) == ["été", "10", ".", "0", "x"]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\x00"), max_size=25), min_size=20, max_size=20))
def test_tokens_equal_python(spark, texts):
    # Both sides use their own Unicode tables: letters one of them does not know yet are left out.
    texts = ["".join(c for c in t if unicodedata.category(c) not in ("Cn", "Co")) for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, v string").select("i", tokens.tokenize(F.col("v")).alias("t"))
    known = re.compile(r"[\u0000-ӿ]*")
    for row in rows.collect():
        if known.fullmatch(texts[row["i"]]):
            assert row["t"] == re.findall(r"\w+|[^\w\s]", texts[row["i"]])


def test_bio_tags_golden(spark):
    line = "2023-12-15 09:30:45 - Authentication failed for admin from 192.168.1.100 on port 22"
    tagged = {t["token"]: t["tag"] for t in one(spark, line, tokens.bio_tags)}
    assert tagged["failed"] == "B-STATUS" and tagged["admin"] == "B-USERNAME" and tagged["22"] == "B-PORT"
    assert tagged["for"] == tagged["from"] == tagged["port"] == "O" and tagged["2023"] == "B-TIMESTAMP"
    staged = spark.createDataFrame([(line,)], "v string").select(tokens.bio_tags(F.col("v")).alias("t"))
    spans = staged.select(tokens.last_span_per_type(tokens.entity_spans(F.col("t")))).first()[0]
    assert spans["IP_ADDRESS"] == "192 . 168 . 1 . 100" and spans["USERNAME"] == "admin"
    assert one(spark, None, tokens.bio_tags) == []


def test_spans_close_at_another_type(spark):
    kind = "array<struct<pos:int,start:int,end:int,token:string,tag:string>>"
    tagged = [(i, i, i + 1, w, t) for i, (w, t) in enumerate([("a", "B-X"), ("b", "I-X"), ("c", "I-Y"), ("d", "I-X"), ("e", "B-X"), ("f", "B-Y")])]
    found = one(spark, tagged, tokens.entity_spans, kind)
    assert [(s["ord"], s["type"], s["value"]) for s in found] == [(0, "X", "a b"), (1, "X", "e"), (2, "Y", "f")]


def test_spans_of_many_rows_in_one_pass(spark):
    """Rows end spans; missing tags go on with a span, missing tokens are left out; all of it leaves Python once."""
    kind = "i int, t array<struct<pos:int,start:int,end:int,token:string,tag:string>>"
    tag = lambda words: [(i, i, i + 1, w, t) for i, (w, t) in enumerate(words)]
    rows = [(0, tag([("a", "B-X")])), (1, tag([("b", "I-X"), ("c", "O"), ("d", "B-X"), (None, "I-X"), ("e", None), ("f", "I-X")])), (2, None), (3, []),
            (4, tag([("g", "B-Y"), ("h", "B-X"), ("i", "I-Y"), ("j", "B-Y")]))]
    df = spark.createDataFrame(rows, kind).coalesce(1)
    found = df.select("i", tokens.entity_spans(F.col("t")).alias("s")).orderBy("i").collect()
    assert [[tuple(s) for s in r["s"]] for r in found] == [
        [(0, "X", "a")], [(0, "X", "d e f")], [], [], [(0, "Y", "g"), (1, "X", "h"), (2, "Y", "j")]]
    lines = spark.createDataFrame([(0, "Failed login for bob from 10.0.0.1 port 22"), (1, None)], "i int, v string")
    last = lines.select("i", tokens.bio_tags(F.col("v")).alias("t")).select("i", tokens.last_span_per_type(tokens.entity_spans(F.col("t"))).alias("m"))
    plan = last._jdf.queryExecution().optimizedPlan().toString()
    assert sum("ArrowEvalPython" in x for x in plan.splitlines()) == 1
    assert {r["i"]: r["m"] for r in last.collect()} == {0: {"STATUS": "Failed", "USERNAME": "bob", "IP_ADDRESS": "10 . 0 . 0 . 1", "PORT": "22"}, 1: {}}


def test_cosine_guard_and_softmax(spark):
    row = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0], [3.0, 4.0])], "z array<double>, a array<double>, b array<double>")
    zero, some, soft, best = row.select(
        vectors.cosine(F.col("z"), F.col("a")), vectors.cosine(F.col("a"), F.col("b")),
        vectors.softmax(F.array(F.lit(0.0), F.lit(0.0))), vectors.first_argmax(F.array(F.lit(1.0), F.lit(2.0), F.lit(2.0))),
    ).first()
    assert zero == 0.0 and some == pytest.approx(0.6) and soft == [0.5, 0.5] and best == 2


def longest_common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcé", max_size=90), st.text("abcé", max_size=90))
def test_common_subsequence_equals_brute_force(a, b):
    assert similarity.common_subsequence(a, b) == longest_common(a, b)
    assert similarity.ratio(a, b) == (2 * longest_common(a, b) / (len(a) + len(b)) if a or b else 1.0)


def test_tfidf_of_two_texts(spark):
    pairs = spark.createDataFrame([(1, "login failed", "login failed"), (2, "a b", "c d"), (3, "login ok", "login no")], "k int, a string, b string")
    found = {r["k"]: r["lexical"] for r in similarity.tfidf_similarity(pairs, "a", "b").collect()}
    weight = 1 + __import__("math").log(1.5)
    assert found[1] == pytest.approx(1) and found[2] == 0 and found[3] == pytest.approx(1 / (1 + weight * weight))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcé", max_size=30), st.text(alphabet="abcé", max_size=30), st.floats(0, 1))
def test_ratio_with_a_threshold(a, b, least):
    total = len(a) + len(b)
    expected = 2 * longest_common(a, b) / total if total else 1.0
    assert similarity.ratio(a, b) == expected
    assert similarity.ratio_at_least(a, b, least) == (expected if expected >= least else None)


def test_ratio_of_long_texts():
    """100,000 characters: linear where the ends agree, and left early where nothing can come of it."""
    import random
    import time

    r = random.Random(1)
    a = "".join(r.choice("abcdefghij ") for _ in range(100_000))
    b = a[:60_000] + "xyz" * 40 + a[60_050:]
    start = time.time()
    assert similarity.common_subsequence(a, b) == 99_950
    c = "".join(r.choice("klmnopqrstuv") for _ in range(100_000))
    assert similarity.ratio_at_least(a, c, 0.5) is None
    d = "".join(r.choice("abcdefghij ") for _ in range(100_000))
    assert similarity.ratio_at_least(a, d, 0.95) is None
    assert time.time() - start < 10
