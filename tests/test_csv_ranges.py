"""Files cut into ranges of a few bytes: the same records and lines as read in one piece."""

import csv
import io
import random

import pytest

from vigilog.sources import csv_ranges, files


@pytest.fixture
def small_ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def use(size):
        for n in names:
            spark.conf.set(n, str(size))

    yield use
    for n, value in zip(names, before):
        spark.conf.set(n, value)


def cells(r):
    kinds = ["plain", "", 'say "hi"', "two\nlines", "a,b", "é\n\n\"\"x", "tail\n", " padded ", '"', "x" * 90 + "\n" + "y" * 200]
    return [str(r.randrange(1000)), r.choice(kinds), r.choice(kinds), r.choice(kinds) or "z"]


def write(path, rows, header=("LineId", "A", "EventId", "Content"), end="\n"):
    text = io.StringIO()
    csv.writer(text, lineterminator=end).writerows([header, *rows])
    path.write_bytes(text.getvalue().encode())


@pytest.mark.parametrize("size", [150, 1 << 20])
def test_equals_reading_each_file_whole(spark, tmp_path, small_ranges, size):
    r = random.Random(size)
    for name in ("a.csv", "b.csv"):
        write(tmp_path / name, [cells(r) for _ in range(25)])
    whole = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path))
    expected = sorted((tuple(x) for x in whole.collect()), key=str)
    small_ranges(size)
    rows = csv_ranges.csv_rows(spark, str(tmp_path))
    assert sorted((tuple(x["cells"]) for x in rows.collect()), key=str) == expected
    if size == 150:
        assert spark.read.text(str(tmp_path / "a.csv")).rdd.getNumPartitions() > 5  # one file, many tasks


def test_order_headers_and_odd_ends(spark, tmp_path, small_ranges):
    (tmp_path / "a.csv").write_bytes('﻿ID,"Lo\ng"\r\n1,"x\r\ny"\r\n\r\n   \r\n2,z\r\n3,"no end\nof quotes'.encode())
    (tmp_path / "b.csv").write_text("\n\nTime,Host,Message\nt1,h1,gamma\nshort\n")
    (tmp_path / "c.csv").write_text("")
    (tmp_path / "d.csv").write_text("only header")
    for size in (17, 1 << 20):
        small_ranges(size)
        rows = sorted(csv_ranges.csv_rows(spark, str(tmp_path)).collect(), key=lambda x: (x["source"], x["place"]))
        found = [(x["source"][-5:], x["names"], x["cells"]) for x in rows]
        assert found[:2] == [("a.csv", ["ID", "Lo\ng"], ["1", "x\r\ny"]), ("a.csv", ["ID", "Lo\ng"], ["2", "z"])]
        assert found[-2:] == [("b.csv", ["Time", "Host", "Message"], ["t1", "h1", "gamma"]), ("b.csv", ["Time", "Host", "Message"], ["short", None, None])]
        assert len(found) <= 5


def test_structured_files_with_headers_of_their_own(spark, tmp_path):
    write(tmp_path / "a.csv", [["1", "INFO", "E1", "two\nlines"]])
    write(tmp_path / "b.csv", [["x", "7", ""]], header=("Extra", "LineId", "Content"))
    found = {r["line_id"]: r["text"] for r in files.structured_csv(spark, str(tmp_path)).collect()}
    assert found == {1: "INFO two\nlines", 7: "x nan"}


def test_wide_rows_make_a_file_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text("first line\na, b, c\n")
    (tmp_path / "b.csv").write_text("A,B\n1,2\n")
    found = sorted((r["source"][-5:], r["line"]) for r in files.csv_lines(spark, str(tmp_path)).collect())
    assert found == [("a.csv", "a, b, c"), ("a.csv", "first line"), ("b.csv", "2")]


@pytest.mark.parametrize("size", [50, 1 << 20])
def test_latin_files_beside_others(spark, tmp_path, small_ranges, size):
    (tmp_path / "u.csv").write_bytes("ID,Log\n1,été\n".encode())
    (tmp_path / "l.csv").write_bytes("ID,Log\n1,été\n".encode("latin-1"))
    (tmp_path / "t.log").write_bytes(("x\x85y\n" * 30 + "é\n" + "plain  \n" * 0 + "z\n" * 40).encode("latin-1"))
    (tmp_path / "v.log").write_bytes("é b\n\n  \nc".encode())
    small_ranges(size)
    assert sorted(r["line"] for r in files.csv_lines(spark, str(tmp_path / "[ul].csv")).collect()) == ["été", "été"]
    lines = sorted((r["source"][-5:], r["line_number"], r["line"]) for r in files.text_lines(spark, str(tmp_path / "*.log")).collect())
    latin = [x for _ in range(30) for x in ("x", "y")] + ["é"] + ["z"] * 40
    assert lines == [("t.log", i, x) for i, x in enumerate(latin, 1)] + [("v.log", 1, "é"), ("v.log", 2, "b"), ("v.log", 3, "c")]


def test_lines_are_not_shuffled(spark, tmp_path):
    (tmp_path / "a.log").write_text("a\nb\n")
    numbered = files.text_lines(spark, str(tmp_path))
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == plan.count("Window [")  # windows over ranges only
    assert "line" not in "".join(x for x in plan.splitlines() if "Window" in x)
    assert [(r["line_number"], r["line"]) for r in numbered.orderBy("line_number").collect()] == [(1, "a"), (2, "b")]
