"""Files in and out, small side inputs, streams."""

import json

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from vigilog.operators import corrections, searches
from vigilog.plans.queries import log_stream, logs
from vigilog.session import scratch_path
from vigilog.sources import banks, files, tables
from vigilog.streaming import searches as streams


def test_text_lines_are_stripped_numbered_and_decoded(spark, tmp_path):
    (tmp_path / "a.log").write_bytes("  one \r\n\n \ntwo\x0bthree four\n".encode())
    (tmp_path / "b.log").write_bytes("café\nüber".encode("latin-1"))
    rows = files.text_lines(spark, str(tmp_path)).collect()
    found = {(r["source"][-5:], r["line_number"]): r["line"] for r in rows}
    assert found == {
        ("a.log", 1): "one", ("a.log", 2): "two", ("a.log", 3): "three", ("a.log", 4): "four",
        ("b.log", 1): "café", ("b.log", 2): "über",
    }
    assert files.text_lines(spark, str(tmp_path / "b.log"), "ISO-8859-1").count() == 2
    assert files.text_lines(spark, str(tmp_path / "a.log"), "utf-8", number=False).columns == ["source", "line"]


def test_line_numbers_across_file_splits(spark, tmp_path):
    expected = [f"line {i} {'x' * (i % 40)}!" for i in range(5000)]
    (tmp_path / "big.log").write_text("\n".join(expected))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        rows = files.text_lines(spark, str(tmp_path)).orderBy("line_number").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["line"] for r in rows] == expected
    assert [r["line_number"] for r in rows] == list(range(1, 5001))


def test_csv_lines(spark, tmp_path):
    (tmp_path / "good.csv").write_text('ID,Asset,Log\n1,A,"say ""hi"", you"\n2,B,\n3,C,NaN\n4,D,"two\nlines"\n')
    found = sorted(r["line"] for r in files.csv_lines(spark, str(tmp_path / "good.csv")).collect())
    assert found == ['say "hi", you', "two\nlines"]
    (tmp_path / "one.csv").write_text("log\nalpha\n\nbeta\n")
    assert sorted(r["line"] for r in files.csv_lines(spark, str(tmp_path / "one.csv")).collect()) == ["alpha", "beta"]


def test_csv_files_with_headers_of_their_own(spark, tmp_path):
    (tmp_path / "a.csv").write_text('ID,Log\n1,alpha\n2,"be,ta"\n')
    (tmp_path / "b.csv").write_text("Time,Host,Message\nt1,h1,gamma\nt2,h2,delta\n")
    (tmp_path / "c.csv").write_text('ID,Log\n3,"ep\nsilon"\n')
    (tmp_path / "d.csv").write_text("only\na, b, c\n")
    found = sorted((r["source"][-5:], r["line"]) for r in files.csv_lines(spark, str(tmp_path)).collect())
    assert found == [
        ("a.csv", "alpha"), ("a.csv", "be,ta"), ("b.csv", "delta"), ("b.csv", "gamma"), ("c.csv", "ep\nsilon"), ("d.csv", "a, b, c"), ("d.csv", "only"),
    ]


def test_structured_cells_may_hold_line_breaks(spark, tmp_path):
    (tmp_path / "s.csv").write_text('LineId,Level,Content,EventId\n1,INFO,"two\nlines",E1\n2,WARN,one,E2\n')
    found = {r["line_id"]: r["text"] for r in files.structured_csv(spark, str(tmp_path / "s.csv")).collect()}
    assert found == {1: "INFO two\nlines", 2: "WARN one"}


def test_broken_csv_is_read_as_text(spark, tmp_path):
    (tmp_path / "broken.csv").write_text("first line\na, b, c\nlast\n")
    found = sorted(r["line"] for r in files.csv_lines(spark, str(tmp_path)).collect())
    assert found == ["a, b, c", "first line", "last"]


def test_admission(spark, tmp_path):
    for name in ("a.LOG", "b.txt", "c.exe", "big.csv"):
        (tmp_path / name).write_text("x" * (50 if name == "big.csv" else 5))
    rows = {r["name"]: r["reason"] for r in files.admission(files.file_listing(spark, str(tmp_path)), 20).collect()}
    assert rows["a.LOG"] is None and rows["b.txt"] is None
    assert rows["c.exe"].startswith("Unsupported file type: exe") and rows["big.csv"].startswith("File too large: 50")
    unlimited = files.admission(files.file_listing(spark, str(tmp_path)), None)
    assert unlimited.filter("name = 'big.csv' and reason is null").count() == 1


def test_exports(spark, tmp_path, lines):
    log = lines(["b", "a, \"q\"", "c"])
    files.write_csv(files.export_rows(log), str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert {(r["line_number"], r["log_line"]) for r in back.collect()} == {("1", "b"), ("2", 'a, "q"'), ("3", "c")}
    files.write_first_lines(log, str(tmp_path / "head"), n=2)
    assert [r["value"] for r in spark.read.text(str(tmp_path / "head")).collect()] == ["b", 'a, "q"']
    assert [r["preview"] for r in files.preview_lines(log, n=2).orderBy("preview").collect()] == ["1: b", '2: a, "q"']


def test_banks(spark, tmp_path):
    assert banks.example_bank(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "bank.csv").write_text('ID,Asset,Log\n1,Ubuntu,"Failed password, port 22"\n')
    row = banks.example_bank(spark, str(tmp_path / "bank.csv")).first()
    assert row["normalized_log"] == "failed password port" and row["ID"] == 1
    (tmp_path / "p.json").write_text(json.dumps({"good": ["a", "b{"], "bad": ["c"]}))
    table = banks.pattern_dictionary(spark, str(tmp_path / "p.json"))
    assert banks.patterns_by_category(table) == {"good": ["a", "b{"], "bad": ["c"]}
    (tmp_path / "t.txt").write_text("Jan B-DATE\n15 I-DATE\n: O\n\nuser O\nbob B-USER\n")
    rows = banks.tagged_sentences(spark, str(tmp_path / "t.txt")).collect()
    assert [(r["pos"], r["token"], r["tag"]) for r in sorted(rows, key=lambda r: (r["sentence"], r["pos"]))] == [
        (0, "Jan", "B-DATE"), (1, "15", "I-DATE"), (2, ":", "O"), (0, "user", "O"), (1, "bob", "B-USER"),
    ]


def test_stored_corrections(spark, tmp_path):
    stored = [
        {"log_text": "a", "original_prediction": {"label": "x", "confidence": 1.0}, "user_correction": {"label": "other_login", "confidence": 1.0},
         "timestamp": "2025-05-31 18:42:26.947990", "record_id": "0123456789ab", "used_for_training": True},
        {"log_text": "b", "original_prediction": {"label": "x", "confidence": 1.0}, "user_correction": {"label": "successful_login", "confidence": 1.0},
         "timestamp": "2025-06-01"},
    ]
    (tmp_path / "c.json").write_text(json.dumps(stored, indent=2))
    rows = corrections.load_corrections(spark, str(tmp_path / "c.json"), multi_line=True)
    stats = corrections.usage_stats(rows).first()
    assert (stats["total"], stats["used"], stats["unused"], stats["usage_rate"]) == (2, 1, 1, 50.0)
    assert rows.filter("log_text = 'b'").first()["record_id"] == __import__("hashlib").md5(b"b2025-06-01").hexdigest()[:12]
    corrections.write_snapshot(rows, str(tmp_path / "v1"))
    with pytest.raises(Exception):
        corrections.write_snapshot(rows, str(tmp_path / "v1"))


def test_scratch_path_follows_the_setting(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(root) and scratch_path(spark, "x") != scratch_path(spark, "x")


@pytest.mark.parametrize(
    "make, window, start",
    [(streams.hourly_stream, "1 hour", None), (streams.daily_summary_stream, "1 day", "9 hours")],
)
def test_complete_stream_equals_batch(spark, make, window, start):
    path = scratch_path(spark, "versions")
    streams.start_to_versions(make(log_stream(spark, SMALL)), path, path + "-checkpoint").awaitTermination()
    versions = spark.read.parquet(path)
    newest = versions.filter(F.col("version") == versions.agg(F.max("version")).scalar()).drop("version")
    batch = searches.with_event_category(logs(spark, SMALL)).withColumn("ts", F.col("ts").cast("timestamp"))
    counted = batch.groupBy(F.window("ts", window, startTime=start).alias("w"), "event_category").agg(F.count(F.lit(1)).alias("events"))
    expected = counted.select("w.start", "w.end", "event_category", "events")
    assert newest.exceptAll(expected).count() == 0 and expected.exceptAll(newest).count() == 0


def test_text_stream(spark, tmp_path):
    (tmp_path / "a.log").write_text(" x \n\ny\x0bz\n")
    path = scratch_path(spark, "textstream")
    streams.start_to_files(files.text_stream(spark, str(tmp_path)), path, path + "-checkpoint").awaitTermination()
    assert sorted(r["line"] for r in spark.read.parquet(path).collect()) == ["x", "y", "z"]


def test_a_file_of_one_row_group_is_dealt_out(spark, tmp_path, monkeypatch):
    """On a cluster too, and where Spark cuts the file by bytes into splits of which one has all rows."""
    path = str(tmp_path / "one")
    spark.range(200_000).selectExpr("id", "md5(cast(id AS string)) AS text").coalesce(1).write.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setitem(vars(spark.sparkContext), "master", "yarn")
    for size in ("128m", "512k"):
        monkeypatch.setattr(tables, "SPLITS_A_CORE", 10)
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        df = spark.read.parquet(path)
        try:
            splits = df.rdd.getNumPartitions()
            dealt = tables.spread(df)
            sizes = [len(x) for x in dealt.select("id").rdd.glom().collect()]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert (splits < cores) == (size == "128m")
        assert len(sizes) == tables.TASKS_A_CORE * cores and min(sizes) > 0 and sum(sizes) == 200_000
    many = str(tmp_path / "many")
    spark.range(1000).repartition(2 * cores).write.parquet(many)
    df = spark.read.parquet(many)
    monkeypatch.setattr(tables, "SPLITS_A_CORE", 0)
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        assert tables.spread(df) is df
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
