"""The cell index gives the rows of the full scan and compares fewer pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilog.operators import example_index as ei
from vigilog.operators import scoring


@pytest.fixture
def folder(tmp_path):
    names = iter(range(1000))
    return lambda: str(tmp_path / f"index{next(names)}")


def clustered(spark, n, seed, name, dim=8, centres=30, width=0.05):
    """Vectors around common centres, with equal, proportional, blank and null ones."""
    r = np.random.default_rng(seed)
    middle = np.random.default_rng(99).normal(size=(centres, dim))
    vectors = (middle[r.integers(0, centres, n)] + width * r.normal(size=(n, dim))).round(2)
    rows = [(int(i), v.tolist()) for i, v in enumerate(vectors)]
    rows += [(n + i, (3 * vectors[i]).tolist()) for i in range(0, n, 7)] + [(2 * n + i, vectors[i].tolist()) for i in range(0, n, 5)]
    rows += [(4 * n, [0.0] * dim), (4 * n + 1, None), (None, vectors[3].tolist())]
    return spark.createDataFrame(rows, f"{name} bigint, vec array<float>").repartition(5)


def same(found, expected, key):
    order = lambda r: (r[key] is None, r[key] or 0, str(r["vec"]))
    a, b = ([(r[key], r["max_similarity_score"], r["most_similar_positive_idx"]) for r in sorted(x.collect(), key=order)] for x in (found, expected))
    assert a == b


@pytest.mark.parametrize("cell_rows, block_rows", [(16, 8192), (300, 5), (1, 3), (10_000, 40)])
def test_equals_the_full_scan(spark, folder, cell_rows, block_rows):
    targets, bank = clustered(spark, 150, 1, "line_id"), clustered(spark, 400, 2, "idx")
    index = ei.build_index(bank, "vec", folder(), cell_rows=cell_rows, block_rows=block_rows)
    same(ei.search_index(targets, index, "vec"), scoring.nearest_example(targets, bank, "vec", folder()), "line_id")


def test_a_bank_without_blank_examples_and_opposite_targets(spark, folder):
    bank = spark.createDataFrame([(i, [1.0, 0.01 * i]) for i in range(50)], "idx bigint, vec array<double>")
    targets = spark.createDataFrame([(1, [-1.0, -1.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 0.2])], "line_id bigint, vec array<double>")
    index = ei.build_index(bank, "vec", folder(), cell_rows=5)
    same(ei.search_index(targets, index, "vec"), scoring.nearest_example(targets, bank, "vec", folder()), "line_id")


def test_vectors_that_nearly_agree(spark, folder):
    """Distances near zero are known to the root of the rounding only; no bound may cut a tie off."""
    r = np.random.default_rng(8)
    middle = r.normal(size=(6, 8))
    near = lambda n, seed: [(middle[i % 6] + 1e-8 * np.random.default_rng(seed + i).normal(size=8)).tolist() for i in range(n)]
    bank = spark.createDataFrame([(i, v) for i, v in enumerate(near(200, 1))], "idx bigint, vec array<double>")
    targets = spark.createDataFrame([(i, v) for i, v in enumerate(near(60, 999))], "line_id bigint, vec array<double>")
    index = ei.build_index(bank, "vec", folder(), cell_rows=10, block_rows=4)
    same(ei.search_index(targets, index, "vec"), scoring.nearest_example(targets, bank, "vec", folder()), "line_id")


def test_few_pairs_are_compared_and_no_task_reads_all_blocks(spark, folder):
    targets, bank = clustered(spark, 300, 3, "line_id", centres=40), clustered(spark, 4000, 4, "idx", centres=40)
    index = ei.build_index(bank, "vec", folder(), cell_rows=64)
    pairs = spark.sparkContext.accumulator(0)
    targets_n = targets.select("vec").distinct().count()
    bank_n = spark.read.parquet(f"{index.path}/vectors").count()
    ei.search_index(targets, index, "vec", pairs=pairs).collect()
    assert 0 < pairs.value < 0.2 * targets_n * bank_n


def test_empty_and_blank_banks(spark, folder):
    targets = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "line_id bigint, vec array<double>")
    for rows in ([], [(5, [0.0, 0.0]), (3, None)]):
        bank = spark.createDataFrame(rows, "idx bigint, vec array<double>")
        index = ei.build_index(bank, "vec", folder())
        same(ei.search_index(targets, index, "vec"), scoring.nearest_example(targets, bank, "vec", folder()), "line_id")


def test_vectors_of_another_size_are_refused(spark, folder):
    targets = spark.createDataFrame([(1, [1.0, 0.0])], "line_id bigint, vec array<double>")
    for vectors in ([[1.0, 0.0, 0.0]], [[1.0, 0.0], [1.0]]):
        bank = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "idx bigint, vec array<double>").coalesce(1)
        with pytest.raises(Exception, match="size|numbers"):
            ei.search_index(targets, ei.build_index(bank, "vec", folder()), "vec").collect()


def test_texts_are_encoded_once_each(spark, lines, folder):
    encoder = scoring.hashed_words(64)
    bank = spark.createDataFrame([(i, f"user w{i} failed {'again ' * (i % 4)}x{i % 9}") for i in range(200)], "idx bigint, line string")
    log = lines([f"user w{i % 90} failed x{i % 7}" for i in range(400)] + ["", None, "   ", "nothing alike"])
    index = ei.build_index(bank, "line", folder(), encoder, cell_rows=10)
    found = sorted(ei.search_index(log, index, "line", encoder).collect(), key=lambda r: r["line_id"])
    expected = sorted(scoring.nearest_example(log, bank, "line", folder(), encoder=encoder).collect(), key=lambda r: r["line_id"])
    names = ["line_id", "line", "max_similarity_score", "most_similar_positive_idx"]
    assert [[r[n] for n in names] for r in found] == [[r[n] for n in names] for r in expected]


def test_small_banks_are_scanned(spark, folder):
    targets, bank = clustered(spark, 20, 5, "line_id"), clustered(spark, 60, 6, "idx")
    scanned = ei.nearest(targets, bank, "vec", folder())
    same(ei.nearest(targets, bank, "vec", folder(), scan_rows=0), scanned, "line_id")


def test_a_large_bank_is_not_scanned_for_log_lines(spark, folder, monkeypatch):
    """``similarity_results`` compared every line with every known text, whatever their number."""
    words = [f"{a}{b}" for a in "abcdefgh" for b in "klmnopqr"]
    texts = [f"{words[i % 64]} {words[i // 64 % 64]} {words[7 * i % 61]}" for i in range(4200)] + ["x y"] * 100
    bank = spark.createDataFrame([(i, t, "Failed login") for i, t in enumerate(texts)], "idx bigint, example string, label string")
    log = spark.createDataFrame([(i, t) for i, t in enumerate([*texts[::97], "", "zz zz"])], "line_id bigint, line string")
    encoder = scoring.hashed_words(32)
    normal = lambda df, c: df.withColumn("normalized_log", scoring.normalize_text(F.col(c)))
    expected = scoring.nearest_example(normal(log, "line"), normal(bank, "example"), "normalized_log", folder(), encoder=encoder)
    expected = sorted((r["line_id"], r["max_similarity_score"], r["most_similar_positive_idx"]) for r in expected.collect())

    def scan(*_, **__):
        raise AssertionError("scanned")

    monkeypatch.setattr(scoring, "nearest_example", scan)
    monkeypatch.setattr(ei, "nearest_example", scan)
    found = scoring.similarity_results(log, bank, encoder, folder())
    assert sorted((r["line_id"], r["max_similarity_score"], r["most_similar_positive_idx"]) for r in found.collect()) == expected


def test_vectors_that_no_bound_rules_out_go_to_groups_of_blocks(spark, tmp_path):
    """A target is sent once for each group of blocks, not once for each block, and to the same blocks."""
    random = np.random.default_rng(8)
    bank = spark.createDataFrame([(i, random.normal(size=16).tolist()) for i in range(1500)], "idx bigint, v array<double>")
    index = ei.build_index(bank, "v", str(tmp_path / "index"), cell_rows=16)
    directory = ei.Directory(index)
    units = random.normal(size=(20, 16))
    units /= np.linalg.norm(units, axis=1)[:, None]
    rows, blocks = directory.left(units, directory.homes(units), np.full(20, -1.0))
    assert len(rows) == 20 * (len(directory.block) - 1) and len(directory.block) > 90
    sent, groups, marks = directory.grouped(rows, blocks)
    assert len(sent) <= len(rows) // 10
    again = [(row, block) for row, group, mark in zip(sent, groups, marks) for block, _ in directory.marked(int(group), np.array([mark]))]
    assert sorted(again) == sorted(zip(rows, blocks))
