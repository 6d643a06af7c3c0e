"""Numbering, scoring, corrections, training sets: properties, hot keys, brute force."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vigilog import fixed_values as fixed
from vigilog.functions import similarity
from vigilog.operators import corrections, ranking, reports, scoring, searches, training, vocabulary
from vigilog.sources.tables import turn_pairs


@pytest.fixture
def skewed(spark):
    """One source holds a third of all rows; ids are dense, sparse and huge."""
    ids = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("source"),
        F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.col("id") * 7_000_003_111).alias("line_id"),
    )
    return ids.repartition(7)


@pytest.mark.parametrize("by", [[], ["source"]])
def test_numbering_equals_one_window(skewed, by):
    skewed = skewed.withColumn("source", F.when(F.col("line_id") % 11 != 0, F.col("source")))
    numbered = ranking.numbered_by_id(skewed, by, "line_id")
    plain = F.row_number().over(Window.partitionBy(*by).orderBy("line_id"))
    assert numbered.withColumn("plain", plain).filter("plain <> line_number").count() == 0
    assert numbered.count() == 3000


def test_shuffle_and_sample_do_not_depend_on_partitions(skewed):
    first = ranking.shuffled_positions(skewed, "line_id", 1, ["source"]).collect()
    again = ranking.shuffled_positions(skewed.repartition(1), "line_id", 1, ["source"]).collect()
    assert sorted(first) == sorted(again)
    picked = ranking.sample_per_group(skewed, "source", "line_id", F.lit(10), 1).groupBy("source").count().collect()
    assert {r["count"] for r in picked} == {10}


def test_splits(skewed):
    parts = {r["part"]: r["count"] for r in ranking.ordered_split(skewed, "line_id").groupBy("part").count().collect()}
    assert parts == {"train": 2400, "validation": 600}
    share = ranking.hash_split(skewed, "line_id").filter("part = 'train'").count() / 3000
    assert 0.75 < share < 0.85


def test_top_k_is_cut_before_the_shuffle(spark, skewed):
    top = ranking.first_rows_per(skewed, ["source"], ["line_id"], 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert top.filter("source = 'hot'").count() == 3


def test_turns_of_one_long_conversation(spark):
    turns = spark.range(500).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.col("id").cast("string").alias("text"))
    assert turn_pairs(turns).filter("cast(first as int) + 1 = cast(second as int)").count() == 499


# ---------------------------------------------------------------- scoring

def random_vectors(spark, n, seed, name):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(n, 8)))]
    rows[0] = (0, [0.0] * 8)
    return spark.createDataFrame(rows, f"{name} bigint, vec array<float>")


def brute_force(targets, bank):
    t, b = (np.array([r["vec"] for r in sorted(d.collect())], dtype=float) for d in (targets, bank))
    unit = [m / np.where((norm := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, norm) for m in (t, b)]
    return np.round(unit[0] @ unit[1].T, 12)


@pytest.fixture
def folder(tmp_path):
    """New folder names, as the cluster's shared folder gives them."""
    names = iter(range(1000))
    return lambda: str(tmp_path / f"bank{next(names)}")


@pytest.mark.parametrize("partitions, block_rows", [(1, 10**6), (2, 7), (8, 1), (3, 40)])
def test_nearest_example(spark, folder, partitions, block_rows):
    targets, bank = random_vectors(spark, 60, 1, "line_id"), random_vectors(spark, 40, 2, "idx")
    expected = brute_force(targets, bank)
    found = scoring.nearest_example(targets.repartition(partitions), bank.repartition(partitions), "vec", folder(), block_rows=block_rows)
    rows = found.collect()
    assert len(rows) == 60
    for r in rows:
        assert r["most_similar_positive_idx"] == expected[r["line_id"]].argmax()
        assert r["max_similarity_score"] == pytest.approx(expected[r["line_id"]].max())


def test_target_ids_and_the_number_of_blocks_change_nothing(spark, folder, monkeypatch):
    """Ids that are null, repeated or texts; ties; a bank of one row and one of many blocks."""
    targets = spark.createDataFrame([(None, [1.0, 0.0]), ("x", [0.0, 1.0]), ("x", [1.0, 1.0]), ("y", None)], "line_id string, vec array<double>")
    bank = spark.createDataFrame([(9, [2.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0]), (7, [0.0, 3.0]), (None, [0.0, 1.0])], "idx bigint, vec array<double>")
    expected = [(None, 1.0, 4), ("x", 0.707106781187, 4), ("x", 1.0, 7), ("y", 0.0, 4)]
    for block_rows in (100, 1):
        for run in (100, 1):
            monkeypatch.setattr(scoring, "TARGET_ROWS", run)
            found = scoring.nearest_example(targets, bank.repartition(3), "vec", folder(), block_rows=block_rows).collect()
            assert sorted((r[0], r[2], r[3]) for r in found if r[0]) == expected[1:]
            assert [(r[0], r[2], r[3]) for r in found if not r[0]] == expected[:1]
    one = scoring.nearest_example(targets, bank.filter("idx = 7"), "vec", folder()).collect()
    assert sorted(r[2] for r in one) == [0.0, 0.0, 0.707106781187, 1.0]


def test_vectors_of_another_size_are_refused(spark, folder):
    targets = spark.createDataFrame([(1, [1.0, 0.0])], "line_id bigint, vec array<double>")
    for vectors in ([[1.0, 0.0, 0.0]], [[1.0, 0.0], [1.0]]):
        bank = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "idx bigint, vec array<double>").coalesce(1)
        with pytest.raises(Exception, match="size|numbers"):
            scoring.nearest_example(targets, bank, "vec", folder()).collect()


def test_similarity_results_over_texts(spark, lines, folder):
    bank = spark.createDataFrame([(3, "Failed password for x", "Failed login"), (5, "session opened", "Successful login")], "idx bigint, example string, label string")
    log = lines(["Failed password for y port 22"] * 30 + ["session opened 12"] * 5 + ["", None])
    found = scoring.similarity_results(log, bank, scoring.hashed_words(256), folder()).collect()
    assert len(found) == 37
    by_label = {}
    for r in found:
        by_label[r["prediction"]] = by_label.get(r["prediction"], 0) + (r["max_similarity_score"] > 0)
    assert by_label == {"Failed login": 30, "Successful login": 5}


def test_empty_bank_scores_zero(spark, lines, folder):
    bank = spark.createDataFrame([], "idx bigint, line string")
    row = scoring.nearest_example(lines(["a"]), bank, "line", folder(), encoder=scoring.hashed_words(8)).first()
    assert row["max_similarity_score"] == 0.0 and row["most_similar_positive_idx"] is None


def test_failing_encoder_gives_zero_vectors(spark, lines):
    def encoder(texts):
        if any("bad" in t for t in texts):
            raise ValueError("no")
        return np.ones((len(texts), 2))

    found = scoring.similarity_to_vectors(lines(["bad", "good", " ", None]), "line", [[1.0, 1.0]], encoder).collect()
    assert {r["line_id"]: round(r["sims"][0], 6) for r in found} == {0: 0.0, 1: 1.0, 2: 0.0, 3: 0.0}


def test_prototype_phrases_and_options():
    phrases = scoring.prototype_phrases()
    assert phrases["successful_login"][0] == "user authenticated" and phrases["non_login"][-1] == "user running"
    assert all(len(p) == 7 for p in phrases.values())
    merged = scoring.scoring_options({"thresholds": {"classification": 0.9}}, {"phrases_per_category": 5})
    assert merged["thresholds"]["classification"] == 0.9 and merged["thresholds"]["login_detection"] == 0.15
    assert merged["phrases_per_category"] == 5 and fixed.SCORING_OPTIONS["phrases_per_category"] == 7


@pytest.mark.parametrize(
    "score, model, same, expected",
    [
        (0.7, 0.9, False, ("S", 0.7, "e (high confidence)")),
        (0.5, 0.6, True, ("S", 0.6, "Agreement: semantic 0.500, model 0.600")),
        (0.5, 0.9, False, ("M", 0.9, "Model confidence: 0.900")),
        (0.5, 0.4, False, ("Ambiguous event", 0.5, "Low confidence: 0.500/0.400")),
    ],
)
def test_combined_predictions(spark, score, model, same, expected):
    parts = scoring.combine_predictions(
        F.lit("S"), F.lit(score), F.lit("e"), F.lit("S" if same else "M"), F.lit(model), scoring.scoring_options()
    )
    assert tuple(spark.range(1).select(*parts).first()) == expected


def test_login_gate(spark):
    categories = ["successful_login", "failed_login", "non_login"]
    row = spark.createDataFrame([([0.2, 0.5, 0.4],), ([0.2, 0.3, 0.4],), ([0.1, 0.14, 0.0],)], "s array<double>")
    assert [r[0] for r in row.select(scoring.is_login(F.col("s"), categories, 0.15)).collect()] == [True, False, False]


# ---------------------------------------------------------------- reports

def test_histogram_and_bins_keep_every_row(spark):
    scores = spark.range(1000).select((F.col("id") % 97 / 96).alias("score"))
    histogram = reports.score_histogram(scores, "score").collect()
    expected, _ = np.histogram([i % 97 / 96 for i in range(1000)], bins=50)
    assert len(histogram) == 50 and sum(r["events"] for r in histogram) == 1000
    assert [r["events"] for r in histogram][-1] == expected[-1]
    bins = reports.equal_width_bins(scores, "score").collect()
    assert len(bins) == 5 and sum(r["events"] for r in bins) == 1000
    flat = reports.equal_width_bins(scores.withColumn("score", F.lit(0.7)), "score").collect()
    assert [r["events"] for r in flat] == [0, 0, 1000, 0, 0]


def test_empty_tables(spark, lines):
    empty = lines(["x"]).filter("false")
    row = reports.line_statistics(empty).first()
    assert (row["total_lines"], row["avg_length"], row["total_characters"]) == (0, 0.0, 0)
    assert [r["events"] for r in reports.events_by_hour(empty).collect()] == [0] * 24
    scores = spark.createDataFrame([], "score double")
    assert reports.analysis_summary(scores, "score").first()["status"] == "no_results"
    assert {r["category"]: r["hits"] for r in reports.attack_counts(reports.detect_attacks(empty)).collect()} == {"Total": 0}


def test_hours_count_every_match(lines):
    found = reports.events_by_hour(lines(["10:00:00 then 11:00:00", "10:59:59", "99:00:00"])).collect()
    assert {r["hour"]: r["events"] for r in found if r["events"]} == {10: 2, 11: 1}


def test_alert_needs_more_than_the_limit(spark):
    line = "Failed login user=bob from 10.0.0.1"
    rows = spark.range(6).select(
        F.col("id").alias("line_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0,0,id,0)").alias("ts"), F.lit(line).alias("line")
    )
    assert [r["failures"] for r in searches.failed_login_alert(rows).collect()] == [6]
    assert searches.failed_login_alert(rows.filter("line_id < 5")).count() == 0
    assert searches.failed_login_alert(rows, "1 hour", "30 minutes").count() == 2
    searches.register_search_views(rows.select("line"), "t")
    assert spark.table("t_failed_logins").count() == 6 and spark.table("t_successful_logins").count() == 0


# ---------------------------------------------------------------- corrections and training

def correction_rows(spark, n=30):
    label = F.when(F.col("id") % 3 == 0, "failed_login").when(F.col("id") % 3 == 1, "Successful login")
    return spark.range(n).select(
        F.concat(F.lit("log "), F.col("id")).alias("log_text"),
        F.struct(F.lit("a").alias("label"), F.lit(0.5).alias("confidence")).alias("original_prediction"),
        F.struct(label.alias("label"), F.lit(1.0).alias("confidence")).alias("user_correction"),
        F.lit("2025-01-01").alias("timestamp"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("r"), F.col("id"))).alias("record_id"),
        F.when(F.col("id") % 5 == 0, True).alias("used_for_training"),
        F.lit(None).cast("string").alias("training_timestamp"),
    )


def test_corrections_defaults_and_marking(spark):
    rows = corrections.with_defaults(correction_rows(spark))
    assert rows.filter("record_id is null or used_for_training is null").count() == 0
    marked = corrections.mark_used(rows, rows.filter("log_text = 'log 2'").unionByName(rows.filter("log_text = 'log 2'")), "now", "s1")
    assert marked.count() == 30 and corrections.used(marked).count() == 7
    assert marked.filter("training_timestamp = 'now' and dataset_generation_session = 's1'").count() == 1
    display = {r["full_log_text"]: r for r in corrections.display_table(rows).collect()}
    assert display["log 2"]["user_correction"] == "Unknown (1.000)" and display["log 0"]["original_prediction"] == "a (0.500)"


def test_class_ids_accept_display_labels(spark):
    labels = ["Successful login", "failed_login", "other_login", "x", None]
    rows = spark.createDataFrame([(l,) for l in labels], "l string")
    assert [r[0] for r in rows.select(training.class_id(F.col("l"))).collect()] == [1, 2, 0, 0, 0]


def test_enhanced_dataset_honours_the_quotas(spark):
    rows = corrections.with_defaults(correction_rows(spark))
    pool = spark.range(600).select(F.col("id"), F.concat(F.lit("line "), "id").alias("Log"), (F.col("id") % 3).cast("int").alias("Label"))
    built = training.enhanced_dataset(rows, pool, "id", F.lit(300), factor=2)
    facts = training.dataset_metadata(built, 2, "t").first()
    assert facts["total_logs"] == 300 and facts["correction_logs"] == 48 and facts["corrections_used"] == 24
    assert facts["successful_logins"] == facts["failed_logins"] == facts["non_login_events"] == 100
    assert training.used_ids(built).count() == 24
    assert training.enhanced_dataset(rows, pool, "id", F.lit(90), include_corrections=False).count() == 90
    few = training.enhanced_dataset(rows, pool.filter("Label <> 1 OR id < 9"), "id", F.lit(300), factor=2)
    assert few.filter("Label = 1 AND Source = 'labelled_line'").count() == 3  # all there are


def test_quotas_are_filled_as_by_ordering_the_whole_pool(spark):
    pool = spark.range(90000).select("id", F.when(F.col("id") % 10 == 0, 1).when(F.col("id") % 9999 == 1, 2).otherwise(0).alias("Label")).repartition(5)
    quotas = spark.createDataFrame([(1, 100), (2, 50), (0, 1)], "Label int, quota bigint")
    found = training.fill_quotas(pool, quotas, "id")
    assert set(found.columns) == {"id", "Label"}
    whole = ranking.sample_per_group(pool.join(quotas, "Label"), "Label", "id", F.col("quota"), training.SHUFFLE_SEED).select("id", "Label")
    assert found.select("id", "Label").exceptAll(whole).count() == 0
    assert found.count() == whole.count() == 101 + pool.filter("Label = 2").count()


def test_quota_of_a_crowded_class_stays_one(spark):
    rows = training.training_rows(corrections.with_defaults(correction_rows(spark)))
    found = {r["Label"]: r["quota"] for r in training.class_quotas(rows, F.lit(9)).collect()}
    assert found == {1: 1, 2: 1, 0: 1}


def test_boost(spark):
    rows = spark.range(3)
    assert training.boosted(rows, 4).count() == 12 and training.boosted(rows, 0).count() == 0


# ---------------------------------------------------------------- vocabulary

def test_vocabulary_order_and_encoding(spark, lines):
    log = lines(["b a a", "c B d", "e"])
    rows = vocabulary.token_rows(log)
    words = vocabulary.vocabulary(rows)
    assert [r["word"] for r in words.orderBy("idx").collect()] == ["b", "a", "c", "d", "e"]
    assert {r["idx"] for r in words.collect()} == {2, 3, 4, 5, 6}
    for head in (0, 2, 50_000):
        found = vocabulary.encoded_lines(vocabulary.encode_tokens(rows, words, head)).collect()
        assert {r["line_id"]: r["ids"] for r in found} == {0: [2, 3, 3], 1: [4, 2, 5], 2: [6]}
    more = lines(["b a a", "c B d", "e", "", "zzz"])
    found = vocabulary.encode_lines(more, words).collect()
    assert {r["line_id"]: (r["ids"], r["length"]) for r in found} == {
        0: ([2, 3, 3], 3), 1: ([4, 2, 5], 3), 2: ([6], 1), 4: ([vocabulary.UNKNOWN], 1)
    }
    same_id = spark.createDataFrame([(1, "a b"), (1, "a"), (1, "a"), (None, "b")], "line_id bigint, line string")
    twice = words.unionAll(words.withColumn("idx", F.col("idx") + 100))
    rows_found = sorted(str((r["line_id"], r["ids"])) for r in vocabulary.encode_lines(same_id, twice).collect())
    assert rows_found == ["(1, [3, 2])", "(1, [3])", "(1, [3])", "(None, [2])"]
    other = vocabulary.encode_tokens(vocabulary.token_rows(lines(["zzz a"])), words, 1).collect()
    assert {r["token"]: r["idx"] for r in other} == {"zzz": vocabulary.UNKNOWN, "a": 3}
    padded = vocabulary.padded(vocabulary.encode_lines(vocabulary.with_batches(log, 2), words)).collect()
    assert {r["line_id"]: (r["batch"], r["ids"], r["length"]) for r in padded} == {0: (0, [2, 3, 3], 3), 1: (0, [4, 2, 5], 3), 2: (1, [6], 1)}


def test_tag_numbers_leave_padding_free():
    numbers = vocabulary.tag_numbers()
    assert min(numbers.values()) == 1 and len(numbers) == 13 and list(numbers) == sorted(numbers)


def test_first_seen_order_of_large_ids(spark):
    """Ids beyond any packed position: equal counts come in the order of first appearance."""
    ids = [1 << 19, (1 << 20) + 1, 1, (1 << 61) + 5]
    rows = spark.createDataFrame([(i, f"word{i}") for i in ids], "line_id bigint, line string")
    words = vocabulary.vocabulary(vocabulary.token_rows(rows)).orderBy("idx").collect()
    assert [r["word"] for r in words] == [f"word{i}" for i in sorted(ids)]
    entities = spark.createDataFrame([(i, "IP", 0, f"10.0.0.{k}") for k, i in enumerate(ids)], "line_id bigint, type string, ord int, entity string")
    top = reports.top_entities(entities).orderBy("rank").collect()
    assert [r["entity"] for r in top] == ["10.0.0.2", "10.0.0.0", "10.0.0.1", "10.0.0.3"]


def test_python_functions_run_once(spark, lines, folder):
    """A filter on the result of a Python function would make Spark run it twice."""
    log = lines(["user bob from 10.0.0.1", "", "x"])
    tagged = vocabulary.tagged_lines(log)
    pair = spark.createDataFrame([("a b", "a c")], "first string, second string")
    encoder = scoring.hashed_words(8)
    for df, nodes in (
        (tagged, 1), (vocabulary.span_rows(tagged), 1), (vocabulary.tag_index(tagged), 1),
        (vocabulary.encode_lines(vocabulary.with_batches(log), vocabulary.vocabulary(vocabulary.token_rows(log))), 1),  # the block dictionary
        (scoring.enhanced_similarity(pair, "first", "second", encoder), 2),  # encoder and string ratio
    ):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert sum("ArrowEvalPython" in x or "MapInArrow" in x for x in plan.splitlines()) == nodes


def test_records_with_one_short_id_are_told_apart(spark):
    rows = corrections.with_defaults(correction_rows(spark)).withColumn("record_id", F.lit("same"))
    text_of = rows.select("log_text").first()["log_text"]
    one = spark.createDataFrame([("same", text_of)], "record_id string, log_text string")
    picked = corrections.selected(rows, one).count()
    assert picked == rows.filter(F.col("log_text") == text_of).count() < rows.count()
    assert corrections.remaining(rows, one).count() == rows.count() - picked
    assert corrections.mark_used(rows, one, "t").filter("training_timestamp = 't'").count() == picked


def test_tagging_runs_once_for_its_rows(lines):
    """A list column that is exploded as it is has its size tested first, by a second run of the function."""
    tagged = vocabulary.tagged_lines(lines(["Failed login for bob from 10.0.0.1", "", "x"]))
    for df in (vocabulary.token_tags(tagged), vocabulary.span_rows(tagged), vocabulary.last_spans(tagged)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert sum("ArrowEvalPython" in x for x in plan.splitlines()) == 1
    assert {(r["type"], r["value"]) for r in vocabulary.last_spans(tagged).collect()} == {("STATUS", "Failed"), ("USERNAME", "bob"), ("IP_ADDRESS", "10 . 0 . 0 . 1")}


def test_pairs_become_python_objects_in_parts(spark):
    """A batch of Spark's may hold 10,000 long texts; their vectors and strings are made a part at a time."""
    seen = spark.sparkContext.accumulator(0)
    words = scoring.hashed_words(8)

    def encoder(texts):
        if len(texts) > similarity.PAIR_ROWS:
            seen.add(1)
        return words(texts)

    rows = [(f"a{i} b", f"a{i} c") for i in range(1000)]
    df = spark.createDataFrame(rows, "first string, second string").coalesce(1)
    found = scoring.enhanced_similarity(df, "first", "second", encoder).collect()
    assert [(r["first"], r["second"]) for r in found] == rows and seen.value == 0
    assert all(r["string"] == similarity.ratio(r["first"], r["second"]) for r in found)


def test_words_are_counted_without_sorting_all_tokens(spark, monkeypatch):
    """A hash table of words, also with ids at both ends of the range or none; equal counts come by first appearance."""
    ids = [5, -(1 << 63), (1 << 63) - 1, None, -1, 0]
    rows = spark.createDataFrame([(i, f"x w{k} x v{k}") for k, i in enumerate(ids)], "line_id bigint, line string")
    seen = []
    whole = vocabulary.numbered_in_ranges
    monkeypatch.setattr(vocabulary, "numbered_in_ranges", lambda df, *rest: seen.append(df) or whole(df, *rest))
    words = vocabulary.vocabulary(vocabulary.token_rows(rows)).orderBy("idx").collect()
    order = [3, 1, 4, 5, 0, 2]
    assert [(r["word"], r["occurrences"]) for r in words] == [("x", 12)] + [(f"{c}{k}", 1) for k in order for c in "wv"]
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
