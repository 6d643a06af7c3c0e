"""The registered queries: every operator on the given tables, whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog import fixed_values as fixed
from vigilog.functions import entities as entities_of
from vigilog.functions import fields, similarity, text, tokens, vectors
from vigilog.operators import corrections, example_index, pattern_scan, ranking, reports, scoring, searches, sketches, totals, training, vocabulary
from vigilog.session import scratch_path
from vigilog.sources import banks, files
from vigilog.sources.tables import auth_lines, derived_corrections, document_lines, spread_stream, table, turn_pairs
from vigilog.streaming import alerts
from vigilog.streaming import searches as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ENCODER_SIZE = 64
ALERT_WINDOW = "7 days"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MARKS = ('<span style="background-color: #FFFF00; font-weight: bold;">', "</span>")


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# ---------------------------------------------------------------- inputs

def logs(spark: SparkSession, folder: str) -> DataFrame:
    return auth_lines(table(spark, folder, "events"))


def document_log(spark: SparkSession, folder: str) -> DataFrame:
    return document_lines(table(spark, folder, "documents"))


def records(spark: SparkSession, folder: str) -> DataFrame:
    raw = derived_corrections(table(spark, folder, "labels"), table(spark, folder, "documents"))
    return corrections.with_defaults(raw)


def page_lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select(F.col("page_id").alias("line_id"), F.col("html").alias("line"))


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings")


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """A side table written once to the shared folder, as banks and vocabularies are kept."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def joined(column: str) -> Column:
    return F.array_join(column, "|").alias(column)


def rounded(*columns: str) -> dict[str, Column]:
    return {c: F.round(c, 6) for c in columns}


# ---------------------------------------------------------------- searches

@query
def failed_login_alert(spark: SparkSession, folder: str) -> DataFrame:
    return searches.failed_login_alert(logs(spark, folder), ALERT_WINDOW)


@query
def failed_login_alert_hourly(spark: SparkSession, folder: str) -> DataFrame:
    """As scheduled: the last hour, every half hour. The events are sparse, so two failures give an alert."""
    return searches.failed_login_alert(logs(spark, folder), "1 hour", "30 minutes", 1)


@query
def security_summary(spark: SparkSession, folder: str) -> DataFrame:
    return searches.security_summary(logs(spark, folder))


@query
def hourly_activity(spark: SparkSession, folder: str) -> DataFrame:
    return searches.hourly_activity(logs(spark, folder))


@query
def activity_by_hour(spark: SparkSession, folder: str) -> DataFrame:
    return searches.activity_by_hour(logs(spark, folder))


@query
def top_users(spark: SparkSession, folder: str) -> DataFrame:
    return searches.top_users(logs(spark, folder))


@query
def failed_sources(spark: SparkSession, folder: str) -> DataFrame:
    return searches.failed_sources(logs(spark, folder))


@query
def count_by_action(spark: SparkSession, folder: str) -> DataFrame:
    found = logs(spark, folder).select(fields.search_field(F.col("line"), "action"))
    return searches.count_by(found, "action")


@query
def failed_logins(spark: SparkSession, folder: str) -> DataFrame:
    found = searches.category_search(logs(spark, folder), searches.FAILURE)
    return found.select("line_id", "line", "event_category")


@query
def successful_logins(spark: SparkSession, folder: str) -> DataFrame:
    found = searches.category_search(logs(spark, folder), searches.SUCCESS)
    return found.select("line_id", "line", "event_category")


@query
def calculated_fields(spark: SparkSession, folder: str) -> DataFrame:
    return searches.calculated_fields(logs(spark, folder))


# ---------------------------------------------------------------- normalising, fields and labels

@query
def normalize_text(spark: SparkSession, folder: str) -> DataFrame:
    return logs(spark, folder).select("line_id", text.normalize_text(F.col("line")).alias("normalized_log"))


@query
def normalize_documents(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return documents.select("doc_id", text.normalize_text(F.col("text")).alias("normalized_log"))


@query
def preprocess_text(spark: SparkSession, folder: str) -> DataFrame:
    return logs(spark, folder).select("line_id", text.preprocess_text(F.col("line")).alias("normalized_log"))


@query
def log_fields(spark: SparkSession, folder: str) -> DataFrame:
    return logs(spark, folder).select("line_id", *fields.log_fields(F.col("line")))


@query
def document_log_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Log fields of free text: whole documents."""
    return table(spark, folder, "documents").select("doc_id", *fields.log_fields(F.col("text")))


@query
def page_log_fields(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", *fields.log_fields(F.col("html")))


@query
def page_rule_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = page_lines(spark, folder).unionAll(table(spark, folder, "documents").select((-F.col("doc_id") - 1).alias("line_id"), F.col("text").alias("line")))
    return rows.select("line_id", fields.ssh_label(F.col("line")).alias("ssh_label"), fields.linux_label(F.col("line")).alias("linux_label"))


@query
def search_filter(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "documents").filter(text.matches_search(F.col("text"), "licen[cs]e|copyright"))
    return found.select("doc_id", "source", text.preview(F.col("text")).alias("preview"))


@query
def rule_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = logs(spark, folder)
    labelled = rows.select("line_id", text.row_text(["event_type", "line", "user_id"]).alias("text"))
    return labelled.select(
        "*", fields.ssh_label(F.col("text")).alias("ssh_label"), fields.linux_label(F.col("text")).alias("linux_label")
    )


@query
def row_text(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    missing = events.withColumn("value", F.when(F.col("event_type") != "view", F.col("value")))
    kept = missing.drop("ts", "props")
    return kept.select("event_id", text.row_text([c for c in kept.columns if c != "event_id"]).alias("text"))


@query
def asset_type(spark: SparkSession, folder: str) -> DataFrame:
    return logs(spark, folder).select("line_id", fields.asset_type(F.col("line")).alias("asset"))


@query
def format_sniff(spark: SparkSession, folder: str) -> DataFrame:
    return reports.source_formats(logs(spark, folder))


@query
def format_report(spark: SparkSession, folder: str) -> DataFrame:
    return reports.format_report(logs(spark, folder)).withColumns(rounded("avg_line_length"))


@query
def document_format_report(spark: SparkSession, folder: str) -> DataFrame:
    return reports.format_report(document_log(spark, folder)).withColumns(rounded("avg_line_length"))


@query
def line_stats(spark: SparkSession, folder: str) -> DataFrame:
    return reports.line_statistics(document_log(spark, folder), ["source"]).withColumns(rounded("avg_length"))


@query
def line_times(spark: SparkSession, folder: str) -> DataFrame:
    """Each event's time written in one of the known forms and read back."""
    events = table(spark, folder, "events")
    forms = [
        "MMM dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "yyyy/MM/dd HH:mm:ss",
        "'['dd/MMM/yyyy:HH:mm:ss' +0000]'", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy HH:mm:ss",
    ]
    written = F
    for i, form in enumerate(forms):
        written = written.when(F.col("event_id") % len(forms) == i, F.date_format("ts", form))
    lines = events.select("event_id", F.concat(F.lit("host "), written, F.lit(" message")).alias("line"))
    parsed = fields.line_time(F.col("line"), year=2024)
    return lines.select("event_id", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("time"))


# ---------------------------------------------------------------- entities, timeline, patterns

@query
def entities(spark: SparkSession, folder: str) -> DataFrame:
    return reports.entity_rows(logs(spark, folder))


@query
def document_entities(spark: SparkSession, folder: str) -> DataFrame:
    return reports.entity_rows(document_log(spark, folder)).select("line_id.doc_id", "line_id.pos", "type", "ord", "entity")


@query
def entity_unique(spark: SparkSession, folder: str) -> DataFrame:
    return reports.unique_entities(reports.entity_rows(logs(spark, folder)))


@query
def entity_top10(spark: SparkSession, folder: str) -> DataFrame:
    return reports.top_entities(reports.entity_rows(logs(spark, folder)))


def typed_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Entities of the log lines with their line, place and hour."""
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour")
    return logs(spark, folder).select("line_id", hour, F.inline(entities_of.entity_array(F.col("line"), ())))


@query
def entity_sketch_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct entities per type from stored hourly sketches: their number of hours, and whether the union is within 2 % of the exact count."""
    found, path = typed_entities(spark, folder), scratch_path(spark, "sketches")
    sketches.write_sketches(found, path)
    stored_sketches = spark.read.parquet(path)
    hours = stored_sketches.groupBy("type").agg(F.count(F.lit(1)).alias("hours"))
    exact = reports.unique_entities(found).withColumnRenamed("unique_entities", "exact")
    both = sketches.distinct_from_sketches(stored_sketches, "type").join(exact, "type").join(hours, "type")
    return both.select("type", "hours", "exact", (F.abs(F.col("unique_entities") - F.col("exact")) <= 0.02 * F.col("exact")).alias("near"))


@query
def entity_top10_two_pass(spark: SparkSession, folder: str) -> DataFrame:
    rows = reports.entity_rows(logs(spark, folder)).select(F.col("type").alias("grp"), F.col("entity").alias("value"), F.struct("line_id", "ord").alias("seen"))
    return sketches.most_frequent(rows, 10, F.col("seen"), 1000).select(F.col("grp").alias("type"), F.col("value").alias("entity"), "events", "rank")


@query
def top_users_two_pass(spark: SparkSession, folder: str) -> DataFrame:
    rows = logs(spark, folder).select(F.lit("user").alias("grp"), fields.search_field(F.col("line"), "user").alias("value"))
    return sketches.most_frequent(rows, 10).select(F.col("value").alias("user"), "events")


@query
def failed_sources_two_pass(spark: SparkSession, folder: str) -> DataFrame:
    failed = searches.category_search(logs(spark, folder), searches.FAILURE)
    rows = failed.select(F.lit("source").alias("grp"), fields.search_field(F.col("line"), "src_ip").alias("value"))
    return sketches.most_frequent(rows, 20).select(F.col("value").alias("src_ip"), "events")


@query
def events_by_hour(spark: SparkSession, folder: str) -> DataFrame:
    return reports.events_by_hour(logs(spark, folder))


@query
def peak_hour(spark: SparkSession, folder: str) -> DataFrame:
    return reports.peak_hour(logs(spark, folder))


@query
def event_patterns(spark: SparkSession, folder: str) -> DataFrame:
    found = reports.dictionary_labels(logs(spark, folder).select("line_id", "line")).drop("line")
    return found.withColumns({f"{c}_hits": F.array_join(F.col(f"{c}_hits").cast("array<string>"), "|") for c in fixed.EVENT_PATTERNS})


@query
def security_patterns(spark: SparkSession, folder: str) -> DataFrame:
    return reports.security_pattern_matches(logs(spark, folder))


@query
def attack_hits(spark: SparkSession, folder: str) -> DataFrame:
    hits = reports.detect_attacks(logs(spark, folder))
    return hits.withColumn("matches", joined("matches")).withColumns(rounded("confidence"))


@query
def page_attack_hits(spark: SparkSession, folder: str) -> DataFrame:
    hits = reports.detect_attacks(page_lines(spark, folder))
    return hits.withColumn("matches", joined("matches")).withColumns(rounded("confidence"))


def benchmark_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of neighbouring words of five letters and more in the benchmark, as a table of patterns."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))
    pairs = table(spark, folder, "benchmark").select("item_id", F.explode(tokens.bigrams(words)).alias("pair"))
    return pairs.select(F.lit("pairs").alias("category"), F.replace("pair", F.lit(" "), F.lit(r"\s+")).alias("pattern")).distinct()


@query
def attack_pattern_table(spark: SparkSession, folder: str) -> DataFrame:
    """The attack patterns as a table, looked for in all log lines in one pass."""
    rows = [(c, p) for c, patterns in fixed.ATTACK_PATTERNS.items() for p in patterns]
    patterns = spark.createDataFrame(rows, "category string, pattern string")
    hits = pattern_scan.detect_attacks_from(logs(spark, folder), patterns, scratch_path(spark, "patterns"))
    return hits.withColumn("matches", joined("matches")).withColumns(rounded("confidence"))


@query
def document_pattern_table(spark: SparkSession, folder: str) -> DataFrame:
    """Thousands of patterns that come from a table, looked for in all documents in one pass."""
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("line_id"), F.col("text").alias("line"))
    hits = pattern_scan.detect_attacks_from(texts, benchmark_pairs(spark, folder), scratch_path(spark, "patterns"))
    return hits.select("line_id", "pattern", F.size("matches").alias("matches"))


@query
def dictionary_table_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The dictionary patterns as a table: the label of every line and the patterns found."""
    rows = [(c, i, p) for c, patterns in fixed.EVENT_PATTERNS.items() for i, p in enumerate(patterns)]
    patterns = spark.createDataFrame(rows, "category string, ord int, pattern string")
    found = pattern_scan.dictionary_labels_from(logs(spark, folder), patterns, scratch_path(spark, "patterns"))
    shown = F.transform("hits", lambda h: F.concat(h["category"], F.lit(":"), h["ord"].cast("string")))
    return found.select("line_id", "label", F.array_join(shown, "|").alias("hits"))


@query
def attack_counts(spark: SparkSession, folder: str) -> DataFrame:
    return reports.attack_counts(reports.detect_attacks(logs(spark, folder)))


@query
def attack_bins(spark: SparkSession, folder: str) -> DataFrame:
    hits = reports.detect_attacks(page_lines(spark, folder))
    return reports.equal_width_bins(hits, "confidence").withColumns(rounded("lower", "upper"))


# ---------------------------------------------------------------- vectors and scores

def label_means(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.mean_vectors(embeddings(spark, folder), "label", "embedding")


def label_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Similarity of every vector to each label's mean vector, by label."""
    scored = scoring.similarity_to_table(embeddings(spark, folder), "embedding", label_means(spark, folder), scratch_path(spark, "prototypes"))
    return scored.select("vec_id", "label", "sims")


def rounded_line_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Similarity of every log line to its nearest example, for the score reports."""
    found = line_scores(spark, folder)
    return found.select("line_id", "prediction", F.round("max_similarity_score", 6).alias("score"))


def best_scores(spark: SparkSession, folder: str) -> DataFrame:
    sims = F.transform("sims", lambda s: s["similarity"])
    scored = label_scores(spark, folder)
    best = F.get("sims", vectors.first_argmax(sims) - 1)["category"]
    return scored.select("vec_id", "label", best.alias("category"), F.round(F.array_max(sims), 6).alias("score"))


@query
def prototype_mean(spark: SparkSession, folder: str) -> DataFrame:
    means = label_means(spark, folder).select(F.col("category").alias("label"), F.posexplode("vec").alias("pos", "value"))
    return means.withColumns(rounded("value"))


@query
def own_prototype_cosine(spark: SparkSession, folder: str) -> DataFrame:
    means = label_means(spark, folder).withColumnRenamed("category", "label")
    both = embeddings(spark, folder).join(means, "label")
    return both.select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("vec")), 6).alias("cosine"))


@query
def prototype_scores(spark: SparkSession, folder: str) -> DataFrame:
    return best_scores(spark, folder)


@query
def softmax_scores(spark: SparkSession, folder: str) -> DataFrame:
    sims = F.transform("sims", lambda s: s["similarity"])
    spread = label_scores(spark, folder).select("vec_id", F.posexplode(vectors.softmax(sims)).alias("pos", "probability"))
    return spread.withColumns(rounded("probability"))


@query
def nearest_example(spark: SparkSession, folder: str) -> DataFrame:
    """Targets are the vectors whose id is divisible by 20, the bank holds all others."""
    every = embeddings(spark, folder)
    bank = every.filter(F.col("vec_id") % 20 != 0).select(F.col("vec_id").alias("idx"), "label", "embedding")
    targets = every.filter(F.col("vec_id") % 20 == 0).select("vec_id", "embedding")
    scored = scoring.nearest_example(targets, bank, "embedding", scratch_path(spark, "bank"))
    named = scoring.with_example(scored.drop("embedding"), bank.select("idx", "label"))
    return named.withColumns(rounded("max_similarity_score"))


def example_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The first line of each event type as a bank of known examples."""
    lines = logs(spark, folder)
    first = lines.groupBy("event_type").agg(F.min("line_id").alias("idx"), F.min_by("line", "line_id").alias("example"))
    bank = first.select("idx", "example", fields.event_category(F.col("example")).alias("label"))
    return stored(spark, bank, "examples")


def line_scores(spark: SparkSession, folder: str) -> DataFrame:
    encoder = scoring.hashed_words(ENCODER_SIZE)
    return scoring.similarity_results(logs(spark, folder), example_lines(spark, folder), encoder, scratch_path(spark, "bank"))


@query
def nearest_line_example(spark: SparkSession, folder: str) -> DataFrame:
    return line_scores(spark, folder).withColumns(rounded("max_similarity_score")).drop("model", "original_log_line")


@query
def nearest_known_line(spark: SparkSession, folder: str) -> DataFrame:
    """Lines whose id is divisible by 20 against every distinct normalised text of the other lines."""
    lines = logs(spark, folder)
    others = lines.filter(F.col("line_id") % 20 != 0).withColumn("norm", text.normalize_text(F.col("line")))
    bank = others.groupBy("norm").agg(F.min("line_id").alias("idx"), F.min_by("line", "line_id").alias("example"))
    bank = stored(spark, bank.select("idx", "example", fields.event_category(F.col("example")).alias("label")), "known")
    found = scoring.similarity_results(
        lines.filter(F.col("line_id") % 20 == 0), bank, scoring.hashed_words(ENCODER_SIZE), scratch_path(spark, "bank"))
    return found.withColumns(rounded("max_similarity_score")).drop("model", "original_log_line")


@query
def nearest_example_index(spark: SparkSession, folder: str) -> DataFrame:
    """As ``nearest_example``, by the stored cell index whatever the size of the bank."""
    every = embeddings(spark, folder)
    bank = every.filter(F.col("vec_id") % 20 != 0).select(F.col("vec_id").alias("idx"), "label", "embedding")
    index = example_index.build_index(bank, "embedding", scratch_path(spark, "index"))
    scored = example_index.search_index(every.filter(F.col("vec_id") % 20 == 0).select("vec_id", "embedding"), index, "embedding")
    named = scoring.with_example(scored.drop("embedding"), bank.select("idx", "label"))
    return named.withColumns(rounded("max_similarity_score"))


@query
def nearest_known_line_index(spark: SparkSession, folder: str) -> DataFrame:
    """As ``nearest_known_line``, by the stored cell index whatever the size of the bank."""
    lines = logs(spark, folder).withColumn("normalized_log", text.normalize_text(F.col("line"))).select("line_id", "line", "normalized_log")
    others = lines.filter(F.col("line_id") % 20 != 0)
    bank = others.groupBy("normalized_log").agg(F.min("line_id").alias("idx"), F.min_by("line", "line_id").alias("example"))
    bank = bank.select("idx", "example", "normalized_log", fields.event_category(F.col("example")).alias("label"))
    encoder = scoring.hashed_words(ENCODER_SIZE)
    index = example_index.build_index(bank, "normalized_log", scratch_path(spark, "index"), encoder)
    scored = example_index.search_index(lines.filter(F.col("line_id") % 20 == 0).drop("line"), index, "normalized_log", encoder)
    named = scoring.with_example(scored, bank.select("idx", "example", "label"))
    return named.select(
        "line_id", "normalized_log", F.round("max_similarity_score", 6).alias("max_similarity_score"), "most_similar_positive_idx",
        F.col("example").alias("most_similar_positive_example"), F.col("label").alias("prediction"))


@query
def analyze_logs(spark: SparkSession, folder: str) -> DataFrame:
    found = scoring.analyze_lines(logs(spark, folder), scoring.hashed_words(ENCODER_SIZE))
    return found.withColumns(rounded("max_similarity_score")).drop("original_log_line", "model")


@query
def analyze_logs_options(spark: SparkSession, folder: str) -> DataFrame:
    """The same with options of a file and of a user merged over the defaults."""
    of_file = {"thresholds": {"high_confidence": 0.5, "login_detection": 0.3}}
    of_user = {"thresholds": {"login_detection": 0.35}, "phrases_per_category": 7}
    options = scoring.scoring_options(of_file, of_user)
    found = scoring.analyze_lines(logs(spark, folder), scoring.hashed_words(ENCODER_SIZE), options)
    return found.withColumns(rounded("max_similarity_score")).drop("original_log_line", "model")


@query
def score_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return reports.score_metrics(rounded_line_scores(spark, folder), "score").withColumns(rounded("mean_score"))


@query
def score_summary(spark: SparkSession, folder: str) -> DataFrame:
    return reports.score_summary(rounded_line_scores(spark, folder), "score").withColumns(rounded("mean_score", "std_score"))


@query
def analysis_summary(spark: SparkSession, folder: str) -> DataFrame:
    lines = logs(spark, folder).agg(F.count(F.lit(1))).scalar()
    return reports.analysis_summary(rounded_line_scores(spark, folder), "score", lines).withColumns(rounded("mean_confidence"))


@query
def score_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return reports.score_histogram(rounded_line_scores(spark, folder), "score").withColumns(rounded("lower", "upper"))


@query
def score_bands(spark: SparkSession, folder: str) -> DataFrame:
    return rounded_line_scores(spark, folder).select("line_id", "score", reports.score_band(F.col("score")).alias("band"))


@query
def scores_above_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return reports.at_least(rounded_line_scores(spark, folder), "score")


@query
def top_scores(spark: SparkSession, folder: str) -> DataFrame:
    return reports.top_scores(rounded_line_scores(spark, folder), "score", "line_id")


# ---------------------------------------------------------------- text pairs

def pairs(spark: SparkSession, folder: str) -> DataFrame:
    return turn_pairs(table(spark, folder, "conversations"))


@query
def token_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    found = similarity.token_breakdown(pairs(spark, folder), "first", "second").drop("first", "second")
    return found.withColumns({c: joined(c) for c in found.columns[2:]})


@query
def bigrams(spark: SparkSession, folder: str) -> DataFrame:
    found = tokens.bigrams(text.split_words(F.col("line")))
    return logs(spark, folder).select("line_id", F.posexplode(found).alias("pos", "bigram"))


@query
def highlight(spark: SparkSession, folder: str) -> DataFrame:
    words = F.array(F.lit("user"), F.lit("login"), F.lit("failed"), F.concat(F.lit("user"), F.col("user_id").cast("string")))
    return logs(spark, folder).select("line_id", text.highlight(F.col("line"), words, *MARKS).alias("highlighted"))


@query
def tfidf_pair(spark: SparkSession, folder: str) -> DataFrame:
    found = similarity.tfidf_similarity(pairs(spark, folder), "first", "second")
    return found.select("conv_id", "turn", F.round("lexical", 6).alias("lexical"))


@query
def similar_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbouring turns whose string ratio is 0.5 or more."""
    scored = pairs(spark, folder).select("conv_id", "turn", similarity.string_ratio_at_least(F.col("first"), F.col("second"), 0.5).alias("ratio"))
    return scored.filter(F.col("ratio").isNotNull()).withColumns(rounded("ratio"))


@query
def string_ratio(spark: SparkSession, folder: str) -> DataFrame:
    return pairs(spark, folder).select("conv_id", "turn", F.round(similarity.string_ratio(F.col("first"), F.col("second")), 6).alias("ratio"))


@query
def enhanced_similarity(spark: SparkSession, folder: str) -> DataFrame:
    encoder = scoring.hashed_words(ENCODER_SIZE)
    found = scoring.enhanced_similarity(pairs(spark, folder), "first", "second", encoder).drop("first", "second")
    return found.withColumns(rounded("semantic", "lexical", "string", "combined"))


# ---------------------------------------------------------------- corrections

@query
def correction_records(spark: SparkSession, folder: str) -> DataFrame:
    return records(spark, folder).select("doc_id", "record_id", "timestamp", "used_for_training")


@query
def correction_display(spark: SparkSession, folder: str) -> DataFrame:
    return corrections.display_table(records(spark, folder)).drop("full_log_text")


@query
def correction_stats(spark: SparkSession, folder: str) -> DataFrame:
    return corrections.usage_stats(records(spark, folder)).withColumns(rounded("usage_rate"))


@query
def correction_types(spark: SparkSession, folder: str) -> DataFrame:
    return corrections.correction_types(records(spark, folder))


@query
def unused_corrections(spark: SparkSession, folder: str) -> DataFrame:
    return corrections.unused(records(spark, folder)).select("doc_id", "record_id", "log_text")


@query
def used_corrections(spark: SparkSession, folder: str) -> DataFrame:
    return corrections.used(records(spark, folder)).select("doc_id", "record_id")


@query
def filtered_counts(spark: SparkSession, folder: str) -> DataFrame:
    shown = ~F.col("used_for_training") & text.matches_search(F.col("log_text"), "licen[cs]e|@")
    return corrections.filtered_counts(records(spark, folder), shown)


def chosen_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Record ids an analyst picks: unused corrections to a failed login."""
    unused = corrections.unused(records(spark, folder))
    return unused.filter(text.label_slug(F.col("user_correction.label")) == "failed_login").select("record_id", "log_text")


@query
def mark_used(spark: SparkSession, folder: str) -> DataFrame:
    marked = corrections.mark_used(records(spark, folder), chosen_ids(spark, folder), "2025-07-01 00:00:00", "20250701_000000")
    return marked.select("doc_id", "record_id", "used_for_training", "training_timestamp", "dataset_generation_session")


@query
def selected_corrections(spark: SparkSession, folder: str) -> DataFrame:
    return corrections.selected(records(spark, folder), chosen_ids(spark, folder)).select("doc_id", "record_id")


@query
def remaining_corrections(spark: SparkSession, folder: str) -> DataFrame:
    return corrections.remaining(records(spark, folder), chosen_ids(spark, folder)).select("doc_id", "record_id")


# ---------------------------------------------------------------- training sets

@query
def training_rows(spark: SparkSession, folder: str) -> DataFrame:
    return training.training_rows(records(spark, folder)).select(*training.COLUMNS)


@query
def boosted_training_set(spark: SparkSession, folder: str) -> DataFrame:
    rows = training.training_rows(corrections.unused(records(spark, folder)))
    return training.boosted(rows).select("ID", "Asset", "Label", "Source")


@query
def class_quota(spark: SparkSession, folder: str) -> DataFrame:
    rows = training.training_rows(corrections.unused(records(spark, folder)))
    total = table(spark, folder, "events").agg(F.count(F.lit(1))).scalar()
    return training.class_quotas(rows, total)


@query
def quota_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled lines picked up to the class quotas of a set as large as the documents table."""
    rows = training.training_rows(corrections.unused(records(spark, folder)))
    total = table(spark, folder, "documents").agg(F.count(F.lit(1))).scalar()
    category = fields.event_category(F.col("line"))
    label = F.when(category == searches.SUCCESS, 1).when(category == searches.FAILURE, 2).otherwise(0)
    pool = logs(spark, folder).select("line_id", label.alias("Label"))
    return training.fill_quotas(pool, training.class_quotas(rows, total), "line_id").select("line_id", "Label")


def filled_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """Boosted corrections and labelled log lines up to the class quotas of a set as large as the events table."""
    total = table(spark, folder, "events").agg(F.count(F.lit(1))).scalar()
    category = fields.event_category(F.col("line"))
    label = F.when(category == searches.SUCCESS, 1).when(category == searches.FAILURE, 2).otherwise(0)
    pool = logs(spark, folder).select("line_id", F.col("line").alias("Log"), label.alias("Label"))
    return training.enhanced_dataset(records(spark, folder), pool, "line_id", total)


@query
def enhanced_dataset(spark: SparkSession, folder: str) -> DataFrame:
    return filled_dataset(spark, folder)


@query
def dataset_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return training.dataset_metadata(filled_dataset(spark, folder), fixed.CORRECTION_BOOST, "2025-07-01 00:00:00")


@query
def saved_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """The enhanced set written as files and read back, row by row."""
    built = filled_dataset(spark, folder)
    facts = training.dataset_metadata(built, fixed.CORRECTION_BOOST, "2025-07-01 00:00:00")
    places = training.save_dataset(built, facts, scratch_path(spark, "dataset"))
    read = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
    parts = [
        read.csv(places[name]).select(F.lit(name).alias("place"), "ID", "Asset", F.md5(F.col("Log").cast("binary")).alias("log_md5"), F.col("Label").cast("int"), "Source")
        for name in ("by_class", "combined")
    ]
    return parts[0].unionByName(parts[1])


def labelled_lines(spark: SparkSession, folder: str) -> DataFrame:
    category = fields.event_category(F.col("line"))
    label = F.when(category == searches.SUCCESS, "Success_login").when(category == searches.FAILURE, "Failed_login").otherwise("Other")
    return logs(spark, folder).withColumn("label", label)


@query
def label_counts(spark: SparkSession, folder: str) -> DataFrame:
    return reports.value_counts(labelled_lines(spark, folder), "label")


@query
def asset_counts(spark: SparkSession, folder: str) -> DataFrame:
    lines = logs(spark, folder).withColumn("Asset", fields.asset_type(F.col("line")))
    return reports.value_counts(lines, "Asset", limit=10)


@query
def distinct_counts(spark: SparkSession, folder: str) -> DataFrame:
    return reports.distinct_counts(logs(spark, folder), "user_id")


@query
def labelled_samples(spark: SparkSession, folder: str) -> DataFrame:
    lines = labelled_lines(spark, folder)
    label = F.when(fields.event_category(F.col("line")) == searches.FAILURE, "Failed_login").otherwise("Other")
    return training.labelled_samples(lines, "source", "line_id", label)


@query
def union_labelled(spark: SparkSession, folder: str) -> DataFrame:
    mine = labelled_lines(spark, folder).select(F.col("line").alias("text"), "label")
    others = document_log(spark, folder).select(F.col("line").alias("text"), fields.asset_type(F.col("line")).alias("asset"))
    return training.union_all([mine, others])


@query
def first_lines(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.head(logs(spark, folder).select("line_id", "line"), ["line_id"], 1000)


@query
def line_preview(spark: SparkSession, folder: str) -> DataFrame:
    return files.preview_lines(logs(spark, folder))


@query
def line_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.numbered_by_id(logs(spark, folder).select("source", "line_id"), ["source"], "line_id")


@query
def shuffled_rows(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.shuffled_positions(logs(spark, folder).select("line_id"), "line_id", training.SHUFFLE_SEED)


@query
def ordered_split(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.ordered_split(logs(spark, folder).select("line_id"), "line_id")


# ---------------------------------------------------------------- tokens

@query
def token_rows(spark: SparkSession, folder: str) -> DataFrame:
    return vocabulary.token_rows(logs(spark, folder))


@query
def token_offsets(spark: SparkSession, folder: str) -> DataFrame:
    spans = logs(spark, folder).select("line_id", F.inline(tokens.token_spans(F.col("line"))))
    return spans.withColumnsRenamed({"start": "start_at", "end": "end_at"})


@query
def document_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return vocabulary.vocabulary(vocabulary.token_rows(document_log(spark, folder)))


@query
def line_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return vocabulary.vocabulary(vocabulary.token_rows(logs(spark, folder)))


def tagger_corpus(spark: SparkSession, folder: str) -> DataFrame:
    return vocabulary.tagged_lines(logs(spark, folder))


@query
def bio_tags(spark: SparkSession, folder: str) -> DataFrame:
    return vocabulary.token_tags(tagger_corpus(spark, folder))


@query
def bio_spans(spark: SparkSession, folder: str) -> DataFrame:
    return vocabulary.span_rows(tagger_corpus(spark, folder))


@query
def last_entities(spark: SparkSession, folder: str) -> DataFrame:
    return vocabulary.last_spans(tagger_corpus(spark, folder))


@query
def span_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens inside the line's first clock time, found by their offsets."""
    at = F.instr("line", ":") - 3
    lines = logs(spark, folder).select("line_id", tokens.token_spans(F.col("line")).alias("tokens"), at.alias("at"))
    span = F.array(F.struct(F.col("at").alias("start"), (F.col("at") + 8).alias("end")))
    inside = tokens.tokens_in_spans(F.col("tokens"), span)[0]
    return lines.select("line_id", F.array_join(F.transform(inside, lambda t: t["token"]), " ").alias("inside"))


@query
def tag_index(spark: SparkSession, folder: str) -> DataFrame:
    return vocabulary.tag_index(tagger_corpus(spark, folder))


@query
def decoded_tags(spark: SparkSession, folder: str) -> DataFrame:
    numbers = vocabulary.tag_numbers()
    tags = tagger_corpus(spark, folder).select(F.explode(vocabulary.once("tagged.tag", "CAST(array() AS array<string>)")).alias("tag"))
    coded = tags.withColumn("idx", vocabulary.tag_to_number(F.col("tag"), numbers))
    decoded = coded.withColumn("decoded", vocabulary.number_to_tag(F.col("idx"), numbers))
    return decoded.groupBy("tag", "decoded").agg(F.count(F.lit(1)).alias("tokens"))


@query
def encoded_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as padded word indices, in batches of 16 lines."""
    lines = logs(spark, folder)
    encoded = vocabulary.encode_lines(lines.select("line_id", "line"), vocabulary.vocabulary(vocabulary.token_rows(lines)))
    return vocabulary.padded(vocabulary.in_batches(encoded)).withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), " "))


# ---------------------------------------------------------------- files and streams

@query
def text_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "text")
    files.write_lines(logs(spark, folder), path)
    found = files.text_lines(spark, path)
    # Numbers run from 1 in each of the files, whose names Spark makes up.
    whole = found.groupBy("source").agg(F.max("line_number").alias("last"), F.countDistinct("line_number").alias("numbers"), F.min("line_number").alias("first"))
    odd = whole.filter("first <> 1 OR last <> numbers").agg(F.count(F.lit(1)).alias("odd"))
    return found.select("line").crossJoin(F.broadcast(odd))


@query
def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    files.write_csv(files.export_rows(document_log(spark, folder)), path)
    return files.csv_lines(spark, path).select("line")


@query
def structured_csv_text(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "structured")
    rows = logs(spark, folder).select(
        F.col("line_id").alias("LineId"), F.col("event_type").alias("Component"), F.col("line").alias("Content"),
        F.lit("E1").alias("EventId"), F.lit("template").alias("EventTemplate"),
    )
    files.write_csv(rows, path)
    return files.structured_csv(spark, path)


@query
def broken_cells_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Whole documents, line breaks and all, as cells of a structured CSV."""
    path = scratch_path(spark, "cells")
    rows = table(spark, folder, "documents").select(F.col("doc_id").alias("LineId"), "source", F.col("text").alias("Content"), F.lit("t").alias("EventTemplate"))
    files.write_csv(rows, path)
    return files.structured_csv(spark, path).withColumn("text", F.md5(F.col("text").cast("binary")))


@query
def example_bank_file(spark: SparkSession, folder: str) -> DataFrame:
    """Log lines written as a bank of examples and read with their normalised texts."""
    path = scratch_path(spark, "bank")
    rows = logs(spark, folder).select(
        F.col("line_id").cast("int").alias("ID"), fields.asset_type(F.col("line")).alias("Asset"), F.col("line").alias("Log"))
    files.write_csv(rows, path)
    return banks.example_bank(spark, path)


@query
def pattern_file_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The dictionary patterns written as a JSON object, read as a table and looked for in all lines."""
    path = scratch_path(spark, "patterns")
    columns = [F.array(*[F.lit(p) for p in patterns]).alias(c) for c, patterns in fixed.EVENT_PATTERNS.items()]
    files.write_json(spark.range(1).select(*columns), path)
    patterns = banks.patterns_by_category(banks.pattern_dictionary(spark, path))
    found = reports.dictionary_labels(logs(spark, folder).select("line_id", "line"), patterns).drop("line")
    return found.withColumns({f"{c}_hits": F.array_join(F.col(f"{c}_hits").cast("array<string>"), "|") for c in patterns})


@query
def pattern_table(spark: SparkSession, folder: str) -> DataFrame:
    """The sources of every language written as a dictionary file and read back as rows."""
    path = scratch_path(spark, "dictionary")
    kinds = table(spark, folder, "documents").groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    one = kinds.agg(F.map_from_entries(F.collect_list(F.struct("lang", "sources"))).alias("m")).select(F.to_json("m").alias("line"))
    files.write_lines(one, path)
    return banks.pattern_dictionary(spark, path)


@query
def first_lines_file(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "head")
    files.write_first_lines(logs(spark, folder), path)
    return files.text_lines(spark, path).select("line_number", "line")


@query
def file_admission(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of every source as text and as ORC files: which folders hold files that are admitted, and why not."""
    path = scratch_path(spark, "admission")
    lines = logs(spark, folder).select("source", "line")
    lines.write.partitionBy("source").text(f"{path}/text")
    lines.write.partitionBy("source").orc(f"{path}/orc")
    found = files.admission(files.file_listing(spark, path), fixed.MAX_FILE_BYTES)
    return found.select(F.regexp_extract("path", "source=([^/]+)", 1).alias("source"), "extension", "reason").distinct()


@query
def json_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "json")
    files.write_json(corrections.unused(records(spark, folder)).drop("doc_id"), path)
    found = corrections.display_table(corrections.load_corrections(spark, path))
    return found.withColumn("full_log_text", F.md5(F.col("full_log_text").cast("binary")))


@query
def feedback_append(spark: SparkSession, folder: str) -> DataFrame:
    """Feedback appended twice to a store, then read back."""
    path = scratch_path(spark, "feedback")
    given = records(spark, folder).select("log_text", "original_prediction", "user_correction", "timestamp")
    stored = corrections.feedback_records(given, F.col("timestamp"))
    corrections.append_feedback(stored, path)
    corrections.append_feedback(stored.filter(F.col("user_correction.label").isNotNull()), path)
    read = corrections.load_corrections(spark, path)
    return read.groupBy("record_id", "used_for_training", F.md5(F.col("log_text").cast("binary")).alias("text_md5")).agg(F.count(F.lit(1)).alias("rows"))


@query
def snapshot_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Marked corrections written as a new version, then counted from it."""
    path = scratch_path(spark, "snapshot")
    marked = corrections.mark_used(records(spark, folder), chosen_ids(spark, folder), "2025-07-01 00:00:00")
    corrections.write_snapshot(marked.drop("doc_id"), path)
    return corrections.usage_stats(corrections.load_corrections(spark, path)).withColumns(rounded("usage_rate"))


@query
def tagged_file_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The tagged corpus written as ``token TAG`` lines and read back."""
    path = scratch_path(spark, "tagged")
    rows = F.transform("tagged", lambda t: F.concat_ws(" ", t["token"], t["tag"]))
    sentences = tagger_corpus(spark, folder).select(F.concat(F.array_join(rows, "\n"), F.lit("\n")).alias("line"))
    files.write_lines(sentences, path)
    read = banks.tagged_sentences(spark, path)
    return read.groupBy("tag").agg(F.count(F.lit(1)).alias("tokens"))


def log_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = table(spark, folder, "events").schema
    return auth_lines(spread_stream(streams.parquet_stream(spark, f"{folder}/events.parque[t]", schema).select("event_id", "ts", "user_id", "event_type")))


def streamed(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    path = scratch_path(spark, name)
    streams.start_to_files(stream, path, f"{path}-checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def plain_bounds(df: DataFrame) -> DataFrame:
    """Window bounds as text, independent of how a client shows zoned times."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("window_start", "window_end")})


def complete(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """The last version of a stream's complete result: every window, the newest ones included."""
    path = scratch_path(spark, name)
    streams.start_to_versions(stream, path, f"{path}-checkpoint").awaitTermination()
    return streams.last_version(spark, path, stream.schema)


@query
def stream_alert(spark: SparkSession, folder: str) -> DataFrame:
    found = streams.alert_stream(log_stream(spark, folder), window=ALERT_WINDOW, slide=ALERT_WINDOW)
    return plain_bounds(complete(spark, found, "alerts"))


@query
def stream_alert_state(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of an hour, every half hour, from a state of half-hour counts; every window that ended before the last watermark."""
    own = spark.newSession()  # the state store is a setting of the session; this one keeps state outside the JVM's heap
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    path = scratch_path(spark, "alerts")
    found = alerts.alert_state_stream(log_stream(own, folder), limit=0)
    streams.start_to_files(found, path, f"{path}-checkpoint").awaitTermination()
    return plain_bounds(spark.read.schema(found.schema).parquet(path))


@query
def hourly_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly activity from log files that arrive in three parts, the first lines last; each run reads new files only."""
    path = scratch_path(spark, "arrivals")
    lines = logs(spark, folder)

    def counted(text_lines: DataFrame) -> DataFrame:
        ts = F.to_timestamp_ntz(F.substring("line", 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))
        return text_lines.select(F.date_trunc("hour", ts).cast("timestamp_ntz").alias("hour"), fields.event_category(F.col("line")).alias("event_category"))

    schema = "hour timestamp_ntz, event_category string, events bigint"
    for part in (1, 2, 0):
        files.write_lines(lines.filter(F.col("line_id") % 3 == part), f"{path}/in/part={part}")
        totals.add_new_files(spark, f"{path}/in", f"{path}/store", lambda names: files.text_lines(spark, names, number=False), counted)
        if part == 2:
            totals.compact(spark, f"{path}/store", schema)
    return totals.totals(spark, f"{path}/store", schema)


@query
def stream_hourly(spark: SparkSession, folder: str) -> DataFrame:
    return plain_bounds(complete(spark, streams.hourly_stream(log_stream(spark, folder)), "hourly"))


@query
def stream_daily_summary(spark: SparkSession, folder: str) -> DataFrame:
    return plain_bounds(complete(spark, streams.daily_summary_stream(log_stream(spark, folder)), "daily"))


@query
def stream_classified(spark: SparkSession, folder: str) -> DataFrame:
    found = streamed(spark, streams.classified_stream(log_stream(spark, folder)), "classified")
    return found.select("line_id", "event_category", "label", "user", "src_ip", "action")


@query
def stream_feedback(spark: SparkSession, folder: str) -> DataFrame:
    """Feedback on every line as a stream of records into the store."""
    lines = log_stream(spark, folder)
    judged = F.struct(fields.event_category(F.col("line")).alias("label"), F.lit(1.0).alias("confidence"))
    given = lines.select(
        "ts", F.col("line").alias("log_text"), judged.alias("original_prediction"), judged.alias("user_correction"),
        text.record_id(F.col("line"), F.lit("")).alias("record_id"),
    )
    stored = streamed(spark, streams.feedback_stream(given, "1 hour"), "feedback")
    return stored.select("record_id", "log_text", F.col("user_correction.label").alias("label"))
