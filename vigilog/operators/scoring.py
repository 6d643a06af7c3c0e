"""Nearest known example and prototype similarity.

Lines are scored in one narrow pass: the distinct texts of a run of lines are encoded once, and
matrix products compare them with the known examples. Nothing is shuffled, so repeated or hot
lines cost nothing. The examples are encoded by Spark, stored in blocks in the shared folder, and every task
reads them block by block, keeping the best so far: one path, whatever their number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from vigilog import fixed_values as fixed
from vigilog.functions.similarity import PAIR_ROWS, combined_similarity, string_ratio, tfidf_similarity
from vigilog.functions.text import normalize_text, preprocess_text
from vigilog.functions.vectors import NEAR_ZERO, first_argmax, softmax

Encoder = Callable[[list[str]], np.ndarray]

BLOCK_ROWS = 4096
TARGET_ROWS = 20_000
LAST = (1 << 63) - 1
DECIMALS = 12
AMBIGUOUS = "Ambiguous event"
NON_LOGIN = "Non-login event"


# ---------------------------------------------------------------- options

def merged_options(base: Mapping, *overrides: Mapping | None) -> dict:
    """Options with nested dictionaries merged, later ones winning."""
    out = dict(base)
    for override in overrides:
        for key, value in (override or {}).items():
            both = isinstance(out.get(key), Mapping) and isinstance(value, Mapping)
            out[key] = merged_options(out[key], value) if both else value
    return out


def scoring_options(*overrides: Mapping | None) -> dict:
    return merged_options(fixed.SCORING_OPTIONS, *overrides)


# ---------------------------------------------------------------- encoders

def hashed_words(dim: int = 64) -> Encoder:
    """An encoder that counts words in ``dim`` hashed slots.

    It stands in where no sentence model is installed. Any callable from a list of
    texts to a matrix, one row per text, can be passed instead.
    """

    def encode(texts: list[str]) -> np.ndarray:
        slots: dict[str, int] = {}
        out = np.zeros((len(texts), dim))
        for row, text in enumerate(texts):
            for word in text.split():
                if word not in slots:
                    slots[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dim
                out[row, slots[word]] += 1.0
        return out

    return encode


def _encode_safely(encoder: Encoder, texts: list[str], dim: int) -> np.ndarray:
    """Vectors of texts; blank texts, and texts the encoder fails on, give zeros."""
    out = np.zeros((len(texts), dim))
    filled = [i for i, t in enumerate(texts) if t and t.strip()]
    if not filled:
        return out
    try:
        out[filled] = encoder([texts[i] for i in filled])
    except Exception:
        for i in filled:
            try:
                out[i] = encoder([texts[i]])[0]
            except Exception:
                out[i] = 0.0
    return out


# ---------------------------------------------------------------- numpy helpers used inside tasks

def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; rows of (almost) zeros become zeros."""
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    blank = (np.abs(matrix) <= NEAR_ZERO).all(axis=1, keepdims=True)
    return np.where(blank, 0.0, matrix / np.where(norms == 0, 1.0, norms))


def _cosines(rows: np.ndarray, unit_matrix: np.ndarray) -> np.ndarray:
    """Cosines with every matrix row, rounded so that equal ones compare equal on any machine."""
    return np.round(_unit_rows(rows) @ unit_matrix.T, DECIMALS)


def _vector_rows(column: pa.Array, dim: int) -> np.ndarray:
    """Matrix from a list column; missing vectors or vectors of another size give zeros."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dim))
    right = lengths == dim
    if dim and right.any():
        kept = column.filter(pa.array(right))
        out[right] = pc.list_flatten(kept).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return out


def _distinct_rows(column: pa.Array, encoder: Encoder, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of the distinct texts, row -> distinct text) of a text column."""
    coded = pc.fill_null(column.cast(pa.string()), "").dictionary_encode()
    vectors = _encode_safely(encoder, coded.dictionary.to_pylist(), dim)
    return vectors, coded.indices.to_numpy(zero_copy_only=False)


def _batch_vectors(batch: pa.RecordBatch, column: str, encoder: Encoder | None, dim: int) -> tuple[np.ndarray, np.ndarray | None]:
    values = batch.column(batch.schema.get_field_index(column))
    if encoder is None:
        return _vector_rows(values, dim), None
    return _distinct_rows(values, encoder, dim)


# ---------------------------------------------------------------- nearest example

BLOCK_SCHEMA = "ids array<bigint>, dim int, vectors binary"


def stored_blocks(bank: DataFrame, column: str, encoder: Encoder | None, path: str, block_rows: int = BLOCK_ROWS) -> str:
    """Writes ``bank(idx, column)`` as blocks of unit vectors; examples of different sizes are refused."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, block_rows):
                batch = whole.slice(at, block_rows)
                values = batch.column(1)
                if encoder is None:
                    sizes = pc.unique(pc.list_value_length(values).drop_null()).to_pylist()
                    if len(sizes) > 1:
                        raise ValueError(f"example vectors of different sizes: {sizes}")
                    matrix = _vector_rows(values, sizes[0] if sizes else 0)
                else:
                    texts = [t or "" for t in values.to_pylist()]
                    matrix = _encode_safely(encoder, texts, encoder(["x"]).shape[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([matrix.shape[1]], pa.int32()),
                     pa.array([_unit_rows(matrix).tobytes()], pa.binary())], names=["ids", "dim", "vectors"])

    bank.select(F.col("idx").cast("bigint").alias("idx"), column).mapInArrow(run, BLOCK_SCHEMA).write.parquet(path)
    return path


def _read_blocks(path: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The blocks of a stored bank, one at a time; an example without an index comes behind all others."""
    system, base = pyarrow.fs.FileSystem.from_uri(path)
    for file in sorted(f.path for f in system.get_file_info(pyarrow.fs.FileSelector(base)) if f.path.endswith(".parquet")):
        for batch in pq.ParquetFile(system.open_input_file(file)).iter_batches(1):
            ids = np.array([LAST if i is None else i for i in batch.column("ids")[0].as_py()], np.int64)
            if len(ids):
                yield ids, np.frombuffer(batch.column("vectors")[0].as_py()).reshape(len(ids), batch.column("dim")[0].as_py())


def _best(vectors: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Highest cosine of each row with any example, and the lowest index that has it."""
    top, found = np.full(len(vectors), -np.inf), np.full(len(vectors), LAST)
    for ids, matrix in _read_blocks(path):
        if not vectors.shape[1]:  # no row has a vector
            vectors = np.zeros((len(vectors), matrix.shape[1]))
        if not matrix.shape[1]:  # no example of the block has one
            matrix = np.zeros((len(matrix), vectors.shape[1]))
        if matrix.shape[1] != vectors.shape[1]:
            raise ValueError(f"example vectors have {matrix.shape[1]} numbers, others {vectors.shape[1]}")
        order = np.argsort(ids, kind="stable")
        similarity = _cosines(vectors, matrix[order])
        place = similarity.argmax(axis=1)
        score, index = similarity[np.arange(len(place)), place], ids[order][place]
        better = (score > top) | ((score == top) & (index < found))
        top, found = np.where(better, score, top), np.where(better, index, found)
    return np.where(np.isinf(top), 0.0, top), found


def _runs(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together to tables of about ``rows`` rows, so that the bank is read seldom."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def nearest_example(
    targets: DataFrame, bank: DataFrame, column: str, path: str, *, encoder: Encoder | None = None, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Adds ``max_similarity_score`` and ``most_similar_positive_idx`` to the targets.

    ``bank`` has ``idx`` (bigint) and the same ``column`` as the targets: texts when
    an encoder is given, else vectors. It is stored in blocks in the new folder ``path``, which all
    executors must reach. The lowest ``idx`` wins among equals; without examples the score is 0.
    """
    stored_blocks(bank, column, encoder, path, block_rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, TARGET_ROWS):
            values = table.column(column).combine_chunks()
            if encoder is None:
                sizes = pc.unique(pc.list_value_length(values).drop_null()).to_pylist()
                if len(sizes) > 1:
                    raise ValueError(f"vectors of different sizes: {sizes}")
                top, found = _best(_vector_rows(values, sizes[0] if sizes else 0), path)
            else:
                vectors, rows = _distinct_rows(values, encoder, encoder(["x"]).shape[1])
                top, found = (x[rows] for x in _best(vectors, path))
            index = pa.array(found, pa.int64(), mask=found == LAST)
            out = table.append_column("max_similarity_score", pa.array(top, pa.float64())).append_column("most_similar_positive_idx", index)
            yield from out.to_batches()

    added = [StructField("max_similarity_score", DoubleType()), StructField("most_similar_positive_idx", LongType())]
    return targets.mapInArrow(score, StructType(targets.schema.fields + added))


def with_example(scored: DataFrame, bank: DataFrame) -> DataFrame:
    """Adds the bank's text and label of the matched example.

    The bank has one row for an index here, so a hot example is a join that Spark can split.
    """
    columns = [c for c in ("example", "label") if c in bank.columns]
    names = bank.groupBy(F.col("idx").cast("bigint").alias("most_similar_positive_idx")).agg(F.min(F.struct(*columns)).alias("_e"))
    return scored.join(names.select("most_similar_positive_idx", "_e.*"), "most_similar_positive_idx", "left")


def similarity_results(lines: DataFrame, bank: DataFrame, encoder: Encoder, path: str) -> DataFrame:
    """The similarity analysis of log lines against known examples, by one scan of a small bank, else by a stored index.

    ``bank``: ``idx, example, label``. The label of the matched example is the
    prediction; without a label it reads ``Failed login``.
    """
    prepared = lines.withColumn("normalized_log", normalize_text(F.col("line")))
    texts = bank.withColumn("normalized_log", normalize_text(F.col("example")))
    from vigilog.operators.example_index import nearest  # which builds on this module

    scored = nearest(prepared, texts, "normalized_log", path, encoder=encoder)
    named = with_example(scored, bank)
    label = F.coalesce(F.col("label"), F.lit("Failed login")) if "label" in bank.columns else F.lit("Failed login")
    return named.select(
        "line_id",
        F.col("line").alias("original_log_line"),
        "normalized_log",
        "max_similarity_score",
        "most_similar_positive_idx",
        F.col("example").alias("most_similar_positive_example"),
        label.alias("prediction"),
        F.lit("Similarity").alias("model"),
    )


# ---------------------------------------------------------------- prototypes

def mean_vectors(vectors: DataFrame, category: str, column: str) -> DataFrame:
    """Mean vector per category: one buffer per category and task, then merged."""
    vector = array_to_vector(F.col(column))
    means = vectors.groupBy(category).agg(Summarizer.mean(vector).alias("_mean"))
    return means.select(F.col(category).alias("category"), vector_to_array("_mean").alias("vec"))


def prototype_phrases(options: Mapping | None = None) -> dict[str, list[str]]:
    """Category -> the first phrases of its templates, context term first.

    The option ``phrases_per_category`` says how many; None takes all. Every category whose name holds ``login`` is combined with the login terms.
    """
    options = scoring_options() if options is None else options
    out = {}
    for category in options["prototype_categories"]:
        if category not in options["prototype_templates"]:
            continue
        context = options["login_terms"] if "login" in category else options["system_terms"]
        phrases = [f"{c} {base}" for base in options["prototype_templates"][category] for c in context]
        out[category] = phrases[: options["phrases_per_category"]]
    return out


def similarity_to_vectors(
    df: DataFrame, column: str, prototypes: Sequence[Sequence[float]], encoder: Encoder | None = None, out: str = "sims"
) -> DataFrame:
    """Adds an array of cosines, one per prototype in the given order."""
    matrix = _unit_rows(np.asarray(prototypes, dtype=np.float64))
    dim = matrix.shape[1]
    shared = df.sparkSession.sparkContext.broadcast(matrix)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prototype_matrix = shared.value
        for batch in batches:
            vectors, rows = _batch_vectors(batch, column, encoder, dim)
            similarity = _cosines(vectors, prototype_matrix)
            if rows is not None:
                similarity = similarity[rows]
            offsets = np.arange(0, similarity.size + 1, similarity.shape[1], dtype=np.int32)
            sims = pa.ListArray.from_arrays(pa.array(offsets), pa.array(similarity.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, sims], names=[*batch.schema.names, out])

    return df.mapInArrow(score, StructType([*df.schema.fields, StructField(out, ArrayType(DoubleType()))]))


def similarity_to_table(df: DataFrame, column: str, prototypes: DataFrame, path: str, encoder: Encoder | None = None, out: str = "sims") -> DataFrame:
    """Adds an array of ``(category, similarity)``, in the order of the categories, for ``prototypes(category, vec)``.

    The table is stored in the new folder ``path`` and read by the tasks, so neither the driver nor the plan holds the categories.
    A task holds all of them, as every row gets a number for each.
    """
    kind = prototypes.schema["category"]
    prototypes.select("category", F.col("vec").cast("array<double>").alias("vec")).write.parquet(path)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = pyarrow.fs.FileSystem.from_uri(path)
        files = [f.path for f in system.get_file_info(pyarrow.fs.FileSelector(base)) if f.path.endswith(".parquet")]
        table = pa.concat_tables(pq.ParquetFile(system.open_input_file(f)).read() for f in files).sort_by("category").combine_chunks()
        categories, vectors = (table.column(n).combine_chunks() if table.num_rows else pa.array([], table.schema.field(n).type) for n in ("category", "vec"))
        sizes = pc.list_value_length(vectors).drop_null().to_pylist()
        matrix = _unit_rows(_vector_rows(vectors, max(sizes, default=0)))
        for batch in batches:
            found, rows = _batch_vectors(batch, column, encoder, matrix.shape[1])
            similarity = _cosines(found, matrix)
            similarity = similarity if rows is None else similarity[rows]
            offsets = np.arange(0, similarity.size + 1, max(len(matrix), 1), dtype=np.int32) if len(matrix) else np.zeros(batch.num_rows + 1, np.int32)
            names = categories.take(pa.array(np.tile(np.arange(len(matrix)), batch.num_rows)))
            pairs = pa.StructArray.from_arrays([names, pa.array(similarity.ravel(), pa.float64())], names=["category", "similarity"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pairs)], names=[*batch.schema.names, out])

    pair = StructType([StructField("category", kind.dataType), StructField("similarity", DoubleType())])
    return df.mapInArrow(score, StructType([*df.schema.fields, StructField(out, ArrayType(pair))]))


def is_login(sims: Column, categories: Sequence[str], threshold: float) -> Column:
    """Best login similarity above the threshold and above every other category's.

    Categories that start with ``non_`` are not login; an empty side counts as 0.
    """

    def best(positions: list[int]) -> Column:
        found = [sims[i] for i in positions]
        return F.lit(0.0) if not found else found[0] if len(found) == 1 else F.greatest(*found)

    inside = best([i for i, c in enumerate(categories) if not c.startswith("non_")])
    outside = best([i for i, c in enumerate(categories) if c.startswith("non_")])
    return (inside > outside) & (inside > threshold)


def semantic_label(sims: Column, categories: Sequence[str], options: Mapping) -> tuple[Column, Column, Column]:
    """(label, score, explanation) of the most similar category, the first of equals."""
    score = F.array_max(sims)
    best = F.element_at(F.array(*[F.lit(c) for c in categories]), first_argmax(sims))
    names = F.array(*[F.lit(options["category_labels"].get(c, "Unknown")) for c in categories])
    label = F.when(score < options["thresholds"]["classification"], AMBIGUOUS).otherwise(
        F.element_at(names, first_argmax(sims))
    )
    return label, score, F.format_string("Semantic similarity: %.3f to %s", score, best)


def class_probabilities(sims: Column, categories: Sequence[str], options: Mapping) -> Column:
    """Softmax of three times the similarity, in the order of the class names."""
    by_label = {options["category_labels"].get(c): i for i, c in enumerate(categories)}
    scores = [sims[by_label[n]] if n in by_label else F.lit(0.0) for n in options["class_names"]]
    return softmax(F.array(*scores))


def combine_predictions(
    label: Column, score: Column, explanation: Column, model_label: Column, model_score: Column, options: Mapping
) -> tuple[Column, Column, Column]:
    """Final (label, confidence, explanation) from the semantic and the model result."""
    limits = options["thresholds"]
    sure = score > limits["high_confidence"]
    agree = (score > limits["medium_confidence"]) & (label == model_label)
    model_sure = model_score > limits["model_confidence"]
    larger = F.greatest(score, model_score)
    final = F.when(sure | agree, label).when(model_sure, model_label).otherwise(AMBIGUOUS)
    confidence = F.when(sure, score).when(agree, larger).when(model_sure, model_score).otherwise(larger)
    text = (
        F.when(sure, F.concat(explanation, F.lit(" (high confidence)")))
        .when(agree, F.format_string("Agreement: semantic %.3f, model %.3f", score, model_score))
        .when(model_sure, F.format_string("Model confidence: %.3f", model_score))
        .otherwise(F.format_string("Low confidence: %.3f/%.3f", score, model_score))
    )
    return final, confidence, text


def analyze_lines(lines: DataFrame, encoder: Encoder, options: Mapping | None = None) -> DataFrame:
    """The prototype analysis of log lines.

    Each distinct text of a batch is encoded once; every later decision is a
    built-in expression over its similarities.
    """
    options = scoring_options(options)
    phrases = prototype_phrases(options)
    categories = list(phrases)
    cleaned = {c: _preprocessed(lines, p, options) for c, p in phrases.items()}
    dim = encoder(["x"]).shape[1]
    prototypes = [_encode_safely(encoder, cleaned[c], dim).mean(axis=0) for c in categories]
    prepared = lines.select("line_id", F.col("line").alias("original_log_line"), preprocess_text(F.col("line"), options).alias("normalized_log"))
    scored = similarity_to_vectors(prepared, "normalized_log", prototypes, encoder)

    sims = F.col("sims")
    label, score, explanation = semantic_label(sims, categories, options)
    probabilities = class_probabilities(sims, categories, options)
    staged = scored.select(
        "line_id", "original_log_line", "normalized_log", "sims",
        label.alias("_label"), score.alias("_score"), explanation.alias("_explanation"), probabilities.alias("_probabilities"),
    )
    names = F.array(*[F.lit(n) for n in options["class_names"]])
    model_label = F.element_at(names, first_argmax(F.col("_probabilities")))
    final, confidence, text = combine_predictions(
        F.col("_label"), F.col("_score"), F.col("_explanation"), model_label, F.array_max("_probabilities"), options
    )
    login = is_login(sims, categories, options["thresholds"]["login_detection"])
    broken = F.isnan("_score")
    return staged.select(
        "line_id",
        "original_log_line",
        "normalized_log",
        F.when(broken, "Error").when(login, final).otherwise(NON_LOGIN).alias("prediction"),
        F.when(broken, 0.0).when(login, confidence).otherwise(0.0).alias("max_similarity_score"),
        F.when(broken, "Processing error: vector is not a number")
        .when(login, text)
        .otherwise("Semantically not login-related")
        .alias("explanation"),
        F.lit("Prototype").alias("model"),
    )


def _preprocessed(lines: DataFrame, phrases: list[str], options: Mapping) -> list[str]:
    """The few configured phrases after the same cleaning as the lines."""
    one = lines.sparkSession.range(1).select(F.array(*[preprocess_text(F.lit(p), options) for p in phrases]).alias("p"))
    return one.first()["p"]


# ---------------------------------------------------------------- text pairs

def semantic_similarity(pairs: DataFrame, first: str, second: str, encoder: Encoder, out: str = "semantic") -> DataFrame:
    """Adds the cosine of the two texts' vectors."""
    dim = encoder(["x"]).shape[1]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, PAIR_ROWS) for whole in batches for at in range(0, whole.num_rows, PAIR_ROWS)):
            sides = []
            for column in (first, second):
                vectors, rows = _distinct_rows(batch.column(batch.schema.get_field_index(column)), encoder, dim)
                sides.append(_unit_rows(vectors)[rows])
            cosine = (sides[0] * sides[1]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cosine, pa.float64())], names=[*batch.schema.names, out])

    return pairs.mapInArrow(score, StructType([*pairs.schema.fields, StructField(out, DoubleType())]))


def enhanced_similarity(pairs: DataFrame, first: str, second: str, encoder: Encoder) -> DataFrame:
    """Adds ``semantic``, ``lexical``, ``string`` and ``combined`` similarity of two texts."""
    both = tfidf_similarity(pairs, first, second)
    both = semantic_similarity(both, first, second, encoder)
    both = both.withColumn("string", string_ratio(F.col(first), F.col(second)))
    return both.withColumn("combined", combined_similarity(F.col("semantic"), F.col("lexical"), F.col("string")))
