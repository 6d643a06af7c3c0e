"""Training sets from corrections and labelled lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilog import fixed_values as fixed
from vigilog.functions.fields import asset_type
from vigilog.functions.text import label_slug
from vigilog.operators.corrections import unused
from vigilog.operators.ranking import first_rows_per, sample_per_group, shuffle_key, shuffled

COLUMNS = ["ID", "Asset", "Log", "Label", "Source"]
SHUFFLE_SEED = 42


def class_id(label: Column) -> Column:
    """1 successful, 2 failed, 0 everything else; display labels count like their slugs."""
    ids = F.create_map(*[F.lit(x) for pair in fixed.CORRECTION_CLASS_IDS.items() for x in pair])
    return F.coalesce(F.try_element_at(ids, label_slug(F.coalesce(label, F.lit("")))), F.lit(0))


def training_rows(corrections: DataFrame) -> DataFrame:
    """Corrections as training rows, with the predictions they came from."""
    log = F.coalesce("log_text", F.lit(""))
    return corrections.select(
        F.coalesce("record_id", F.lit("")).alias("ID"),
        asset_type(log).alias("Asset"),
        log.alias("Log"),
        class_id(F.col("user_correction.label")).alias("Label"),
        F.lit(fixed.CORRECTION_SOURCE).alias("Source"),
        F.col("original_prediction").alias("Original_Prediction"),
        F.col("user_correction").alias("User_Correction"),
        F.coalesce("timestamp", F.lit("")).alias("Correction_Timestamp"),
    )


def boosted(rows: DataFrame, factor: int = fixed.CORRECTION_BOOST) -> DataFrame:
    """Every row ``factor`` times."""
    copies = F.explode(F.sequence(F.lit(1), F.lit(factor))) if factor > 0 else F.explode(F.array().cast("array<int>"))
    return rows.withColumn("_copy", copies).drop("_copy")


def class_quotas(rows: DataFrame, total: Column, factor: int = fixed.CORRECTION_BOOST) -> DataFrame:
    """``Label, boosted, quota``: other rows to add per class, at least one each.

    The counts are one small aggregate; the three quotas follow by arithmetic.
    """
    counts = rows.agg(
        *[(F.count_if(F.col("Label") == c) * factor).alias(f"b{c}") for c in (1, 2, 0)]
    ).select("*", total.cast("bigint").alias("total"))
    third = F.floor(F.col("total") / 3)
    shares = counts.withColumns({"q1": F.greatest(F.lit(1), third - F.col("b1")), "q2": F.greatest(F.lit(1), third - F.col("b2"))})
    rest = F.col("total") - F.col("q1") - F.col("q2") - F.col("b1") - F.col("b2") - F.col("b0")
    shares = shares.withColumn("q0", F.greatest(F.lit(1), rest))
    entries = [
        F.struct(F.lit(c).alias("Label"), F.col(f"b{c}").alias("boosted"), F.col(f"q{c}").alias("quota")) for c in (1, 2, 0)
    ]
    return shares.select(F.inline(F.array(*entries)))


def fill_quotas(pool: DataFrame, quotas: DataFrame, id_col: str, seed: int = SHUFFLE_SEED) -> DataFrame:
    """Pool rows picked in pseudo-random order up to their class's quota.

    The order is that of a hash of the id. Rows are counted by class and the first digits of the hash, 65,536 places, which gives
    the place in which a class's quota is reached; the rows of that place are put in order, which gives its last row. With these
    three rows at hand (one for each class), picking is a filter, and the pool is neither shuffled nor sorted.
    """
    wanted = {r["Label"]: r["quota"] for r in quotas.select("Label", "quota").collect()}
    key, label = shuffle_key(id_col, seed), F.col("Label")
    place = F.substring(key, 1, 4)
    counts = pool.filter(label.isin(list(wanted))).groupBy("Label", place.alias("_place")).agg(F.count(F.lit(1)).alias("_n"))
    upto = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy("Label").orderBy("_place")))
    reached = F.lit(False)
    for c, quota in wanted.items():
        reached = reached | ((label == c) & (F.col("_upto") >= quota))
    found = upto.filter(reached).groupBy("Label").agg(F.min(F.struct("_place", "_n", "_upto")).alias("_last")).select("Label", "_last.*").collect()
    near, left = F.lit(False), F.lit(0)
    for r in found:
        near = near | ((label == r["Label"]) & (place == r["_place"]))
        left = F.when(label == r["Label"], wanted[r["Label"]] - (r["_upto"] - r["_n"])).otherwise(left)
    in_place = pool.filter(near).select("Label", key.alias("_key"), F.col(id_col).alias("_id"))
    ranked = in_place.withColumn("_rank", F.row_number().over(Window.partitionBy("Label").orderBy("_key", "_id")))
    last = {r["Label"]: r for r in ranked.filter(F.col("_rank") == left).collect()} if found else {}
    whole = [c for c, quota in wanted.items() if quota > 0 and c not in last]  # fewer rows than the quota
    picked = label.isin(whole) if whole else F.lit(False)
    for c, r in last.items():
        picked = picked | ((label == c) & ((key < r["_key"]) | ((key == r["_key"]) & (F.col(id_col) <= r["_id"]))))
    rows = pool.filter(picked)
    # Rows that share the last id would all pass: then, and only then, they are numbered.
    tied = rows.filter(F.col(id_col).isin([r["_id"] for r in last.values()])).groupBy("Label", id_col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1") if last else None
    if tied is None or tied.isEmpty():
        return rows
    return sample_per_group(rows.join(F.broadcast(quotas.select("Label", "quota")), "Label"), "Label", id_col, F.col("quota"), seed).drop("quota")


def enhanced_dataset(
    corrections: DataFrame,
    pool: DataFrame,
    id_col: str,
    total: Column,
    factor: int = fixed.CORRECTION_BOOST,
    include_corrections: bool = True,
    seed: int = SHUFFLE_SEED,
) -> DataFrame:
    """Unused corrections, boosted, filled up with labelled lines to the class quotas.

    ``pool``: ``id_col, Log, Label``. A class with fewer lines than its quota gives all it has.
    """
    rows = training_rows(unused(corrections))
    if not include_corrections:
        rows = rows.filter(F.lit(False))
    picked = fill_quotas(pool, class_quotas(rows, total, factor), id_col, seed)
    filler = picked.select(
        F.col(id_col).cast("string").alias("ID"), asset_type(F.col("Log")).alias("Asset"), "Log", "Label",
        F.lit(fixed.FILLER_SOURCE).alias("Source"),
    )
    return filler.unionByName(boosted(rows, factor).select(*COLUMNS))


def dataset_metadata(dataset: DataFrame, factor: int, generated_at: str) -> DataFrame:
    """One row of real counts. The used record ids are a table of their own: ``used_ids``."""
    real = F.col("Source") == fixed.CORRECTION_SOURCE
    counts = dataset.agg(
        F.count(F.lit(1)).alias("total_logs"),
        F.count_if(~real).alias("filler_logs"),
        F.count_if(real).alias("correction_logs"),
        *[F.count_if(F.col("Label") == c).alias(name) for c, name in fixed.CLASS_NAMES_BY_ID.items()],
        *[F.count_if(real & (F.col("Label") == c)).alias(f"corrections_{name}") for c, name in fixed.CLASS_NAMES_BY_ID.items()],
    )
    used_count = F.floor(F.col("correction_logs") / F.lit(max(factor, 1)))
    return counts.select(
        F.lit(generated_at).alias("generation_timestamp"),
        "*",
        used_count.alias("corrections_used"),
        F.lit(factor).alias("correction_boost_factor"),
    )


def used_ids(dataset: DataFrame) -> DataFrame:
    real = dataset.filter(F.col("Source") == fixed.CORRECTION_SOURCE)
    return real.select(F.col("ID").alias("record_id")).distinct()


def save_dataset(dataset: DataFrame, metadata: DataFrame, path: str, seed: int = SHUFFLE_SEED) -> dict[str, str]:
    """Class folders, the shuffled whole, the metadata and the used ids below one new folder."""
    places = {name: f"{path}/{name}" for name in ("by_class", "combined", "metadata", "used_ids")}
    dataset.write.partitionBy("Label").option("header", True).option("escape", '"').csv(places["by_class"])
    key = F.concat_ws("|", "Source", "ID", "Log")
    order = shuffled(dataset.withColumn("_key", key), "_key", seed).drop("_key")
    order.write.option("header", True).option("escape", '"').csv(places["combined"])
    metadata.write.json(places["metadata"])
    used_ids(dataset).write.json(places["used_ids"])
    return places


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows of frames whose columns may differ."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def labelled_samples(lines: DataFrame, source: str, id_col: str, label: Column, n: int = 100) -> DataFrame:
    """The first ``n`` lines of each source as ``text, label``."""
    first = first_rows_per(lines.select(source, id_col, "line"), [source], [id_col], n)
    return first.select(source, id_col, F.col("line").alias("text"), label.alias("label"))
