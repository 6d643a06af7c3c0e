"""Secret scan through a ledger of blobs.

Every version of a path is content-addressed by the SHA-256 of its text. A ledger
in the shared folder holds two tables: ``scanned`` (blob, kind, version of the rule)
and ``findings`` (blob, kind, version, start, end). A run scans only the pairs of blob
and rule version that ``scanned`` lacks, each blob once however many paths hold it,
appends to both tables, and joins the findings back to all paths.

Only DataFrame functions are used. Places come from one ``regexp_replace`` per rule
that puts marks around each match; the lengths of the pieces between the marks,
summed up, are the places. Marks that stand in a text are replaced by another
control character before, which no rule can match, so lengths stay the same.

Defined cases: a null text is an empty one; empty texts have no findings; a null path
is a path of its own; repeated (path, text) rows give a row each; other columns of the
input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilog.llm.common import free_name, shared_path, stored

OUTER, INNER, OTHER = "\x01", "\x02", "\x03"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: two groups of a pattern, the least length of the second, and its version.

    The first group may be empty; a match is both groups together.
    """

    kind: str
    pattern: str
    least: int
    version: int = 1


# The kinds in their order.
# A run of [0-9a-f] or of AKIA[A-Z0-9] is matched whole or not at all, so their least length stands in the pattern.
RULES = (
    Rule("assign", r"""(?i)((?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 6),
    Rule("access", r"()(AKIA[A-Z0-9]{16,})", 20),
    Rule("hex", r"()([0-9a-f]{24,})", 24),
)


def blob_of(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def _marked(text: Column, rule: Rule) -> Column:
    return F.regexp_replace(text, rule.pattern, f"{OUTER}$1{INNER}$2{OUTER}")


def scan_texts(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob, kind, version, start, end`` for ``texts(blob, text, kinds)``; ``kinds`` are the rules due for a blob.

    Places are code points, the end is exclusive.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    clean = F.when(
        F.contains(text, F.lit(OUTER)) | F.contains(text, F.lit(INNER)), F.translate(text, OUTER + INNER, OTHER + OTHER)
    ).otherwise(text)
    each = [
        F.struct(
            F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(r.least).alias("least"),
            F.when(F.array_contains("kinds", r.kind), _marked(F.col("clean"), r)).alias("marked"),
        )
        for r in rules
    ]
    # The arrays' elements pass an explode, so that each pattern runs once and not again in the filter.
    marked = texts.select("blob", "kinds", F.explode(F.array(clean)).alias("clean")).select("blob", F.inline(F.array(*each)))
    pieces = marked.filter(F.contains("marked", F.lit(OUTER))).select(
        "blob", "kind", "version", "least",
        F.posexplode(F.transform(
            F.split("marked", OUTER, -1), lambda p: F.struct(F.length(p).alias("n"), F.instr(p, INNER).alias("cut"))
        )).alias("place", "piece"),
    ).select("blob", "kind", "version", "least", "place", "piece.n", "piece.cut")
    width = F.col("n") - F.when(F.col("cut") > 0, 1).otherwise(0)
    upto = F.sum(width.cast("bigint")).over(Window.partitionBy("blob", "kind", "version").orderBy("place"))
    found = pieces.withColumn("end", upto).filter((F.col("cut") > 0) & (F.col("n") - F.col("cut") >= F.col("least")))
    return found.select("blob", "kind", "version", (F.col("end") - (F.col("n") - 1)).alias("start"), "end")


SCANNED = "blob binary, kind string, version int"
FINDINGS = "blob binary, kind string, version int, start bigint, end bigint"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error.getCondition()):
            raise
        return None


def _append(rows: DataFrame, path: str) -> None:
    """Appends ``rows``, which are few and small, as a file for each core and not one for each partition of the shuffle before them."""
    rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism).write.mode("append").parquet(path)


def scan_versions(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``path, blob, spans`` for ``versions(path, text)``: ``spans`` is null or an array of (start, kind, end), sorted.

    ``ledger`` is a folder that may hold the tables of earlier runs. Findings are
    appended before the pairs count as scanned, so a run that breaks off is made up
    for by the next one, whose repeated findings are dropped in the join.
    """
    spark = versions.sparkSession
    addressed = versions.select("path", blob_of("text").alias("blob"))
    paths = stored(addressed, "paths")
    due = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules))
    # One path stands for each blob; least() of the ids needs no order of the rows.
    blobs = paths.groupBy("blob").agg(F.min(_key("path")).alias("key"))
    pairs = blobs.select("blob", "key", F.inline(due))
    before = _read(spark, f"{ledger}/scanned", SCANNED)
    if before is not None:
        pairs = pairs.join(before, ["blob", "kind", "version"], "left_anti")
    wanted = pairs.groupBy("blob", "key").agg(F.collect_set("kind").alias("kinds"))
    # A repeated row of the same path and text would be scanned twice; the distinct() below the join drops its findings.
    texts = versions.select(_key("path").alias("key"), blob_of("text").alias("blob"), "text").join(wanted, ["key", "blob"])
    _append(scan_texts(texts.select("blob", "text", "kinds"), rules), f"{ledger}/findings")
    _append(pairs.select("blob", "kind", "version"), f"{ledger}/scanned")

    now = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(i).alias("rank"))
                    for i, r in enumerate(rules)))
    current = spark.range(1).select(F.inline(now))  # one row per rule
    found = spark.read.schema(FINDINGS).parquet(f"{ledger}/findings").join(F.broadcast(current), ["kind", "version"]).distinct()
    spans = found.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind"))).alias("spans"))
    return paths.join(spans, "blob", "left")


def _equals(kind: str):
    return lambda k: k == F.lit(kind)


def _key(path: str) -> Column:
    return F.coalesce(F.concat(F.lit("p"), F.col(path).cast("string")), F.lit(""))


def secret_report(documents: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The digest of ``documents(doc_id, text)``: counts by kind, base spans and all spans, a row for each row."""
    ledger = ledger or shared_path(documents.sparkSession, "ledger")
    found = scan_versions(documents.select(F.col("doc_id").alias("path"), "text"), ledger, rules)
    spans = F.coalesce(F.col("spans"), F.expr("cast(array() as array<struct<start:bigint,rank:int,end:bigint,kind:string>>)"))
    joined = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    kinds = F.transform(spans, lambda s: s.kind)
    counts = [F.size(F.filter(kinds, _equals(r.kind))).cast("bigint").alias(f"n_{r.kind}") for r in rules]
    return found.select(
        F.col("path").alias("doc_id"), *counts, F.sha2(joined.cast("binary"), 256).alias("base_sha256"), joined.alias("spans")
    )


def redacted(documents: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``documents`` with every found span replaced by ``mark``; overlapping spans become one mark.

    ``n_chars``, where present, follows the new text. Rows without findings are unchanged.
    """
    ledger = shared_path(documents.sparkSession, "ledger")
    found = scan_versions(documents.select(F.col("doc_id").alias("path"), "text"), ledger)
    blob, marks, new_text = (free_name(documents, n) for n in ("_blob", "_spans", "_new"))
    hit = found.filter("spans IS NOT NULL").select(F.col("blob").alias(blob), F.col("spans").alias(marks)).dropDuplicates([blob])
    text, spans = F.col("text"), F.col(marks)
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("bigint").alias("upto"))

    def step(state, span):
        fresh = span.start >= state.upto
        between = F.substring(text, state.upto.cast("int") + 1, (span.start - state.upto).cast("int"))
        return F.struct(
            F.when(fresh, F.concat(state.done, between, F.lit(mark))).otherwise(state.done).alias("done"),
            F.greatest(state.upto, span.end).alias("upto"),
        )

    new = F.aggregate(
        spans, start, step, lambda s: F.concat(s.done, F.substring(text, s.upto.cast("int") + 1, F.length(text)))
    )
    joined = documents.withColumn(blob, blob_of("text")).join(hit, blob, "left")
    out = joined.withColumn(new_text, F.when(spans.isNotNull(), new).otherwise(text))
    columns = []
    for name in documents.columns:
        if name == "text":
            columns.append(F.col(new_text).alias("text"))
        elif name == "n_chars":
            kind = documents.schema["n_chars"].dataType
            columns.append(F.when(spans.isNotNull(), F.length(new_text)).otherwise(F.col("n_chars")).cast(kind).alias("n_chars"))
        else:
            columns.append(F.col(f"`{name}`"))
    return out.select(*columns)
