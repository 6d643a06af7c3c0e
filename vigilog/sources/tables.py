"""Tables and the log views derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.functions.text import is_filled, strip

MOST_SPREAD = 32
TASKS_A_CORE = 2
SPLITS_A_CORE = 4


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))


def spread(df: DataFrame, most: int = MOST_SPREAD) -> DataFrame:
    """A table in fewer files or splits than cores is dealt out over the cores.

    Spark cuts a file by bytes, but a row group is read by one task whatever the cuts, so a file can be the work of one core, on a
    cluster as in a local session, and regexes over it would leave the others idle. A table in many files, or in more splits than
    a few a core, is read as it is.
    """
    context = df.sparkSession.sparkContext
    cores, local = context.defaultParallelism, context.master.startswith("local[")
    cores, wanted = (min(cores, most),) * 2 if local else (cores, TASKS_A_CORE * cores)
    splits = df.rdd.getNumPartitions()
    few = splits < cores or (splits < SPLITS_A_CORE * cores and len(df.inputFiles()) < cores)
    return df.repartition(wanted) if few else df


def spread_stream(df: DataFrame) -> DataFrame:
    """A stream whose files may be fewer than the cores, dealt out over them; how many files a batch has is not known before."""
    return df.repartition(TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism)


AUTH_LINE = """
  concat(substring(cast(ts AS string), 1, 19), ' host-', event_id % 7, ' ', CASE
    WHEN event_type = 'error' AND event_id % 3 = 0 THEN concat(
      'sshd[', event_id % 60000 + 1000, ']: ERROR authentication failed; failed login for user=user', user_id,
      ' from 10.0.', user_id % 4, '.', user_id % 250 + 1)
    WHEN event_type = 'error' THEN concat(
      'sshd[', event_id % 60000 + 1000, ']: Failed password login for user=user', user_id,
      ' from 10.0.', user_id % 4, '.', user_id % 250 + 1, ' port 22 ssh2')
    WHEN event_type = 'signup' THEN concat(
      'sshd[', event_id % 60000 + 1000, ']: Successful login INFO for user=user', user_id,
      ' from 10.0.', user_id % 4, '.', user_id % 250 + 1, ' port 22 ssh2')
    WHEN event_type = 'purchase' THEN concat(
      'postgres[', event_id % 60000 + 1000, ']: LOG:  connection authorized: user=user', user_id,
      ' database=prod session_id=s', event_id)
    WHEN event_type = 'click' THEN concat(
      'apache2[', event_id % 60000 + 1000, ']: 10.0.', user_id % 4, '.', user_id % 250 + 1, ' GET /index.html',
      CASE WHEN event_id % 11 = 0 THEN ' union select' ELSE '' END,
      CASE WHEN event_id % 13 = 0 THEN ' <script>' ELSE '' END)
    ELSE 'kernel: WARN eth0 state change on web-prod-01' END)
"""


def auth_lines(events: DataFrame) -> DataFrame:
    """``line_id, ts, user_id, event_type, source, line`` from the events table.

    A line is written by sshd, postgres, apache2 or the kernel, by event type. Only
    the four columns used are read. ``ts`` stays a time without zone, so no result
    depends on the session time zone. The line comes out of a one-element
    ``explode``: filters on it then read it like a stored column, where otherwise
    each of them would build the text again.
    """
    return events.selectExpr(
        "event_id AS line_id",
        "ts",
        "user_id",
        "event_type",
        "concat('host-', event_id % 7) AS source",
        f"explode(array({AUTH_LINE})) AS line",
    )


def document_lines(documents: DataFrame) -> DataFrame:
    """``line_id, source, line``: the non-blank lines of every document, whole.

    The id is a struct of the document's id and the line's place, so no number of documents or lines runs into another.
    """
    lines = documents.select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"))
    return lines.filter(is_filled(F.col("raw"))).select(
        F.struct("doc_id", "pos").alias("line_id"),
        "source",
        strip(F.col("raw")).alias("line"),
    )


def turn_pairs(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, first, second``: each turn with the next one of its conversation.

    An equi join on the unique (conversation, turn) key spreads even one huge
    conversation over all tasks, which a window over conversations would not.
    """
    mine = conversations.select("conv_id", "turn", F.col("text").alias("first"))
    following = conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("second"))
    return mine.join(following, ["conv_id", "turn"])


def derived_corrections(labels: DataFrame, documents: DataFrame) -> DataFrame:
    """Analyst corrections derived from labelled documents, in the stored record's shape.

    Some records lack the id, the used flag or the corrected label, as stored ones do.
    """
    doc = F.col("doc_id")
    original = F.struct(
        F.when(F.col("quality") == 1, "Successful login").otherwise("Failed login").alias("label"),
        ((F.col("n_chars") % 1000) / 1000).alias("confidence"),
    )
    corrected = (
        F.when(doc % 13 == 0, F.lit(None).cast("string"))
        .when(doc % 7 == 0, "Failed login")
        .when(F.col("toxic") == 1, "failed_login")
        .when(F.col("quality") == 1, "successful_login")
        .otherwise("other_login")
    )
    stamp = F.concat(
        F.lit("2025-06-"), F.lpad((doc % 28 + 1).cast("string"), 2, "0"), F.lit(" 12:"),
        F.lpad((doc % 60).cast("string"), 2, "0"), F.lit(":00.000000"),
    )
    return labels.join(documents.select("doc_id", "text", "n_chars"), "doc_id").select(
        "doc_id",
        F.col("text").alias("log_text"),
        original.alias("original_prediction"),
        F.struct(corrected.alias("label"), F.lit(1.0).alias("confidence")).alias("user_correction"),
        stamp.alias("timestamp"),
        F.when(doc % 5 != 0, F.substring(F.md5(doc.cast("string").cast("binary")), 1, 12)).alias("record_id"),
        F.when(doc % 5 != 0, doc % 3 == 0).alias("used_for_training"),
        F.lit(None).cast("string").alias("training_timestamp"),
    )
