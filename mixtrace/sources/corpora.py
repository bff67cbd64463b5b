"""Mapping of the driver tables onto the engine's datasets (FIXTURES.md §3).

* training datasets: ``documents`` grouped by ``source`` (one dataset per source)
* evaluation datasets: ``bench`` = ``benchmark``; ``toxic`` = documents whose
  label says toxic = 1
All rows carry ``(dataset, row_id, text)``; ``row_id`` is the stable key that
replaces the reference's positional row identity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import small_enough
from .tables import table


def train_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("dataset"), F.col("doc_id").alias("row_id"), "text")


def toxic_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels").filter(F.col("toxic") == 1).select("doc_id")
    lab = F.broadcast(lab) if small_enough(lab, 1_000_000) else lab  # else the texts are shuffled
    return (d.join(lab, "doc_id", "left_semi")
            .select(F.lit("toxic").alias("dataset"), F.col("doc_id").alias("row_id"), "text"))


def bench_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.lit("bench").alias("dataset"), F.col("item_id").alias("row_id"), "text")


def eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bench_rows(spark, sf_dir).unionByName(toxic_rows(spark, sf_dir))


def toxic_prompt_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1 input: one ``generation`` per document line, ``group`` = language,
    ``prompt_label`` = the document's toxic label (NULL when unlabelled)."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("prompt_label"))
    labelled = d.select("doc_id", "lang", "text").join(lab, "doc_id", "left")
    lines = labelled.select("doc_id", F.col("lang").alias("group"), "prompt_label",
                            F.posexplode(F.split("text", "\n")).alias("line_no", "generation"))
    return (lines.withColumn("key", F.concat_ws(":", F.col("doc_id").cast("string"),
                                           F.col("line_no").cast("string"))))


def minimal_pair_raw(spark: SparkSession, sf_dir: str):
    """B2 inputs: document lines as space-split token lists; even ``doc_id`` ->
    pro table, odd -> anti table."""
    d = table(spark, sf_dir, "documents")
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    rows = lines.select("doc_id", F.split("line", " ").alias("tokens"),
                        F.concat_ws(":", F.col("doc_id").cast("string"),
                                    F.col("line_no").cast("string")).alias("key"))
    pro = rows.filter(F.col("doc_id") % 2 == 0).select("tokens", "key")
    anti = rows.filter(F.col("doc_id") % 2 == 1).select("tokens", "key")
    return pro, anti


# The Q/A categories assigned by conv_id mod 5, in order.
QA_CATEGORIES = ["Indexical Error: Time", "Confusion: People", "Misconceptions", "Law", "Health"]


def qa_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B3 input in long form: one row per (question, incorrect answer).

    Each user turn is a question; its answers are the assistant turns that
    follow it up to the next user turn.  The owning question of a turn is a
    distributed running max of user-turn numbers (no per-conversation task)
    over the narrow columns; texts are joined after, and no per-question list
    is collected.  ``key`` = conv:question turn:answer turn.
    """
    from ..operators.ordinal import running_max
    c = table(spark, sf_dir, "conversations")
    tagged = running_max(c.select("conv_id", "turn", "role"), "conv_id", ["turn"],
                         F.when(F.col("role") == "user", F.col("turn")), "q_turn")
    owners = (tagged.filter((F.col("role") == "assistant") & F.col("q_turn").isNotNull())
              .select("conv_id", "q_turn", "turn").distinct())
    answers = (c.filter(F.col("role") == "assistant").join(owners, ["conv_id", "turn"])
               .select("conv_id", "q_turn", F.col("turn").alias("a_turn"), F.col("text").alias("answer")))
    qs = c.filter(F.col("role") == "user").select("conv_id", F.col("turn").alias("q_turn"),
                                                   F.col("text").alias("question"))
    cat = F.element_at(F.array(*[F.lit(x) for x in QA_CATEGORIES]),
                       (F.col("conv_id") % len(QA_CATEGORIES)).cast("int") + 1)
    return (qs.join(answers, ["conv_id", "q_turn"])
            .select("question", cat.alias("category"), "answer",
                    F.concat_ws(":", F.col("conv_id").cast("string"), F.col("q_turn").cast("string"),
                                F.col("a_turn").cast("string")).alias("key")))
