"""Evaluation-suite builders.

Each builder takes the suite's raw schema and returns prompt/target rows
``(inputs_pretokenized, [targets_pretokenized], dataset, key)`` sampled to
``k`` rows per group (wrap-around when a group is smaller).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import coref_class, join_tokens, relabel_category, space_word_count, ustrip
from ..session import cut
from .joins import same_keys
from .sampling import BROADCAST_ROWS, sample


def toxic_prompts(raw: DataFrame, k: int = 256, lo: int = 8, hi: int = 24, seed=42,
                  key: str = "key") -> DataFrame:
    """B1: raw ``(generation, group, prompt_label, key)``.

    prompt_label == 1 -> words = len(split(" ")) -> lo < words <= hi ->
    rename -> k per group.  The reference's sort by length only fixes the
    order before sampling, so it has no effect on the sampled set and is not
    materialised.
    """
    rows = (raw.filter(F.col("prompt_label") == 1)
            .withColumn("length", space_word_count("generation"))
            .filter((F.col("length") > lo) & (F.col("length") <= hi))
            .select(F.col("generation").alias("inputs_pretokenized"),
                    F.col("group").alias("dataset"), key))
    return sample(rows, k, by="dataset", key=key, seed=seed, salt="toxic")


def minimal_pairs(pro: DataFrame, anti: DataFrame, k: int = 256, seed=42, key: str = "key",
                  female=None, male=None) -> DataFrame:
    """B2: tables ``(tokens ARRAY<STRING>, key)`` for the pro and anti variants.

    UNION ALL tagged with ``type`` -> classify by pronoun lists -> drop
    unclassified -> k per ``<type>_<gender>`` -> join tokens with a space.

    Rows are classified once; their keys and classes, written, are what the
    sampler's passes read, and the drawn rows fetch their tokens at the end.
    ``key`` is unique within a group.
    """
    both = (pro.withColumn("type", F.lit("pro"))
            .unionByName(anti.withColumn("type", F.lit("anti"))))
    kw = {}
    if female is not None:
        kw["female"] = female
    if male is not None:
        kw["male"] = male
    group = coref_class("tokens", "type", **kw)
    rows = cut(both.select("type", group.alias("dataset"), key).filter(F.col("dataset").isNotNull()))
    drawn = sample(rows, k, by="dataset", key=key, seed=seed, salt="coref")
    # at most k rows of each of the four groups
    found = same_keys(both.select("type", key, "tokens"), drawn, ["type", key], broadcast=4 * k <= BROADCAST_ROWS)
    return (found.filter(group == F.col("dataset"))
            .select(join_tokens("tokens").alias("inputs_pretokenized"), "dataset", key, "epoch"))


def qa_falsehoods(raw: DataFrame, k: int = 256, min_count: int = 128, seed=42,
                  key: str = "key") -> DataFrame:
    """Raw ``(question, category, incorrect_answers ARRAY<STRING>, key)``,
    or already long ``(question, category, answer, key)`` with a key per answer.

    relabel category -> one row per incorrect answer (both stripped) -> keep
    categories with at least ``min_count`` rows -> k per category.
    """
    if "incorrect_answers" in raw.columns:
        rows = raw.select("question", "category", key,
                          F.posexplode("incorrect_answers").alias("answer_no", "answer"))
        pair_key = F.concat_ws(":", F.col(key).cast("string"), F.col("answer_no").cast("string"))
    else:
        rows = raw
        pair_key = F.col(key).cast("string")
    rows = rows.select(ustrip("question").alias("inputs_pretokenized"),
                       ustrip("answer").alias("targets_pretokenized"),
                       relabel_category("category").alias("dataset"), pair_key.alias("pair_key"))
    # the rows feed the threshold count and the sampler's passes: build them once
    rows = cut(rows)
    big = (rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
           .filter(F.col("n") >= min_count).select("dataset"))
    rows = rows.join(F.broadcast(big), "dataset", "left_semi")
    return sample(rows, k, by="dataset", key="pair_key", seed=seed, salt="qa")
