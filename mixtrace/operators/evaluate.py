"""Evaluation aggregates (E2-E7, E10) and external scorers.

A losses table is ``(dataset, batch_id, row_id, nll, n_tok)`` - summed NLL and
token count of each example.  Everything downstream is an aggregate of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .models.lm import join_checked
from .ordinal import dense_ordinal


def batch_loss(losses: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean NLL over the non-ignored tokens of each batch (+ batch row count)."""
    keys = keys or []
    return (losses.groupBy(*keys, "dataset", "batch_id")
            .agg((F.sum("nll") / F.sum("n_tok")).alias("loss"),
                 F.count(F.lit(1)).alias("n_rows"),
                 F.sum("n_tok").cast("long").alias("n_tok")))


def eval_loss(losses: DataFrame, weighting: str = "batch", keys: list[str] | None = None) -> DataFrame:
    """Per-dataset and overall loss (overall row has dataset NULL).

    ``batch``: each batch loss repeated once per example, then averaged, i.e.
    ``sum_b n_b L_b / sum_b n_b``; ``example``: mean of per-example token
    means; ``token``: ``sum nll / sum n_tok``.
    """
    keys = keys or []
    if weighting == "batch":
        b = batch_loss(losses, keys)
        num, den = F.sum(F.col("loss") * F.col("n_rows")), F.sum("n_rows")
        src = b
    elif weighting == "example":
        src = losses.withColumn("_l", F.col("nll") / F.col("n_tok"))
        num, den = F.sum("_l"), F.count(F.lit(1))
    elif weighting == "token":
        src = losses
        num, den = F.sum("nll"), F.sum("n_tok")
    else:
        raise ValueError(weighting)
    if not keys:
        return src.rollup("dataset").agg((num / den).alias("loss"))
    per = src.groupBy(*keys, "dataset").agg((num / den).alias("loss"))
    overall = src.groupBy(*keys).agg((num / den).alias("loss")) \
        .withColumn("dataset", F.lit(None).cast("string"))
    return per.unionByName(overall)


def metric_name(prefix: str = "eval") -> F.Column:
    """``eval_loss`` for the overall row, ``eval_loss_<dataset>`` otherwise."""
    return F.when(F.col("dataset").isNull(), F.lit(f"{prefix}_loss")) \
        .otherwise(F.concat(F.lit(f"{prefix}_loss_"), F.col("dataset")))


def eval_log_wide(long: DataFrame, names: list[str], keys: list[str] | None = None) -> DataFrame:
    """Long (keys, metric, value) -> one column per metric, explicit sorted names."""
    keys = keys or []
    g = long.groupBy(*keys) if keys else long.groupBy()
    return g.pivot("metric", sorted(names)).agg(F.first("value"))


def sample_counts(n_rows: DataFrame, max_col: str = "max_samples") -> DataFrame:
    """``samples = min(max_samples, len)`` (no maximum -> len)."""
    return n_rows.withColumn("samples", F.least(F.col("n_rows"), F.coalesce(F.col(max_col), F.col("n_rows"))))


def with_metrics(losses: DataFrame, metrics: list[Column], by: str = "dataset",
                 partial: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
                 schema: str | None = None) -> DataFrame:
    """Optional metrics hook, one row of ``metrics`` (aggregates) per set.

    A Python metric is given as ``partial``: it maps one Arrow batch of rows to
    a few partial rows of ``schema`` (``by`` among them), which ``metrics`` then
    merge.  So no task ever holds an evaluation set, whatever its size.
    """
    if partial is not None:
        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                yield partial(pdf)
        losses = losses.mapInPandas(run, schema)
    return losses.groupBy(by).agg(*metrics)


def exact_median(losses: DataFrame, value: Column, by: str = "dataset", key: str = "row_id",
                 name: str = "median") -> DataFrame:
    """(by, name): the exact median of ``value`` per set, NULLs ignored.

    The middle rows are found by their distributed ordinal, so a set holding
    most rows is never sorted or collected in one task.
    """
    v = losses.select(by, key, value.alias("_v")).filter(F.col("_v").isNotNull())
    o = dense_ordinal(v, by, ["_v", key], name="_ord")
    n = v.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    mid = join_checked(o, n, by).filter(
        (F.col("_ord") == F.floor((F.col("_n") - 1) / 2)) | (F.col("_ord") == F.floor(F.col("_n") / 2)))
    return mid.groupBy(by).agg(F.avg("_v").alias(name))


def external_scorer(rows: DataFrame, load_model: Callable[[], Callable[[pd.DataFrame], pd.Series]],
                    out_col: str = "nll") -> DataFrame:
    """Score rows with a user model via Arrow batches.

    ``load_model`` runs once per partition (e.g. loads weights); the returned
    callable maps a pandas frame to one value per row.
    """
    # a new StructType: .add() would mutate the DataFrame's cached schema
    schema = T.StructType(list(rows.schema.fields) + [T.StructField(out_col, T.DoubleType())])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model()
        for pdf in it:
            yield pdf.assign(**{out_col: model(pdf).astype("float64").values})

    return rows.mapInPandas(run, schema)
