"""Run keys and snapshots.

A run's output folder name is derived from its argument string; here it is a
column expression over a ``runs`` manifest, so thousands of runs are keyed in
one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import col, ustrip

# Arguments left out of a run key (matched at the start of an
# argument), in the reference's order; "logging_strategy" is listed twice there.
DROP_ARGS = [
    "do_train", "do_eval", "generation_max_length", "per_device_eval_batch_size",
    "logging_steps", "logging_strategy", "save_steps", "save_strategy", "eval_steps",
    "evaluation_strategy", "max_steps", "num_train_epochs", "log_level", "logging_strategy",
    "metric", "predict_with_generate", "save_arnoldi", "overwrite_output_dir",
]

# Abbreviations applied to the whole key, in this order.
ABBREVIATIONS = [
    ("train_adapter", "adapter"),
    ("per_device_train_batch_size", "train_batch"),
    ("gradient_accumulation_steps", "accumul"),
    ("train_dir", "train"),
    ("retain_dir", "retain"),
    ("learning_rate", "lr"),
    ("warmup_steps", "warmup"),
]


def run_key(argv) -> Column:
    """Argv string -> run key.

    split on "--" and drop the head; keep the text after the last "/"; drop
    arguments starting with a listed name; strip, spaces -> "=", remove
    "model="; join with "-"; then apply the abbreviations to the whole key.
    """
    parts = F.split(ustrip(col(argv)), "--")
    parts = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    parts = F.transform(parts, lambda p: F.when(p.contains("/"), F.element_at(F.split(p, "/"), -1))
                        .otherwise(p))
    pattern = "^(" + "|".join(DROP_ARGS) + ")"
    parts = F.filter(parts, lambda p: ~p.rlike(pattern))
    parts = F.transform(parts, lambda p: F.replace(F.replace(ustrip(p), F.lit(" "), F.lit("=")),
                                                   F.lit("model="), F.lit("")))
    key = F.array_join(parts, "-")
    for arg, abbr in ABBREVIATIONS:
        key = F.replace(key, F.lit(arg), F.lit(abbr))
    return key


def run_folders(runs: DataFrame, template: str = "{}", value: str = "run_id", run_id: str = "run_id") -> DataFrame:
    """R2: manifest -> (run_id, folder): the path format with every ``{}`` filled
    by the column ``value`` (a dataset name, or a ``run_key``).

    A format without ``{}`` names one folder that all runs read."""
    pieces = template.split("{}")
    parts = [F.lit(pieces[0])]
    for piece in pieces[1:]:
        parts += [col(value).cast("string"), F.lit(piece)]
    return runs.select(col(run_id).cast("string").alias("run_id"), F.concat(*parts).alias("folder"))


def save_snapshot(params: DataFrame, path: str, step: int) -> None:
    """Parameters of every run at ``step``, partitioned for pruning on read."""
    (params.withColumn("step", F.lit(step).cast("long"))
     .write.mode("append").partitionBy("run_id", "step").parquet(path))


def load_snapshot(spark, path: str, step: int) -> DataFrame:
    """Read one step of a snapshot back (partition pruning on ``step``).  Run
    ids are text: the folder ``run_id=01`` is not the run 1."""
    schema = spark.read.parquet(path).schema
    for f in schema.fields:
        f.dataType = T.StringType() if f.name == "run_id" else T.LongType() if f.name == "step" else f.dataType
    return spark.read.schema(schema).parquet(path).filter(F.col("step") == step).drop("step")
