"""Task-grouped batches, batch shuffling and the evaluation schedule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import md5_key
from ..session import cut
from .joins import same_keys
from .models.lm import BROADCAST_ROWS
from .ordinal import dense_ordinal

# Extra evaluation steps of the denser schedule.
DENSE_EVAL_STEPS = [1, 50, 100, 200]


def task_batches(df: DataFrame, batch_size: int = 8, by: str = "dataset",
                 order: str = "row_id") -> DataFrame:
    """Batches never mix datasets; datasets in first-appearance order, rows
    in ``order``; the last partial batch of a dataset is kept; ``batch_id`` is
    global.  Adds ``batch_id`` and ``pos`` (position in batch).  Rows of a NULL
    dataset are a dataset too.

    Per-row work is the distributed ordinal; the batch offsets are an
    exclusive prefix sum over one row per dataset.
    """
    o = dense_ordinal(df, by, [order], name="_ord")
    per = (df.groupBy(by).agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n"))
           .withColumn("_nb", F.ceil(F.col("_n") / batch_size).cast("long")))
    w = Window.orderBy("_first", by)  # one row per dataset
    per = cut(per.withColumn("_off", F.sum("_nb").over(w) - F.col("_nb")).select(by, "_off"))
    return (same_keys(o, per, by, broadcast=BROADCAST_ROWS)
            .withColumn("batch_id", (F.col("_off") + F.floor(F.col("_ord") / batch_size)).cast("long"))
            .withColumn("pos", (F.col("_ord") % batch_size).cast("long"))
            .drop("_off", "_ord"))


def shuffle_batches(batched: DataFrame, seed=42, salt: str = "batches") -> DataFrame:
    """Permute whole batches (never rows inside a batch) by md5(seed:batch_id)."""
    ids = batched.select("batch_id").distinct().withColumn("_h", md5_key(F.lit(f"{seed}{salt}"), "batch_id"))
    ranked = dense_ordinal(ids, None, ["_h", "batch_id"], name="new_batch_id")
    return (batched.join(ranked.select("batch_id", "new_batch_id"), "batch_id")
            .withColumnRenamed("batch_id", "orig_batch_id")
            .withColumnRenamed("new_batch_id", "batch_id"))


def eval_schedule(steps: DataFrame, eval_steps: int, denser: bool = False,
                  extra: list[int] = DENSE_EVAL_STEPS) -> DataFrame:
    """Keep steps where ``step % eval_steps == 0`` (or a denser extra step)."""
    cond = (F.col("step") % eval_steps) == 0
    if denser:
        cond = cond | F.col("step").isin(list(extra))
    return steps.filter(cond)


#: Steps that one row of ``run_steps`` generates.
STEP_CHUNK = 65_536


def run_steps(spark: SparkSession, per_run: DataFrame, run: str = "run_id",
              n: str = "n_steps") -> DataFrame:
    """(run, step) for step = 1..n_steps of each run (none when n_steps < 1).

    Steps are generated in chunks of ``STEP_CHUNK``, spread over the tasks, so
    no row holds an array as long as a run.
    """
    last = F.floor((F.col(n) - 1) / STEP_CHUNK)
    chunks = (per_run.filter(F.col(n) >= 1)
              .select(run, n, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_k"))
              .repartition(run, "_k"))
    first = F.col("_k") * STEP_CHUNK
    return chunks.select(run, F.explode(F.sequence(first + 1, F.least(first + STEP_CHUNK, F.col(n)))).alias("step"))
