"""M-LR: logistic regression over hashed bag-of-token features.

The conditional-model analogue of the prompt->target pairs: ``p(y | text)``
with binary features "bucket f occurs in row i" (md5 buckets of the word
tokens, plus a bias feature).  A row holds its features as one array ``fs``;
parameters are ``(run_id, f, theta)`` for all runs at once, ``buckets + 1``
rows a run.  Per gradient step:

    z_i = sum_f theta[f]     (a higher-order function over ``fs`` and the
                              run's parameters as an array: rows don't move)
    e_i = sigmoid(z_i) - y_i
    g_f = mean_i e_i         (features exploded into an aggregate by
                              (run, f) with map-side partial sums: the only
                              shuffle of a step, runs x buckets rows a task)

Parameter arrays are broadcast up to ``BROADCAST_CELLS`` values, joined beyond.
Where every run meets every row (evaluation, leave-one-out) the runs come in
chunks of ``RUNS_PER_CHUNK`` arrays; the (row, run) pairs stream into the
partial aggregate and are never stored or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.text import word_tokens
from ...session import cut
from ..tokens import hashed_ids

BUCKETS = 1024
RUNS_PER_CHUNK = 64
BROADCAST_CELLS = 8_000_000


def features(rows: DataFrame, keys: list[str], text: str = "text",
             buckets: int = BUCKETS) -> DataFrame:
    """(keys..., fs ARRAY<INT>): distinct hashed token buckets and the bias
    f = buckets; a NULL or empty text has the bias only."""
    ids = F.coalesce(hashed_ids(word_tokens(text), buckets, offset=0), F.array().cast("array<int>"))
    return rows.select(*keys, F.array_union(ids, F.array(F.lit(buckets))).alias("fs"))


def _sigmoid(z):
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _logloss(z, y):
    # -[y log s(z) + (1-y) log(1-s(z))] = log(1 + e^z) - y z, in a stable form
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - y * z


def _z(theta: Column) -> Column:
    return F.aggregate("fs", F.lit(0.0), lambda acc, f: acc + F.get(theta, f))


def _arrays(params: DataFrame) -> DataFrame:
    """(run_id, _th): each run's parameters as an array indexed by f."""
    return params.groupBy("run_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("f", "theta"))), lambda s: s["theta"]).alias("_th"))


def _checked(side: DataFrame, params: DataFrame) -> DataFrame:
    return F.broadcast(side) if params.count() <= BROADCAST_CELLS else side


def _own_run(rows: DataFrame, params: DataFrame) -> DataFrame:
    """``rows (run_id, ...)`` + z under the row's own run."""
    return rows.join(_checked(_arrays(params), params), "run_id").withColumn("z", _z(F.col("_th"))).drop("_th")


def _every_run(rows: DataFrame, params: DataFrame) -> DataFrame:
    """``rows`` + (run_id, z) for every run."""
    runs = params.select("run_id").distinct().count()
    n = max(1, -(-runs // RUNS_PER_CHUNK))
    chunks = (_arrays(params).groupBy(F.pmod(F.hash("run_id"), F.lit(n)).alias("_c"))
              .agg(F.collect_list(F.struct("run_id", "_th")).alias("_runs")))
    scores = F.transform("_runs", lambda r: F.struct(r["run_id"].alias("run_id"), _z(r["_th"]).alias("z")))
    return (rows.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
            .join(_checked(chunks, params), "_c")
            .select(*rows.columns, F.explode(scores).alias("_s")).select(*rows.columns, "_s.*"))


def _stepped(params: DataFrame, scored: DataFrame, sizes: DataFrame, lr: float) -> DataFrame:
    """Parameters after one full-batch step along ``lr`` x the mean gradient of
    ``scored (run_id, fs, y, z)``; ``sizes (run_id, n)`` are the runs' row counts."""
    g = (scored.select("run_id", (_sigmoid(F.col("z")) - F.col("y")).alias("e"), F.explode("fs").alias("f"))
         .groupBy("run_id", "f").agg(F.sum("e").alias("g")))
    return cut(params.join(g, ["run_id", "f"], "left").join(sizes, "run_id")
               .select("run_id", "f", (F.col("theta") + lr * F.coalesce(F.col("g"), F.lit(0.0)) / F.col("n"))
                       .alias("theta")))


def _zeros(runs: DataFrame, buckets: int) -> DataFrame:
    return cut(runs.select("run_id", F.explode(F.sequence(F.lit(0), F.lit(buckets))).alias("f"),
                           F.lit(0.0).alias("theta")))


def fit(X: DataFrame, steps: int, lr: float, buckets: int = BUCKETS) -> DataFrame:
    """Full-batch gradient descent from theta = 0 on ``X (fs, y)``: (f, theta),
    every bucket and the bias."""
    X = X.select(F.lit("full").alias("run_id"), "fs", "y")
    sizes = cut(X.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")))
    params = _zeros(sizes, buckets)
    for _ in range(steps):
        params = _stepped(params, _own_run(X, params), sizes, -lr)
    return params.select("f", "theta")


def run_losses(Xe: DataFrame, params: DataFrame) -> DataFrame:
    """(run_id, eval_dataset, loss): mean log-loss of every run on every set of
    ``Xe (eval_dataset, fs, y)``."""
    return (_every_run(Xe.select("eval_dataset", "fs", "y"), params)
            .groupBy("run_id", "eval_dataset").agg(F.avg(_logloss(F.col("z"), F.col("y"))).alias("loss")))


def _base_losses(Xe: DataFrame, theta: DataFrame) -> DataFrame:
    return cut(run_losses(Xe, theta.withColumn("run_id", F.lit("full")))
               .select("eval_dataset", F.col("loss").alias("_l0")))


def unlearn_influence(Xt: DataFrame, Xe: DataFrame, theta0: DataFrame, steps: int, lr: float,
                      buckets: int = BUCKETS) -> DataFrame:
    """Forward unlearning of the classifier: (train_dataset, eval_dataset, step, influence).

    ``Xt (dataset, fs, y)``, ``Xe (eval_dataset, fs, y)``; each run d takes
    ``steps`` full-batch ascent steps on d's rows from ``theta0 (f, theta)``.
    """
    Xt = Xt.select(F.col("dataset").alias("run_id"), "fs", "y")
    sizes = cut(Xt.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")))
    params = cut(sizes.select("run_id", F.explode(F.sequence(F.lit(0), F.lit(buckets))).alias("f"))
                 .join(theta0, "f"))
    base = _base_losses(Xe, theta0)
    outs = []
    for t in range(1, steps + 1):
        params = _stepped(params, _own_run(Xt, params), sizes, lr)
        outs.append(cut(run_losses(Xe, params).join(F.broadcast(base), "eval_dataset")
                        .select(F.col("run_id").alias("train_dataset"), "eval_dataset",
                                F.lit(t).cast("long").alias("step"),
                                (F.col("loss") - F.col("_l0")).alias("influence"))))
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return out


def influence_loo(Xt: DataFrame, Xe: DataFrame, steps: int, lr: float,
                  buckets: int = BUCKETS) -> DataFrame:
    """Leave-one-dataset-out by refitting: (train_dataset, eval_dataset, influence).

    Run d is fitted like ``fit`` on all rows of ``Xt (dataset, fs, y)`` but
    those of d, all runs in one job a step; the influence is its loss minus
    that of the fit on all rows.  A run left without rows stays at zero.
    """
    Xt = Xt.select("dataset", "fs", "y")
    per = Xt.groupBy("dataset").agg(F.count(F.lit(1)).alias("_n"))
    per = cut(per.filter(F.col("dataset").isNotNull()).withColumnRenamed("dataset", "run_id"))
    n = Xt.count()
    sizes = cut(per.select("run_id", F.greatest(F.lit(n) - F.col("_n"), F.lit(1)).alias("n")))
    params = _zeros(sizes, buckets)
    for _ in range(steps):
        others = _every_run(Xt, params).filter(~F.col("dataset").eqNullSafe(F.col("run_id")))
        params = _stepped(params, others, sizes, -lr)
    base = _base_losses(Xe, fit(Xt, steps, lr, buckets))
    return (run_losses(Xe, params).join(F.broadcast(base), "eval_dataset")
            .select(F.col("run_id").alias("train_dataset"), "eval_dataset",
                    (F.col("loss") - F.col("_l0")).alias("influence")))
