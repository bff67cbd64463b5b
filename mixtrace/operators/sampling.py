"""Sampling and mixture composition.

Uniform sampling without replacement of exactly ``k`` rows per group, with
wrap-around when ``k > N``: every row appears ``k div N`` times, and the
remaining ``k mod N`` rows are the first of one more random permutation.
That is the behaviour of a random sampler asked for more samples than rows.

The permutation is stateless: the order key is ``md5(seed:group:epoch:key)``,
so a sample is reproducible, independent of partitioning, and can be written
in SQL.  A different ``salt`` per call site replaces a shared generator.

Plan shape: group sizes are one aggregate (a row per group, materialised
once and broadcast).  The last, partial epoch is known by its last order key:
ranking runs on the narrow key columns only - a per-partition top-k before the
shuffle when ``k`` is small, the distributed ordinal otherwise - and leaves
one row per group.  The rows themselves are never shuffled: where they are
read, each compares its order key with its group's last one and is emitted
once per epoch it is drawn in.  ``key`` is unique within a group.  Rows whose
group is NULL (or NULL in a column of it) are a group of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import md5_key
from ..session import cut, shuffle_width
from .joins import same_keys
from .models.lm import BROADCAST_ROWS
from .ordinal import dense_ordinal

# The windowed top-k keeps at most r narrow rows per group and input partition
# before the shuffle, so the final sort of one group sees up to
# partitions x r rows; beyond this budget the distributed ordinal is used.
WINDOW_TOPK_ROWS = 2_000_000


def _by(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def order_key(seed, salt: str, by: list[str], epoch, key: str) -> Column:
    return md5_key(F.lit(f"{seed}{salt}"), *by, epoch, key)


def sample(df: DataFrame, k, by="dataset", key: str = "doc_id", seed=42, salt: str = "",
           method: str = "auto") -> DataFrame:
    """M1/M2/M4: exactly ``k`` rows per group (wrap-around when k > N).

    ``k`` is an int (same for all groups) or a DataFrame ``(by..., k)``; groups
    missing from it are dropped.  Adds ``epoch`` (0 for the first pass).
    Empty groups produce nothing.
    """
    by = _by(by)
    cols = df.columns
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    if isinstance(k, int):
        spec = n.withColumn("_k", F.lit(k).cast("long"))
    else:
        spec = same_keys(n, k.select(*by, F.col("k").cast("long").alias("_k")), by)
    # one row per group, materialised once: every step below reads it instead
    # of re-aggregating the input
    spec = cut(spec.withColumn("_q", F.floor(F.col("_k") / F.col("_n")).cast("long"))
               .withColumn("_r", (F.col("_k") % F.col("_n")).cast("long"))
               .select(*by, "_q", "_r"))
    # order key of the partial epoch, whose number is the count of full ones
    pos = F.struct(order_key(seed, salt, by, F.col("_q"), key).alias("_h"), F.col(key).alias("_id"))
    r_max = spec.agg(F.max("_r")).first()[0] or 0
    drawn = F.lit(0)
    if r_max > 0:
        part = (same_keys(df.select(*dict.fromkeys([*by, key])), spec, by, broadcast=BROADCAST_ROWS)
                .filter(F.col("_r") > 0).select(*by, "_r", pos.alias("_pos")))
        if method == "window" or (method == "auto" and r_max * shuffle_width(part) <= WINDOW_TOPK_ROWS):
            w = Window.partitionBy(*by).orderBy("_pos")
            # literal bound first: Catalyst plans a partial top-k before the shuffle
            last = (part.withColumn("_rn", F.row_number().over(w))
                    .filter(F.col("_rn") <= F.lit(int(r_max)))
                    .filter(F.col("_rn") == F.col("_r")))
        else:
            last = (dense_ordinal(part, by, ["_pos"], name="_rn")
                    .filter(F.col("_rn") == F.col("_r") - 1))
        spec = cut(same_keys(spec, last.select(*by, F.col("_pos").alias("_last")), by, "left"))
        drawn = F.when(pos <= F.col("_last"), 1).otherwise(0)
    times = F.col("_q") + drawn
    return (same_keys(df, spec, by, broadcast=BROADCAST_ROWS).filter(times > 0)
            .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
            .select(*cols, "epoch"))


def sample_rows(df: DataFrame, k: int, key: str, seed=42, salt: str = "",
                method: str = "auto") -> DataFrame:
    """M6: ``max_train_samples`` / ``max_eval_samples``: k over the whole table.

    The whole table is one group (named ``all`` in the order key): its size is
    one count, so the epochs are literals and no spec table is joined.  The
    last order key of the partial epoch comes from the narrow keys - a
    per-partition top-r before the merge when r is small, the distributed
    ordinal otherwise - and the rows are compared with it where they are read.
    """
    cols = df.columns
    n = df.count()
    if n == 0 or k <= 0:
        return df.withColumn("epoch", F.lit(0).cast("long")).filter(F.lit(False))
    q, r = divmod(int(k), n)
    times = F.lit(q).cast("long")
    if r > 0:
        pos = F.struct(md5_key(F.lit(f"{seed}{salt}"), F.lit("all"), F.lit(q).cast("long"), key).alias("_h"),
                       F.col(key).alias("_id"))
        part = df.select(pos.alias("_pos"))
        if method == "window" or (method == "auto" and r * shuffle_width(part) <= WINDOW_TOPK_ROWS):
            last = part.orderBy("_pos").limit(r).agg(F.max("_pos").alias("_pos"))
        else:
            last = dense_ordinal(part, None, ["_pos"], name="_rn").filter(F.col("_rn") == r - 1)
        h, i = last.select("_pos.*").first()
        kind = df.schema[key].dataType
        times = times + F.when(pos <= F.struct(F.lit(h).alias("_h"), F.lit(i).cast(kind).alias("_id")), 1).otherwise(0)
    return (df.filter(times > 0)
            .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
            .select(*cols, "epoch"))


def fractions_to_counts(fractions: DataFrame, total: int, by: str = "dataset",
                        tol: float = 1e-9) -> DataFrame:
    """M8: ``k_d = int(total * frac_d)``; the fractions must sum to 1."""
    s = fractions.agg(F.sum("frac")).first()[0]
    if s is None or abs(s - 1.0) > tol:
        raise ValueError(f"mixture fractions sum to {s}, not 1")
    return fractions.select(by, F.floor(F.lit(float(total)) * F.col("frac")).cast("long").alias("k"))


def mixture(df: DataFrame, fractions: DataFrame, total: int, by: str = "dataset",
            key: str = "doc_id", seed=42, salt: str = "mixture") -> DataFrame:
    """M8: weighted mixture, then UNION ALL (one DataFrame)."""
    return sample(df, fractions_to_counts(fractions, total, by), by=by, key=key,
                  seed=seed, salt=salt)


def equal_mixture(df: DataFrame, per_dataset: int, by: str = "dataset", key: str = "doc_id",
                  seed=42, salt: str = "equal") -> DataFrame:
    """M7: the same number of rows from every dataset."""
    return sample(df, per_dataset, by=by, key=key, seed=seed, salt=salt)


def with_index(df: DataFrame, by: str = "dataset", order: str = "doc_id",
               name: str = "index") -> DataFrame:
    """``add_column(range(len), "index")`` per dataset, before sampling."""
    return dense_ordinal(df, by, [order], name=name)
