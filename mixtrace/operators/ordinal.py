"""Dense 0-based ordinal per group, distributed.

``row_number().over(Window.partitionBy(group))`` puts each group into one task;
with one dataset holding a third of all rows that task is the whole job.
Here the rows are range-partitioned on ``(group, order)`` (so a hot group is
split over many partitions), sorted within partitions and checkpointed into
the shared folder (partition ids and in-partition positions must not change
between the two passes).  Then:

    ordinal = position in partition - first position of (partition, group)
              + rows of the same group in earlier partitions

The per-(partition, group) table has at most ``partitions + groups`` rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut, small_enough


def dense_ordinal(df: DataFrame, group: list[str] | str | None, order: list,
                  name: str = "ordinal", partitions: int | None = None, costly: bool = False) -> DataFrame:
    """Add ``name`` = 0-based position of each row within its group by ``order``.

    ``order`` must make the order total (end it with a unique key).  The range
    partitioning runs its input twice (once for a sample of the keys); a
    ``costly`` input of narrow rows, such as text sizes, is written first.
    """
    df = cut(df) if costly else df
    group = [] if group is None else ([group] if isinstance(group, str) else list(group))
    order = list(order)
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g) for g in group] + [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = cut(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys))
    with_id = (ranged.withColumn("_pid", F.spark_partition_id())
               .withColumn("_mid", F.monotonically_increasing_id()))
    stats = with_id.groupBy("_pid", *group).agg(F.min("_mid").alias("_first"),
                                                F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*group).orderBy("_pid") if group else Window.orderBy("_pid")
    stats = stats.withColumn("_before", F.sum("_n").over(w) - F.col("_n")).drop("_n")
    out = _join_back(with_id, stats, group)
    return (out.withColumn(name, F.col("_mid") - F.col("_first") + F.col("_before"))
            .drop("_pid", "_mid", "_first", "_before"))


def _join_back(rows: DataFrame, stats: DataFrame, group: list[str]) -> DataFrame:
    """Join the per-(partition, group) table back; NULL groups match NULL groups."""
    ren = stats.select(F.col("_pid").alias("_s_pid"), *[F.col(g).alias(f"_s_{g}") for g in group],
                       *[c for c in stats.columns if c != "_pid" and c not in group])
    ren = cut(ren)  # counted, then joined: the aggregate runs once
    cond = [F.col("_pid") == F.col("_s_pid")] + [F.col(g).eqNullSafe(F.col(f"_s_{g}")) for g in group]
    small = F.broadcast(ren) if small_enough(ren, 1_000_000) else ren
    out = rows.join(small, cond, "inner")
    return out.drop("_s_pid", *[f"_s_{g}" for g in group])


def window_ordinal(df: DataFrame, group: list[str] | str | None, order: list,
                   name: str = "ordinal") -> DataFrame:
    """Same result with one window; for inputs whose groups are known to be small."""
    group = [] if group is None else ([group] if isinstance(group, str) else list(group))
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, (F.row_number().over(w) - 1).cast("long"))


def running_max(df: DataFrame, group: list[str] | str, order: list, value, name: str,
                partitions: int | None = None) -> DataFrame:
    """Add ``name`` = max of ``value`` over the rows of the same group up to
    and including the current one in ``order`` (NULLs ignored).

    Same split as ``dense_ordinal``: range partitions over (group, order), a
    running max inside each (partition, group) chunk, and the carry from
    earlier chunks of the group through a table of at most partitions +
    groups rows.  A group holding most rows is spread over many tasks.
    """
    group = [group] if isinstance(group, str) else list(group)
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g) for g in group] + [F.col(o) if isinstance(o, str) else o for o in order]
    v = value if not isinstance(value, str) else F.col(value)
    ranged = cut(df.withColumn("_v", v).repartitionByRange(n, *keys).sortWithinPartitions(*keys))
    r = ranged.withColumn("_pid", F.spark_partition_id())
    w_local = (Window.partitionBy("_pid", *group).orderBy(*order)
               .rowsBetween(Window.unboundedPreceding, 0))
    r = r.withColumn("_local", F.max("_v").over(w_local))
    chunk = r.groupBy("_pid", *group).agg(F.max("_v").alias("_cm"))
    w_prev = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    chunk = chunk.withColumn("_carry", F.max("_cm").over(w_prev)).drop("_cm")
    out = _join_back(r, chunk, group)
    return (out.withColumn(name, F.greatest(F.col("_local"), F.col("_carry")))
            .drop("_pid", "_v", "_local", "_carry"))
