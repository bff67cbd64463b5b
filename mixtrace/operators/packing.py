"""K2-K3: concatenate-and-chunk packing into fixed-size blocks.

Semantics of the reference's map-batch grouping: documents of one dataset, in
key order, form batches of ``batch_docs``; a batch's sequences are
concatenated; if the total is at least ``block_size`` the remainder is
dropped and the rest cut into blocks, otherwise the batch yields one short
block (an empty batch yields none).  Blocks never span batches or datasets.

A dataset may first be split into ``shards`` contiguous shards, as several
processes of a packing step divide it: the first ``N mod shards`` of them hold
one document more, there are no more shards than documents, and a batch ends
where its shard does.

Plan: ordinals and the prefix sums of lengths are computed on narrow
``(dataset, key, length)`` rows.  Each document then meets its start inside
the batch (broadcast after a size check, a join on the key beyond), is sliced
into its pieces of blocks where it stands, and the pieces are grouped by
``(dataset, batch, block)`` - at most ``block_size`` tokens a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut, small_enough
from .joins import same_keys
from .ordinal import dense_ordinal

# Documents up to which the starts are broadcast (five narrow columns a row).
BROADCAST_DOCS = 500_000
# Datasets up to which their sizes are broadcast.
BROADCAST_DATASETS = 1_000_000


def batch_of(position: Column, rows: Column, shards: int, batch_docs: int) -> Column:
    """Number of the batch that holds a dataset's 0-based ``position`` if its
    ``rows`` rows are split into contiguous shards; batches count on from shard
    to shard."""
    n = F.least(F.lit(shards), rows).cast("long")
    small = F.floor(rows / n).cast("long")
    longer = rows % n  # so many shards hold one row more
    edge = longer * (small + 1)
    per_long = F.ceil((small + 1) / batch_docs)
    per_small = F.ceil(small / batch_docs)
    rest = position - edge
    in_long = F.floor(position / (small + 1)) * per_long + F.floor(position % (small + 1) / batch_docs)
    in_small = longer * per_long + F.floor(rest / small) * per_small + F.floor(rest % small / batch_docs)
    return F.when(position < edge, in_long).otherwise(in_small).cast("long")


def pack(seqs: DataFrame, ids: str = "input_ids", block_size: int = 1024, batch_docs: int = 1000,
         by: str = "dataset", order: str = "doc_id", shards: int = 1) -> DataFrame:
    """(by, batch_id, block_no, input_ids, labels, attention_mask) from
    ``(by, order, ids ARRAY<...>)``; ``order`` is unique within a dataset.

    The arrays cross the network as pieces of blocks: once, or twice when the
    starts are too many to broadcast.  NULL and empty arrays add no tokens but
    count as documents of their batch.
    """
    if shards < 1:
        raise ValueError(f"shards must be at least 1, not {shards}")
    b = F.lit(block_size)
    size = F.coalesce(F.greatest(F.size(ids), F.lit(0)), F.lit(0)).cast("long")
    docs = dense_ordinal(seqs.select(by, order, size.alias("_len")), by, [order], name="_ord", costly=True)
    if shards == 1:
        batch = F.floor(F.col("_ord") / batch_docs).cast("long")
    else:
        rows = cut(docs.groupBy(by).agg(F.count(F.lit(1)).alias("_rows")))
        docs = same_keys(docs, rows, by, broadcast=BROADCAST_DATASETS)
        batch = batch_of(F.col("_ord"), F.col("_rows"), shards, batch_docs)
    docs = docs.withColumn("batch_id", batch)
    wb = Window.partitionBy(by, "batch_id")
    w_ord = wb.orderBy("_ord").rowsBetween(Window.unboundedPreceding, -1)
    docs = (docs.withColumn("_start", F.coalesce(F.sum("_len").over(w_ord), F.lit(0)))
            .withColumn("_total", F.sum("_len").over(wb)))
    keep = F.when(F.col("_total") >= b, F.floor(F.col("_total") / b) * b).otherwise(F.col("_total"))
    starts = cut(docs.select(F.col(by).alias("_s_by"), F.col(order).alias("_s_order"), "batch_id", "_start",
                             F.least(F.col("_start") + F.col("_len"), keep).alias("_end"))
                 .filter(F.col("_start") < F.col("_end")))
    side = F.broadcast(starts) if small_enough(starts, BROADCAST_DOCS) else starts
    j = seqs.select(by, order, ids).join(
        side, F.col(by).eqNullSafe(F.col("_s_by")) & F.col(order).eqNullSafe(F.col("_s_order")))

    def piece(n):
        first = F.greatest(F.col("_start"), n * b)
        last = F.least(F.col("_end"), (n + 1) * b)
        return F.struct(n.alias("block_no"), first.alias("_pos"),
                        F.slice(ids, (first - F.col("_start") + 1).cast("int"),
                                (last - first).cast("int")).alias("_ids"))

    numbers = F.sequence(F.floor(F.col("_start") / b), F.floor((F.col("_end") - 1) / b))
    pieces = j.select(by, "batch_id", F.explode(F.transform(numbers, piece)).alias("_p")) \
        .select(by, "batch_id", "_p.*")
    blocks = (pieces.groupBy(by, "batch_id", "block_no")
              .agg(F.sort_array(F.collect_list(F.struct("_pos", "_ids"))).alias("_b"))
              .withColumn("input_ids", F.flatten(F.transform("_b", lambda s: s["_ids"])))
              .drop("_b"))
    return model_inputs(blocks)


def model_inputs(blocks: DataFrame) -> DataFrame:
    """``labels`` equal to the ids, and a mask of ones: blocks hold no padding."""
    return (blocks.withColumn("labels", F.col("input_ids"))
            .withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids"))))
