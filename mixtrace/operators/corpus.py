"""The corpus builder end to end: sample, tokenise, pack, number, mix.

``documents -> (row sample per dataset) -> token ids -> blocks -> index ->
block sample per dataset``: the samplers (M1-M3, M7, M8), K1-K3 and P4 chained.
Texts cross the network once, as pieces of blocks; the blocks are stored in
the shared folder, and every later step but the last join works on their
narrow keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from . import packing, sampling
from .models.lm import join_checked
from .ordinal import dense_ordinal


def corpus_blocks(docs: DataFrame, k: int | DataFrame, ids: Column, doc_counts: DataFrame | None = None,
                  block_size: int = 1024, batch_docs: int = 1000, seed=42, shards: int = 1) -> DataFrame:
    """(dataset, batch_id, block_no, index, epoch, input_ids, labels, attention_mask).

    ``docs (dataset, doc_id, ...)``, ``doc_id`` unique within a dataset; ``ids``
    is the token-id array as an expression over its columns.  ``doc_counts
    (dataset, k)`` first samples so many documents (wrap-around; datasets not
    listed go), which pack in (epoch, doc_id) order.  ``k`` blocks are drawn
    from every dataset, or by a table ``(dataset, k)``.  ``shards``: see ``packing``.
    """
    spark = docs.sparkSession
    order = F.struct(F.lit(0).cast("long").alias("epoch"), "doc_id")
    if doc_counts is not None:
        docs = sampling.sample(docs, doc_counts, seed=seed, salt="corpus")
        order = F.struct("epoch", "doc_id")
    seqs = docs.select("dataset", order.alias("_order"), ids.alias("input_ids"))
    path = scratch_path(spark, "blocks")
    keys = ["dataset", "batch_id", "block_no"]
    (packing.pack(seqs, block_size=block_size, batch_docs=batch_docs, order="_order", shards=shards)
     .select(*keys, "input_ids").write.parquet(path))
    blocks = spark.read.parquet(path)
    index = dense_ordinal(blocks.select(*keys), "dataset", ["batch_id", "block_no"], name="index")
    drawn = sampling.sample(index, k, key="index", seed=seed, salt="blocks")
    return packing.model_inputs(join_checked(blocks, drawn, keys))
