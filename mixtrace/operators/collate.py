"""Collation of prompt/target rows into model batches.

Rows carry a ``batch_id``; every per-batch quantity (the "separate" flag, the
longest row) is a window over ``batch_id`` - a batch is a handful of rows.
All array work is higher-order functions in the JVM.

Causal collation keeps the loss on the target only: the separator's last
occurrence is cut out and labels before it are ``label_pad``; a row whose
separator was truncated away keeps its ids and gets no loss at all.  Unlike
the reference (which pads before stripping and can end with ragged rows),
rows are stripped first and then padded to the longest stripped row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrays import last_subarray_pos, pad_right
from ..functions.text import col
from .tokens import BOS_ID, EOS_ID, PAD_ID, hashed_ids

# Response separator text and the loss-ignore label.
SEP_TEXT = "########"
IGNORE = -100


def causal_text(prompt, target, sep: str = SEP_TEXT) -> Column:
    """K4: prompt + separator + " " + target when the target is not NULL.

    The separator is space-delimited so a whitespace tokenizer keeps it whole.
    """
    p, t = col(prompt), col(target)
    return F.when(t.isNotNull(), F.concat(p, F.lit(f" {sep} "), t)).otherwise(p)


def truncate(ids, max_len: int, bos: int | None = None, eos: int | None = None) -> Column:
    """K5: right truncation after concatenation; specials kept inside ``max_len``."""
    a = col(ids)
    room = max_len - (bos is not None) - (eos is not None)
    a = F.slice(a, 1, room)
    if bos is not None:
        a = F.concat(F.array(F.lit(bos)), a)
    if eos is not None:
        a = F.concat(a, F.array(F.lit(eos)))
    return a


def _target_len(length: Column, padding: str, max_len: int | None, multiple_of: int | None) -> Column:
    n = F.lit(max_len) if padding == "max_length" else length
    if multiple_of:
        n = F.ceil(n / multiple_of) * multiple_of
    return n.cast("int")


def collate_causal(df: DataFrame, ids: str, has_target: str, sep_ids: list[int],
                   pad_id: int = PAD_ID, label_pad: int = IGNORE, padding: str = "longest",
                   max_len: int | None = None, multiple_of: int | None = None,
                   batch: str = "batch_id") -> DataFrame:
    """(…, input_ids, attention_mask, labels, sep_found).

    ``ids`` are already tokenized and truncated; ``has_target`` marks rows
    that were built with a separator.  One such row sets the whole batch to
    separate mode (the reference's per-batch flag).
    """
    wb = Window.partitionBy(batch)
    a = F.col(ids)
    sep_mode = F.max(F.col(has_target).cast("int")).over(wb) == 1
    p = last_subarray_pos(a, sep_ids)
    n = len(sep_ids)
    stripped = F.concat(F.slice(a, 1, p - 1), F.slice(a, p + n, F.greatest(F.size(a), F.lit(1))))
    tail = F.slice(a, p + n, F.greatest(F.size(a), F.lit(1)))
    lab_sep = F.concat(F.array_repeat(F.lit(label_pad), p - 1), tail)
    out = (df.withColumn("_sep", sep_mode).withColumn("_p", p)
           .withColumn("_ids", F.when(F.col("_sep") & F.col("_p").isNotNull(), stripped).otherwise(a))
           .withColumn("_lab", F.when(~F.col("_sep"), a)
                       .when(F.col("_p").isNull(), F.array_repeat(F.lit(label_pad), F.size(a)))
                       .otherwise(lab_sep)))
    L = _target_len(F.max(F.size("_ids")).over(wb), padding, max_len, multiple_of)
    out = out.withColumn("_L", L)
    return (out.withColumn("input_ids", pad_right("_ids", "_L", pad_id))
            .withColumn("attention_mask", pad_right(F.array_repeat(F.lit(1), F.size("_ids")), "_L", 0))
            .withColumn("labels", pad_right("_lab", "_L", label_pad))
            .withColumn("sep_found", F.when(F.col("_sep"), F.col("_p").isNotNull()))
            .drop("_sep", "_p", "_ids", "_lab", "_L"))


def collate_seq2seq(df: DataFrame, src: str, tgt: str, pad_id: int = PAD_ID,
                    label_pad: int = IGNORE, start_id: int = PAD_ID, padding: str = "longest",
                    max_source: int | None = None, max_target: int | None = None,
                    multiple_of: int | None = None, batch: str = "batch_id") -> DataFrame:
    """Source and target padded separately per batch; decoder inputs
    are the labels shifted right behind ``start_id`` with ignore -> pad."""
    wb = Window.partitionBy(batch)
    Ls = _target_len(F.max(F.size(src)).over(wb), padding, max_source, multiple_of)
    Lt = _target_len(F.max(F.size(tgt)).over(wb), padding, max_target, multiple_of)
    out = df.withColumn("_Ls", Ls).withColumn("_Lt", Lt)
    out = (out.withColumn("input_ids", pad_right(src, "_Ls", pad_id))
           .withColumn("attention_mask", pad_right(F.array_repeat(F.lit(1), F.size(src)), "_Ls", 0))
           .withColumn("labels", pad_right(tgt, "_Lt", label_pad)))
    shifted = F.concat(F.array(F.lit(start_id)),
                       F.transform(F.slice("labels", 1, F.greatest(F.size("labels") - 1, F.lit(0))),
                                   lambda x: F.when(x == label_pad, F.lit(pad_id)).otherwise(x)))
    return out.withColumn("decoder_input_ids",
                          F.when(F.size("labels") > 0, shifted).otherwise(F.array().cast("array<int>"))) \
        .drop("_Ls", "_Lt")


def collate_pairs(df: DataFrame, preds: str, answers: str, pad_id: int = PAD_ID,
                  padding: str = "longest", max_len: int | None = None,
                  multiple_of: int | None = None, batch: str = "batch_id") -> DataFrame:
    """prediction/answer id lists padded per batch; no labels are set."""
    wb = Window.partitionBy(batch)
    out = df
    for c in (preds, answers):
        L = _target_len(F.max(F.size(c)).over(wb), padding, max_len, multiple_of)
        out = out.withColumn(c, pad_right(c, L, pad_id))
    return out


def tokenize_causal(text, max_len: int, buckets: int = 50_000) -> Column:
    """Whitespace tokens -> hashed ids -> BOS + right truncation to ``max_len``."""
    return truncate(hashed_ids(F.split(col(text), " "), buckets), max_len, bos=BOS_ID)


def tokenize_target(text, max_len: int, buckets: int = 50_000) -> Column:
    """Target side: hashed ids, truncated, EOS appended inside ``max_len``."""
    return truncate(hashed_ids(F.split(col(text), " "), buckets), max_len, eos=EOS_ID)


def tokenize_source(text, max_len: int, buckets: int = 50_000) -> Column:
    """Source side: no special tokens."""
    return truncate(hashed_ids(F.split(col(text), " "), buckets), max_len)


def pass_through(df: DataFrame) -> DataFrame:
    """Rows that already hold ``input_ids`` skip tokenising; tags ride along."""
    keep = [c for c in ("input_ids", "attention_mask", "labels", "dataset") if c in df.columns]
    return df.select(*keep)


def text_only(df: DataFrame, src: str = "inputs_pretokenized",
              tgt: str = "targets_pretokenized") -> DataFrame:
    """Strings untouched (``inputs``/``labels``), dataset carried."""
    cols = [F.col(src).alias("inputs"), F.col(tgt).alias("labels")]
    if "dataset" in df.columns:
        cols.append(F.col("dataset"))
    return df.select(*cols)
