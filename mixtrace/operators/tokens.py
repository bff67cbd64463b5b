"""K1 (re-aimed): vocabulary and encoding jobs, plus hashed ids.

A pretrained sub-word tokenizer is a single-machine artefact; here the
vocabulary is a distributed job (``groupBy(tok).count`` -> top-V by
``(count desc, tok)`` -> dense ids) and encoding is a look-up of its head and a
join with its tail.  A user's
own tokenizer can still be plugged in with ``pandas_tokenizer``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import WORD_SPLIT, col, word_tokens
from ..session import scratch_path, spread
from .joins import same_keys
from .ordinal import dense_ordinal

# Special tokens and their ids.
SPECIALS = ["<pad>", "<unk>", "<s>", "</s>"]
PAD_ID, UNK_ID, BOS_ID, EOS_ID = 0, 1, 2, 3

# What a task holds of a vocabulary: bytes in all, of a token, beside each token.
HEAD_BYTES = 16 << 20
LONGEST = 24
ENTRY = 16


def vocab_build(rows: DataFrame, text: str = "text", max_size: int | None = None,
                min_count: int = 1, pattern: str = WORD_SPLIT) -> DataFrame:
    """(tok, count, id): ids after the specials, by (count desc, tok)."""
    c = (spread(rows.select(text)).select(F.explode(word_tokens(text, pattern)).alias("tok"))
         .groupBy("tok").agg(F.count(F.lit(1)).alias("count"))
         .filter(F.col("count") >= min_count))
    # rank every counted token with the distributed ordinal (range partitions
    # on (count desc, tok)); top-V is then a filter - no single-task merge
    v = dense_ordinal(c, None, [F.col("count").desc(), F.col("tok")], name="id")
    if max_size is not None:
        v = v.filter(F.col("id") < max_size)
    return v.withColumn("id", (F.col("id") + len(SPECIALS)).cast("int"))


def _head(vocab: DataFrame, most_bytes: int) -> tuple[dict[str, int], bool]:
    """What every task can hold of a vocabulary, and whether that is all of it:
    all tokens if they fit ``most_bytes``, else the most frequent of at most
    ``LONGEST`` bytes, as many as surely do."""
    size = vocab.agg(F.sum(F.octet_length("tok") + ENTRY)).first()[0] or 0
    whole = size <= most_bytes
    if not whole:
        n = most_bytes // (LONGEST + ENTRY)
        vocab = vocab.filter((F.col("id") < n + len(SPECIALS)) & (F.octet_length("tok") <= LONGEST))
    return dict(zip(*vocab.select("tok", "id").toArrow().to_pydict().values())), whole


def encode(rows: DataFrame, vocab: DataFrame, key: list[str] | str, text: str = "text",
           pattern: str = WORD_SPLIT, head_bytes: int = HEAD_BYTES) -> DataFrame:
    """(key..., ids ARRAY<INT>) of every row that has tokens; unknown tokens ->
    <unk>.  ``key`` is unique.

    Ids are ranks by frequency, so the vocabulary's first tokens are most of any
    text.  They go to every task (at most ``head_bytes``) and are looked up where
    the row is read, once for each different token of a batch.  If that is the
    whole vocabulary, nothing is shuffled.  Otherwise a row asks for its other
    tokens, each once, by a join with the rest of the vocabulary, and only rows
    that have some are joined with the answers; pass ``vocab`` materialised.
    """
    key = [key] if isinstance(key, str) else list(key)
    spark = rows.sparkSession
    head, whole = _head(vocab, head_bytes)
    shared = spark.sparkContext.broadcast(head)
    toks = spread(rows.select(*key, text)).select(*key, word_tokens(text, pattern).alias("_toks")).filter(F.size("_toks") > 0)
    keys = toks.select(*key).schema.fields
    ids = T.StructField("ids", T.ArrayType(T.IntegerType()))

    def look_up(batches):
        at = shared.value
        for b in batches:
            for part in _slices(b, "_toks"):
                lists = part.column("_toks")
                flat = lists.flatten().dictionary_encode()
                known = np.fromiter((at.get(t, -1) for t in flat.dictionary.to_pylist()), np.int32, len(flat.dictionary))
                got = known[flat.indices.to_numpy()]
                ends = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy())).astype(np.int32)
                lost = got < 0
                if whole:
                    got = np.where(lost, UNK_ID, got)
                out = [*[part.column(k) for k in key], pa.ListArray.from_arrays(ends, pa.array(got, pa.int32()))]
                if not whole:
                    tail = pc.if_else(pa.array(lost), flat.dictionary_decode(), pa.scalar(None, pa.string()))
                    out.append(pa.ListArray.from_arrays(ends, tail))
                yield pa.RecordBatch.from_arrays(out, [*key, "ids", "_tail"][:len(out)])

    if whole:
        return toks.mapInArrow(look_up, T.StructType([*keys, ids]))
    path = scratch_path(spark, "encoded")
    schema = T.StructType([*keys, ids, T.StructField("_tail", T.ArrayType(T.StringType()))])
    toks.mapInArrow(look_up, schema).write.parquet(path)
    met = spark.read.schema(schema).parquet(path)
    has_tail = F.exists("_tail", lambda t: t.isNotNull())
    rest = met.filter(has_tail)
    asked = rest.select(*key, F.explode(F.array_distinct(F.filter("_tail", lambda t: t.isNotNull()))).alias("tok"))
    answers = (asked.join(vocab.select("tok", "id"), "tok").groupBy(*key)
               .agg(F.collect_list(F.struct("tok", "id")).alias("_found")))

    def fill(batches):
        for b in batches:
            out = []
            for got, tail, found in zip(*(b.column(c).to_pylist() for c in ("ids", "_tail", "_found"))):
                at = {f["tok"]: f["id"] for f in found or ()}
                out.append([i if t is None else at.get(t, UNK_ID) for i, t in zip(got, tail)])
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in key], pa.array(out, pa.list_(pa.int32()))], [*key, "ids"])

    filled = same_keys(rest, answers, key, "left").select(*key, "ids", "_tail", "_found").mapInArrow(fill, T.StructType([*keys, ids]))
    return met.filter(~has_tail).select(*key, "ids").unionByName(filled)


def _slices(batch: pa.RecordBatch, lists: str, most: int = 1 << 20):
    """A batch cut so that each part holds about ``most`` tokens (or one row)."""
    n = pc.list_value_length(batch.column(lists)).to_numpy()
    part = (np.cumsum(n, dtype=np.int64) - n) // most
    edge = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edge, edge[1:]):
        if a < b:
            yield batch.slice(a, b - a)


def hashed_ids(tokens, buckets: int = 50_000, offset: int = len(SPECIALS)) -> Column:
    """ARRAY<STRING> -> ARRAY<INT> via md5 bucket ids (no vocabulary pass).

    id = offset + (first 32 bits of md5(token)) mod buckets.
    """
    return F.transform(col(tokens), lambda t: (
        F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % buckets + offset).cast("int"))


def pandas_tokenizer(fn, text: str = "text") -> Column:
    """Hook for a user tokenizer: ``fn(list[str]) -> list[list[int]]`` on Arrow batches."""
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def _tok(s: pd.Series) -> pd.Series:
        return pd.Series(fn(s.tolist()))

    return _tok(F.col(text))
