"""Contiguous ranges of documents in ascending order, without a sampling
pass over wide rows (``repartitionByRange`` runs its whole input once more to
sample it) and without an id that must fit one range.

The order is (``_key``, ``_hash``): the id, NULL first, then a hash of the text.
Rows that share an id, or have none, are so dealt out by their texts; only equal
texts of one id are sure to stay together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOW = -(1 << 63)


def with_order(rows: DataFrame) -> DataFrame:
    """rows (doc_id long, text) with ``_key`` and ``_hash``.  Rows without an id
    have the smallest key; their hashes are negative and all others aren't, so
    they also come before a document that has this number as its id."""
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    return rows.withColumns({
        "_key": F.coalesce("doc_id", F.lit(_LOW)),
        "_hash": F.when(F.col("doc_id").isNull(), h.bitwiseOR(F.lit(_LOW))).otherwise(h.bitwiseAND(F.lit(-_LOW - 1)))})


def range_bounds(rows: DataFrame, n: int) -> list[tuple[int, int]]:
    """At most ``n - 1`` ascending cuts (key, hash), from a scan of the ids alone
    (a mergeable quantile sketch; its size does not grow with the table).

    An id that r of the quantiles fall on holds about r of n parts of all rows:
    its hashes, which are evenly spread, are cut into r parts.
    """
    if n < 2:
        return []
    marks = [i / n for i in range(1, n)]
    row = rows.agg(F.percentile_approx("_key", marks, max(10_000, 20 * n)).alias("q")).first()
    cuts = []
    for key, r in zip(*np.unique(np.array(row.q or [], np.int64), return_counts=True)):
        low = _LOW if key == _LOW else 0
        cuts += [(int(key), low + j * ((1 << 63) // int(r))) for j in range(int(r))]
    return cuts


def range_of(bounds: list[tuple[int, int]]) -> Column:
    """Number of the range that a row's (``_key``, ``_hash``) falls in: how many cuts are <= it."""
    if not bounds:
        return F.lit(0)
    keys = np.array([k for k, _ in bounds], np.int64)
    hashes = np.array([h for _, h in bounds], np.int64)
    once, first, count = np.unique(keys, return_index=True, return_counts=True)
    several = [(k, a, c) for k, a, c in zip(once, first, count) if c > 1 or k == _LOW]

    @F.pandas_udf(T.IntegerType())
    def find(key: pd.Series, hash_: pd.Series) -> pd.Series:
        key, hash_ = key.to_numpy(), hash_.to_numpy()
        at = np.searchsorted(keys, key, side="right")
        for k, a, c in several:
            mine = np.flatnonzero(key == k)
            at[mine] = a + np.searchsorted(hashes[a:a + c], hash_[mine], side="right")
        return pd.Series(at, dtype="int32")

    return find("_key", "_hash")
