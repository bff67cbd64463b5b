"""Helpers shared by the operators of this package."""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: Words of the contracts: maximal runs of anything but ASCII white space.
WORD_RE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns and no other, found by exact name.

    Columns are renamed by position first, so an extra column whose name
    differs only in case, or a repeated name, can't make the lookup ambiguous
    (of a repeated name the first counts).
    """
    at = {}
    for i, c in enumerate(df.columns):
        at.setdefault(c, i)
    missing = [n for n in names if n not in at]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_{at[n]}").alias(n) for n in names])


def positional(df: DataFrame) -> tuple[DataFrame, dict[str, str], list[str]]:
    """All columns renamed ``_0, _1, ...``; name -> new name; the old names."""
    at: dict[str, str] = {}
    for i, c in enumerate(df.columns):
        at.setdefault(c, f"_{i}")
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]), at, df.columns


def held_out(doc_id: Column | str) -> Column:
    """True for the rows no model may learn from (NULL ids: false)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % 4 == 2, F.lit(False))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sample_per_class(rows: DataFrame, key: str, label: str, most: int, seed: int) -> DataFrame:
    """About ``most`` rows of each class of ``label`` (all, if there are
    fewer), chosen by a hash of ``key``: the documented bound of a training
    sample.  One pass counts the classes, which must be few (they are the
    classes of a model).

    With ``text`` among the columns its hash takes part, so rows without a key
    and rows that share one are chosen each by itself (equal texts of one key
    together).
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect() if r[0] is not None}
    if not counts:
        return rows.filter(F.lit(False))
    unit = 1 << 20
    salt = ["text"] if "text" in rows.columns else []
    hashed = F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string"), *salt), F.lit(unit))
    keep = F.lit(False)
    for value, n in sorted(counts.items(), key=lambda x: str(x[0])):
        share = int(min(unit, -(-most * unit // n)))
        keep = keep | ((F.col(label) == F.lit(value)) & (hashed < share))
    return rows.filter(keep)


def labelled_sample(docs: DataFrame, known: DataFrame, most: int, seed: int) -> DataFrame:
    """doc_id, text, y of about ``most`` documents of each class, for ``known
    (doc_id, y)``: the documented bound of a training sample.

    Ids are chosen first, so that no other text is shuffled; then the different
    texts that the chosen ids hold are bounded again, each by itself, since one
    id may be held by any number of rows.  Equal texts of one id count once.
    """
    # about ``most`` ids of each class
    chosen = F.broadcast(sample_per_class(known, "doc_id", "y", most, seed).withColumnRenamed("doc_id", "_id"))
    rows = (pick(docs, "doc_id", "text").filter("text is not null").join(chosen, F.col("doc_id") == F.col("_id"))
            .select("doc_id", "text", "y").distinct())
    path = scratch_path(docs.sparkSession, "training-sample")
    rows.write.parquet(path)
    rows = docs.sparkSession.read.schema(rows.schema).parquet(path)
    return sample_per_class(rows, "doc_id", "y", most, seed + 50)


def slices(batches: Iterable[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each holds about ``most`` bytes of ``text``
    (one longer text is a slice of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(size, dtype=np.int64) - size) // most
        edge = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edge, edge[1:]):
            yield batch.slice(a, b - a)


def arrow_schema(ddl: list[tuple[str, pa.DataType]]) -> pa.Schema:
    return pa.schema(ddl)


_owner: list = ["", lambda: None]


def claim(name: str, drop=lambda: None) -> None:
    """Called by a task that is about to fill a cache of its worker process:
    workers are used again by later stages, and only the last operator's cache
    may stay.  ``drop`` empties the caller's own, once another one comes."""
    if _owner[0] != name:
        _owner[1]()
        gc.collect()
    _owner[:] = [name, drop]


class UnitCache(dict):
    """``cache[unit]`` computes a missing value with ``make`` and keeps it;
    ``trim`` empties the cache once it holds ``most`` values, so that its
    memory is bounded whatever the vocabulary."""

    def __init__(self, make, most: int = 400_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, unit):
        value = self[unit] = self.make(unit)
        return value

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()
