"""Operator 10: SimHash near-dedup by anchor-point covering.

Fingerprint: words are ASCII-lower-cased; every run of three (repeats count)
is hashed by XXH64, seed 42; a bit is set if it is set in over half of the
hashes.  Fingerprints link at ``DISTANCE`` or fewer differing bits; a component
is what links reach.

Anchors are the words of a covering code: the perfect binary Golay code on
bits 0-22 and again on bits 23-45 (2^24 anchors; every fingerprint is within
3 bits of exactly one word of each block, its home; bits 46-63 take no part).
If two fingerprints differ in at most t bits, each is within covering radius +
t, block by block and t in total, of the other's home.  So every fingerprint
goes to its home once, and is replicated to every anchor within that radius
(about 61); a home row and a replica that meet at an anchor are compared in
full.  That is exact: no link is lost, and nothing is capped.

Equal fingerprints are one row before replication, so large groups of copies
cost nothing; rows that share an anchor meet in a sort-merge join, which
streams and spills, and whose hot partitions AQE splits.

Defined cases: NULL and empty texts have fingerprint zero and link like any
other; fewer than three words are one shingle; NULL doc_ids take part but a
component's id is the smallest that isn't NULL (NULL if there is none);
repeated rows are repeated in the result; extra columns are ignored
(``keep_first``: kept, and one row of each component stays).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import claim, partitions, pick, positional, slices
from .components import components

SHINGLE = 3
DISTANCE = 2
SEED = 42
#: Generator polynomial of the binary Golay code (fixed value).
GOLAY = 0b101011100011
BLOCK, RADIUS = 23, 3

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """The fingerprint of one text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= k:
        return xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.append(0, ends[:-k]).tolist()
    stops = (ends[k - 1:] - 1).tolist()
    view = joined
    h = np.array([xxh64_intdigest(view[a:b], SEED) for a, b in zip(starts, stops)], np.uint64)
    count = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):  # whole texts, in blocks
        bits = np.unpackbits(h[i:i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.uint16)
    return int(((2 * count > len(h)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def _marked(rows: DataFrame, k: int, ddl: str) -> DataFrame:
    """The columns of ``ddl``, and fp (the bits of the text's fingerprint as a signed long)."""
    names = [c.split()[0] for c in ddl.split(", ")]

    def run(batches):
        claim("simhash")
        for b in slices(batches, "text"):
            fp = np.array([fingerprint(t, k) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*map(b.column, names), pa.array(fp.view(np.int64))], [*names, "fp"])

    return rows.mapInArrow(run, f"{ddl}, fp long")


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long)."""
    rows = pick(docs, "doc_id", "text").selectExpr("cast(doc_id as long) doc_id", "text")
    return _marked(rows, k, "doc_id long")


@lru_cache(maxsize=4)
def _cosets(distance: int) -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome of the Golay code: the error patterns up to weight
    RADIUS + distance (padded with -1), and each one's excess over RADIUS."""
    from itertools import combinations

    powers, r = [], 1  # x^i mod the generator
    for _ in range(BLOCK):
        powers.append(r)
        r <<= 1
        if r >> 11:
            r ^= GOLAY
    lists: list[list[tuple[int, int]]] = [[] for _ in range(1 << 11)]
    for weight in range(RADIUS + distance + 1):
        for at in combinations(range(BLOCK), weight):
            s = e = 0
            for i in at:
                s ^= powers[i]
                e |= 1 << i
            lists[s].append((e, max(0, weight - RADIUS)))
    width = max(map(len, lists))
    errors, excess = np.full((1 << 11, width), -1, np.int64), np.full((1 << 11, width), 99, np.int8)
    for s, row in enumerate(lists):
        errors[s, :len(row)] = [e for e, _ in row]
        excess[s, :len(row)] = [x for _, x in row]
    return errors, excess


@lru_cache(maxsize=1)
def _syndrome_table() -> np.ndarray:
    """Syndromes of all 2^23 block values would be 16 MB; of the two halves it is small."""
    powers, r = [], 1
    for _ in range(BLOCK):
        powers.append(r)
        r <<= 1
        if r >> 11:
            r ^= GOLAY
    half = np.zeros((2, 1 << 12), np.int64)
    for h in range(2):
        for i in range(12):
            if h * 12 + i < BLOCK:
                half[h] ^= np.where(np.arange(1 << 12) >> i & 1, powers[h * 12 + i], 0)
    return half


def anchors(fp: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """uint64 fingerprints -> (row, anchor, is home), all anchors within the
    covering radius plus ``distance``."""
    errors, excess = _cosets(distance)
    half = _syndrome_table()
    mask = (1 << BLOCK) - 1
    words, over = [], []
    for k in range(2):
        x = (fp >> np.uint64(k * BLOCK)).astype(np.int64) & mask
        s = half[0][x & 4095] ^ half[1][x >> 12]
        words.append(x[:, None] ^ errors[s])
        over.append(excess[s])
    total = over[0][:, :, None] + over[1][:, None, :]
    row, i, j = np.nonzero(total <= distance)
    anchor = words[0][row, i] | words[1][row, j] << BLOCK
    return row, anchor, total[row, i, j] == 0


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Distinct fingerprints ``fp`` -> a, b: every pair at 1 to ``distance`` bits, once."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                fp = batch.column("fp").slice(k, 4096).to_numpy()
                row, anchor, home = anchors(fp.view(np.uint64), distance)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[row]), pa.array(home)],
                                                 ["anchor", "fp", "home"])

    # both sides of the join read one shuffle's worth of narrow rows each
    placed = fps.select("fp").mapInArrow(run, "anchor long, fp long, home boolean")
    home = placed.filter("home").select("anchor", F.col("fp").alias("a"))
    met = home.join(placed.select("anchor", F.col("fp").alias("b")).hint("merge"), "anchor")
    near = met.filter((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _named(marked: DataFrame, low: Column, distance: int) -> DataFrame:
    """fp, low (of the fingerprint's rows), component (its smallest fingerprint)."""
    n = partitions(marked.sparkSession)
    distinct = cut(marked.groupBy("fp").agg(low.alias("low")).repartition(n))
    reach = components(links(distinct, distance))
    named = distinct.join(reach.withColumnRenamed("node", "fp"), "fp", "left")
    return named.withColumn("component", F.coalesce("component", "fp"))


def near_dedup(docs: DataFrame, k: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id that links reach)."""
    marked = cut(fingerprints(docs, k))
    # a component's id comes from documents, its name from fingerprints
    named = _named(marked, F.min("doc_id"), distance)
    low = named.groupBy("component").agg(F.min("low").alias("component_id"))
    table = named.join(low, "component").select("fp", "component_id")
    return marked.join(table, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, k: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row of each component, with all columns of ``docs``: the one with the
    smallest doc_id (NULL last), of rows that share it the one with the smallest
    (fp, hash of the row).  Rows are told apart by 128 bits over all columns but
    maps, so only exact repeats of that row go with it; they go before the texts
    are shuffled, which is once."""
    plain, at, names = positional(docs)
    whole = [c for c, kind in plain.dtypes if "map<" not in kind and "variant" not in kind]
    plain = plain.withColumns({f"_h{i}": F.xxhash64(F.lit(i), *whole) for i in (1, 2)})
    rows = plain.select(F.col(at["doc_id"]).cast("long").alias("doc_id"), F.col(at["text"]).alias("text"), "_h1", "_h2")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "_h1", "_h2")
    named = _named(cut(_marked(rows, k, "doc_id long, _h1 long, _h2 long")), F.min(order), distance)
    kept = named.groupBy("component").agg(F.min("low").alias("low")).select("low._h1", "low._h2")
    out = plain.dropDuplicates(["_h1", "_h2"]).join(kept, ["_h1", "_h2"], "left_semi")
    return out.drop("_h1", "_h2").toDF(*names)
