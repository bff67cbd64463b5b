"""Operator 6: document fingerprints by content-defined chunking.

A gear hash of the last 32 bytes is taken at every byte; a chunk ends where it
has enough zero bits: many below the normal size, few above it (normalised
chunking), between a least and a greatest size.  Ends depend on nearby bytes
only, so an insertion or a cut moves the chunks near it and no others.  The
fingerprint is the set of chunk digests (64 bits), each with the bytes it
covers; ``containment`` is the covered share of one that the other covers too.

All texts of a slice are hashed at once: the hash is a sum of shifted table
entries, built by five doublings over one array, with gaps between texts so
that no text sees another.

Defined cases: NULL text is the empty text, whose fingerprint is empty; two
empty fingerprints are alike (1), an empty one and another aren't (0); NULL
doc_id comes first in the order of documents, rows that share a doc_id are
ordered by a hash of their texts (NULL as the empty text), then by the texts;
the only document is its own next; an empty table gives an empty result; extra
columns are ignored.  Whole texts are read; memory is
bounded by a slice of about 2 MB of text or one longer text.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, pick, slices
from .ordered import range_bounds, range_of, with_order

LEAST, NORMAL, MOST = 16, 64, 256
#: Zero bits asked for below and above the normal size.
STRICT, LOOSE = 8, 4
REACH = 32


def _gear() -> np.ndarray:
    """256 fixed random numbers, by rule."""
    x = (np.arange(1, 257, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def _ends(texts: list[bytes]) -> list[tuple[list[int], list[int], int]]:
    """For each text: where strict and loose ends may be (positions in a
    common array), and where it starts there."""
    gap = bytes(REACH)
    data = gap.join(texts)
    h = GEAR[np.frombuffer(data, np.uint8)]
    starts, at = [], 0
    for t in texts:
        starts.append(at)
        at += len(t)
        h[at:at + REACH] = 0
        at += REACH
    step = 1
    while step < REACH:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    loose = np.flatnonzero(h >> np.uint32(32 - LOOSE) == 0)
    strict = loose[h[loose] >> np.uint32(32 - STRICT) == 0].tolist()
    return strict, loose.tolist(), starts


def fingerprints(texts: list[str]) -> list[dict[int, int]]:
    """Digest -> bytes covered, for each whole text."""
    from xxhash import xxh64_intdigest

    raw = [t.encode() for t in texts]
    strict, loose, starts = _ends(raw)
    strict.append(1 << 62)
    loose.append(1 << 62)
    out = []
    for data, base in zip(raw, starts):
        size, s, got = len(data), 0, {}
        while s < size:
            # a cut at position p ends the chunk after byte p
            p = strict[bisect_left(strict, base + s + LEAST - 1)]
            if p >= base + s + NORMAL - 1:
                p = loose[bisect_left(loose, base + s + NORMAL - 1)]
            e = min(p - base + 1, s + MOST, size)
            d = xxh64_intdigest(data[s:e])
            got[d] = got.get(d, 0) + e - s
            s = e
        out.append(got)
    return out


def as_text(fp: dict[int, int]) -> str:
    """digest:bytes pairs, hex, ascending; equal sets give equal strings."""
    return ",".join([f"{d:016x}:{n:x}" for d, n in sorted(fp.items())])


def from_text(s: str) -> dict[int, int]:
    return {int(d, 16): int(n, 16) for d, n in (x.split(":") for x in s.split(","))} if s else {}


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """The share of a's bytes in chunks that b has too (as often, at most)."""
    if not a or not b:
        return float(not a and not b)
    common = a.keys() & b.keys()
    return sum([min(a[d], b[d]) for d in common]) / sum(a.values())


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every row."""

    def run(batches):
        for b in slices(batches, "text", 2 << 20):
            fps = fingerprints([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([as_text(f) for f in fps], pa.string())],
                                             ["doc_id", "fingerprint"])

    rows = pick(docs, "doc_id", "text").selectExpr("cast(doc_id as long) doc_id", "text")
    return rows.mapInArrow(run, "doc_id long, fingerprint string")


def with_next(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text) dealt into contiguous ranges of (id, hash of the
    text), one per partition, sorted; ``halo`` marks a copy of the next range's
    first document that stands at a partition's end (the last range's: the
    first document of all).  One shuffle of the texts; cuts come from a scan of
    the ids alone, and the first documents, one a range, from a partial minimum."""
    n = partitions(rows.sparkSession)
    rows = with_order(rows.select("doc_id", "text"))
    placed = rows.withColumn("p", range_of(range_bounds(rows, n)))
    first = placed.groupBy("p").agg(F.min(F.struct("_key", "_hash")).alias("low")).collect()  # one per partition
    first = sorted((r.p, r.low._key, r.low._hash) for r in first)
    lows = [(p, first[i - 1][0], key, h) for i, (p, key, h) in enumerate(first)]
    lows = F.broadcast(rows.sparkSession.createDataFrame(lows, "p int, before int, _key long, _hash long"))
    halo = (placed.join(lows, ["p", "_key", "_hash"]).groupBy("before", "_key", "_hash")
            .agg(F.min(F.struct(F.col("text").isNotNull().alias("some"), "doc_id", "text")).alias("x")))
    halo = halo.select(F.col("x.doc_id").alias("doc_id"), F.col("x.text").alias("text"), "_key", "_hash",
                       F.col("before").alias("p"), F.lit(True).alias("halo"))
    return (placed.withColumn("halo", F.lit(False)).unionByName(halo)
            .repartitionById(n, F.col("p")).sortWithinPartitions("halo", "_key", "_hash", "text")
            .select("doc_id", "text", "halo"))


def edited(text: str, after: str) -> str:
    """The last quarter of the code points replaced by the next text's first ones."""
    n = len(text) // 4
    return text[:len(text) - n] + after[:n]


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with likenesses to
    the edited text's and the next document's."""
    rows = pick(docs, "doc_id", "text").selectExpr("cast(doc_id as long) doc_id", "text")

    def results(held):
        texts = [t for _, t, _ in held]
        changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
        fps = fingerprints(texts + changed)
        own, new = fps[:len(texts)], fps[len(texts):]
        return pa.RecordBatch.from_arrays([
            pa.array([d for d, _, _ in held[:-1]], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
            pa.array([as_text(f) for f in own[:-1]], pa.string()), pa.array([as_text(f) for f in new], pa.string()),
            pa.array([containment(a, b) for a, b in zip(own, new)], pa.float64()),
            pa.array([containment(a, b) for a, b in zip(own, own[1:])], pa.float64()),
        ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches):
        held, over = [], False
        for b in slices(batches, "text", 2 << 20):
            for row in zip(b.column("doc_id").to_pylist(), [t or "" for t in b.column("text").to_pylist()],
                           b.column("halo").to_pylist()):
                if not over:  # of the halo only the first row is anyone's next
                    held.append(row)
                    over = row[2]
            if len(held) > 1:
                yield results(held)
                held = held[-1:]

    return with_next(rows).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                           "edited_fingerprint string, near_edited double, near_next double")
