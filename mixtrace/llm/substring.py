"""Operator 3: substring dedup by minimizer paths (in place of De Bruijn compaction, see the README).

Words are symbols; a window of ``WINDOW`` words is an edge between the runs of
words it starts and ends with.  A window is removed (all its words) if the
same words also start in a document with a smaller doc_id.

1. Compaction inside a document: the smallest of a window's k-mer hashes (k =
   25, the leftmost of equal ones) is its anchor, a function of its words
   alone.  Consecutive windows with the same anchor are one path of up to 26
   edges, kept as (anchor, 128-bit hash of its words, source coordinates):
   about one row per 13 words instead of one per word.
2. Across documents, one partial aggregate per anchor finds the smallest and
   largest document and whether all its paths are equal.  If so nothing
   branches at the anchor, and every path of a document above the smallest is
   a repeat, by the hash of the whole path.
3. At a branching anchor paths overlap in part.  Each distinct path's windows
   are hashed once, at the source coordinates of its first document, a join on
   the window hashes finds each window's smallest document, and the path's
   occurrences look their windows up there.
4. The spans found are joined to the texts and removed.

Nothing is emitted in pairs: rows are paths of documents, distinct paths and
distinct windows of branching paths.  Anchors held by very many documents are
pre-aggregated, and the joins are sort-merge joins whose hot keys AQE splits.

Defined cases: NULL text has no words; rows with NULL doc_id keep all words and
remove none (NULL isn't smaller than anything); rows that share a doc_id don't
remove each other's words and are told apart by a hash of their text; a
window repeated inside one document only stays; an empty table gives an empty
result; extra columns are ignored (``apply``: kept).
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import UnitCache, claim, pick, positional, slices

WINDOW = 50
_M = (1 << 64) - 1
#: Odd multipliers of the two rolling hashes, and the constants of the finaliser.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

_powers: list[tuple[np.ndarray, np.ndarray]] = []
_words: UnitCache | None = None


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """base^i and base^-i for i < n, both bases."""
    if not _powers or len(_powers[0][0]) < n:
        size, out = max(n, 1 << 20), []
        for b in _BASES:
            pair = []
            for x in (b, pow(b, -1, 1 << 64)):
                p = np.full(size, x, np.uint64)
                p[0] = 1
                pair.append(np.cumprod(p, dtype=np.uint64))
            out.append(tuple(pair))
        _powers[:] = out
    return _powers


def _drop() -> None:
    global _words
    _words = None
    _powers.clear()


def word_hashes(words: list[bytes]) -> np.ndarray:
    global _words
    if _words is None:
        claim("substring", _drop)
        from xxhash import xxh64_intdigest

        _words = UnitCache(xxh64_intdigest)
    _words.trim()
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


class Rolling:
    """128-bit hashes of runs of a slice's words."""

    def __init__(self, h: np.ndarray):
        self.tables = _power_tables(len(h) + 1)
        self.sums = []
        for t, (up, _) in zip((h, _mixed(h ^ np.uint64(_BASES[0]))), self.tables):
            s = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(t * up[:len(h)], dtype=np.uint64, out=s[1:])
            self.sums.append(s)

    def of(self, start: np.ndarray | slice, size, which: int) -> np.ndarray:
        s, (_, down) = self.sums[which], self.tables[which]
        if isinstance(start, slice):
            return _mixed((s[start.start + size:start.stop + size] - s[start]) * down[start])
        return _mixed(((s[start + size] - s[start]) * down[start]) ^ np.asarray(size, np.uint64))


def shape(window: int) -> tuple[int, int]:
    """k of the k-mers and the most windows of a path."""
    k = max(1, window // 2, window - 30)
    return k, window - k + 1


def paths(h: np.ndarray, edges: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Word hashes of a slice's documents end to end, and where each ends ->
    start, windows, anchor, s1, s2 of every path."""
    k, most = shape(window)
    n = len(h) - window + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, np.uint64))
    roll = Rolling(h)
    kmers = roll.of(slice(0, len(h) - k + 1), k, 0)
    anchor = np.lib.stride_tricks.sliding_window_view(kmers, most)[:n].argmin(axis=1) + np.arange(n)
    # windows that cross a document's end don't count
    ends = np.repeat(edges, np.diff(edges, prepend=0))[:n]
    valid = np.arange(n) + window <= ends
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    start = np.flatnonzero(first)
    last = valid.copy()
    last[:-1] &= ~valid[1:] | first[1:]
    count = np.flatnonzero(last) - start + 1
    size = count + window - 1
    return start, count, kmers[anchor[start]], roll.of(start, size, 0), roll.of(start, size, 1)


def _tag(text: str) -> int:
    """26 bits that tell rows with the same doc_id apart."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(text.encode()) >> 38


def _occurrences(docs: DataFrame, window: int) -> DataFrame:
    """doc, at (tag, windows and position in one long), m, s1, s2: every path."""

    def run(batches):
        for b in slices(batches, "text", 2 << 20):
            texts = b.column("text").to_pylist()
            words = [t.encode().split() for t in texts]
            sizes = np.array([len(w) for w in words], np.int64)
            edges = np.cumsum(sizes)
            start, count, m, s1, s2 = paths(word_hashes([w for x in words for w in x]), edges, window)
            doc = np.searchsorted(edges, start, side="right")
            tags = np.array([_tag(t) for t in texts], np.int64)
            at = tags[doc] << 37 | count << 32 | start - (edges - sizes)[doc]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(doc)), pa.array(at), *[pa.array(x.view(np.int64)) for x in (m, s1, s2)]],
                ["doc", "at", "m", "s1", "s2"])

    rows = pick(docs, "doc_id", "text").selectExpr("cast(doc_id as long) doc_id", "text")
    rows = rows.filter("doc_id is not null and text is not null")
    return rows.mapInArrow(run, "doc long, at long, m long, s1 long, s2 long")


def _kept_table(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: columns, compressed."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _windows(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """wanted: one row per distinct branching path, at its first document ->
    s1, s2, i, low, w1, w2: its windows' hashes, read from that text."""
    lists = wanted.groupBy("low").agg(F.collect_list(F.struct("at", "s1", "s2")).alias("paths"))
    rows = pick(docs, "doc_id", "text").selectExpr("cast(doc_id as long) low", "text").filter("text is not null")

    def run(batches):
        for b in slices(batches, "text", 2 << 20):
            out = []
            for low, text, wanted in zip(*(b.column(c).to_pylist() for c in ("low", "text", "paths"))):
                tag, h = _tag(text), None
                mine = [p for p in wanted if p["at"] >> 37 == tag]
                if not mine:
                    continue
                h = word_hashes(text.encode().split())
                roll = Rolling(h)
                at = np.array([p["at"] for p in mine], np.int64)
                count, pos = at >> 32 & 31, at & 0xFFFFFFFF
                which = np.repeat(np.arange(len(at)), count)
                i = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
                start = pos[which] + i
                s = np.array([[p["s1"], p["s2"]] for p in mine], np.int64)[which]
                out.append((s[:, 0], s[:, 1], i, np.full(len(i), low, np.int64),
                            roll.of(start, window, 0).view(np.int64), roll.of(start, window, 1).view(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)],
                                                 ["s1", "s2", "i", "low", "w1", "w2"])

    return rows.join(lists, "low").mapInArrow(run, "s1 long, s2 long, i long, low long, w1 long, w2 long")


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc, tag, spans array<struct<pos, mask>>: bit i of mask stands for the
    window that starts at word pos + i and also starts in a smaller document."""
    occ = _kept_table(_occurrences(docs, window), "paths")
    anchors = occ.groupBy("m").agg(F.min("doc").alias("low"), F.max("doc").alias("high"),
                                   *[f(s).alias(f"{s}_{f.__name__}") for s in ("s1", "s2") for f in (F.min, F.max)]).filter("low < high")
    branches = (F.col("s1_min") != F.col("s1_max")) | (F.col("s2_min") != F.col("s2_max"))
    # joins with written tables: AQE splits hot keys of plain sort-merge joins only
    anchors = _kept_table(anchors.select("m", "low", branches.alias("branches")), "anchors")
    hit = _kept_table(occ.join(anchors, "m").filter("branches or doc > low"), "repeated-paths")
    plain = hit.filter("not branches").select(
        "doc", "at", F.expr("shiftleft(1L, cast(shiftright(at, 32) & 31 as int)) - 1").alias("mask"))
    wanted = hit.filter("branches").groupBy("s1", "s2").agg(F.min("doc").alias("low"), F.min_by("at", "doc").alias("at"))
    wins = _kept_table(_windows(docs, wanted, window), "branch-windows")
    first = _kept_table(wins.groupBy("w1", "w2").agg(F.min("low").alias("first")), "windows")
    lows = _kept_table(wins.join(first, ["w1", "w2"]).groupBy("s1", "s2")
                       .agg(F.collect_list(F.struct("i", "first")).alias("firsts")), "path-windows")
    branch = (hit.filter("branches").join(lows, ["s1", "s2"])
              .select("doc", "at", F.expr("aggregate(firsts, 0L, (a, x) -> if(x.first < doc, a | shiftleft(1L, cast(x.i as int)), a))")
                      .alias("mask")).filter("mask != 0"))
    spans = plain.unionByName(branch)
    return spans.groupBy("doc", F.expr("shiftright(at, 37)").alias("tag")).agg(
        F.collect_list(F.struct(F.expr("at & 4294967295L").alias("pos"), "mask")).alias("spans"))


def _keep(n: int, spans: list[dict] | None, window: int) -> np.ndarray | None:
    """True for each of n words that stays; None if all do."""
    if not spans:
        return None
    pos = np.array([s["pos"] for s in spans], np.int64)
    mask = np.array([s["mask"] for s in spans], np.int64)
    bit, which = np.nonzero(mask[None, :] >> np.arange(31)[:, None] & 1)
    start = pos[which] + bit
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + window, -1)
    return np.cumsum(cover)[:n] == 0


def _joined(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with positional names, and the spans of each row, or NULL.  The
    lists of the rows that share a doc_id come together; the tag chooses."""
    by_doc = found.groupBy("doc").agg(F.collect_list(F.struct("tag", "spans")).alias("_found"))
    plain, at, _ = positional(docs)
    key = F.col(at["doc_id"]).cast("long")
    return plain.join(by_doc, key == F.col("doc"), "left").drop("doc")


def _spans(found: list[dict] | None, text: str) -> list[dict] | None:
    if not found:
        return None
    tag = _tag(text)
    return next((f["spans"] for f in found if f["tag"] == tag), None)


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    rows = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))

    def run(batches):
        for b in slices(batches, "_1"):
            out = ([], [], [])
            for text, found in zip(b.column("_1").to_pylist(), b.column("_found").to_pylist()):
                words = (text or "").encode().split()
                keep = _keep(len(words), _spans(found, text or ""), window)
                kept = words if keep is None else [w for w, k in zip(words, keep.tolist()) if k]
                out[0].append(len(words))
                out[1].append(len(words) - len(kept))
                out[2].append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("_0"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _joined(rows, repeats(rows, window)).mapInArrow(
        run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


_WITH_SPACE = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def apply(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the repeated words, and the white space after each, taken
    out of text (n_chars, if there, follows); rows without repeats unchanged."""
    joined = _joined(docs, repeats(docs, window))
    _, at, names = positional(docs)
    text = int(at["text"][1:])

    def run(batches):
        for b in slices(batches, f"_{text}"):
            new = []
            for t, found in zip(b.column(f"_{text}").to_pylist(), b.column("_found").to_pylist()):
                spans = _spans(found, t) if t is not None else None
                if spans:
                    data = t.encode()
                    words = _WITH_SPACE.findall(data)
                    keep = _keep(len(words), spans, window).tolist()
                    lead = data[:len(data) - sum(map(len, words))]
                    t = (lead + b"".join([w for w, k in zip(words, keep) if k])).decode()
                new.append(t)
            columns = [b.column(f"_{i}") for i in range(len(names))]
            columns[text] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, [f"_{i}" for i in range(len(names))])

    plain, _, _ = positional(docs)
    out = joined.mapInArrow(run, plain.schema)
    if "n_chars" in at:
        length = F.length(at["text"]).cast(plain.schema[at["n_chars"]].dataType)
        out = out.withColumn(at["n_chars"], F.when(F.col(at["text"]).isNull(), F.col(at["n_chars"])).otherwise(length))
    return out.toDF(*names)
