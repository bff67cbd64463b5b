"""Operator 12: alignment of two tokenizers' tokens by merge-path partitioning.

Tokenizer A (byte-level BPE) encodes a space and the text, tokenizer B
(SentencePiece) the text, to which it adds the space itself; both token
sequences then cut the same bytes.  The ends of A and B of a whole slice of
documents are two ascending lists.  Their merge is cut along diagonals
``i + j = d``: a binary search finds, for each, how many ends of either list
come first, so every piece merges the same number of ends, whatever the
documents' lengths.  A piece stands by itself: with one token after it on
either side it knows which A token and which B token overlap before each end
it holds (a link), and the ends both lists share, which cut the text into
groups.  The groups that a piece leaves open at its borders are stitched to
those of its neighbours.

``align`` gives the per-document tokens, groups and links.  Links are counted
corpus-wide by pairs of ids: documents carry their distinct pairs with their
times, which are exploded, added up by Spark, and met again by a join
(broadcast within ``BROADCAST_PAIRS`` counted rows, a shuffle join beyond).

Token bytes: A's entries are byte-level decoded; B's pieces are UTF-8 with
U+2581 as a space and ``<0xHH>`` as that byte.

Defined cases: texts that are NULL or empty, or whose joined A or B bytes differ
from space and text, have no tokens (zeros, an empty group text); every row is
aligned by itself, also rows without doc_id and repeated rows; an empty table
gives an empty result; extra columns are ignored.  Memory: one slice of about
1 MB of text or one longer text; whole texts are encoded.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut, scratch_path
from .common import claim, pick, slices
from .sentencepiece_codec import Model, SPACE

#: Ends that a piece merges.
PIECE = 1 << 15
#: Rows of the table of pairs that may be broadcast.
BROADCAST_PAIRS = 1_000_000
#: Pre-token rule of byte-level files (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for
    themselves, the other bytes for the characters from U+0100 on, in order."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in same]
    return {chr(b): b for b in same} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Tokenizer A: ids of whole texts, and the bytes of each id.

    Where the file's merges are in the order of the ids they make, they are the
    ranks of the same byte-pair encoding in the tiktoken library, which gives the
    same ids in less time; any other file is encoded by its own library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, at = spec.get("pre_tokenizer") or {}, byte_alphabet()
        vocab, special = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.bytes = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in (vocab | special).items():
            self.bytes[i] = bytes(at[c] for c in token) if all(c in at for c in token) else token.encode()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"].get("merges") or []]
        made = [vocab.get(x + y) for x, y in merges]
        ranks = {self.bytes[i]: i for t, i in vocab.items() if t not in special}
        #: Every byte has an id and nothing is changed before: the ids spell any text.
        self.lossless = (pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer")
                         and all(bytes([b]) in ranks for b in range(256)))
        self.core = None
        if (self.lossless and pre.get("use_regex", True) and made == list(range(256, 256 + len(made)))
                and len(ranks) == 256 + len(made)):
            import tiktoken

            self.core = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if self.core is not None:
            return [self.core.encode_to_numpy(t, disallowed_special=()).astype(np.int32) for t in texts]
        return [np.asarray(e.ids, np.int32) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]


def piece_bytes(model: Model) -> list[bytes]:
    """Bytes of each id of tokenizer B."""
    sp = model.sp
    return [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i)
            else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(sp.get_piece_size())]


class Pair:
    """Both tokenizers, with what the merge needs of their vocabularies."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.model = ByteLevel(path_a), Model(path_b)
        self.bytes = self.a.bytes, piece_bytes(self.model)
        self.size = [np.array([len(x) for x in table], np.int64) for table in self.bytes]
        # an id's text in a group, with what follows it: another id, or the end of its side
        self.text = [np.array([f"{i}{s}" for i in range(len(table)) for s in (",", end)], object)
                     for table, end in zip(self.bytes, "|;")]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Both id sequences of each text; empty if either doesn't spell the text."""
        first = self.a.ids([" " + t for t in texts])
        second = [x[:-1] for x in self.model.ids(texts)]  # without the end id
        none = np.zeros(0, np.int32)
        for k, t in enumerate(texts):
            raw = b" " + t.encode()
            if not t or self._joined(1, second[k]) != raw or not (self.a.lossless or self._joined(0, first[k]) == raw):
                first[k] = second[k] = none
        return first, second

    def _joined(self, side: int, ids: np.ndarray) -> bytes:
        table = self.bytes[side]
        return b"".join([table[i] for i in ids.tolist()])


@lru_cache(maxsize=1)
def _load(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def tokenizers(path_a: str, path_b: str) -> Pair:
    """Loaded once per Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    claim("alignment", _load.cache_clear)
    return _load(path_a, path_b)


def diagonals(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> list[tuple[int, int]]:
    """Borders (i, j) of the merge's pieces of ``piece`` ends each: i of a's and
    j of b's ends come first.  Each is found by itself, by binary search along
    its diagonal; an end of both lists is never cut in two."""
    n, m = len(a), len(b)
    out = [(0, 0)]
    for d in range(piece, n + m, piece):
        low, high = max(0, d - m), min(d, n)
        while low < high:  # the first i whose end isn't among the d smallest
            i = (low + high) // 2
            low, high = (i + 1, high) if a[i] <= b[d - i - 1] else (low, i)
        i, j = low, d - low
        if i and j < m and a[i - 1] == b[j]:
            j += 1
        out.append((i, j))
    return [*out, (n, m)]


def merge_piece(a: np.ndarray, b: np.ndarray, start: tuple[int, int], stop: tuple[int, int]) -> tuple[np.ndarray, ...]:
    """One piece, by its own ends alone: for each distinct end, the number of
    the A and the B token that overlap just before it (the next of a side, if
    it has no such end left), and the pairs of token numbers that end together."""
    (i0, j0), (i1, j1) = start, stop
    own_a, own_b = a[i0:i1], b[j0:j1]
    ends = np.concatenate([own_a, own_b])
    ends.sort(kind="stable")  # two ascending runs: one merge
    if len(ends):
        ends = ends[np.append(True, ends[1:] != ends[:-1])]
    link_a, link_b = np.searchsorted(own_a, ends), np.searchsorted(own_b, ends)
    both = np.zeros(len(ends), bool)
    inside = (link_a < len(own_a)) & (link_b < len(own_b))
    both[inside] = own_a[link_a[inside]] == own_b[link_b[inside]]
    return link_a + i0, link_b + j0, link_a[both] + i0, link_b[both] + j0


class Slice:
    """The tokens of some documents, aligned."""

    def __init__(self, pair: Pair, texts: list[str], piece: int = PIECE):
        ids = pair.encode(texts)
        self.n_a, self.n_b = (np.array([len(x) for x in side], np.int64) for side in ids)
        self.a, self.b = (np.concatenate([*side, np.zeros(0, np.int32)]).astype(np.int64) for side in ids)
        # the documents' bytes follow each other, so a document's last end is an end of both lists
        ends = [np.cumsum(size[x]) for size, x in zip(pair.size, (self.a, self.b))]
        border = diagonals(*ends, piece)
        parts = [merge_piece(*ends, x, y) for x, y in zip(border, border[1:])]
        self.link_a, self.link_b = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        # stitched: a group reaches from the last common end, of whatever piece, to this one
        self.stop_a, self.stop_b = (np.concatenate([p[k] for p in parts]) + 1 for k in (2, 3))
        doc = np.repeat(np.arange(len(texts)), self.n_a)
        self.link_doc = doc[self.link_a]
        self.n_links = np.bincount(self.link_doc, minlength=len(texts))
        self.n_groups = np.bincount(doc[self.stop_a - 1], minlength=len(texts))
        self.text = pair.text

    def group_texts(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each document."""
        flags = [np.zeros(len(x), np.int64) for x in (self.a, self.b)]
        for flag, stop in zip(flags, (self.stop_a, self.stop_b)):
            flag[stop - 1] = 1
        size_a, size_b = np.diff(self.stop_a, prepend=0), np.diff(self.stop_b, prepend=0)
        out = np.empty(len(self.a) + len(self.b), object)
        # an id stands after its own side's ids and the other side's ids of the groups before (and, for B, of its own)
        out[np.arange(len(self.a)) + np.repeat(self.stop_b - size_b, size_a)] = self.text[0][2 * self.a + flags[0]]
        out[np.arange(len(self.b)) + np.repeat(self.stop_a, size_b)] = self.text[1][2 * self.b + flags[1]]
        edge = np.append(0, np.cumsum(self.n_a + self.n_b)).tolist()
        listed = out.tolist()
        return ["".join(listed[x:y])[:-1] for x, y in zip(edge, edge[1:])]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct id pairs of each document, ``a << 32 | b`` ascending, their
        times, and the number of pairs of each document."""
        kind = np.unique(self.a[self.link_a] << 32 | self.b[self.link_b])  # of the slice: numbered, to sort small keys
        at = np.searchsorted(kind, self.a[self.link_a] << 32 | self.b[self.link_b])
        key, times = np.unique(self.link_doc * len(kind) + at, return_counts=True)
        n = np.bincount(key // max(len(kind), 1), minlength=len(self.n_a)) if len(key) else np.zeros(len(self.n_a), np.int64)
        return kind[key % max(len(kind), 1)] if len(key) else kind, times, n


ALIGNED = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
           "groups_sha256 string, pairs array<long>, times array<int>")


def align(docs: DataFrame, path_a: str, path_b: str, piece: int = PIECE, texts: bool = False) -> DataFrame:
    """A row per document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256,
    its distinct pairs and their times; with ``texts`` also the groups.  ``row``
    tells rows apart; it is stable once the result is written."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pair = tokenizers(path_a, path_b)
        row = TaskContext.get().partitionId() << 40
        for b in slices(batches, "text", 1 << 20):
            s = Slice(pair, [t or "" for t in b.column("text").to_pylist()], piece)
            groups = s.group_texts()
            key, times, n = s.pairs()
            edge = pa.array(np.append(0, np.cumsum(n)), pa.int32())
            cols = [pa.array(np.arange(row, row + len(groups))), b.column("doc_id"), *map(pa.array, (s.n_a, s.n_b, s.n_groups, s.n_links)),
                    pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups], pa.string()),
                    pa.ListArray.from_arrays(edge, pa.array(key)), pa.ListArray.from_arrays(edge, pa.array(times.astype(np.int32)))]
            names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
            if texts:
                cols, names = [*cols, pa.array(groups, pa.string())], [*names, "groups"]
            row += len(groups)
            yield pa.RecordBatch.from_arrays(cols, names)

    rows = pick(docs, "doc_id", "text").selectExpr("cast(doc_id as long) doc_id", "text")
    return rows.mapInArrow(run, ALIGNED + (", groups string" if texts else ""))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Materialised (pair, a, b, n, best): the links of each id pair in the whole
    corpus, and whether no other pair of its B id has more."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("p.pairs", "p.times")
    n = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n"))
    n = n.withColumns({"a": F.shiftright("pair", 32), "b": F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))})
    most = F.max("n").over(Window.partitionBy("b"))  # at most A's vocabulary for each B id
    return cut(n.withColumn("best", F.col("n") == most))


def score(docs: DataFrame, path_a: str, path_b: str, piece: int = PIECE, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    path = scratch_path(docs.sparkSession, "alignment")
    align(docs, path_a, path_b, piece).write.parquet(path)
    aligned = docs.sparkSession.read.parquet(path)
    counts = pair_counts(aligned)
    known = counts.select("pair", "n", "best")
    if counts.count() <= broadcast_pairs:
        known = F.broadcast(known)
    each = aligned.select("row", F.explode_outer(F.arrays_zip("pairs", "times")).alias("p")) \
        .select("row", F.col("p.pairs").alias("pair"), F.col("p.times").cast("long").alias("times"))
    sums = each.join(known, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return aligned.join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
