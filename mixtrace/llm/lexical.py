"""Operator 11: ranked lexical search by norm buckets with exact rescoring.

A document is a sparse vector over the terms of the queries: coordinate t is
its saturated frequency, ``(1e9 * tf) div (1000 * tf + 8 * m)``; a query's
coordinate is its count of t times the weight of t.  Scores are the inner
products, in 64-bit integers.

1. ``vectors``: every document is split into terms once; kept are its number of
   terms and the frequencies of query terms (written to the shared folder).
2. Corpus counts (documents, terms, documents of each query term) are
   aggregates; they give the weights.
3. The vectors are ordered by length (range partitions, longest first).  Some
   of the longest are scored first: the k-th best score of a query so far is a
   threshold that its answers can't be below.
4. Each task cuts its vectors into buckets of similar length.  By
   Cauchy-Schwarz a bucket whose longest vector times the query's length is
   below the threshold is left out.  Inside a bucket the query's heaviest
   coordinates are taken one after the other: the product so far plus the
   lengths of what remains of both vectors bounds the score, and documents
   below the threshold fall out.  The rest are scored exactly in integers, and
   the threshold rises with them.

Bounds are doubles with a margin above their rounding; they only decide what is
scored, never a score.  Equal scores are never pruned.

Queries are held in memory by every task, so they go in blocks of about
``BLOCK_BYTES`` of text (counted first), each with a pass of its own.

Defined cases: NULL text has no term, and documents without terms don't count;
rows with one item_id are one item (repeated texts once, different texts
joined); every document row is ranked by itself, also repeated ones; NULL
doc_id comes after all others among equal scores; items without terms, empty
tables: no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import scratch_path
from .common import partitions, pick, slices

TOP = 10
#: Text of one block of queries.
BLOCK_BYTES = 16 << 20
#: Longest vectors that are scored before the others, about.
HEAD = 20_000
#: A bucket ends where vectors get shorter than this part of its longest ...
SHORTER = 0.9
#: ... but holds so many at least, and so many at most.
BUCKET_LEAST, BUCKET_MOST = 512, 4096
#: Relative margin of the bounds above their rounding errors.
MARGIN = 1e-9

#: Everything but digits, letters and bytes of non-ASCII characters is a space; A-Z are lower-cased.
_FOLD = bytes(c if c >= 0x80 or chr(c) in string.digits + string.ascii_lowercase
              else c + 32 if chr(c) in string.ascii_uppercase else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def vectors(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n (terms with repeats), t array<int> (ascending numbers of the
    vocabulary's terms), f array<int> (their frequencies); documents without terms are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {w: i for i, w in enumerate(shared.value)}
        for b in slices(batches, "text", 1 << 20):
            split = [terms(x or b"") for x in b.column("text").to_pylist()]
            n = np.array([len(x) for x in split], np.int64)
            ids = np.fromiter(map(at.get, chain.from_iterable(split), repeat(-1)), np.int64, int(n.sum()))
            doc = np.repeat(np.arange(len(n)), n)[ids >= 0]
            key, freq = np.unique(doc << 32 | ids[ids >= 0], return_counts=True)
            keep = np.flatnonzero(n)
            edge = np.append(0, np.cumsum(np.bincount(key >> 32, minlength=len(n))[keep]))
            lists = [pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(x.astype(np.int32)))
                     for x in (key & 0xFFFFFFFF, freq)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(keep)), pa.array(n[keep]), *lists], ["doc_id", "n", "t", "f"])

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return rows.mapInArrow(run, "doc_id long, n long, t array<int>, f array<int>")


def saturated(n_docs: int, n_terms: int) -> Column:
    """array<long>: the coordinates of a document."""
    m = f"(25L + (75L * n * {n_docs}L) div {n_terms}L)"
    return F.expr(f"transform(f, x -> (1000000000L * x) div (1000L * x + 8L * {m}))")


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    """The integer weight of each term, from the number of documents that hold it."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


class Query:
    """A query's coordinates, heaviest first."""

    def __init__(self, counts: dict[int, int], w: np.ndarray):
        t = np.array(sorted(counts), np.int64)
        v = np.array([counts[int(i)] for i in t], np.int64) * w[t]
        heavy = np.lexsort((t, -v))
        self.t, self.v = t[heavy], v[heavy]
        square = self.v.astype(float) ** 2
        self.length = math.sqrt(square.sum())
        #: Length of what is left after the first i coordinates.
        self.left = np.sqrt(np.append(np.cumsum(square[::-1])[::-1], 0.0))


class Best:
    """The k best rows of each query so far, and the score that a row must reach."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.astype(np.int64)  # at least 1: a score is above 0
        none = np.zeros(0, np.int64)
        self.rows = [(none, none, none.astype(bool)) for _ in range(n)]

    def add(self, q: int, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        ok = score >= self.floor[q]
        if not ok.any():
            return
        score, ids, null = (np.concatenate([a, b[ok]]) for a, b in zip(self.rows[q], (score, ids, null)))
        first = np.lexsort((ids, null, -score))[:self.k]
        self.rows[q] = score[first], ids[first], null[first]
        if len(first) == self.k:
            self.floor[q] = max(self.floor[q], int(score[first[-1]]))


class Bucket:
    """Vectors of similar length: rows, and postings by term."""

    def __init__(self, ids, null, length, edge, t, v):
        self.ids, self.null, self.length, self.edge, self.t, self.v = ids, null, length, edge, t, v
        order = np.argsort(t, kind="stable")
        self.by_term, self.value = t[order], v[order]
        self.row = np.repeat(np.arange(len(ids)), np.diff(edge))[order]

    def survivors(self, q: Query, floor: int) -> np.ndarray:
        """Rows whose bound reaches the floor."""
        a, b = np.searchsorted(self.by_term, q.t, "left"), np.searchsorted(self.by_term, q.t, "right")
        product, square = np.zeros(len(self.ids)), self.length ** 2
        alive, look = np.arange(len(self.ids)), 1
        for i in range(len(q.t)):
            rows, v = self.row[a[i]:b[i]], self.value[a[i]:b[i]].astype(float)  # a term is once in a row
            product[rows] += q.v[i] * v
            square[rows] -= v * v
            if i + 1 == look or i + 1 == len(q.t):
                look *= 2
                # squares of what is left are differences: their rounding is relative to the whole length
                rest = np.sqrt(np.maximum(square[alive], 0) + MARGIN * self.length[alive] ** 2)
                bound = (product[alive] + q.left[i + 1] * rest) * (1 + MARGIN) + 1
                alive = alive[bound >= floor]
                if len(alive) * 64 < len(self.ids):
                    break
        return alive

    def scores(self, q: Query, rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Exact scores of the given rows; ``dense`` is zero and left so."""
        dense[q.t] = q.v
        size = np.diff(self.edge)[rows]
        stop = np.cumsum(size)
        at = np.arange(stop[-1]) + np.repeat(self.edge[rows] - (stop - size), size)
        total = np.concatenate([[0], np.cumsum(dense[self.t[at]] * self.v[at])])
        dense[q.t] = 0
        return total[stop] - total[stop - size]


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[Bucket]:
    """Consecutive rows, longest first, cut by length."""
    for b in batches:
        length = b.column("length").to_numpy(zero_copy_only=False)
        lists = b.column("t"), b.column("v")
        edge = lists[0].offsets.to_numpy().astype(np.int64)
        t = lists[0].values.to_numpy(zero_copy_only=False).astype(np.int64)
        v = lists[1].values.to_numpy(zero_copy_only=False)
        null = b.column("doc_id").is_null().to_numpy(zero_copy_only=False)
        ids = b.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
        start = 0
        while start < len(ids):
            short = np.flatnonzero(length[start:start + BUCKET_MOST] < SHORTER * length[start])
            stop = start + (max(BUCKET_LEAST, int(short[0])) if len(short) else BUCKET_MOST)
            stop = min(stop, len(ids))
            yield Bucket(ids[start:stop], null[start:stop], length[start:stop], edge[start:stop + 1] - edge[start],
                         t[edge[start]:edge[stop]], v[edge[start]:edge[stop]])
            start = stop


def _scan(ordered: DataFrame, queries, w, floor: np.ndarray, k: int) -> DataFrame:
    """Each task's k best rows of each query: q, doc_id, score, and scored, the
    number of documents that the task scored for the query."""
    shared = ordered.sparkSession.sparkContext.broadcast((queries, w, floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, w, floor = shared.value
        qs = [Query(c, w) for c in counts]
        best, dense = Best(len(qs), k, floor), np.zeros(len(w), np.int64)
        lengths = np.array([q.length for q in qs])
        scored = np.zeros(len(qs), np.int64)
        for bucket in _buckets(batches):
            reach = lengths * bucket.length.max() * (1 + MARGIN) + 1
            for i in np.flatnonzero(reach >= best.floor):
                rows = bucket.survivors(qs[i], best.floor[i])
                if len(rows):
                    scored[i] += len(rows)
                    best.add(i, bucket.scores(qs[i], rows, dense), bucket.ids[rows], bucket.null[rows])
        size = [len(r[0]) for r in best.rows]
        if sum(size):
            score, ids, null = (np.concatenate([r[i] for r in best.rows]) for i in range(3))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(qs), dtype=np.int32), size)), pa.array(ids, mask=null), pa.array(score),
                 pa.array(np.repeat(scored, size))], ["q", "doc_id", "score", "scored"])

    return ordered.mapInArrow(run, "q int, doc_id long, score long, scored long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _search(docs: DataFrame, items: list, k: int) -> DataFrame:
    """One block: ``items`` are (item_id, its terms)."""
    spark = docs.sparkSession
    vocabulary = sorted(set().union(*[x for _, x in items]))
    at = {w: i for i, w in enumerate(vocabulary)}
    queries = [dict(Counter(at[x] for x in ts)) for _, ts in items]
    path = scratch_path(spark, "lexical-vectors")
    vectors(docs, vocabulary).write.parquet(path)
    vec = spark.read.parquet(path)
    n_docs, n_terms = vec.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for t, n in vec.select(F.explode("t").alias("t")).groupBy("t").count().collect():  # a row per term of the block
        df[t] = n
    w = weights(n_docs, df)
    rows = vec.withColumn("v", saturated(n_docs, max(n_terms, 1))).filter(F.size("t") > 0)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = rows.select("doc_id", "t", "v", length.alias("length"))
    cut = rows.agg(F.percentile_approx("length", 1 - min(1.0, HEAD / max(n_docs, 1)), 10_000)).first()[0] or 0.0
    order = [F.col("length").desc(), F.xxhash64("doc_id", "t", "v")]

    def scan(part, floor):
        return _scan(part.sortWithinPartitions(*order), queries, w, floor, k)

    floor = np.ones(len(queries), np.int64)
    head = _ranked(scan(rows.filter(F.col("length") >= cut), floor), k).filter(F.col("rank") == k)
    for r in head.select("q", "score").collect():  # a number per query
        floor[r.q] = max(1, r.score)
    found = _ranked(scan(rows.repartitionByRange(partitions(spark), *order), floor), k)
    names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(items)], "q int, item_id string")
    return found.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of each item."""
    kind = pick(items, "item_id").schema["item_id"].dataType
    it = pick(items, "item_id", "text").filter(F.col("text").isNotNull()).distinct()
    size = it.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    many = max(1, -(-size // block_bytes))
    block = F.pmod(F.xxhash64("item_id"), F.lit(many))
    out = []
    for b in range(many):
        texts: dict = {}
        for r in it.filter(block == b).select(F.col("item_id").cast("string").alias("i"), "text").collect():
            texts.setdefault(r.i, []).extend(terms(r.text.encode()))
        held = [(i, x) for i, x in sorted(texts.items(), key=lambda e: (e[0] is None, e[0])) if x]
        if held:
            out.append(_search(docs, held, k))
    if not out:
        return docs.sparkSession.createDataFrame([], "item_id string, rank int, doc_id long, score long") \
            .withColumn("item_id", F.col("item_id").cast(kind))
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found.withColumn("item_id", F.col("item_id").cast(kind))


def oracle_sql(documents: str = "documents", benchmark: str = "benchmark", k: int = TOP) -> str:
    """DuckDB SQL for the query."""
    split = (f"coalesce(regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), "
             r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])")
    return f"""
with d as (select doc_id, row_number() over () as r, {split} as x from {documents}),
c as (select count(*)::bigint as n_docs, sum(len(x))::bigint as n_terms from d where len(x) > 0),
p as (select r, term, count(*)::bigint as tf from (select r, unnest(x) as term from d) group by all),
w as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w
      from p, c group by term, n_docs),
q as (select item_id, term, count(*)::bigint as times
      from (select item_id, unnest({split}) as term from (select distinct item_id, text from {benchmark})) group by all),
m as (select r, doc_id, 25 + (75 * len(x) * n_docs) // n_terms as m from d, c where len(x) > 0),
s as (select q.item_id, m.r, any_value(m.doc_id) as doc_id,
             sum(q.times * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * m.m)))::bigint as score
      from q join w using (term) join p using (term) join m on m.r = p.r group by q.item_id, m.r),
o as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
      from s where score > 0)
select * from o where rank <= {k}"""
