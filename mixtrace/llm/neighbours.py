"""Operator 7: approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample (``SAMPLE`` vectors, by a hash) and
splits each node into ``BRANCH`` clusters until a leaf would hold about
``LEAF`` rows of the whole table; every row of the table is then sent down to
its leaf.  A query walks the tree best bin first: a priority queue holds the
nodes seen, nearest centre first, and leaves are visited in that order.  How
many leaves is calibrated: true neighbours of ``PROBES`` rows are found by
brute force, and visits are widened until the share of them in visited leaves
reaches ``RECALL``.  Leaves can be small, so a query goes on past that many
until those it visits hold k rows besides all rows of its own id.

Largest inner product is nearest distance once every vector gets one more
coordinate, sqrt(M^2 - |x|^2) with M the greatest norm, and the query a zero.

Leaves next to each other in the tree share a shard of about ``BLOCK`` rows; a
leaf that holds more (equal vectors can't be split) is cut by a hash into
shards of its own.  A query goes to each shard that holds leaves it visits,
once, with those leaves, and brings back its k best there.  Queries of a shard
are cut by a hash into blocks of about ``BLOCK`` too, so neither side of a
task is unbounded.  Rows are chosen by matrix product; the scores returned, and
ties, are computed pair by pair in double precision in a fixed order, so equal
vectors have equal scores.

Defined cases: vectors that are NULL, empty, zero, hold NULL or non-finite
components, or have another length than most, and rows without vec_id take no
part; rows with the query's vec_id are its own; of repeated query ids one
(the smallest vector) asks; repeated candidate rows are found as often as they
are there; fewer candidates than k are all found (every leaf is visited);
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import scratch_path
from .common import partitions, pick

K = 20
EVERY = 20
SAMPLE = 20_000
BRANCH = 8
LEAF = 256
PROBES = 256
RECALL = 0.95
BLOCK = 16_384
ROUNDS = 8


@dataclass
class Tree:
    """centre[i], children[i] (empty: a leaf), leaf number (or -1) of every node."""

    scale: float
    centres: np.ndarray
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)

    @property
    def leaves(self) -> int:
        return max(self.leaf, default=-1) + 1

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Rows with the coordinate that makes all norms equal."""
        rest = np.maximum(self.scale ** 2 - np.einsum("ij,ij->i", x, x), 0)
        return np.column_stack([x, np.sqrt(rest)])

    def aim(self, q: np.ndarray) -> np.ndarray:
        """Queries at the same norm, whose best rows are the nearest ones."""
        return np.column_stack([q * (self.scale / np.linalg.norm(q, axis=1))[:, None], np.zeros(len(q))])

    def place(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each lifted row: the nearest centre at every level."""
        node = np.zeros(len(x), np.int64)
        todo = np.arange(len(x))
        while len(todo):
            nxt = []
            for n in np.unique(node[todo]):
                at = todo[node[todo] == n]
                kids = self.children[n]
                if kids:
                    node[at] = np.asarray(kids)[_nearest(x[at], self.centres[kids])]
                    nxt.append(at)
            todo = np.concatenate(nxt) if nxt else np.zeros(0, np.int64)
        return np.asarray(self.leaf)[node]

    def visit(self, q: np.ndarray, most: int, rows_of: np.ndarray | None = None, need: int = 0) -> list[int]:
        """The first ``most`` leaves of one aimed query, best bin first; with
        ``rows_of`` (rows of each leaf) more, until they hold ``need`` rows."""
        queue, out, held = [(0.0, 0)], [], 0
        while queue and (len(out) < most or rows_of is not None and held < need):
            _, n = heapq.heappop(queue)
            kids = self.children[n]
            if not kids:
                out.append(self.leaf[n])
                held += int(rows_of[self.leaf[n]]) if rows_of is not None else 0
                continue
            d = ((self.centres[kids] - q) ** 2).sum(axis=1)
            for x in zip(d.tolist(), kids):
                heapq.heappush(queue, x)
        return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres ** 2).sum(axis=1)[None, :] - 2 * x @ centres.T).argmin(axis=1)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Labels 0..; fewer than k clusters where there are fewer distinct rows."""
    centres = x[rng.integers(len(x))][None, :]
    for _ in range(k - 1):  # seeds far apart
        d = ((x[:, None, :] - centres[None, -1:, :]) ** 2).sum(axis=2)[:, 0]
        best = d if len(centres) == 1 else np.minimum(best, d)  # noqa: F821
        if best.sum() <= 1e-12:
            break
        centres = np.vstack([centres, x[rng.choice(len(x), p=best / best.sum())]])
    for _ in range(ROUNDS):
        label = _nearest(x, centres)
        n = np.bincount(label, minlength=len(centres))
        keep = np.flatnonzero(n)
        sums = np.zeros((len(centres), x.shape[1]))
        np.add.at(sums, label, x)
        centres = sums[keep] / n[keep, None]
    return _nearest(x, centres)


def grow(sample: np.ndarray, scale: float, rows: int, seed: int = 7) -> Tree:
    """The tree of a sample of a table of ``rows`` rows."""
    rng = np.random.default_rng(seed)
    tree = Tree(scale, np.zeros((0, sample.shape[1] + 1)))
    x = tree.lift(sample)
    most = max(16, LEAF * len(x) // max(rows, 1))  # sample rows of a leaf
    centres = [x.mean(axis=0)]
    tree.children.append([])
    stack = [(0, np.arange(len(x)))]
    while stack:
        node, at = stack.pop()
        if len(at) <= most:
            continue
        label = _kmeans(x[at], min(BRANCH, -(-len(at) // most)), rng)
        if label.max() == 0:
            continue
        for k in np.unique(label):
            kid = at[label == k]
            tree.children[node].append(len(centres))
            tree.children.append([])
            stack.append((len(centres), kid))
            centres.append(x[kid].mean(axis=0))
    tree.centres = np.array(centres)
    number = iter(range(len(centres)))
    tree.leaf = [-1 if kids else next(number) for kids in tree.children]
    return tree


def usable(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, v array<double>: the rows that take part."""
    v = pick(rows, id_col, vector).select(F.col(id_col).cast("long").alias("id"),
                                          F.col(vector).cast("array<double>").alias("v"))
    v = v.filter("id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) "
                 "and abs(x) < double('infinity')) and exists(v, x -> x != 0)")
    most = v.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    return v.filter(F.size("v") == (most.d if most else 0))


def _matrix(column) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def _top(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int):
    """(query number, row number, score) of each query's k best rows, own id
    left out; ties to the smaller id."""
    out = ([], [], [])
    for a in range(0, len(q), 256):
        part = q[a:a + 256]
        s = part @ x.T
        s[q_id[a:a + 256, None] == x_id[None, :]] = -np.inf
        cut = -np.partition(-s, min(k, s.shape[1]) - 1, axis=1)[:, min(k, s.shape[1]) - 1]
        near = np.abs(cut) * 1e-9 + 1e-12 * np.linalg.norm(part, axis=1) * np.linalg.norm(x, axis=1).max()
        i, j = np.nonzero((s >= (cut - near)[:, None]) & (s > -np.inf))
        exact = (part[i] * x[j]).sum(axis=1)
        order = np.lexsort((x_id[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        first = np.searchsorted(i, i)
        keep = np.arange(len(i)) - first < k
        for o, v in zip(out, (i[keep] + a, j[keep], exact[keep])):
            o.append(v)
    return tuple(np.concatenate(o) if o else np.zeros(0, np.int64) for o in out)


def _best(rows: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """The k best of each query among (query, id, score, ...); ties to the smaller id."""
    order = np.lexsort((rows[1], -rows[2], rows[0]))
    rows = tuple(c[order] for c in rows)
    keep = np.arange(len(order)) - np.searchsorted(rows[0], rows[0]) < k
    return tuple(c[keep] for c in rows)


def _calibrate(index: DataFrame, probes: np.ndarray, probe_ids: np.ndarray, tree: Tree, k: int, recall: float) -> int:
    """Leaves to visit. Probes are a bounded number of rows; each batch of the
    table sends its k best for each, and a partial top-k merges them."""
    shared = index.sparkSession.sparkContext.broadcast((probes, probe_ids))

    def run(batches):
        q, q_id = shared.value
        best = None
        for b in batches:
            if not b.num_rows:
                continue
            x, x_id = _matrix(b.column("v")), b.column("id").to_numpy()
            leaf = b.column("leaf").to_numpy()
            i, j, s = _top(q, q_id, x, x_id, k)
            new = (i, x_id[j], s, leaf[j])
            best = _best(new if best is None else tuple(map(np.concatenate, zip(best, new))), k)
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in best], ["q", "id", "s", "leaf"])

    found = index.mapInArrow(run, "q long, id long, s double, leaf long")
    w = Window.partitionBy("q").orderBy(F.col("s").desc(), "id")
    found = found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select("q", "leaf").collect()
    aimed = tree.aim(probes)
    order = [np.argsort(tree.visit(v, tree.leaves)) for v in aimed]  # leaf -> place in the visit
    place = np.sort([order[r.q][r.leaf] for r in found]) + 1
    return int(place[int(np.ceil(recall * len(place))) - 1]) if len(place) else 1


def search(rows: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vector: str = "embedding",
           recall: float = RECALL, sample: int = SAMPLE, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose id
    is divisible by ``every``, among all other rows."""
    spark = rows.sparkSession
    v = usable(rows, id_col, vector)
    n, norm = v.agg(F.count(F.lit(1)), F.max(F.sqrt(F.expr("aggregate(v, 0d, (a, x) -> a + x * x)")))).first()
    empty = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], empty)

    def some(most: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        unit = 1 << 30
        share = min(unit, -(-most * unit // n))
        # each row by itself: an id may be held by any number of rows; equal rows count once
        got = v.filter(F.pmod(F.xxhash64(F.lit(seed), "id", "v"), F.lit(unit)) < share).distinct().orderBy("id", "v").toArrow()
        ids = got.column("id").to_numpy()
        order = np.arange(len(ids))
        return _matrix(got.column("v").combine_chunks())[order], ids[order]

    taught, _ = some(sample, 11)
    asked, asked_ids = some(probes, 12)
    if not len(taught):
        taught = asked
    if not len(taught):
        taught = _matrix(v.limit(1).toArrow().column("v").combine_chunks())
    tree = grow(taught, float(norm) * (1 + 1e-9), n)
    shared = spark.sparkContext.broadcast(tree)  # nodes of a bounded sample

    def place(batches):
        for b in batches:
            if b.num_rows:
                leaf = shared.value.place(shared.value.lift(_matrix(b.column("v"))))
                yield pa.RecordBatch.from_arrays([pa.array(leaf), b.column("id"), b.column("v")], ["leaf", "id", "v"])

    path = scratch_path(spark, "vector-index")
    v.mapInArrow(place, "leaf long, id long, v array<double>").write.parquet(path)
    index = spark.read.schema("leaf long, id long, v array<double>").parquet(path)
    visits = _calibrate(index, asked, asked_ids, tree, k, recall) if len(asked) else tree.leaves

    # leaf -> first shard, number of shards: as many rows as leaves, which the sample bounds
    rows_of = np.zeros(tree.leaves, np.int64)
    for r in index.groupBy("leaf").count().collect():
        rows_of[r["leaf"]] = r["count"]
    base, parts, at, held = [], [], -1, BLOCK
    for size in rows_of.tolist():
        cuts = max(1, -(-size // BLOCK))
        if cuts > 1 or held + size > BLOCK:
            at, held = at + 1, 0
        base.append(at)
        parts.append(cuts)
        at, held = at + cuts - 1, BLOCK if cuts > 1 else held + size
    homes = spark.sparkContext.broadcast((np.array(base), np.array(parts), rows_of))

    def deal(batches):
        first, cuts, _ = homes.value
        for b in batches:
            if b.num_rows:
                leaf = b.column("leaf").to_numpy()
                shard = first[leaf] + b.column("h").to_numpy() % cuts[leaf]
                yield pa.RecordBatch.from_arrays([pa.array(shard), *[b.column(c) for c in ("leaf", "id", "v")]],
                                                 ["shard", "leaf", "id", "v"])

    def walk(batches):
        t, (first, cuts, sizes) = shared.value, homes.value
        for b in batches:
            if not b.num_rows:
                continue
            row, shard, leaves = [], [], []
            for i, (q, own) in enumerate(zip(t.aim(_matrix(b.column("v"))), b.column("own").to_pylist())):
                to: dict[int, list[int]] = {}
                for leaf in t.visit(q, visits, sizes, k + own):
                    for part in range(cuts[leaf]):
                        to.setdefault(int(first[leaf]) + part, []).append(leaf)
                row.extend([i] * len(to))
                shard.extend(to)
                leaves.extend(to.values())
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard, pa.int64()), pa.array(leaves, pa.list_(pa.int64())), b.column("id").take(take), b.column("v").take(take)],
                ["shard", "leaves", "id", "v"])

    # queries are spread out first: walking the tree is their work
    queries = index.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("own"))
    path, ddl = scratch_path(spark, "vector-queries"), "shard long, leaves array<long>, id long, v array<double>"
    queries.repartition(partitions(spark)).mapInArrow(walk, ddl).write.parquet(path)
    queries = spark.read.schema(ddl).parquet(path)
    blocks = queries.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    h = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    x = (index.withColumn("h", h).mapInArrow(deal, "shard long, leaf long, id long, v array<double>")
         .join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
         .select("shard", "block", "leaf", "id", "v"))
    q = (queries.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
         .select("shard", "block", "leaves", "id", "v"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        x, x_id, leaf = _matrix(left.column("v").combine_chunks()), left.column("id").to_numpy(), left.column("leaf").to_numpy()
        v, q_id = _matrix(right.column("v").combine_chunks()), right.column("id").to_numpy()
        lists = right.column("leaves").combine_chunks()
        which, wanted = np.repeat(np.arange(len(q_id)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for n in np.unique(leaf) if len(q_id) else ():
            rows, asks = np.flatnonzero(leaf == n), which[wanted == n]
            if len(asks):
                i, j, s = _top(v[asks], q_id[asks], x[rows], x_id[rows], k)
                best = _best(tuple(map(np.concatenate, zip(best, (asks[i], x_id[rows[j]], s)))), k)
        return pa.table({"query_id": q_id[best[0]], "vec_id": best[1], "score": best[2]})

    keys = ["shard", "block"]
    found = x.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
