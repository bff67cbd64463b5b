"""Word pairs and bigram parameters in blocks: a block holds all rows of its contexts, packed.

A block is a row whose binary column is an array of numbers for every field,
in ascending order of the context and compressed, some bytes a pair, so that
pairs are shuffled and stored at a small part of the bytes of (string, string)
rows.  A task works on one block at a time.

Groups are numbers: training run r is ``run = r``, evaluation set e is ``run = -1 - e``.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .optim import Optim, moved

#: Tokens that a task gathers before it packs their pairs (a longer text is packed alone).
PACK_TOKENS = 1_000_000
#: Characters of text a block; a block's arrays are some hundred bytes for each of its pairs.
BLOCK_CHARS = 3_000_000

PACKED = "block int, data binary"
GATHERED = "block int, data binary, state binary, sizes array<struct<run:int,b:long,n:long>>, base array<double>"
MOVED = GATHERED + ", run int, step long, delta array<double>"


def dump(*arrays: np.ndarray | pa.Array) -> bytes:
    """Numbers and strings as one compressed value: integers in the fewest bytes that hold them, byte by byte."""
    heads, parts = [], []
    for a in arrays:
        if isinstance(a, pa.Array):
            words = a.cast(pa.large_string())
            ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
            text = words.buffers()[2].to_pybytes()[ends[0]:ends[-1]] if len(words) and words.buffers()[2] else b""
            parts += [dump(np.diff(ends)), text]
            heads.append(["s", len(parts[-2]), len(text)])
            continue
        if a.dtype.kind in "iu":
            low = int(a.min()) if len(a) else 0
            a = a.astype(np.int64) - low
            a = a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))
            parts.append(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())
            heads.append([a.dtype.str, len(a), low])
        else:
            parts.append(a.tobytes())
            heads.append([a.dtype.str, len(a), None])
    head = json.dumps(heads).encode()
    raw = len(head).to_bytes(8, "little") + head + b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(raw, asbytes=True)


def load(data: bytes) -> list:
    raw = memoryview(pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True))
    at = 8 + int.from_bytes(raw[:8], "little")
    out = []
    for kind, n, low in json.loads(bytes(raw[8:at])):
        if kind == "s":
            ends = np.concatenate([[0], np.cumsum(load(bytes(raw[at:at + n]))[0])]).astype(np.int64)
            at += n
            out.append(pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(bytes(raw[at:at + low]))))
            at += low
            continue
        dtype = np.dtype(kind)
        a = np.frombuffer(raw, np.uint8, n * dtype.itemsize, at)
        at += n * dtype.itemsize
        if low is None:
            out.append(a.view(dtype).copy())
        else:
            out.append(np.ascontiguousarray(a.reshape(dtype.itemsize, n).T).reshape(-1).view(dtype).astype(np.int64) + low)
    return out


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of keys begins, in rows that are ordered by them."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def groups(run: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The (run, b) that occur, two rows, and the number of each row's."""
    low, wide = int(run.min()), int(b.max()) + 1
    keys, g = np.unique((run - low) * wide + b, return_inverse=True)
    return np.stack([keys // wide + low, keys % wide]), g


def tally(u: np.ndarray, v: np.ndarray, g: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(u, v, g, count): the combinations that occur, ascending, and their rows or the sums of ``n``."""
    sizes = [int(x.max()) + 1 for x in (u, v, g)]
    if sizes[0] * sizes[1] * sizes[2] >= 1 << 63:
        o = np.lexsort((g, v, u))
        u, v, g = u[o], v[o], g[o]
        first = starts_of(u, v, g)
        count = np.diff(np.append(first, len(u))) if n is None else np.add.reduceat(n[o], first)
        return u[first], v[first], g[first], count
    key = u.astype(np.int64)
    key *= sizes[1]
    key += v
    key *= sizes[2]
    key += g
    if n is None:
        key.sort()
        first = starts_of(key)
        count = np.diff(np.append(first, len(key)))
    else:
        o = np.argsort(key)
        key = key[o]
        first = starts_of(key)
        count = np.add.reduceat(n[o], first)
    key, g = np.divmod(key[first], sizes[2])
    return *np.divmod(key, sizes[1]), g, count


def _slices(batches):
    """Tables (run, b, toks) of about PACK_TOKENS tokens."""
    held, size = [], 0
    for batch in batches:
        n = np.diff(np.asarray(batch.column("toks").offsets)) if batch.num_rows else np.zeros(0, np.int64)
        at = 0
        while at < len(n):
            more = np.cumsum(n[at:])
            take = max(1, int(np.searchsorted(more, PACK_TOKENS - size, "right")))
            held.append(batch.slice(at, take))
            size += int(more[min(take, len(more)) - 1])
            at += take
            if size >= PACK_TOKENS or at < len(n):
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def pack(n_blocks: int):
    """(run, b, toks) -> (block, data): the adjacent words of every text, counted in each slice of a task.

    The block of a pair is a hash of its context.  Data: the words, and u, v
    (their numbers), run, b and the count of each pair.
    """
    def run(batches):
        for t in _slices(batches):
            toks = t.column("toks").combine_chunks()
            toks = pa.concat_arrays(toks.chunks) if isinstance(toks, pa.ChunkedArray) else toks
            n = np.diff(np.asarray(toks.offsets))
            flat = toks.flatten()
            if len(flat) < 2:
                continue
            flat = flat.dictionary_encode()
            words, ids = flat.dictionary, flat.indices.to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(n), dtype=np.int32), n)
            inside = row[1:] == row[:-1]
            if not inside.any():
                continue
            group, g = groups(*(t.column(c).to_numpy().astype(np.int64) for c in ("run", "b")))
            block = np.fromiter((zlib.crc32(w.encode()) % n_blocks for w in words.to_pylist()), np.int64, len(words))
            by_block = np.argsort(block, kind="stable")
            rank = np.empty_like(by_block)
            rank[by_block] = np.arange(len(rank))
            u, v, g, count = tally(rank[ids[:-1][inside]], ids[1:][inside], g[row[1:][inside]])
            u = by_block[u]
            cuts = starts_of(block[u])
            for a, z in zip(cuts, np.append(cuts[1:], len(u))):
                used, place = np.unique(np.concatenate([u[a:z], v[a:z]]), return_inverse=True)
                at = group[:, g[a:z]]
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(block[u[a]])], pa.int32()),
                    pa.array([dump(words.take(pa.array(used)), place[:z - a], place[z - a:], at[0], at[1], count[a:z])], pa.binary())], ["block", "data"])
    return run


def unpack(batches):
    """Packed data as rows (run, b, ctx, tok, cnt)."""
    for batch in batches:
        for data in batch.column("data"):
            words, u, v, run, b, n = load(data.as_py())
            words = words.cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(run, pa.int32()), pa.array(b, pa.int64()), words.take(pa.array(u)), words.take(pa.array(v)),
                                              pa.array(n, pa.int64())], ["run", "b", "ctx", "tok", "cnt"])


def gather(vocab_size: int, alpha: float, n_sets: int):
    """Packed data, ordered by block -> one row a block: its pairs, summed, the
    pairs of every (run, b) in it, and the fitted model's loss on the evaluation pairs."""
    def whole(block, parts):
        words = pa.concat_arrays([p[0] for p in parts]).dictionary_encode()
        place = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.cumsum([0] + [len(p[0]) for p in parts])
        u, v = (np.concatenate([place[a + p[i]] for a, p in zip(at, parts)]) for i in (1, 2))
        run, b, n = (np.concatenate([p[i] for p in parts]) for i in (3, 4, 5))
        group, g = groups(run, b)
        u, v, g, n = tally(u, v, g, n)
        total = np.bincount(g, n, group.shape[1]).astype(np.int64)
        data = dump(u, v, group[0][g], group[1][g], n)
        base = fitted_loss(u, v, group[0][g], n, vocab_size, alpha, n_sets)
        sizes = [{"run": int(r), "b": int(x), "n": int(k)} for r, x, k in zip(*group, total)]
        return pa.RecordBatch.from_pylist([{"block": block, "data": data, "state": None, "sizes": sizes, "base": base.tolist()}], schema=_schema(False))

    def run(batches):
        now, parts = None, []
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data")):
                if block != now and parts:
                    yield whole(now, parts)
                    parts = []
                now = block
                parts.append(load(data.as_py()))
        if parts:
            yield whole(now, parts)
    return run


def _schema(moved_too: bool) -> pa.Schema:
    sizes = pa.list_(pa.struct([("run", pa.int32()), ("b", pa.int64()), ("n", pa.int64())]))
    fields = [("block", pa.int32()), ("data", pa.binary()), ("state", pa.binary()), ("sizes", sizes), ("base", pa.list_(pa.float64()))]
    return pa.schema(fields + [("run", pa.int32()), ("step", pa.int64()), ("delta", pa.list_(pa.float64()))] * moved_too)


def _places(keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where ``of`` stand in the ascending ``keys``, whether they do; 0 where they don't)."""
    if not len(keys):
        return np.zeros(len(of), np.int64), np.zeros(len(of), bool)
    at = np.minimum(np.searchsorted(keys, of), len(keys) - 1)
    there = keys[at] == of
    return np.where(there, at, 0), there


def fitted_loss(u: np.ndarray, v: np.ndarray, run: np.ndarray, n: np.ndarray, vocab_size: int, alpha: float, n_sets: int) -> np.ndarray:
    """Of each set, the fitted model's loss on its pairs, summed; rows are ordered by (u, v)."""
    train, wide = run >= 0, int(v.max()) + 1
    out = np.zeros(n_sets)
    if train.all():
        return out

    def count_of(keys):
        first = starts_of(keys[train])
        if not len(first):
            return np.zeros((~train).sum())
        at, there = _places(keys[train][first], keys[~train])
        return np.where(there, np.add.reduceat(n[train], first)[at], 0)

    loss = np.log(count_of(u) + alpha * vocab_size) - np.log(count_of(u * wide + v) + alpha)
    return np.bincount(-1 - run[~train], n[~train] * loss, n_sets)


class Block:
    """The parameters of a block's contexts as arrays.

    Rows are ordered by segment, a (run, context): the run's pairs, then its
    classes, the other pairs of one training count c (0: unseen), which stay
    equal for ever and are one row with multiplicity ``n``.
    """

    def __init__(self, data: bytes, vocab_size: int, alpha: float, n_sets: int):
        u, v, run, b, cnt = load(data)
        train = run >= 0
        wide = int(v.max()) + 1 if len(v) else 1
        eu, ev, es, ec = u[~train], v[~train], -1 - run[~train], cnt[~train]
        u, v, run, self.b, self.cnt = (x[train] for x in (u, v, run, b, cnt))
        # pairs, contexts and (run, pair)s, all in the order of the rows
        first = starts_of(u, v)
        pair = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(u))))
        count = np.bincount(pair, self.cnt, len(first)).astype(np.int64)
        pu, pkey = u[first], u[first] * wide + v[first]
        cfirst = starts_of(pu)
        n_seen = np.diff(np.append(cfirst, len(pu)))
        ctx, words = np.repeat(np.arange(len(cfirst)), n_seen), pu[cfirst]
        ofirst = starts_of(pair, run)
        own = np.repeat(np.arange(len(ofirst)), np.diff(np.append(ofirst, len(run))))
        own_pair, own_run = pair[ofirst], run[ofirst]
        n_ctx = max(1, len(cfirst))
        segs, own_seg = np.unique(own_run * n_ctx + ctx[own_pair], return_inverse=True)
        self.seg_run, seg_ctx = segs // n_ctx, segs % n_ctx
        # classes of every context, and those of the segments
        most = int(count.max()) + 1 if len(count) else 1
        keys = np.concatenate([ctx * most + count, np.arange(len(cfirst)) * most])
        cls, place, size = np.unique(keys, return_inverse=True, return_counts=True)
        size[place[len(ctx):]] = vocab_size - n_seen
        pair_cls, cls_count = place[:len(ctx)], cls % most
        cls_first = np.searchsorted(cls, np.arange(len(cfirst) + 1) * most)
        per_seg = np.diff(cls_first)[seg_ctx]
        seg_first = np.concatenate([[0], np.cumsum(per_seg)])
        row_seg = np.repeat(np.arange(len(segs)), per_seg)
        row_cls = np.arange(seg_first[-1]) - seg_first[row_seg] + cls_first[seg_ctx[row_seg]]
        at = seg_first[own_seg] + pair_cls[own_pair] - cls_first[seg_ctx[own_seg]]
        n = size[row_cls] - np.bincount(at, minlength=len(row_cls))
        there = n > 0
        # the rows: own pairs and classes, by segment
        seg = np.concatenate([own_seg, row_seg[there]])
        o = np.argsort(seg, kind="stable")
        self.seg = seg[o]
        self.first = starts_of(self.seg)
        self.count = np.concatenate([count[own_pair], cls_count[row_cls[there]]])[o]
        self.n = np.concatenate([np.ones(len(ofirst), np.int64), n[there]])[o]
        back = np.empty_like(o)
        back[o] = np.arange(len(o))
        self.own = back[own]  # the row of every target
        self.theta = np.log(self.count + alpha)
        self.runs, self.seg_place = np.unique(self.seg_run, return_inverse=True)
        # evaluation: counts of the segments and rows of each set
        e_ctx, known = _places(words, eu)
        e_pair, seen = _places(pkey, eu * wide + ev)
        e_cls = np.where(seen, pair_cls[e_pair] if len(pkey) else 0, cls_first[e_ctx])
        self.seg_eval, self.row_eval = [], []
        for s in range(n_sets):
            mine, paired = known & (es == s), seen & (es == s)
            by_ctx = np.bincount(e_ctx[mine], ec[mine], len(cfirst))
            by_pair = np.bincount(e_pair[paired], ec[paired], len(first))
            by_cls = np.bincount(e_cls[mine], ec[mine], len(cls))
            rest = by_cls[row_cls] - np.bincount(at, by_pair[own_pair], len(row_cls))
            self.seg_eval.append(by_ctx[seg_ctx])
            self.row_eval.append(np.concatenate([by_pair[own_pair], rest[there]])[o])
        self.target_run = run

    def log_partition(self, theta: np.ndarray) -> np.ndarray:
        """ln sum n exp(theta) of every segment, relative to its largest theta: a diverging run doesn't overflow."""
        top = np.maximum.reduceat(theta, self.first)
        return top + np.log(np.add.reduceat(self.n * np.exp(theta - top[self.seg]), self.first))

    def targets(self, sizes: dict, accum: int) -> None:
        """Sorts the targets by step: ``cnt / pairs of the micro-batch / accum`` each."""
        runs, bs, ns = (np.array(x, np.int64) for x in zip(*sizes)) if sizes else [np.zeros(0, np.int64)] * 3
        wide = int(max([0, *bs, *self.b])) + 1
        key = runs * wide + bs
        o = np.argsort(key)
        total = ns[o][np.searchsorted(key[o], self.target_run * wide + self.b)]
        step = self.b // accum + 1
        by = np.argsort(step, kind="stable")
        self.q_step, self.q_row, self.q = step[by], self.own[by], (self.cnt / total / accum)[by]

    def step_gradient(self, theta: np.ndarray, t: int) -> np.ndarray:
        """``qc(ctx) * p(tok|ctx) - q(ctx, tok)`` of every row."""
        a, z = np.searchsorted(self.q_step, [t, t + 1])
        q = np.bincount(self.q_row[a:z], self.q[a:z], len(theta))
        qc = np.add.reduceat(q, self.first)
        return qc[self.seg] * np.exp(theta - self.log_partition(theta)[self.seg]) - q

    def delta(self, theta: np.ndarray) -> np.ndarray:
        """(runs of the block, sets): what the sets' losses have gained since the start, times their pairs."""
        z, th = self.log_partition(theta) - self.log_partition(self.theta), theta - self.theta
        wide = int(self.seg_run.max()) + 1
        run = self.seg_run[self.seg]
        out = [np.bincount(self.seg_run, e * z, wide) - np.bincount(run, w * th, wide) for e, w in zip(self.seg_eval, self.row_eval)]
        return np.stack(out, 1)[self.runs] if out else np.zeros((len(self.runs), 0))


class Steps:
    """The loop over a block's rows, ``first`` to ``last``; what of it crosses blocks comes with each row:
    ``totals`` (run, b, n), ``ends`` (run, n_steps) and, for the first step, ``scales`` (run, scale)."""

    def __init__(self, opt: Optim, vocab_size: int, alpha: float, n_sets: int, accum: int, eval_steps: int, sign: float):
        self.opt, self.shape, self.accum, self.eval_steps, self.sign = opt, (vocab_size, alpha, n_sets), accum, eval_steps, sign

    def _blocks(self, batches):
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c, batch=batch, i=i: batch.column(c)[i]
                block = Block(get("data").as_py(), *self.shape)
                if not len(block.first):
                    continue
                rows = lambda c, get=get: [tuple(x.values()) for x in get(c).as_py()]
                block.targets(rows("totals"), self.accum)
                ends = dict(rows("ends"))
                block.ends = np.array([ends[r] for r in block.runs.tolist()])
                state = get("state").as_py()
                zero = np.zeros(len(block.theta)) if self.opt.name == "adamw" else None
                block.now = load(state) if state else [block.theta, *([zero, zero] if zero is not None else [])]
                block.live = lambda t, k=block: (k.ends >= t)[k.seg_place][k.seg]
                yield get, rows, block

    def norms(self, t: int):
        """-> (run, g): the norm of each run's gradient in the block."""
        def run(batches):
            for _, _, k in self._blocks(batches):
                g = np.where(k.live(t), k.step_gradient(k.now[0], t), 0.0)
                square = np.bincount(k.seg_run[k.seg], k.n * g * g)[k.runs]
                yield pa.RecordBatch.from_arrays([pa.array(k.runs, pa.int32()), pa.array(np.sqrt(square))], ["run", "g"])
        return run

    def moved(self, first: int, last: int, keep: bool, scaled: bool):
        """-> MOVED: a row (run, step, delta) for each scheduled step, and with ``keep`` the block and its state.
        ``scaled``: the rows have ``scales``, the gradient's of the step."""
        def run(batches):
            for get, rows, k in self._blocks(batches):
                out = []
                for t in range(first, min(last, int(k.ends.max())) + 1):
                    if t == 1:
                        out += [(r, 0, d) for r, d in zip(k.runs, k.delta(k.theta))]
                    live, g = k.live(t), k.step_gradient(k.now[0], t)
                    if scaled:
                        scale = dict(rows("scales"))
                        g = g * np.array([scale[r] for r in k.runs.tolist()])[k.seg_place][k.seg]
                    new = moved(self.opt, t, self.sign, g, *k.now, sqrt=np.sqrt)
                    k.now = [np.where(live, x, old) for x, old in zip(new, k.now)]
                    due = (k.ends >= t) & ((t % self.eval_steps == 0) | (k.ends == t))
                    if due.any():
                        out += [(r, t, d) for r, d, yes in zip(k.runs, k.delta(k.now[0]), due) if yes]
                found = [{"run": int(r), "step": t, "delta": d.tolist()} for r, t, d in out]
                if keep:
                    found.append({c: get(c).as_py() for c in ("block", "data", "sizes", "base")} | {"state": dump(*k.now)})
                yield pa.RecordBatch.from_pylist(found, schema=_schema(True))
        return run


def packed_pairs(texts: DataFrame, n_blocks: int) -> DataFrame:
    """(run, b, toks) -> PACKED."""
    return texts.mapInArrow(pack(n_blocks), PACKED)


def blocks(packed: DataFrame, n_blocks: int, vocab_size: int, alpha: float, n_sets: int) -> DataFrame:
    """PACKED -> GATHERED: each block in a partition of its own."""
    return (packed.repartitionById(n_blocks, F.col("block")).sortWithinPartitions("block")
            .mapInArrow(gather(vocab_size, alpha, n_sets), GATHERED))
