"""The bigram loop's packed blocks: what they hold, and how many bytes they take."""

import math
import os
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mixtrace.operators import bigram, pair_blocks as B
from mixtrace.operators.optim import Optim
from test_bigram_unlearning import EVAL, ROWS, TRAIN, check, full_grid, texts_of


def test_dump_and_load():
    arrays = [np.array([], np.int64), np.array([-3, 0, 70000]), np.array([5]), np.array([0.5, -1e300]), np.array([0, 1 << 40])]
    words = pa.array(["a", "", "straße", "日本", "x" * 300])
    got = B.load(B.dump(*arrays, words, words.slice(1, 3), words.slice(0, 0)))
    for a, b in zip(arrays, got):
        assert a.tolist() == b.tolist()
    assert [x.to_pylist() for x in got[5:]] == [words.to_pylist(), words.to_pylist()[1:4], []]


def test_packed_pairs_are_the_pairs(spark, monkeypatch):
    """Slices of a few tokens, several blocks, empty and one-word texts, a NULL dataset."""
    monkeypatch.setattr(B, "PACK_TOKENS", 3)
    toks = pa.array([s.split() for *_, s in TRAIN])
    batch = pa.RecordBatch.from_arrays([pa.array([0] * len(TRAIN)), pa.array(range(len(TRAIN))), toks], ["run", "b", "toks"])
    got = Counter()
    for packed in B.pack(4)([batch.slice(0, 4), batch.slice(4)]):
        for rows in B.unpack([packed]):
            for r in rows.to_pylist():
                got[r["b"], r["ctx"], r["tok"]] += r["cnt"]
    want = Counter((i, u, v) for i, (*_, s) in enumerate(TRAIN) for u, v in zip(s.split(), s.split()[1:]))
    assert got == want


def test_blocks_start_like_the_long_form(spark):
    train = spark.createDataFrame(TRAIN, ROWS)
    counts, q = bigram.pair_targets(train, 1)
    long = bigram.initial_params(counts, q.select("run_id", "ctx", "tok").distinct(), 50, 1.0)
    runs = bigram.run_numbers(train)
    want = Counter((r.run, round(r.theta, 12), r.n) for r in long.join(runs, long.run_id.eqNullSafe(runs.run_id)).collect())
    packed = B.packed_pairs(bigram.run_texts(train, runs, 1), 3)
    got = Counter()
    for r in B.blocks(packed, 3, 50, 1.0, 0).collect():
        k = B.Block(bytes(r.data), 50, 1.0, 0)
        got.update(zip(k.seg_run[k.seg].tolist(), [round(x, 12) for x in k.theta.tolist()], k.n.tolist()))
    assert got == want


@pytest.mark.parametrize("opt", [Optim("adamw", lr=0.1, max_grad_norm=0.05), Optim("sgd", lr=2.0, max_grad_norm=0.05, warmup_steps=2)])
def test_clipped_epochs_equal_the_full_grid(spark, opt):
    """The state goes from step to step, and runs leave after their own last step."""
    def batches(run, t):
        return [([s], 1.0) for s in texts_of(run)[t - 1:t]]
    want, size = full_grid(opt, lambda run: len(texts_of(run)), batches)
    log, _ = bigram.unlearn_influence(spark.createDataFrame(TRAIN, ROWS), spark.createDataFrame(EVAL, ROWS), opt, size, batch_rows=1)
    check(log, want)


def test_bytes_a_pair(spark):
    """All that a clipped step writes to the shared folder is some bytes for each pair of a run."""
    rng = np.random.default_rng(5)
    words = np.array([f"word{i}" for i in range(3000)])
    texts = [" ".join(words[np.minimum(rng.zipf(1.3, 200) - 1, 2999)]) for _ in range(800)]
    rows = spark.createDataFrame([(f"d{i % 4}", i, s) for i, s in enumerate(texts)], ROWS)
    pairs = len({(i % 4, *p) for i, s in enumerate(texts) for p in zip(s.split(), s.split()[1:])})
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")

    def size():
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs)
    before = size()
    log, _ = bigram.unlearn_influence(rows, rows.limit(20).withColumn("dataset", F.lit("e")), Optim("sgd", lr=1.0, max_grad_norm=0.1), 3000, steps=1)
    assert log.filter("step = 1").count() == 4
    assert (size() - before) / pairs < 40
