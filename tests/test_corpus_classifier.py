"""Corpus builder and packing against a plain loop, samplers on hard keys, the
classifier's refits against a numpy loop, the learning rate in the step log."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixtrace.operators import corpus, influence as U, packing, sampling
from mixtrace.operators.models import logreg
from mixtrace.operators.optim import Optim


def _packed(docs, block, batch):
    """docs: {dataset: [ids or None in key order]} -> {(dataset, batch, block): ids}."""
    out = {}
    for d, seqs in docs.items():
        for i in range(0, len(seqs), batch):
            flat = [t for s in seqs[i:i + batch] for t in s or []]
            n = len(flat) // block * block if len(flat) >= block else len(flat)
            for j in range(0, n, block):
                out[d, i // batch, j // block] = flat[j:min(j + block, n)]
    return out


@pytest.mark.parametrize("limit", [500_000, 0])
def test_pack_equals_plain_loop(spark, monkeypatch, limit):
    """Long, empty and NULL arrays, a NULL dataset; starts broadcast or joined."""
    monkeypatch.setattr(packing, "BROADCAST_DOCS", limit)
    docs = {"a": [list(range(50)), [], None, [1], list(range(7)), [3] * 8, [9]], "b": [None, []],
            "c": [[5]], None: [[1, 2], [3, 4, 5]]}
    rows = [(d, i, s) for d, seqs in docs.items() for i, s in enumerate(seqs)]
    df = spark.createDataFrame(rows, "dataset string, doc_id long, input_ids array<int>")
    out = packing.pack(df, block_size=8, batch_docs=3).collect()
    assert {(r.dataset, r.batch_id, r.block_no): r.input_ids for r in out} == _packed(docs, 8, 3)
    assert len(out) == len(_packed(docs, 8, 3))
    assert all(r.labels == r.input_ids and r.attention_mask == [1] * len(r.input_ids) for r in out)


def test_corpus_blocks(spark):
    rows = [(d, i, [ord(d) * 100 + i] * (i + 1)) for d in "ab" for i in range(9)]
    docs = spark.createDataFrame(rows, "dataset string, doc_id long, ids array<int>")
    whole = _packed({d: [s for x, _, s in rows if x == d] for d in "ab"}, 4, 3)
    k = spark.createDataFrame([("a", 30), ("b", 2)], "dataset string, k long")
    out = corpus.corpus_blocks(docs, k, F.col("ids"), block_size=4, batch_docs=3).collect()
    assert Counter(r.dataset for r in out) == {"a": 30, "b": 2}
    for r in out:
        assert whole[r.dataset, r.batch_id, r.block_no] == r.input_ids
        assert sorted(x for x in whole if x[0] == r.dataset).index((r.dataset, r.batch_id, r.block_no)) == r["index"]
    times = Counter((r.batch_id, r.block_no) for r in out if r.dataset == "a")
    n = sum(1 for x in whole if x[0] == "a")
    assert set(times.values()) <= {30 // n, 30 // n + 1} and len(times) == min(n, 30)
    # sampled documents: only their tokens, each as often as drawn
    few = spark.createDataFrame([("a", 12)], "dataset string, k long")
    out = corpus.corpus_blocks(docs, 1000, F.col("ids"), few, block_size=1, batch_docs=100).collect()
    assert {r.dataset for r in out} == {"a"} and len(out) == 1000


def test_sample_string_and_null_keys(spark):
    """A NULL key sorts before the others and is drawn like any row."""
    df = spark.createDataFrame([("a", None)] + [("a", f"k{i}") for i in range(9)], "dataset string, key string")
    for method in ("window", "ordinal"):
        for k in (1, 4, 9, 10, 13, 20):
            out = sampling.sample(df, k, key="key", method=method).collect()
            rows = sampling.sample_rows(df, k, "key", method=method).collect()
            for got in (out, rows):
                assert len(got) == k
                assert max(Counter(r.key for r in got).values()) == -(-k // 10)


def _plain_fit(x, y, steps, lr):
    th = np.zeros(x.shape[1])
    for _ in range(steps):
        th -= lr * x.T @ (1 / (1 + np.exp(-x @ th)) - y) / len(y)
    return th


def _plain_loss(x, y, th):
    z = x @ th
    return float(np.mean(np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z))) - y * z))


def test_classifier_equals_plain_refits(spark, monkeypatch):
    """Fit, leave-one-out and unlearning against full matrices, also with one
    run a chunk; a NULL text has the bias only."""
    monkeypatch.setattr(logreg, "RUNS_PER_CHUNK", 1)
    texts = ["x y", "y z", None, "", "z z q", "x q", "w", "y w x"]
    rows = [(i, "abc"[i % 3], "ef"[i % 2], t, float(i % 2 or i == 4)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, dataset string, eval_dataset string, text string, y double")
    X = logreg.features(df, ["doc_id", "dataset", "eval_dataset", "y"], buckets=16)
    got = sorted(X.collect(), key=lambda r: r.doc_id)
    assert got[2].fs == [16] and got[3].fs == [16]
    m = np.zeros((len(rows), 17))
    for r in got:
        m[r.doc_id, r.fs] = 1.0
    y = np.array([r[4] for r in rows])
    part, ev = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    th = logreg.fit(X, 3, 0.5, 16)
    full = _plain_fit(m, y, 3, 0.5)
    assert np.allclose([r.theta for r in th.orderBy("f").collect()], full)
    loo = {(r.train_dataset, r.eval_dataset): r.influence for r in logreg.influence_loo(X, X, 3, 0.5, 16).collect()}
    un = {(r.train_dataset, r.eval_dataset): r.influence
          for r in logreg.unlearn_influence(X, X, th, 1, 0.5, 16).collect()}
    assert set(loo) == set(un) == {(d, e) for d in "abc" for e in "ef"}
    for d, e in loo:
        base = _plain_loss(m[ev == e], y[ev == e], full)
        refit = _plain_fit(m[part != d], y[part != d], 3, 0.5)
        assert loo[d, e] == pytest.approx(_plain_loss(m[ev == e], y[ev == e], refit) - base)
        x, t = m[part == d], y[part == d]
        up = full + 0.5 * x.T @ (1 / (1 + np.exp(-x @ full)) - t) / len(t)
        assert un[d, e] == pytest.approx(_plain_loss(m[ev == e], y[ev == e], up) - base)


def test_step_log_carries_the_learning_rate(spark):
    tr = spark.createDataFrame([("a", 1, "x y y z"), ("b", 2, "z z w")], "dataset string, row_id long, text string")
    ev = spark.createDataFrame([("e", 1, "x y w")], "dataset string, row_id long, text string")
    model, q, w = U.fit(tr, ev, 1)
    log = U.unlearn_log(model, q, w, U.eval_weights(ev), 2, Optim("sgd", lr=2.0, warmup_steps=4), with_lr=True)
    rates = defaultdict(set)
    for r in log.filter("metric = 'eval_lr'").collect():
        rates[r.step].add(r.loss)
    assert rates == {0: {0.0}, 1: {0.5}, 2: {1.0}}
