"""Bigram unlearning against a plain loop over the full V x V grid."""

import math

import numpy as np
import pytest

from mixtrace.operators import bigram, influence as U
from mixtrace.operators.optim import Optim

ROWS = "dataset string, row_id long, text string"
TRAIN = [("a", 1, "p q r p q"), ("a", 2, "q p q"), ("a", 3, ""), ("a", 4, "r r p s"), ("b", 5, "p q t"), ("b", 6, "t u"),
         (None, 7, "s p q p"), (None, 8, "u"), ("c", 9, "q q q q r")]
EVAL = [("e", 1, "p q r z p"), ("f", 2, "t t q p"), ("it's", 3, "z z s")]


def full_grid(opt, steps_of, batches_of, alpha=1.0):
    vocab = sorted({w for *_, s in TRAIN + EVAL for w in s.split()})
    at = {w: i for i, w in enumerate(vocab)}
    size = len(vocab)

    def counts(texts):
        c = np.zeros((size, size))
        for s in texts:
            for u, v in zip(s.split(), s.split()[1:]):
                c[at[u], at[v]] += 1
        return c
    theta0 = np.log(counts([s for *_, s in TRAIN]) + alpha)
    sets = {e: counts([s for d, _, s in EVAL if d == e]) for e, *_ in EVAL}
    lse = lambda th: np.log(np.exp(th).sum(1, keepdims=True))
    loss = lambda th: {e: float((c * (lse(th) - th)).sum() / c.sum()) for e, c in sets.items()}
    out = {}
    for run in {d for d, *_ in TRAIN}:
        th, m, v = theta0.copy(), np.zeros_like(theta0), np.zeros_like(theta0)
        out[run, 0] = loss(th)
        for t in range(1, steps_of(run) + 1):
            g = np.zeros_like(th)
            for texts, share in batches_of(run, t):
                c = counts(texts)
                if c.sum():
                    g += share * (c.sum(1, keepdims=True) * np.exp(th - lse(th)) - c) / c.sum()
            if opt.max_grad_norm:
                g *= min(1.0, opt.max_grad_norm / (math.sqrt((g * g).sum()) + 1e-6))
            u = g
            if opt.name == "adamw":
                m, v = opt.beta1 * m + (1 - opt.beta1) * g, opt.beta2 * v + (1 - opt.beta2) * g * g
                u = (m / (1 - opt.beta1 ** t)) / (np.sqrt(v / (1 - opt.beta2 ** t)) + opt.eps)
            th = th + opt.lr_at(t) * u
            out[run, t] = loss(th)
    return out, size


def texts_of(run):
    return [s for d, _, s in sorted((r for r in TRAIN if r[0] == run), key=lambda r: r[1])]


def check(log, want):
    got = {(r.run_id, r.step, r.eval_dataset): r.loss for r in log.collect()}
    assert set(got) == {(run, t, e) for (run, t), per in want.items() for e in per}
    for (run, t), per in want.items():
        for e, value in per.items():
            assert got[run, t, e] == pytest.approx(value, abs=1e-9)


@pytest.mark.parametrize("opt", [Optim("sgd", lr=2.0), Optim("sgd", lr=2.0, max_grad_norm=0.05), Optim("adamw", lr=0.1)])
def test_slices_equal_the_full_grid(spark, opt):
    def batches(run, t):
        rows = texts_of(run)
        return [([s for i, s in enumerate(rows) if i * 2 // len(rows) == t - 1], 1.0)]
    want, size = full_grid(opt, lambda run: 2, batches)
    log, infl = bigram.unlearn_influence(spark.createDataFrame(TRAIN, ROWS), spark.createDataFrame(EVAL, ROWS), opt, size)
    check(log, want)
    assert infl.count() == 4 * 3 * 2


def test_epochs_equal_the_full_grid(spark):
    opt, batch, accum = Optim("sgd", lr=2.0), 1, 2

    def batches(run, t):
        rows = texts_of(run)
        return [([s], 1 / accum) for s in rows[(t - 1) * accum:t * accum]]
    want, size = full_grid(opt, lambda run: math.ceil(len(texts_of(run)) / accum), batches)
    log, _ = bigram.unlearn_influence(spark.createDataFrame(TRAIN, ROWS), spark.createDataFrame(EVAL, ROWS), opt, size,
                                      batch_rows=batch, accum=accum)
    check(log, want)


def test_rows_are_pairs_and_classes(spark):
    """Multiplicities of a context add up to the vocabulary; a run's own pairs are single rows."""
    counts, q = bigram.pair_targets(spark.createDataFrame(TRAIN, ROWS), 1)
    own = q.select("run_id", "ctx", "tok").distinct()
    rows = bigram.initial_params(counts, own, 50, 1.0).collect()
    assert {(r.run_id, r.ctx, r.tok) for r in rows if r.tok is not None} == {tuple(r) for r in own.collect()}
    for key in {(r.run_id, r.ctx) for r in rows}:
        assert sum(r.n for r in rows if (r.run_id, r.ctx) == key) == 50
        classes = [r._c for r in rows if (r.run_id, r.ctx) == key and r.tok is None]
        assert len(classes) == len(set(classes))


def test_adafactor_is_refused(spark):
    df = spark.createDataFrame(TRAIN, ROWS)
    with pytest.raises(ValueError, match="adafactor"):
        bigram.unlearn_influence(df, df, Optim("adafactor"), 9)
