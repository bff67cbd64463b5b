"""The unlearning loop on epochs of different lengths, NULL groups and many runs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixtrace.operators import batching, influence as U, sampling, selection
from mixtrace.operators.joins import same_keys
from mixtrace.operators.models import lm
from mixtrace.operators.optim import Optim

ROWS = "dataset string, row_id long, text string"


def plain_loop(train, ev, opt, batch, accum, alpha=1.0):
    """{(run, step): {set: loss}}, every run by itself over the whole vocabulary."""
    vocab = sorted({w for _, _, s in train + ev for w in s.split()})
    at = {w: i for i, w in enumerate(vocab)}

    def counts(words):
        c = np.zeros(len(vocab))
        for w in words:
            c[at[w]] += 1
        return c

    def lse(x):
        top = x.max()
        return top + math.log(np.exp(x - top).sum())

    theta0 = np.log(counts([w for *_, s in train for w in s.split()]) + alpha)
    sets = {e: counts([w for d, _, s in ev if d == e for w in s.split()]) for e, *_ in ev}
    loss = lambda th: {e: lse(th) - float(c @ th) / c.sum() for e, c in sets.items()}
    out = {}
    for run in {d for d, *_ in train}:
        texts = [s for _, _, s in sorted((r for r in train if r[0] == run), key=lambda r: r[1])]
        batches = [texts[i:i + batch] for i in range(0, len(texts), batch)]
        th, m, v = theta0.copy(), np.zeros(len(vocab)), np.zeros(len(vocab))
        out[run, 0] = loss(th)
        for t in range(1, math.ceil(len(batches) / accum) + 1):
            g = np.zeros(len(vocab))
            for b in batches[(t - 1) * accum:t * accum]:
                words = [w for s in b for w in s.split()]
                if words:
                    g += (np.exp(th - lse(th)) - counts(words) / len(words)) / accum
            if opt.max_grad_norm:
                g *= min(1.0, opt.max_grad_norm / (math.sqrt((g * g).sum()) + 1e-6))
            if opt.name == "sgd":
                u = g
            elif opt.name == "adamw":
                m, v = opt.beta1 * m + (1 - opt.beta1) * g, opt.beta2 * v + (1 - opt.beta2) * g * g
                u = (m / (1 - opt.beta1 ** t)) / (np.sqrt(v / (1 - opt.beta2 ** t)) + opt.eps)
            else:
                b2 = 1.0 - t ** opt.decay_rate
                v = b2 * v + (1 - b2) * (g * g + opt.eps1)
                u = g / np.sqrt(v)
                u = u / max(1.0, math.sqrt((u * u).mean()) / opt.clip_threshold)
            th = th + opt.lr_at(t) * u
            out[run, t] = loss(th)
    return out


def tables(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(rng.choice(words, n))
    train = [("big", i, text(5)) for i in range(100)] + [("one", 200, text(6))]
    train += [(None, 300 + i, text(4) if i != 3 else "") for i in range(7)] + [("it's v1.0", 400 + i, text(3)) for i in range(9)]
    ev = [("e", 1, text(12)), ("f.2 'x'", 2, text(7))]
    return train, ev, spark.createDataFrame(train, ROWS), spark.createDataFrame(ev, ROWS)


@pytest.mark.parametrize("opt,batch,accum", [
    (Optim("sgd", lr=0.5, max_grad_norm=0.05), 8, 2),
    (Optim("adamw", lr=0.05, warmup_steps=3), 20, 1),
    (Optim("adafactor", lr=0.05), 3, 7),
])
def test_epochs_of_different_lengths_equal_plain_loops(spark, opt, batch, accum):
    """Sources of 1, 7, 9 and 100 rows (one without a name) in one job; each
    takes the steps of its own epoch."""
    train, ev, tr, er = tables(spark)
    want = plain_loop(train, ev, opt, batch, accum)
    steps = U.epoch_steps(tr, batch, accum)
    last = {r.run_id: r.n_steps for r in steps.collect()}
    assert last == {run: max(t for r, t in want if r == run) for run in last}
    model, q, w = U.fit(tr, er, None, accum, 1.0, batch)
    ec = lm.token_counts(er).withColumnRenamed("dataset", "eval_dataset")
    log = U.unlearn_log(model, q, w, ec, max(last.values()), opt, run_steps=steps)
    got = {(r.run_id, r.step, r.eval_dataset): r.loss for r in log.collect() if r.eval_dataset}
    assert set(got) == {(run, t, e) for (run, t), per in want.items() for e in per}
    for (run, t), per in want.items():
        for e, value in per.items():
            assert got[run, t, e] == pytest.approx(value, abs=1e-9)


def test_a_step_rewrites_active_runs_only(spark, monkeypatch):
    """A run's rows leave the loop after its last step; every run is evaluated there."""
    train, _, tr, er = tables(spark)
    sizes, real = [], U.cut

    def spy(df):
        out = real(df)
        if df.columns[:3] == ["run_id", "tok", "_c"]:
            sizes.append({r.run_id for r in out.select("run_id").distinct().collect()})
        return out
    monkeypatch.setattr(U, "cut", spy)
    log, infl = U.unlearn_influence(tr, er, Optim("sgd", lr=0.5), batch_rows=20, eval_steps=3)
    assert sizes == [{"big", "one", None, "it's v1.0"}] * 2 + [{"big"}] * 4
    seen = {(r.run_id, r.step) for r in log.collect()}
    assert seen == {(r, t) for r in ("one", None, "it's v1.0") for t in (0, 1)} | {("big", t) for t in (0, 3, 5)}
    assert {r.train_dataset for r in infl.collect()} == {"big", "one", None, "it's v1.0"}


def test_steps_do_not_pass_through_the_driver(spark, monkeypatch):
    """The loop itself neither collects nor creates a table from driver rows."""
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    _, _, tr, er = tables(spark)
    model, q, w = U.fit(tr, er, 2)
    ec = U.eval_weights(er)
    calls, real = [], U._initial_params

    def started(*a):
        out = real(*a)
        for name in ("collect", "first", "toPandas"):
            monkeypatch.setattr(Classic, name, lambda self, *x, **y: calls.append(self) or pytest.fail("driver"))
        monkeypatch.setattr(type(spark), "createDataFrame", lambda *x, **y: pytest.fail("driver"))
        return out
    monkeypatch.setattr(U, "_initial_params", started)
    log = U.unlearn_log(model, q, w, ec, 2, Optim("adafactor", lr=0.1, max_grad_norm=1.0), with_norms=True, with_lr=True)
    monkeypatch.undo()
    assert not calls and log.filter("metric = 'grad_norm'").count() == 2 * 4


def test_many_runs(spark):
    """Hundreds of runs need no more than the same few plans a step."""
    n = 400
    tr = spark.range(n * 2).selectExpr(f"concat('d', id % {n}) dataset", "id row_id", "concat('a b', id % 7, ' c', id % 3) text")
    er = spark.createDataFrame([("e", 1, "a b1 c2")], ROWS)
    _, infl = U.unlearn_influence(tr, er, Optim("sgd", lr=0.5), steps=2)
    assert infl.count() == n * 2


def test_null_groups_are_groups(spark):
    rows = [("a", i) for i in range(20)] + [(None, i) for i in range(100, 120)]
    df = spark.createDataFrame(rows, "dataset string, row_id long")
    for k, method in ((5, "auto"), (5, "ordinal"), (30, "auto")):
        got = sampling.sample(df, k, key="row_id", method=method).groupBy("dataset").count().collect()
        assert {r.dataset: r["count"] for r in got} == {"a": k, None: k}
    spec = spark.createDataFrame([("a", 3), (None, 25)], "dataset string, k int")
    got = sampling.sample(df, spec, key="row_id").groupBy("dataset").count().collect()
    assert {r.dataset: r["count"] for r in got} == {"a": 3, None: 25}
    batched = batching.task_batches(df, 8).collect()
    assert len(batched) == 40 and len({r.batch_id for r in batched}) == 6
    assert all(len({r.dataset for r in batched if r.batch_id == b}) == 1 for b in range(6))
    assert {r.dataset for r in selection.exclude(df, ["a"]).collect()} == {None}
    texts = df.withColumn("text", F.lit("x y"))
    assert {r.run_id for r in U.micro_batch_counts(texts, 2).collect()} == {"a", None}
    assert {r.dataset for r in U.batch_weighted_counts(texts, 4, mean_of_batches=True).collect()} == {"a", None}


def test_same_keys(spark):
    a = spark.createDataFrame([(1, None, "x"), (1, 2, "y"), (None, None, "z")], "p int, q int, v string")
    b = spark.createDataFrame([(1, None, "l"), (None, None, "m")], "p int, q int, w string")
    for broadcast in (False, True, 1, 100):
        got = sorted((r.v, r.w) for r in same_keys(a, b, ["p", "q"], "left", broadcast).collect())
        assert got == [("x", "l"), ("y", None), ("z", "m")]


def test_bigram_names_are_free(spark):
    rows = [("v1.0", 1, "a b a c"), ("it's", 2, "b a b"), ("`", 3, "c c a")]
    tp = lm.bigram_counts(spark.createDataFrame(rows, ROWS))
    ep = tp.withColumnRenamed("dataset", "eval_dataset")
    got = lm.influence_loo_bigram(tp, ep, 3).collect()
    assert len(got) == 9 and {r.eval_dataset for r in got} == {"v1.0", "it's", "`"}
