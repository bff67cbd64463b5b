"""Unigram model: LOO by subtraction equals refit; ascent raises the loss;
finite-difference check of the gradient; end-to-end queries on sf0.001."""

import math

import pytest
from pyspark.sql import functions as F

from mixtrace.operators import influence as U
from mixtrace.operators.models import lm
from mixtrace.operators.optim import Optim
from tests.conftest import SF001


def _toy(spark):
    train = spark.createDataFrame([("a", 1, "x y y z"), ("a", 2, "y"), ("b", 3, "z z w"), ("c", 4, "x w w")],
                                  "dataset string, row_id long, text string")
    ev = spark.createDataFrame([("e", 1, "x y w"), ("f", 2, "z q")], "dataset string, row_id long, text string")
    return train, ev


def _refit_loss(train_rows, ev_rows, drop, alpha, V):
    from collections import Counter
    c = Counter(t for d, _, s in train_rows if d != drop for t in s.split())
    n = sum(c.values())
    out = {}
    for e, _, s in ev_rows:
        toks = s.split()
        out[e] = sum(math.log(n + alpha * V) - math.log(c.get(t, 0) + alpha) for t in toks) / len(toks)
    return out


def test_loo_equals_refit(spark):
    train, ev = _toy(spark)
    tc, ec = lm.token_counts(train), lm.token_counts(ev).withColumnRenamed("dataset", "eval_dataset")
    V = lm.vocabulary(tc, ec).count()
    got = {(r.train_dataset, r.eval_dataset): r.influence for r in lm.influence_loo(tc, ec, 1.0).collect()}
    tr, er = [tuple(r) for r in train.collect()], [tuple(r) for r in ev.collect()]
    full = _refit_loss(tr, er, None, 1.0, V)
    for d in "abc":
        without = _refit_loss(tr, er, d, 1.0, V)
        for e in "ef":
            assert got[(d, e)] == pytest.approx(without[e] - full[e], abs=1e-12)


def test_ascent_raises_and_descent_lowers(spark):
    train, ev = _toy(spark)
    tc = lm.token_counts(train)
    own = tc.withColumnRenamed("dataset", "eval_dataset")
    model = lm.fit_unigram(tc, lm.vocabulary(tc, lm.token_counts(ev)), 1.0)
    q, w = U.step_targets(U.micro_batch_counts(train, 1))
    for sign in (1.0, -1.0):
        log = U.unlearn_log(model, q, w, own, 1, Optim("sgd", lr=0.05), sign=sign)
        l = {(r.run_id, r.eval_dataset, r.step): r.loss for r in log.collect()}
        for d in "abc":
            delta = l[(d, d, 1)] - l[(d, d, 0)]
            assert (delta > 0) if sign > 0 else (delta < 0)


def test_gradient_finite_difference(spark):
    import numpy as np
    theta = np.array([0.3, -0.2, 1.1, 0.0])
    q = np.array([0.5, 0.25, 0.0, 0.25])
    toks = ["a", "b", "c", "d"]
    params = spark.createDataFrame([("r", t, float(v)) for t, v in zip(toks, theta)],
                                   "run_id string, tok string, theta double")
    tq = spark.createDataFrame([("r", t, float(v)) for t, v in zip(toks, q) if v > 0],
                               "run_id string, tok string, q double")
    from mixtrace.operators.optim import gradient
    logz = lm.log_partition(params).first()["logz"]
    g = {r.tok: r.g for r in gradient(params, F.lit(logz), tq, F.lit(1.0), True).collect()}

    def loss(th):
        return math.log(np.exp(th).sum()) - float((q * th).sum())
    for i, t in enumerate(toks):
        e = np.zeros(4)
        e[i] = 1e-6
        fd = (loss(theta + e) - loss(theta - e)) / 2e-6
        assert g[t] == pytest.approx(fd, abs=1e-6)


@pytest.mark.parametrize("name", ["influence_loo", "sample_wraparound", "pack_blocks",
                                  "collate_causal", "qa_suite", "run_key"])
def test_catalog_runs_on_sf0001(spark, name):
    from __spark_entry__ import queries
    df = queries()[name](spark, SF001)
    assert df.count() >= 0
    assert len(df.columns) > 0


def test_entry(spark):
    from __spark_entry__ import entry
    rows = entry(spark).collect()
    assert len(rows) > 0
    assert set(rows[0].asDict()) == {"train_dataset", "eval_dataset", "influence"}


def test_partition_count_independence(spark):
    from __spark_entry__ import queries
    q = queries()["dense_index"]
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    a = sorted(map(tuple, q(spark, SF001).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    b = sorted(map(tuple, q(spark, SF001).collect()))
    assert a == b


def test_bigram_loo_equals_refit(spark):
    from collections import Counter
    train, ev = _toy(spark)
    tp = lm.bigram_counts(train)
    ep = lm.bigram_counts(ev).withColumnRenamed("dataset", "eval_dataset")
    V = 6
    got = {(r.train_dataset, r.eval_dataset): r.influence
           for r in lm.influence_loo_bigram(tp, ep, V, 1.0).collect()}
    tr, er = [tuple(r) for r in train.collect()], [tuple(r) for r in ev.collect()]

    def loss(drop):
        c = Counter((a, b) for d, _, s in tr if d != drop for a, b in zip(s.split(), s.split()[1:]))
        cu = Counter()
        for (a, _), n in c.items():
            cu[a] += n
        out = {}
        for e, _, s in er:
            ps = list(zip(s.split(), s.split()[1:]))
            out[e] = sum(math.log(cu[a] + V) - math.log(c[(a, b)] + 1.0) for a, b in ps) / len(ps)
        return out
    full = loss(None)
    for d in "abc":
        w = loss(d)
        for e in "ef":
            assert got[(d, e)] == pytest.approx(w[e] - full[e], abs=1e-12)


def _brute_unlearn(train, ev, opt, steps, n_micro, alpha=1.0):
    """Uncompressed reference: every run holds the whole vocabulary."""
    import numpy as np
    vocab = sorted({w for _, _, s in train + ev for w in s.split()})
    idx = {w: i for i, w in enumerate(vocab)}

    def counts(words):
        c = np.zeros(len(vocab))
        for w in words:
            c[idx[w]] += 1
        return c
    theta0 = np.log(counts([w for _, _, s in train for w in s.split()]) + alpha)
    evc = {e: counts([w for d, _, s in ev if d == e for w in s.split()]) for e, _, _ in ev}

    def lse(th):
        mx = th.max()
        return mx + math.log(np.exp(th - mx).sum())

    def losses(th):
        return {e: lse(th) - float(c @ th) / c.sum() for e, c in evc.items()}
    out = {}
    for d in sorted({d for d, _, _ in train}):
        rows = sorted((r, s) for dd, r, s in train if dd == d)
        slices = [[] for _ in range(n_micro)]
        for o, (_, s) in enumerate(rows):
            slices[o * n_micro // len(rows)].extend(s.split())
        th, v = theta0.copy(), np.zeros(len(vocab))
        out[(d, 0)] = losses(th)
        for t in range(1, steps + 1):
            q = counts(slices[t - 1]) / len(slices[t - 1])
            g = np.exp(th - lse(th)) - q
            if opt.max_grad_norm:
                g = g * min(1.0, opt.max_grad_norm / (math.sqrt((g * g).sum()) + 1e-6))
            if opt.name == "sgd":
                u = g
            else:
                b2 = 1.0 - t ** opt.decay_rate
                v = b2 * v + (1 - b2) * (g * g + opt.eps1)
                u = g / np.sqrt(v)
                u = u / max(1.0, math.sqrt((u * u).mean()) / opt.clip_threshold)
            th = th + opt.lr_at(t) * u
            out[(d, t)] = losses(th)
    return out


@pytest.mark.parametrize("opt", [Optim("sgd", lr=0.5, max_grad_norm=0.05),
                                 Optim("adafactor", lr=0.05)])
def test_compressed_params_equal_brute_force(spark, opt):
    """Tokens a run never trains on and no evaluation set counts are collapsed
    by count class; the losses must equal the full runs x vocabulary loop."""
    train = [("a", 1, "p q r s"), ("a", 2, "t u p"), ("b", 3, "v w x"), ("b", 4, "y z v"),
             ("c", 5, "p v k"), ("c", 6, "m n o")]
    ev = [("e", 1, "p v m zz"), ("f", 2, "q y")]
    schema = "dataset string, row_id long, text string"
    tr, er = spark.createDataFrame(train, schema), spark.createDataFrame(ev, schema)
    tc = lm.token_counts(tr)
    ec = lm.token_counts(er).withColumnRenamed("dataset", "eval_dataset")
    model = lm.fit_unigram(tc, lm.vocabulary(tc, ec), 1.0)
    q, w = U.step_targets(U.micro_batch_counts(tr, 2))
    log = U.unlearn_log(model, q, w, ec, 2, opt)
    got = {(r.run_id, r.step, r.eval_dataset): r.loss for r in log.collect() if r.eval_dataset}
    want = _brute_unlearn(train, ev, opt, 2, 2)
    assert len(got) == 3 * 3 * 2
    for (d, t), per in want.items():
        for e, val in per.items():
            assert got[(d, t, e)] == pytest.approx(val, abs=1e-9)


def test_initial_params_compression_invariants(spark):
    """Per run the multiplicities add up to the vocabulary; exactly the tokens
    the run trains on are their own rows, evaluation tokens are not; the table
    has no more rows than (run, token) pairs plus classes, and classes and
    active tokens together hold every evaluation count."""
    train = [("a", 1, "p q r s"), ("a", 2, "t u p"), ("b", 3, "v w x"), ("b", 4, "y z v"),
             ("c", 5, "p v k"), ("c", 6, "m n o")]
    ev = [("e", 1, "p v m zz"), ("f", 2, "q y")]
    schema = "dataset string, row_id long, text string"
    tr, er = spark.createDataFrame(train, schema), spark.createDataFrame(ev, schema)
    tc = lm.token_counts(tr)
    ec = lm.token_counts(er).withColumnRenamed("dataset", "eval_dataset")
    model = lm.fit_unigram(tc, lm.vocabulary(tc, ec), 1.0)
    V, n_counts = model.count(), model.select("count").distinct().count()
    q, _ = U.step_targets(U.micro_batch_counts(tr, 2))
    wide = lm.eval_wide(ec, ["e", "f"])
    runs = ["a", "b", "c"]
    p, rest = U._initial_params(model, q, wide, ["e", "f"], runs, False, 100)
    p, rest = p.collect(), rest.collect()
    pairs = {(d, w) for d, _, s in train for w in s.split()}
    assert len(p) <= len(pairs) + len(runs) * n_counts
    assert len(rest) == sum(x.tok is None for x in p)
    for r in runs:
        rows = [x for x in p if x.run_id == r]
        assert sum(x.n for x in rows) == V
        own = {w for d, w in pairs if d == r}
        assert {x.tok for x in rows if x.tok is not None} == own
        assert all(x.n == 1 for x in rows if x.tok is not None)
        for i, e in enumerate("ef"):
            words = [w for d, _, s in ev if d == e for w in s.split()]
            assert sum(x[f"_e{i}"] for x in rest if x.run_id == r) == sum(w not in own for w in words)


def _weights(rows, batch_rows, mean_of_batches=False):
    """Brute force of ``batch_weighted_counts``."""
    out = {}
    for d in {r[0] for r in rows}:
        mine = [(s or "").split() for _, _, s in sorted(r for r in rows if r[0] == d)]
        batches = [mine[i:i + batch_rows] for i in range(0, len(mine), batch_rows)]
        batches = [b for b in batches if any(b)]
        for b in batches:
            toks = [w for r in b for w in r]
            for w in toks:
                x = 1 / (len(toks) * len(batches)) if mean_of_batches else len(b) / len(toks)
                out[(d, w)] = out.get((d, w), 0.0) + x
    return out


@pytest.mark.parametrize("mean_of_batches", [False, True])
@pytest.mark.parametrize("batch_rows", [1, 2, 5])
def test_batch_weighted_counts(spark, batch_rows, mean_of_batches):
    rows = [("a", 1, "p q"), ("a", 2, ""), ("a", 3, "p p r"), ("a", 7, "s"), ("b", 4, ""), ("b", 9, "x y z")]
    df = spark.createDataFrame(rows, "dataset string, row_id long, text string")
    got = {(r.dataset, r.tok): r.cnt for r in U.batch_weighted_counts(df, batch_rows, mean_of_batches).collect()}
    assert got == pytest.approx(_weights(rows, batch_rows, mean_of_batches))
    nulls = spark.createDataFrame([("a", 1, None), ("a", 2, "p")], df.schema)
    assert [r.cnt for r in U.batch_weighted_counts(nulls, 2).collect()] == [2.0]


def test_inverse_equals_brute_force(spark):
    """U9 over the whole runs x vocabulary table in NumPy: micro-batches of 2
    accumulated per step, batch-weighted losses of every training set."""
    import numpy as np
    train = [("a", 1, "p q r s"), ("a", 2, "t u p"), ("b", 3, "v w x"), ("b", 4, "y z v"), ("c", 5, "p v k")]
    ev = [("e", 1, "p v m zz"), ("e", 2, "q"), ("e", 5, "v v"), ("f", 2, "q y")]
    schema = "dataset string, row_id long, text string"
    _, infl = U.unlearn_influence_inverse(spark.createDataFrame(train, schema), spark.createDataFrame(ev, schema),
                                          Optim("sgd", lr=0.5), steps=2)
    got = {(r.eval_dataset, r.train_dataset, r.step): r.influence for r in infl.collect()}
    vocab = sorted({w for _, _, s in train + ev for w in s.split()})
    counts = np.array([sum(s.split().count(w) for _, _, s in train) for w in vocab], float)
    cw, q = _weights(train, 8), _weights(ev, 2, True)

    def loss(th, d):
        c = np.array([cw.get((d, w), 0.0) for w in vocab])
        return math.log(np.exp(th).sum()) - float(c @ th) / c.sum()
    assert len(got) == 2 * 3 * 2
    for e in "ef":
        th0 = np.log(counts + 1.0)
        th = th0.copy()
        for t in (1, 2):
            th = th + 0.5 * (np.exp(th) / np.exp(th).sum() - np.array([q.get((e, w), 0.0) for w in vocab]))
            for d in "abc":
                assert got[(e, d, t)] == pytest.approx(loss(th, d) - loss(th0, d), abs=1e-9)


def test_no_slice_is_left_out(spark):
    """More slices than steps x accumulation run as further steps; targets
    beyond the steps and tokens without a parameter raise."""
    schema = "dataset string, row_id long, text string"
    tr = spark.createDataFrame([("a", i, f"p{i} q") for i in range(4)], schema)
    ev = spark.createDataFrame([("e", 1, "p0 p3")], schema)
    _, infl = U.unlearn_influence(tr, ev, Optim("sgd", lr=0.5), steps=1, n_micro=4, accum=2)
    assert {r.step for r in infl.collect()} == {1, 2}
    model, q, w = U.fit(tr, ev, 4)
    with pytest.raises(ValueError, match="4 steps"):
        U.unlearn_log(model, q, w, U.eval_weights(ev), 2, Optim("sgd"))
    with pytest.raises(ValueError, match="no parameter"):
        U.unlearn_log(model.filter("tok <> 'q'"), q, w, U.eval_weights(ev), 4, Optim("sgd"))


def test_warm_up_starts_at_zero():
    opt = Optim("sgd", lr=2.0, warmup_steps=4)
    assert [opt.lr_at(t) for t in (1, 2, 3, 4, 5, 6)] == [0.0, 0.5, 1.0, 1.5, 2.0, 2.0]


@pytest.mark.parametrize("n_micro", [1, 2, 3, 7])
def test_slice_lookup_equals_key_join(spark, n_micro, monkeypatch):
    """Slice ids from the broadcast array of slice starts equal the ones joined
    on the key, also with more slices than rows (empty slices)."""
    train = [("a", 1, "p q"), ("a", 5, "r"), ("a", 9, "s t"), ("a", 12, "u"), ("a", 20, "p"),
             ("b", 3, "v w"), ("b", 4, "x")]
    tr = spark.createDataFrame(train, "dataset string, row_id long, text string")
    got = sorted(map(tuple, U.micro_batch_counts(tr, n_micro).collect()))
    monkeypatch.setattr(U, "SLICE_LOOKUP_MAX", 0)
    want = sorted(map(tuple, U.micro_batch_counts(tr, n_micro).collect()))
    assert got == want


def test_user_scorer_shards(spark, monkeypatch):
    """A model cut into many shards gives the scores of one shard and of
    the token join."""
    import mixtrace.plans.catalog as C
    key = ["dataset", "row_id"]
    a = C.QUERIES["external_scorer"](spark, SF001).toPandas().sort_values(key).reset_index(drop=True)
    monkeypatch.setattr(C, "SCORER_SHARD", 5000)
    b = C.QUERIES["external_scorer"](spark, SF001).toPandas().sort_values(key).reset_index(drop=True)
    assert len(a) > 0 and a.equals(b)
    _, _, model, v, n = C._fitted(spark, SF001)
    assert v > 3 * 5000
    ex = lm.example_losses(C.corpora.eval_rows(spark, SF001), model, math.log(n + v)).toPandas()
    ex = ex.sort_values(key).reset_index(drop=True)
    assert a["n_tok"].tolist() == ex["n_tok"].tolist()
    assert a["nll"].tolist() == pytest.approx(ex["nll"].tolist(), abs=1e-6)


def test_fit_union_equals_fit_on_the_vocabulary(spark):
    from mixtrace.operators.models import lm
    train = spark.createDataFrame([("a", "x", 2), ("b", "x", 1), ("b", "y", 4)], "dataset string, tok string, cnt long")
    other = spark.createDataFrame([("e", "y", 1.5), ("e", "z", 2.5), ("f", "z", 1.0)], "dataset string, tok string, cnt double")
    want = lm.fit_unigram(train, lm.vocabulary(train, other), 0.5)
    got = lm.fit_union(train, other, alpha=0.5)
    assert got.dtypes == want.dtypes and sorted(got.collect()) == sorted(want.collect())
    assert lm.fit_union(train.limit(0), other.limit(0)).count() == 0
