"""Epochs of many steps: every run in one pass, with the log of the loop by steps."""

import pytest

from mixtrace.operators import influence as U, run_loop
from mixtrace.operators.models import lm
from mixtrace.operators.optim import Optim
from test_unlearning_loop import plain_loop, tables


@pytest.mark.parametrize("opt,accum", [
    (Optim("sgd", lr=0.5), 2),
    (Optim("sgd", lr=0.5, max_grad_norm=0.05, warmup_steps=3), 1),
    (Optim("adamw", lr=0.05, weight_decay=0.1, max_grad_norm=0.5), 1),
    (Optim("adafactor", lr=0.05), 1),
])
def test_long_epochs_equal_plain_loops_and_the_loop_by_steps(spark, monkeypatch, opt, accum):
    train, ev, tr, er = tables(spark)
    batch, decayed = 2, opt.weight_decay
    steps = U.epoch_steps(tr, batch, accum)
    most = max(r.n_steps for r in steps.collect())
    model, q, w = U.fit(tr, er, None, accum, 1.0, batch)
    ec = lm.token_counts(er).withColumnRenamed("dataset", "eval_dataset")

    def log(long):
        monkeypatch.setattr(run_loop, "LONG_STEPS", long)
        rows = U.unlearn_log(model, q, w, ec, most, opt, eval_steps=4, extra_eval_steps=(1, 6), with_norms=True, with_lr=True, run_steps=steps)
        return {(r.run_id, r.step, r.eval_dataset, r.metric): r.loss for r in rows.collect()}
    got = log(most)
    if accum == 2:  # the loop by steps takes its time
        other = log(most + 1)
        assert set(got) == set(other)
        for k in got:
            assert got[k] == pytest.approx(other[k], abs=1e-9)
    if not decayed:
        want = plain_loop(train, ev, opt, batch, accum)
        last = {run: max(t for r, t in want if r == run) for run, _ in want}
        seen = {(run, t, e) for run, t, e, m in got if e}
        assert seen == {(run, t, e) for (run, t), per in want.items() for e in per if t % 4 == 0 or t in (1, 6, last[run])}
        for run, t, e in seen:
            assert got[run, t, e, "eval_loss"] == pytest.approx(want[run, t][e], abs=1e-9)
    norms = {(run, t) for run, t, _, m in got if m == "grad_norm"}
    assert norms == ({(r.run_id, t) for r in steps.collect() for t in range(1, r.n_steps + 1)} if opt.max_grad_norm else set())


def test_a_long_epoch_takes_a_few_jobs(spark):
    """50 steps: before, each was a checkpoint and a state of its own."""
    _, _, tr, er = tables(spark)
    spark.sparkContext.setJobGroup("long-epoch", "")
    log, infl = U.unlearn_influence(tr, er, Optim("sgd", lr=0.5), batch_rows=2)
    assert infl.filter("train_dataset = 'big'").count() == 2 * 50
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("long-epoch"))
    assert jobs < 200


def test_runs_too_large_for_a_task_go_by_steps(spark, monkeypatch):
    _, _, tr, er = tables(spark)
    monkeypatch.setattr(run_loop, "LONG_STEPS", 2)
    monkeypatch.setattr(run_loop, "TASK_ROWS", 3)
    monkeypatch.setattr(run_loop, "states", lambda *a: pytest.fail("one task"))
    _, infl = U.unlearn_influence(tr, er, Optim("sgd", lr=0.5), batch_rows=50)
    assert infl.count() == 2 * (2 + 1 + 1 + 1)
