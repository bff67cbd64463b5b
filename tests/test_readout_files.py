"""Files as a trainer writes them, run ids that look like numbers, diverging
parameters and evaluation names with special characters."""

import json
import math

import pytest

from mixtrace.operators import readout, runs
from mixtrace.operators.models import lm


def test_indented_logs_strings_and_run_ids(spark, tmp_path):
    log = {"best": None, "log_history": [{"step": 1, "epoch": 0.5, "eval_loss": 2.5, "eval_loss_a": 2.25, "note": "x"},
                                         {"step": 1, "loss": 3.0}]}
    for run in ("01", "1"):
        d = tmp_path / "log" / f"run_id={run}"
        d.mkdir(parents=True)
        (d / "trainer_state.json").write_text(json.dumps(log, indent=2))
    got = sorted(map(tuple, readout.log_scan(spark, str(tmp_path / "log")).collect()))
    assert got == [(r, 1, 0.5, m, v) for r in ("01", "1") for m, v in (("eval_loss", 2.5), ("eval_loss_a", 2.25))]
    base = tmp_path / "eval_results.json"
    base.write_text(json.dumps({"eval_loss_a": 2.0, "model": "m"}, indent=2))
    assert list(map(tuple, readout.baseline_scan(spark, str(base)).collect())) == [("eval_loss_a", 2.0)]


def test_unreadable_log_raises(spark, tmp_path):
    d = tmp_path / "run_id=x"
    d.mkdir()
    (d / "trainer_state.json").write_text("{broken")
    with pytest.raises(Exception, match="unreadable JSON"):
        readout.log_scan(spark, str(tmp_path)).collect()


def test_snapshot_keeps_run_ids(spark, tmp_path):
    p = spark.createDataFrame([("01", "t", 0.5)], "run_id string, tok string, theta double")
    runs.save_snapshot(p, str(tmp_path / "s"), 3)
    assert [r.run_id for r in runs.load_snapshot(spark, str(tmp_path / "s"), 3).collect()] == ["01"]


def test_log_partition_of_large_parameters(spark):
    p = spark.createDataFrame([("r", "a", 800.0), ("r", "b", 799.0), ("r", "c", -900.0), ("q", "a", -2.0)],
                              "run_id string, tok string, theta double")
    got = {r.run_id: r.logz for r in lm.log_partition(p).collect()}
    assert got["r"] == pytest.approx(800 + math.log(1 + math.exp(-1))) and got["q"] == pytest.approx(-2)


def test_evaluation_names_with_special_characters(spark):
    train = spark.createDataFrame([("d", "a", 2), ("d", "b", 1), ("e", "a", 1)], "dataset string, tok string, cnt long")
    plain = spark.createDataFrame([("x", "a", 1), ("y", "b", 2)], "eval_dataset string, tok string, cnt long")
    odd = spark.createDataFrame([("v1.0", "a", 1), ("it's `", "b", 2)], "eval_dataset string, tok string, cnt long")
    names = {"x": "v1.0", "y": "it's `"}
    want = {(r.train_dataset, names[r.eval_dataset]): r.influence for r in lm.influence_loo(train, plain).collect()}
    assert {(r.train_dataset, r.eval_dataset): r.influence for r in lm.influence_loo(train, odd).collect()} == want
