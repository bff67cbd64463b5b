"""Run keys (T8) and the read-out (R1-R7) goldens."""

import json
import os
import tempfile

from mixtrace.operators import readout, runs

# Argument strings of published runs and the keys they have.
GOLDEN = [
    ("--unlearn --optim adafactor --max_grad_norm 0 --model_name_or_path model/t5_00 "
     "--train_dir data/synthetic_train00_dataset --dataset_names dataset1 "
     "--eval_dir data/synthetic_eval00_dataset --eval_steps 16 --logging_steps 16 "
     "--save_strategy no --num_train_epochs 1",
     "unlearn-optim=adafactor-max_grad_norm=0-t5_00-synthetic_train00_dataset-dataset_names=dataset1-synthetic_eval00_dataset"),
    ("--unlearn --optim adafactor --max_grad_norm 0 --per_device_train_batch_size 2 "
     "--gradient_accumulation_steps 128 --model_name_or_path model/t5_00 "
     "--train_dir data/synthetic_eval00_dataset --eval_dir data/synthetic_train00_dataset "
     "--each_eval_samples 256 --eval_steps 5 --logging_steps 5 --save_strategy no --max_steps 50",
     "unlearn-optim=adafactor-max_grad_norm=0-train_batch=2-accumul=128-t5_00-synthetic_eval00_dataset-synthetic_train00_dataset-each_eval_samples=256"),
    ("--learning_rate 1e-4 --train_dir d --eval_dir data/a data/b --dataset_names x y --metric rouge",
     "lr=1e-4-train=d-b-dataset_names=x=y"),
]


def test_run_key_goldens(spark):
    df = spark.createDataFrame([(a,) for a, _ in GOLDEN], "argv string")
    got = [r[0] for r in df.select(runs.run_key("argv")).collect()]
    assert got == [k for _, k in GOLDEN]


def _write(d, name, obj):
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, name), "w") as f:
        f.write(json.dumps(obj))


def test_readout_golden(spark):
    root = tempfile.mkdtemp(prefix="mixtrace-ro-")
    _write(f"{root}/state/run_id=d1", "trainer_state.json",
           {"log_history": [{"epoch": 1.0, "step": 16.0, "eval_loss": 2.5, "eval_loss_dataset0": 2.5},
                            {"epoch": 1.0, "step": 16.0, "loss": 3.0}]})
    _write(f"{root}/init", "eval_results.json", {"eval_loss": 2.0, "eval_loss_dataset0": 2.0})
    log = readout.log_scan(spark, f"{root}/state")
    base = readout.baseline_scan(spark, f"{root}/init")
    rows = sorted(tuple(r) for r in readout.influence(log, base, key="epoch").collect())
    assert rows == [("d1", "dataset0", 0.0, 0.0), ("d1", "dataset0", 1.0, 0.5)]
    inv = readout.influence(log, base, key="epoch", inverse=True)
    assert set(inv.columns) == {"eval_dataset", "train_dataset", "epoch", "influence"}
    r = inv.filter("epoch = 1").first()
    assert (r.eval_dataset, r.train_dataset) == ("d1", "dataset0")


def test_readout_missing_baseline_raises(spark):
    import pytest
    root = tempfile.mkdtemp(prefix="mixtrace-ro-")
    _write(f"{root}/state/run_id=d1", "s.json", {"log_history": [{"epoch": 1.0, "step": 1.0, "eval_loss": 1.0, "eval_loss_x": 1.0}]})
    _write(f"{root}/init", "e.json", {"eval_loss_y": 2.0})
    with pytest.raises(KeyError):
        readout.influence(readout.log_scan(spark, f"{root}/state"),
                          readout.baseline_scan(spark, f"{root}/init")).collect()


def test_pairs_csv(spark):
    from mixtrace.sources.tables import read_pairs_csv
    d = tempfile.mkdtemp(prefix="mixtrace-csv-")
    with open(f"{d}/x.csv", "w") as f:
        f.write('inputs_pretokenized,targets_pretokenized,dataset\n"a, b",7,dataset1\nwhat,008,dataset1\n')
    rows = read_pairs_csv(spark, f"{d}/x.csv").collect()
    assert rows[0].inputs_pretokenized == "a, b"
    assert rows[1].targets_pretokenized == "008"


def test_pairs_csv_roundtrip_keeps_values(spark):
    """save_pairs_csv -> read_pairs_csv returns every value unchanged; an
    empty field (empty string or NULL) reads as NULL."""
    from mixtrace.sources.tables import PAIR_SCHEMA, read_pairs_csv, save_pairs_csv
    rows = [('say "hi", then go', "  padded  ", "d1"),
            ("two\nlines", "a,b,c", "d1"),
            ("", None, "d2"),
            ('""', "tail\\", "d2")]
    df = spark.createDataFrame(rows, PAIR_SCHEMA)
    path = tempfile.mkdtemp(prefix="mixtrace-csv-rt-") + "/pairs"
    save_pairs_csv(df, path)
    def key(t):
        return tuple((x is None, x or "") for x in t)
    got = sorted((tuple(r) for r in read_pairs_csv(spark, path).collect()), key=key)
    want = [tuple(None if x == "" else x for x in t) for t in rows]
    assert got == sorted(want, key=key)
