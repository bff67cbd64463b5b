"""Logs found by a path format, the merged metrics object, packing by shards."""

import json
import random

import pytest

from mixtrace.operators import metrics, packing, readout, runs
from test_runs_readout import GOLDEN


def _log(folder, *entries, name="trainer_state.json"):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(json.dumps({"log_history": list(entries)}, indent=1))


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_logs_by_path_format(spark, tmp_path):
    """One run a dataset, in a folder that its argument string names."""
    argv = GOLDEN[0][0]
    for i in (1, 2):
        key = GOLDEN[0][1].replace("dataset1", f"dataset{i}")
        _log(tmp_path / "model/t5" / key, {"step": 16, "epoch": 1.0, "eval_loss": 2.0 + i, "eval_loss_dataset0": 2.0 + i})
    _log(tmp_path / "model/t5/another", {"step": 1, "epoch": 1.0, "eval_loss": 9.0})
    names = spark.createDataFrame([("dataset1",), ("dataset2",)], "run_id string")
    want = [(f"dataset{i}", 16, 1.0, m, 2.0 + i) for i in (1, 2) for m in ("eval_loss", "eval_loss_dataset0")]

    template = "model/t5/" + GOLDEN[0][1].replace("dataset1", "{}") + "/"
    assert _rows(readout.log_scan(spark, str(tmp_path), runs=runs.run_folders(names, template))) == want

    keyed = spark.createDataFrame([(f"dataset{i}", argv.replace("dataset1", f"dataset{i}")) for i in (1, 2)],
                                  "run_id string, argv string").withColumn("key", runs.run_key("argv"))
    folders = runs.run_folders(keyed, "model/t5/{}", "key")
    assert _rows(readout.log_scan(spark, f"file:{tmp_path}/", runs=folders)) == want
    assert _rows(readout.log_scan(spark, str(tmp_path / "model"), runs=runs.run_folders(keyed, "t5/{}", "key"))) == want


def test_one_folder_for_all_runs_and_depths(spark, tmp_path):
    _log(tmp_path / "one", {"step": 1, "epoch": 0.5, "eval_loss": 1.0})
    _log(tmp_path / "deep/er/x", {"step": 2, "epoch": 1.0, "eval_loss": 3.0})
    m = spark.createDataFrame([("a", "one"), ("b", "one//"), ("c", "deep/er/x"), ("a", "one"), (None, "one"), ("d", None)],
                              "run_id string, folder string")
    assert _rows(readout.log_scan(spark, str(tmp_path), runs=m)) == [
        ("a", 1, 0.5, "eval_loss", 1.0), ("b", 1, 0.5, "eval_loss", 1.0), ("c", 2, 1.0, "eval_loss", 3.0)]


@pytest.mark.parametrize("name", ["a+b c", "50%25", "it's", "[x]", "{y}", "ünï", "lr=1e+4", "q?*"])
def test_folder_names_of_any_character(spark, tmp_path, name):
    root = tmp_path / f"r {name}"
    _log(root / name, {"step": 1, "epoch": 1.0, "eval_loss": 1.0})
    m = runs.run_folders(spark.createDataFrame([(name,)], "run_id string"))
    assert _rows(readout.log_scan(spark, str(root), runs=m)) == [(name, 1, 1.0, "eval_loss", 1.0)]


def test_missing_runs_are_named(spark, tmp_path):
    _log(tmp_path / "a", {"step": 1, "epoch": 1.0, "eval_loss": 1.0})
    m = runs.run_folders(spark.createDataFrame([("a",), ("lost",)], "run_id string"))
    with pytest.raises(KeyError, match="lost"):
        readout.log_scan(spark, str(tmp_path), runs=m)
    assert len(_rows(readout.log_scan(spark, str(tmp_path), runs=m, check=False))) == 1
    with pytest.raises(KeyError, match="lost"):
        readout.log_scan(spark, str(tmp_path / "none"), runs=m.filter("run_id = 'lost'"))
    assert _rows(readout.log_scan(spark, str(tmp_path), runs=m.limit(0))) == []
    with pytest.raises(ValueError):
        readout.log_scan(spark, "model/t5", runs=m)


def _metrics(spark, *rows):
    return spark.createDataFrame(rows, "run_id string, metric string, value double")


def test_metrics_end_in_one_object(spark, tmp_path):
    path = str(tmp_path / "m")
    assert _rows(metrics.load_metrics(spark, path)) == []
    metrics.save_metrics(_metrics(spark, ("r 1/=", "train_loss", 2.0), ("r 1/=", "epoch", 1.0), ("q", "epoch", 1.0),
                                  (None, "epoch", 5.0), ("q", None, 5.0), ("q", "x", None)), path, "train")
    metrics.save_metrics(_metrics(spark, ("r 1/=", "eval_loss", 3.0), ("r 1/=", "epoch", 2.0), ("r 1/=", "epoch", 1.5)), path, "eval")
    assert _rows(metrics.load_metrics(spark, path)) == [
        ("q", "epoch", 1.0), ("r 1/=", "epoch", 2.0), ("r 1/=", "eval_loss", 3.0), ("r 1/=", "train_loss", 2.0)]
    assert _rows(metrics.load_metrics(spark, path, "eval")) == [("r 1/=", "epoch", 2.0), ("r 1/=", "eval_loss", 3.0)]
    # a split saved again replaces the run's object, while the merged one keeps its other names
    metrics.save_metrics(_metrics(spark, ("r 1/=", "eval_acc", float("inf"))), path, "eval")
    assert _rows(metrics.load_metrics(spark, path, "eval")) == [("r 1/=", "eval_acc", float("inf"))]
    assert ("r 1/=", "eval_loss", 3.0) in _rows(metrics.load_metrics(spark, path))
    assert _rows(metrics.load_metrics(spark, path, "train")) == [("q", "epoch", 1.0), ("r 1/=", "epoch", 1.0), ("r 1/=", "train_loss", 2.0)]
    with pytest.raises(ValueError):
        metrics.save_metrics(_metrics(spark, ("a", "b", 1.0)), path, "all")


def test_failed_save_leaves_the_former_metrics(spark, tmp_path):
    from pyspark.sql import functions as F
    path = str(tmp_path / "m")
    metrics.save_metrics(_metrics(spark, ("r", "train_loss", 2.0)), path, "train")
    broken = _metrics(spark, ("r", "eval_loss", 3.0)).withColumn("value", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        metrics.save_metrics(broken, path, "eval")
    (tmp_path / "m" / "version-half").mkdir()  # what a lost job leaves behind
    assert _rows(metrics.load_metrics(spark, path)) == [("r", "train_loss", 2.0)]
    metrics.save_metrics(_metrics(spark, ("r", "eval_loss", 3.0)), path, "eval")
    assert _rows(metrics.load_metrics(spark, path)) == [("r", "eval_loss", 3.0), ("r", "train_loss", 2.0)]


def _plain_pack(docs, block, batch, shards):
    """(batch, block number, ids): contiguous shards, batches of each, blocks of each."""
    out, b = [], 0
    shards = min(shards, len(docs))
    for i in range(shards):
        small, more = divmod(len(docs), shards)
        lo = i * small + min(i, more)
        shard = docs[lo:lo + small + (i < more)]
        for at in range(0, len(shard), batch):
            ids = [t for d in shard[at:at + batch] for t in d or []]
            end = len(ids) // block * block if len(ids) >= block else len(ids)
            out += [(b, j // block, ids[j:min(j + block, end)]) for j in range(0, end, block)]
            b += 1
    return out


@pytest.mark.parametrize("shards,batch", [(1, 3), (4, 3), (32, 2), (7, 100)])
def test_pack_by_shards(spark, shards, batch):
    rng = random.Random(shards)
    docs = {"a": 45, "b": 3, "c": 32, None: 33}
    rows = [(d, i, None if rng.random() < .1 else [rng.randrange(99) for _ in range(rng.randrange(9))])
            for d, n in docs.items() for i in range(n)]
    df = spark.createDataFrame(rows, "dataset string, doc_id long, input_ids array<int>").repartition(5)
    got = sorted(((r.dataset or "", r.batch_id, r.block_no, r.input_ids)
                  for r in packing.pack(df, block_size=8, batch_docs=batch, shards=shards).collect()))
    want = sorted((d or "", *x) for d in docs for x in _plain_pack([r[2] for r in rows if r[0] == d], 8, batch, shards))
    assert got == want


def test_pack_refuses_no_shards(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([], "dataset string, doc_id long, input_ids array<int>"), shards=0)
