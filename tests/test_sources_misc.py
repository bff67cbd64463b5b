"""Sinks, snapshots, projections, metrics hook and coverage checks."""

import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from mixtrace.operators import batching, evaluate, runs, selection
from mixtrace.sources import tables


def test_save_partitioned_and_read_dirs(spark):
    d = tempfile.mkdtemp(prefix="mixtrace-save-")
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "dataset string, x long")
    tables.save(df, d, partition_by=["dataset"])
    back = tables.read_dirs(spark, [f"{d}/dataset=a"], base_path=d)
    assert sorted((r.dataset, r.x) for r in back.collect()) == [("a", 1), ("a", 3)]


def test_snapshot_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="mixtrace-snap-")
    p = spark.createDataFrame([("r1", "t", 0.5), ("r2", "t", 1.5)], "run_id string, tok string, theta double")
    runs.save_snapshot(p, d, 3)
    runs.save_snapshot(p.withColumn("theta", F.col("theta") + 1), d, 4)
    got = sorted((r.run_id, r.theta) for r in runs.load_snapshot(spark, d, 4).collect())
    assert got == [("r1", 1.5), ("r2", 2.5)]


def test_projection_helpers(spark):
    df = spark.createDataFrame([(1, "x", "y")], "a long, b string, c string")
    assert selection.keep_columns(df, ["c", "a", "zz"]).columns == ["c", "a"]
    assert selection.tag(df, "ds").first().dataset == "ds"


def test_include_all_and_coverage_errors(spark):
    df = spark.createDataFrame([("a",), ("b",)], "dataset string")
    assert selection.include(df, ["all", "a"]).count() == 2
    with pytest.raises(AssertionError):
        selection.select_datasets(df, ["a", "zz"])
    assert selection.select_datasets(df, None, ["a"]).count() == 1


def test_label_lookup_missing_raises(spark):
    df = spark.createDataFrame([("d1",), ("d2",)], "dataset string")
    lab = spark.createDataFrame([("d1", "SimSame")], "dataset string, label string")
    with pytest.raises(KeyError):
        selection.attach_labels(df, lab)


def test_metrics_hook(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), ("a", 3, 3.0), ("b", 1, 2.0), ("b", 2, 5.0), ("c", 1, None)],
                               "dataset string, row_id long, v double")

    def partial(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.groupby("dataset", as_index=False)["v"].max().rename(columns={"v": "m"})
    got = {r.dataset: r.m for r in evaluate.with_metrics(df, [F.max("m").alias("m")], partial=partial,
                                                         schema="dataset string, m double").collect()}
    assert got["a"] == 3.0 and got["b"] == 5.0
    plain = evaluate.with_metrics(df, [F.max("v").alias("top"), F.count("v").alias("n")])
    assert {(r.dataset, r.top, r.n) for r in plain.collect()} == {("a", 3.0, 3), ("b", 5.0, 2), ("c", None, 0)}
    med = evaluate.exact_median(df, F.col("v"))
    assert {(r.dataset, r["median"]) for r in med.collect()} == {("a", 3.0), ("b", 3.5)}


def test_run_steps_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(batching, "STEP_CHUNK", 4)
    per = spark.createDataFrame([("a", 9), ("b", 4), ("c", 0), ("d", 1)], "run_id string, n_steps long")
    got = sorted(map(tuple, batching.run_steps(spark, per).collect()))
    assert got == [("a", i) for i in range(1, 10)] + [("b", i) for i in range(1, 5)] + [("d", 1)]


def test_example_and_token_weighting(spark):
    rows = [(0, "a", 4.0, 2, 0), (1, "a", 1.0, 1, 0)]
    df = spark.createDataFrame(rows, "row_id long, dataset string, nll double, n_tok long, batch_id long")
    ex = {r.dataset: r.loss for r in evaluate.eval_loss(df, "example").collect()}
    tok = {r.dataset: r.loss for r in evaluate.eval_loss(df, "token").collect()}
    assert ex["a"] == pytest.approx(1.5) and tok["a"] == pytest.approx(5 / 3)


def test_minimal_pairs_share_keys_across_tables(spark):
    """Both tables number their rows alike, and a key stands for one row of each class."""
    from mixtrace.operators.suites import minimal_pairs
    def rows(tag):
        return [(["the", tag, str(i)], i) for i in range(5)] + [(["of", tag, str(i)], i) for i in range(2)] + [
            (["the", "of"], 90), (["none"], 91), (None, 92)]
    pro, anti = (spark.createDataFrame(rows(t), "tokens array<string>, key long") for t in ("p", "q"))
    out = minimal_pairs(pro, anti, k=4, female=["the"], male=["of"])
    assert out.columns == ["inputs_pretokenized", "dataset", "key", "epoch"]
    got = out.collect()
    assert sorted((d, sum(r.dataset == d for r in got)) for d in {r.dataset for r in got}) == [
        (f"{t}_{g}", 4) for t in ("anti", "pro") for g in ("female", "male")]
    for r in got:
        kind, g = r.dataset.split("_")
        assert r.inputs_pretokenized == f"{'the' if g == 'female' else 'of'} {'p' if kind == 'pro' else 'q'} {r.key}"
    # a class of two rows goes round twice, one of five gives four different rows
    assert sorted(r.key for r in got if r.dataset == "pro_male") == [0, 0, 1, 1]
    assert len({r.key for r in got if r.dataset == "anti_female"}) == 4
