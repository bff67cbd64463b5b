"""Sampling multiplicities, mixtures, ordinals, packing and batching goldens."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from mixtrace.operators import batching, evaluate, packing, sampling
from mixtrace.operators.ordinal import dense_ordinal, window_ordinal


def _groups(spark, sizes):
    rows = [(g, i) for g, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "dataset string, doc_id long")


@pytest.mark.parametrize("k,expected", [(8, {3, 2}), (2, {1, 0})])
def test_wraparound_multiplicities(spark, k, expected):
    df = _groups(spark, {"a": 3})
    out = sampling.sample(df, k, key="doc_id").collect()
    assert len(out) == k
    mult = Counter(r.doc_id for r in out)
    counts = sorted([mult.get(i, 0) for i in range(3)], reverse=True)
    assert set(counts) == expected
    assert sum(counts) == k


def test_empty_group_yields_nothing(spark):
    df = _groups(spark, {"a": 3}).filter(F.lit(False))
    assert sampling.sample(df, 5, key="doc_id").count() == 0


def test_sample_methods_agree(spark):
    df = _groups(spark, {"a": 40, "b": 7, "c": 1})
    w = sorted(map(tuple, sampling.sample(df, 13, key="doc_id", method="window").collect()))
    o = sorted(map(tuple, sampling.sample(df, 13, key="doc_id", method="ordinal").collect()))
    assert w == o and len(w) == 39


def test_weighted_counts(spark):
    fr = spark.createDataFrame([(f"d{i}", f) for i, f in enumerate(
        [0.30, 0.20, 0.15, 0.10, 0.10, 0.05, 0.05, 0.05])], "dataset string, frac double")
    ks = [r.k for r in sampling.fractions_to_counts(fr, 320000).orderBy("dataset").collect()]
    assert ks == [96000, 64000, 48000, 32000, 32000, 16000, 16000, 16000]
    bad = spark.createDataFrame([("a", 0.5), ("b", 0.4)], "dataset string, frac double")
    with pytest.raises(ValueError):
        sampling.fractions_to_counts(bad, 10)


def test_dense_ordinal_matches_window(spark):
    df = _groups(spark, {"a": 57, "b": 3, "c": 20})
    a = sorted(map(tuple, dense_ordinal(df, "dataset", ["doc_id"], partitions=5).collect()))
    b = sorted(map(tuple, window_ordinal(df, "dataset", ["doc_id"]).collect()))
    assert a == b


def test_pack_golden(spark):
    seqs = spark.createDataFrame([
        ("d", 0, [1, 2, 3]), ("d", 1, [4, 5, 6]),
        ("d", 2, [7, 8]), ("d", 3, [9]),
        ("d", 4, [10, 11, 12, 13, 14]),
    ], "dataset string, doc_id long, input_ids array<int>")
    out = packing.pack(seqs, block_size=4, batch_docs=2).orderBy("batch_id", "block_no").collect()
    assert [(r.batch_id, r.block_no, r.input_ids) for r in out] == [
        (0, 0, [1, 2, 3, 4]), (1, 0, [7, 8, 9]), (2, 0, [10, 11, 12, 13])]
    assert all(r.labels == r.input_ids for r in out)


def test_task_batches_and_batch_weighted_mean(spark):
    rows = [(0, "a", 4.0, 2), (1, "b", 6.0, 3), (2, "a", 2.0, 1), (3, "a", 9.0, 3),
            (4, "b", 1.0, 1), (5, "a", 1.0, 4), (6, "a", 5.0, 5)]
    df = spark.createDataFrame(rows, "row_id long, dataset string, nll double, n_tok long")
    b = batching.task_batches(df, 2, order="row_id")
    got = {r.row_id: r.batch_id for r in b.collect()}
    assert got == {0: 0, 2: 0, 3: 1, 5: 1, 6: 2, 1: 3, 4: 3}
    e = {r.dataset: r.loss for r in evaluate.eval_loss(b, "batch").collect()}
    assert e["a"] == pytest.approx(1.571429, abs=1e-6)
    assert e["b"] == pytest.approx(1.75, abs=1e-6)
    assert e[None] == pytest.approx(1.622449, abs=1e-6)


def test_eval_schedule(spark):
    steps = spark.range(1, 41).withColumnRenamed("id", "step")
    assert [r.step for r in batching.eval_schedule(steps, 16).orderBy("step").collect()] == [16, 32]
    assert [r.step for r in batching.eval_schedule(steps, 16, denser=True).orderBy("step").collect()] == [1, 16, 32]


def test_shuffle_keeps_batches_whole(spark):
    df = _groups(spark, {"a": 10, "b": 5})
    b = batching.task_batches(df.withColumnRenamed("doc_id", "row_id"), 3, order="row_id")
    s = batching.shuffle_batches(b)
    per = s.groupBy("batch_id").agg(F.countDistinct("orig_batch_id").alias("n"),
                                    F.countDistinct("dataset").alias("d")).collect()
    assert all(r.n == 1 and r.d == 1 for r in per)
    assert s.count() == 15


def test_running_max_matches_window(spark):
    from pyspark.sql.window import Window
    from mixtrace.operators.ordinal import running_max
    rows = [(c, t, (t * 7 + c) % 3 == 0) for c in range(4) for t in range(30 if c == 0 else 5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, is_user boolean")
    v = F.when(F.col("is_user"), F.col("turn"))
    a = running_max(df, "conv_id", ["turn"], v, "q", partitions=6)
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    b = df.withColumn("q", F.max(v).over(w))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_qa_builder_array_input(spark):
    from mixtrace.operators import suites
    raw = spark.createDataFrame(
        [(" Why? ", "Indexical Error: Time", [" a ", "b"], "q1"),
         ("How", "Law", ["c"], "q2"),
         ("What", "Confusion: People", ["d", "e", "f"], "q3")],
        "question string, category string, incorrect_answers array<string>, key string")
    out = suites.qa_falsehoods(raw, k=4, min_count=2).collect()
    assert {r.dataset for r in out} == {"indexical_error", "confusion"}
    assert len(out) == 8
    assert {r.targets_pretokenized for r in out if r.dataset == "indexical_error"} == {"a", "b"}
    assert {r.inputs_pretokenized for r in out if r.dataset == "indexical_error"} == {"Why?"}


def test_dense_ordinal_null_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "dataset string, doc_id long")
    got = sorted((r.dataset or "", r.o) for r in dense_ordinal(df, "dataset", ["doc_id"], "o").collect())
    assert got == [("", 0), ("", 1), ("a", 0)]


def test_sample_properties(spark):
    """Exactly k rows per non-empty group; each row appears floor(k/N) or ceil(k/N) times."""
    from hypothesis import given, settings, strategies as st

    @settings(max_examples=8, deadline=None)
    @given(st.dictionaries(st.sampled_from("abcd"), st.integers(1, 9), min_size=1, max_size=3),
           st.integers(0, 25))
    def check(sizes, k):
        df = _groups(spark, sizes)
        out = sampling.sample(df, k, key="doc_id", method="ordinal" if k % 2 else "window").collect()
        per = Counter(r.dataset for r in out)
        for g, n in sizes.items():
            assert per.get(g, 0) == k
            mult = Counter(r.doc_id for r in out if r.dataset == g)
            assert all(k // n <= mult.get(i, 0) <= -(-k // n) for i in range(n))
    check()


@pytest.mark.parametrize("k", [3, 7, 17])
def test_sample_rows_equals_grouped_sample(spark, k):
    """Whole-table sampling (literal epochs, no spec join) draws the same rows
    as the grouped sampler over a single 'all' group, on both ranking paths."""
    from mixtrace.operators import sampling
    df = spark.createDataFrame([(i, f"t{i}") for i in range(7)], "doc_id long, text string")
    ref = sampling.sample(df.withColumn("_all", F.lit("all")), k, by="_all", key="doc_id",
                          seed=42, salt="x").drop("_all")
    want = sorted((r.doc_id, r.epoch) for r in ref.collect())
    assert len(want) == k
    for method in ("window", "ordinal"):
        got = sampling.sample_rows(df, k, key="doc_id", seed=42, salt="x", method=method)
        assert got.columns == ["doc_id", "text", "epoch"]
        assert sorted((r.doc_id, r.epoch) for r in got.collect()) == want
