"""Goldens for causal and seq2seq collation."""

from pyspark.sql import functions as F

from mixtrace.functions.arrays import last_subarray_pos
from mixtrace.operators import collate


def _rows(spark, data):
    return spark.createDataFrame(data, "rid int, ids array<int>, has_target boolean, batch_id long")


def test_causal_golden(spark):
    df = _rows(spark, [
        (1, [5, 6, 9, 9, 7, 8], True, 0),
        (2, [5, 9, 9, 6, 9, 9, 7], True, 0),
        (3, [5, 6, 7], True, 0),
        (4, [5, 9, 9, 9, 7], True, 0),
    ])
    out = {r.rid: r for r in collate.collate_causal(df, "ids", "has_target", [9, 9]).collect()}
    assert out[1].input_ids == [5, 6, 7, 8, 0]
    assert out[1].attention_mask == [1, 1, 1, 1, 0]
    assert out[1].labels == [-100, -100, 7, 8, -100]
    assert out[2].input_ids == [5, 9, 9, 6, 7]
    assert out[2].attention_mask == [1, 1, 1, 1, 1]
    assert out[2].labels == [-100, -100, -100, -100, 7]
    assert out[3].input_ids == [5, 6, 7, 0, 0]
    assert out[3].attention_mask == [1, 1, 1, 0, 0]
    assert out[3].labels == [-100] * 5
    assert out[3].sep_found is False
    assert out[4].input_ids == [5, 9, 7, 0, 0]
    assert out[4].labels == [-100, -100, 7, -100, -100]


def test_causal_multiple_of_8(spark):
    df = _rows(spark, [(1, [5, 6, 9, 9, 7, 8], True, 0), (2, [5, 6, 7], True, 0)])
    out = collate.collate_causal(df, "ids", "has_target", [9, 9], multiple_of=8).collect()
    assert all(len(r.input_ids) == 8 and len(r.labels) == 8 and len(r.attention_mask) == 8 for r in out)


def test_causal_without_targets_keeps_labels(spark):
    df = _rows(spark, [(1, [5, 6, 7], False, 0), (2, [4], False, 0)])
    out = {r.rid: r for r in collate.collate_causal(df, "ids", "has_target", [9, 9]).collect()}
    assert out[1].labels == [5, 6, 7]
    assert out[2].input_ids == [4, 0, 0]
    assert out[2].labels == [4, -100, -100]
    assert out[1].sep_found is None


def test_last_subarray_pos(spark):
    df = spark.createDataFrame([([5, 9, 9, 9, 7],), ([9],), ([],), ([1, 2],)], "a array<int>")
    got = [r[0] for r in df.select(last_subarray_pos("a", [9, 9])).collect()]
    assert got == [3, None, None, None]


def test_truncation_loses_separator(spark):
    df = spark.createDataFrame([("a b c d", "x y")], "p string, t string")
    ids = df.select(collate.tokenize_causal(collate.causal_text("p", "t"), 5).alias("ids")).first().ids
    assert len(ids) == 5 and ids[0] == 2


def test_seq2seq_golden(spark):
    df = spark.createDataFrame([(1, [7, 8], [3, 4, 1], 0), (2, [7, 8, 9], [3, 4, 5, 6, 1], 0)],
                               "rid int, src array<int>, tgt array<int>, batch_id long")
    out = {r.rid: r for r in collate.collate_seq2seq(df, "src", "tgt").collect()}
    assert out[1].labels == [3, 4, 1, -100, -100]
    assert out[1].decoder_input_ids == [0, 3, 4, 1, 0]
    assert out[1].input_ids == [7, 8, 0]
    assert out[1].attention_mask == [1, 1, 0]
    assert out[2].decoder_input_ids == [0, 3, 4, 5, 6]


def test_text_only_and_pass_through(spark):
    df = spark.createDataFrame([("q", "a", "d")], "inputs_pretokenized string, targets_pretokenized string, dataset string")
    r = collate.text_only(df).first()
    assert (r.inputs, r.labels, r.dataset) == ("q", "a", "d")
    t = spark.createDataFrame([([1, 2], "d", 5)], "input_ids array<int>, dataset string, other int")
    assert collate.pass_through(t).columns == ["input_ids", "dataset"]


def test_collate_pairs(spark):
    df = spark.createDataFrame([([1], [2, 3], 0), ([4, 5, 6], [7], 0)],
                               "preds array<int>, answers array<int>, batch_id long")
    out = collate.collate_pairs(df, "preds", "answers").orderBy(F.size("preds")).collect()
    assert [r.preds for r in out] == [[1, 0, 0], [4, 5, 6]]
    assert [r.answers for r in out] == [[2, 3], [7, 0]]
