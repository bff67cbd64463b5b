"""Encoding by the vocabulary's head and tail against a plain look-up."""

import random

import pytest
from pyspark.sql import functions as F

from mixtrace.operators import tokens
from mixtrace.operators.models import lm
from mixtrace.session import cut


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    words = ["the"] * 60 + [f"w{i}" for i in range(300)] + ["x" * 40, "größe"]
    rows = [("a" if i % 3 else None, i, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(80)]
    return rows + [("a", 900, None), ("a", 901, " ,. "), ("b", 902, "the " * 5000 + "unseen"), ("b", 903, "unseen unseen " + "y" * 30)]


def _docs(spark, texts):
    return spark.createDataFrame(texts, "dataset string, row_id long, text string").repartition(3)


@pytest.mark.parametrize("head_bytes", [tokens.HEAD_BYTES, 40 * 20, 40, 0])
def test_encode_equals_plain_look_up(spark, texts, head_bytes):
    df = _docs(spark, texts)
    vocab = cut(tokens.vocab_build(df.filter("dataset is null or dataset = 'a'")))
    ids = {r.tok: r.id for r in vocab.collect()}
    counted = sorted(vocab.collect(), key=lambda r: (-r["count"], r.tok))
    assert [r.id for r in counted] == list(range(4, 4 + len(counted))) and counted[0].tok == "the"
    got = {(r.dataset, r.row_id): r.ids for r in tokens.encode(df, vocab, ["dataset", "row_id"], head_bytes=head_bytes).collect()}
    want = {}
    for d, i, t in texts:
        w = (t or "").replace(",", " ").replace(".", " ").lower().split()
        if w:
            want[d, i] = [ids.get(x, tokens.UNK_ID) for x in w]
    assert got == want
    assert tokens.encode(df.limit(0), vocab, "row_id", head_bytes=head_bytes).count() == 0


def test_no_exchange_holds_the_head(spark, texts):
    """Frequent tokens aren't asked for: what a tail join reads are rare tokens, once a row."""
    df = _docs(spark, texts)
    vocab = cut(tokens.vocab_build(df))
    whole = tokens.encode(df, vocab, ["dataset", "row_id"])
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    head, all_of_it = tokens._head(vocab, 40 * 20)
    assert "the" in head and len(head) <= 20 and not all_of_it
    assert tokens._head(vocab.limit(0), 0) == ({}, True)


def test_example_losses_beyond_the_broadcast(spark, texts):
    df = _docs(spark, texts)
    model = cut(tokens.vocab_build(df).select("tok", F.log("count").alias("theta")))
    near, far = ({(r.dataset, r.row_id): (r.nll, r.n_tok) for r in lm.example_losses(df, model, 3.0, broadcast_rows=n).collect()}
                 for n in (10**6, 0))
    assert near.keys() == far.keys() and all(near[k] == (pytest.approx(far[k][0]), far[k][1]) for k in near)


def test_a_users_tokenizer(spark):
    df = spark.createDataFrame([("ab",), ("",), ("c d",)], "text string")
    fn = lambda batch: [[ord(c) for c in t] for t in batch]
    assert [r[0] for r in df.select(tokens.pandas_tokenizer(fn)).collect()] == [[97, 98], [], [99, 32, 100]]
