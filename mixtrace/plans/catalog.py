"""Catalogue of registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the driver tables (or what Spark derives from them) in
full.  ``ORACLE`` holds the DuckDB twin for each query that has one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.models import lm
from ..sources import corpora
from . import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

ALPHA = 1.0


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _counts(spark, sf, once: bool = False):
    """Token counts of the training sources and evaluation sets, materialised
    once in the checkpoint folder (each feeds several jobs, or ``once`` a single one)."""
    from ..session import cut
    train = lm.token_counts(corpora.train_rows(spark, sf))
    ev = lm.token_counts(corpora.eval_rows(spark, sf)).withColumnRenamed("dataset", "eval_dataset")
    return (train, ev) if once else (cut(train), cut(ev))


@register("influence_loo", O.influence_loo(ALPHA))
def q_influence_loo(spark: SparkSession, sf: str) -> DataFrame:
    train, ev = _counts(spark, sf)
    out = lm.influence_loo(train, ev, alpha=ALPHA)
    return out.select("train_dataset", "eval_dataset", r6("influence").alias("influence"))


# ---------------------------------------------------------------- sampling
from ..operators import sampling, selection, suites  # noqa: E402
from ..sources.tables import table  # noqa: E402

SEED = 42


def _docs(spark, sf):
    return corpora.train_rows(spark, sf).select("dataset", F.col("row_id").alias("doc_id"))


@register("sample_exact", O.sample_sql(f"SELECT source AS dataset, doc_id FROM documents",
                                       ["dataset"], "doc_id", ["dataset", "doc_id"], k=7,
                                       seed=SEED, salt="m1"))
def q_sample_exact(spark, sf):
    """M1: 7 documents from every source (k < N)."""
    return sampling.sample(_docs(spark, sf), 7, key="doc_id", seed=SEED, salt="m1")


@register("sample_wraparound", O.sample_sql(f"SELECT source AS dataset, doc_id FROM documents",
                                            ["dataset"], "doc_id", ["dataset", "doc_id"], k=120,
                                            seed=SEED, salt="m2"))
def q_sample_wraparound(spark, sf):
    """M2: 120 documents from every source; k > N wraps around."""
    return sampling.sample(_docs(spark, sf), 120, key="doc_id", seed=SEED, salt="m2")


# Per-source sample sizes of the corpus builder (a parameter table; sources
# without an entry are dropped, like corpora that are not listed).
SPEC_ROWS = [("src0", 400), ("src1", 40), ("src2", 10), ("src3", 1), ("src4", 100), ("src5", 60)]
SPEC_SQL = " UNION ALL ".join(f"SELECT '{d}' AS dataset, CAST({k} AS BIGINT) AS k" for d, k in SPEC_ROWS)


@register("corpus_sample_by_spec", O.sample_sql(
    "SELECT source AS dataset, doc_id FROM documents", ["dataset"], "doc_id",
    ["dataset", "doc_id"], spec=SPEC_SQL, seed=SEED, salt="m3"))
def q_corpus_sample_by_spec(spark, sf):
    """M3: per-source sample sizes from a spec table (broadcast)."""
    spec = spark.createDataFrame(SPEC_ROWS, "dataset string, k long")
    return sampling.sample(_docs(spark, sf), spec, key="doc_id", seed=SEED, salt="m3")


@register("stratified_256", O.sample_sql("SELECT lang, doc_id FROM documents", ["lang"], "doc_id",
                                         ["lang", "doc_id"], k=256, seed=SEED, salt="m4"))
def q_stratified_256(spark, sf):
    """M4: 256 documents per language (small languages wrap around)."""
    d = table(spark, sf, "documents").select("lang", "doc_id")
    return sampling.sample(d, 256, by="lang", key="doc_id", seed=SEED, salt="m4")


@register("each_eval_samples", O.sample_sql(O.EVAL_ROWS.replace(", text", ""), ["dataset"], "row_id",
                                            ["dataset", "row_id"], k=32, seed=SEED, salt="m5"))
def q_each_eval_samples(spark, sf):
    """M5: ``each_eval_samples`` = 32 rows per evaluation dataset."""
    ev = corpora.eval_rows(spark, sf).select("dataset", "row_id")
    return sampling.sample(ev, 32, key="row_id", seed=SEED, salt="m5")


@register("max_samples", O.sample_sql("SELECT 'all' AS _all, source AS dataset, doc_id FROM documents",
                                      ["_all"], "doc_id", ["dataset", "doc_id"], k=100,
                                      seed=SEED, salt="m6"))
def q_max_samples(spark, sf):
    """M6: ``max_train_samples`` = 100 rows over the whole training table."""
    return sampling.sample_rows(_docs(spark, sf), 100, key="doc_id", seed=SEED, salt="m6")


@register("mixture_equal", O.sample_sql("SELECT source AS dataset, doc_id FROM documents", ["dataset"],
                                        "doc_id", ["dataset", "doc_id"], k=60, seed=SEED, salt="equal"))
def q_mixture_equal(spark, sf):
    """M7: equal mixture, 60 rows from every source."""
    return sampling.equal_mixture(_docs(spark, sf), 60, seed=SEED)


EIGHT = [f"src{i}" for i in range(8)]
EIGHT_SQL = "SELECT source AS dataset, doc_id FROM documents WHERE source IN (" + \
    ", ".join(f"'{s}'" for s in EIGHT) + ")"


WEIGHTED_TOTAL = 400
_FRAC_SQL = " UNION ALL ".join(
    f"SELECT '{d}' AS dataset, CAST(floor({WEIGHTED_TOTAL} * {f}) AS BIGINT) AS k"
    for d, f in zip(EIGHT, O.MIXTURE_FRACTIONS))


@register("mixture_weighted", O.sample_sql(EIGHT_SQL, ["dataset"], "doc_id", ["dataset", "doc_id"],
                                           spec=_FRAC_SQL, seed=SEED, salt="mixture"))
def q_mixture_weighted(spark, sf):
    """M8: weighted mixture of 8 sources, total 400."""
    fr = spark.createDataFrame(list(zip(EIGHT, O.MIXTURE_FRACTIONS)), "dataset string, frac double")
    d = selection.include(_docs(spark, sf), EIGHT)
    return sampling.mixture(d, fr, WEIGHTED_TOTAL, seed=SEED)


# ---------------------------------------------------------------- selection
@register("dense_index", "SELECT source AS dataset, doc_id, "
          "CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS BIGINT) AS \"index\" "
          "FROM documents")
def q_dense_index(spark, sf):
    """0-based ordinal per dataset (distributed ordinal)."""
    return sampling.with_index(_docs(spark, sf), "dataset", "doc_id")


@register("select_datasets", "SELECT source AS dataset, doc_id FROM documents "
          "WHERE source IN ('src1', 'src3', 'src5')")
def q_select_datasets(spark, sf):
    """P8 (+P10 check): include three datasets."""
    return selection.select_datasets(_docs(spark, sf), ["src1", "src3", "src5"])


@register("loo_select", "SELECT source AS dataset, doc_id FROM documents "
          "WHERE source NOT IN ('src0', 'src19')")
def q_loo_select(spark, sf):
    """P8 with "all" (disabled) then P9 leave-out."""
    return selection.select_datasets(_docs(spark, sf), ["all"], ["src0", "src19"])


@register("coverage_check", """
SELECT coalesce(r.dataset, f.dataset) AS dataset, r.dataset IS NOT NULL AS requested,
       f.dataset IS NOT NULL AS found
FROM (SELECT unnest(['src0', 'src5', 'src99']) AS dataset) r
FULL OUTER JOIN (SELECT DISTINCT source AS dataset FROM documents) f ON r.dataset = f.dataset""")
def q_coverage_check(spark, sf):
    """P10: requested vs found names (src99 requested but absent)."""
    return selection.coverage(_docs(spark, sf), ["src0", "src5", "src99"])


@register("distinct_datasets", """
SELECT dataset, first_key, CAST(row_number() OVER (ORDER BY first_key, dataset) - 1 AS BIGINT) AS position
FROM (SELECT source AS dataset, min(doc_id) AS first_key FROM documents GROUP BY source)""")
def q_distinct_datasets(spark, sf):
    """Distinct datasets in first-appearance order."""
    return selection.distinct_in_order(_docs(spark, sf), "doc_id")


# ---------------------------------------------------------------- suites
@register("toxic_suite", O.sample_sql(
    f"SELECT generation AS inputs_pretokenized, \"group\" AS dataset, key FROM ({O.TOXIC_RAW}) "
    "WHERE prompt_label = 1 AND len(string_split(generation, ' ')) > 8 "
    "AND len(string_split(generation, ' ')) <= 24",
    ["dataset"], "key", ["inputs_pretokenized", "dataset", "key"], k=256, seed=SEED, salt="toxic"))
def q_toxic_suite(spark, sf):
    """B1 (P5, P6, T1, M4)."""
    return suites.toxic_prompts(corpora.toxic_prompt_raw(spark, sf), seed=SEED)


@register("coref_suite", O.sample_sql(
    f"SELECT * FROM ({O.COREF_ROWS}) WHERE dataset IS NOT NULL", ["dataset"], "key",
    ["inputs_pretokenized", "dataset", "key"], k=256, seed=SEED, salt="coref"))
def q_coref_suite(spark, sf):
    """B2 (P7, T2, T6, M4) with word lists {the, that} / {and, of}."""
    pro, anti = corpora.minimal_pair_raw(spark, sf)
    return suites.minimal_pairs(pro, anti, seed=SEED, female=["the", "that"], male=["and", "of"])


QA_MIN = 45  # drops one category at sf0.01 (health, 42 pairs)


@register("qa_suite", O.sample_sql(
    f"SELECT * FROM ({O.QA_ROWS}) WHERE dataset IN (SELECT dataset FROM ({O.QA_ROWS}) "
    f"GROUP BY dataset HAVING count(*) >= {QA_MIN})", ["dataset"], "pair_key",
    ["inputs_pretokenized", "targets_pretokenized", "dataset", "pair_key"], k=256, seed=SEED, salt="qa"))
def q_qa_suite(spark, sf):
    """B3 (T3, T4, T5, T7, HAVING count >= 45, M4)."""
    return suites.qa_falsehoods(corpora.qa_raw(spark, sf), min_count=QA_MIN, seed=SEED)


# ---------------------------------------------------------------- tokens, packing, batches
from ..functions.arrays import ids_string  # noqa: E402
from ..operators import batching, evaluate, packing, tokens  # noqa: E402

def _encoded(spark, sf):
    """Training and evaluation rows encoded with the training corpora's whole vocabulary."""
    from ..session import cut
    rows = corpora.train_rows(spark, sf).unionByName(corpora.eval_rows(spark, sf))
    return tokens.encode(rows, cut(tokens.vocab_build(corpora.train_rows(spark, sf))), ["dataset", "row_id"])


@register("vocab_build", O.vocab_sql())
def q_vocab_build(spark, sf):
    """K1: vocabulary job, every token of the training corpora, dense ids."""
    return tokens.vocab_build(corpora.train_rows(spark, sf))


@register("encode", O.encode_sql())
def q_encode(spark, sf):
    """K1: encode the training corpora and the evaluation rows with the
    vocabulary of the training corpora; <unk> fallback."""
    enc = _encoded(spark, sf)
    return enc.select("dataset", "row_id", F.size("ids").cast("long").alias("n_ids"),
                      F.size(F.filter("ids", lambda x: x == tokens.UNK_ID)).cast("long").alias("n_unk"),
                      F.md5(ids_string("ids")).alias("ids_md5"))


PACK_BLOCK, PACK_BATCH = 1024, 16


@register("pack_blocks", O.pack_sql(PACK_BLOCK, PACK_BATCH))
def q_pack_blocks(spark, sf):
    """K2-K3: space-split documents packed per source, 16-document batches, 1024 blocks."""
    d = table(spark, sf, "documents").select(F.col("source").alias("dataset"), "doc_id",
                                             F.split("text", " ").alias("input_ids"))
    p = packing.pack(d, block_size=PACK_BLOCK, batch_docs=PACK_BATCH)
    return p.select("dataset", "batch_id", "block_no",
                    F.size("input_ids").cast("long").alias("n_tokens"),
                    F.md5(F.array_join("input_ids", " ")).alias("block_md5"))


PACK_SHARDS = 32


@register("pack_blocks_sharded", O.pack_sql(PACK_BLOCK, PACK_BATCH, shards=PACK_SHARDS))
def q_pack_blocks_sharded(spark, sf):
    """K2 as 32 processes do it: contiguous shards of each source, batches that end with their shard."""
    d = table(spark, sf, "documents").select(F.col("source").alias("dataset"), "doc_id",
                                             F.split("text", " ").alias("input_ids"))
    p = packing.pack(d, block_size=PACK_BLOCK, batch_docs=PACK_BATCH, shards=PACK_SHARDS)
    return p.select("dataset", "batch_id", "block_no",
                    F.size("input_ids").cast("long").alias("n_tokens"),
                    F.md5(F.array_join("input_ids", " ")).alias("block_md5"))


def _event_batches(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("dataset"), "event_id")
    return batching.task_batches(e, 8, order="event_id")


@register("task_batches", O.task_batches_sql("SELECT event_type AS dataset, event_id FROM events",
                                             "event_id", 8))
def q_task_batches(spark, sf):
    """Events as an evaluation table (dataset = event_type), batches of 8."""
    return _event_batches(spark, sf)


@register("task_batches_shuffled", f"""
WITH tb AS ({O.task_batches_sql("SELECT event_type AS dataset, event_id FROM events", "event_id", 8)}),
r AS (SELECT batch_id, CAST(row_number() OVER (ORDER BY md5(concat_ws(':', '{SEED}batches',
                 CAST(batch_id AS VARCHAR))), batch_id) - 1 AS BIGINT) AS new_id
      FROM (SELECT DISTINCT batch_id FROM tb))
SELECT tb.dataset, tb.event_id, tb.pos, tb.batch_id AS orig_batch_id, r.new_id AS batch_id
FROM tb JOIN r USING (batch_id)""")
def q_task_batches_shuffled(spark, sf):
    """Whole batches permuted, rows inside a batch untouched."""
    return batching.shuffle_batches(_event_batches(spark, sf), seed=SEED)


EVAL_BS = 8


def _fitted(spark, sf):
    from ..session import cut
    train, ev = _counts(spark, sf)
    vocab = lm.vocabulary(train, ev)
    v = vocab.count()
    n = train.agg(F.sum("cnt")).first()[0]
    model = cut(lm.fit_unigram(train, vocab, ALPHA))
    return train, ev, model, v, n


def _lm_losses(spark, sf):
    _, _, model, v, n = _fitted(spark, sf)
    logz = __import__("math").log(n + ALPHA * v)
    rows = corpora.eval_rows(spark, sf)
    ex = lm.example_losses(rows, model, logz, ALPHA)
    b = batching.task_batches(rows.select("dataset", "row_id"), EVAL_BS, order="row_id")
    return b.join(ex, ["dataset", "row_id"])


@register("batch_loss", f"WITH {O.lm_losses_ctes(ALPHA, EVAL_BS)} "
          "SELECT dataset, batch_id, round(loss, 6) AS loss, n_rows, n_tok FROM bl")
def q_batch_loss(spark, sf):
    """Unigram-model mean NLL over the tokens of each evaluation batch."""
    b = evaluate.batch_loss(_lm_losses(spark, sf))
    return b.select("dataset", "batch_id", r6("loss").alias("loss"), "n_rows", "n_tok")


@register("eval_loss", f"WITH {O.lm_losses_ctes(ALPHA, EVAL_BS)} "
          "SELECT dataset, round(sum(loss * n_rows) / sum(n_rows), 6) AS loss FROM bl GROUP BY ROLLUP (dataset)")
def q_eval_loss(spark, sf):
    """Batch-weighted per-dataset and overall evaluation loss."""
    e = evaluate.eval_loss(_lm_losses(spark, sf), "batch")
    return e.select("dataset", r6("loss").alias("loss"))


@register("eval_loss_token", f"WITH {O.lm_losses_ctes(ALPHA, EVAL_BS)} "
          "SELECT dataset, round(sum(nll) / sum(n_tok), 6) AS loss FROM l GROUP BY ROLLUP (dataset)")
def q_eval_loss_token(spark, sf):
    """E5: token-weighted variant."""
    e = evaluate.eval_loss(_lm_losses(spark, sf), "token")
    return e.select("dataset", r6("loss").alias("loss"))


@register("eval_log_wide", f"""WITH {O.lm_losses_ctes(ALPHA, EVAL_BS)},
el AS (SELECT dataset, sum(loss * n_rows) / sum(n_rows) AS loss FROM bl GROUP BY ROLLUP (dataset))
SELECT round(max(CASE WHEN dataset IS NULL THEN loss END), 6) AS eval_loss,
       round(max(CASE WHEN dataset = 'bench' THEN loss END), 6) AS eval_loss_bench,
       round(max(CASE WHEN dataset = 'toxic' THEN loss END), 6) AS eval_loss_toxic FROM el""")
def q_eval_log_wide(spark, sf):
    """Metric names eval_loss / eval_loss_<dataset>, long -> wide with explicit names."""
    e = evaluate.eval_loss(_lm_losses(spark, sf), "batch")
    long = e.select(evaluate.metric_name().alias("metric"), r6("loss").alias("value"))
    names = [r[0] for r in long.select("metric").distinct().collect()]
    return evaluate.eval_log_wide(long, names)


@register("sample_counts", f"""
SELECT 'train' AS split, count(*) AS n_rows, CAST(100 AS BIGINT) AS max_samples, least(count(*), 100) AS samples FROM documents
UNION ALL
SELECT 'eval', count(*), CAST(NULL AS BIGINT), count(*) FROM ({O.EVAL_ROWS})""")
def q_sample_counts(spark, sf):
    """train_samples = min(max_train_samples, len); eval without a maximum."""
    tr = corpora.train_rows(spark, sf).agg(F.count(F.lit(1)).alias("n_rows")) \
        .select(F.lit("train").alias("split"), "n_rows", F.lit(100).cast("long").alias("max_samples"))
    ev = corpora.eval_rows(spark, sf).agg(F.count(F.lit(1)).alias("n_rows")) \
        .select(F.lit("eval").alias("split"), "n_rows", F.lit(None).cast("long").alias("max_samples"))
    return evaluate.sample_counts(tr.unionByName(ev))


@register("eval_schedule", """
SELECT dataset, step FROM (SELECT source AS dataset, count(*) AS n FROM documents GROUP BY source) c,
  LATERAL (SELECT unnest(range(1, c.n + 1)) AS step)
WHERE step % 16 = 0 OR step IN (1, 50, 100, 200)""")
def q_eval_schedule(spark, sf):
    """One step per training document (batch 1, one epoch); evaluate every
    16 steps and at the denser extra steps."""
    per = corpora.train_rows(spark, sf).groupBy("dataset").agg(F.count(F.lit(1)).alias("n_steps"))
    steps = batching.run_steps(spark, per, run="dataset")
    return batching.eval_schedule(steps, 16, denser=True)


@register("lm_fit", f"""WITH {O.counts_ctes(ALPHA)}
SELECT tok, CAST(coalesce(cw.C, 0) AS BIGINT) AS count, round(ln(coalesce(cw.C, 0) + {float(ALPHA)}), 6) AS theta
FROM vocab LEFT JOIN cw USING (tok)""")
def q_lm_fit(spark, sf):
    """Closed-form unigram fit over the train+eval vocabulary."""
    _, _, model, _, _ = _fitted(spark, sf)
    return model.select("tok", "count", r6("theta").alias("theta"))


@register("lm_eval_loss", f"""WITH {O.counts_ctes(ALPHA)}
SELECT ec.eval_dataset, round(sum(ec.cnt * (ln(nt.N + {float(ALPHA)} * vs.V) - ln(coalesce(cw.C, 0) + {float(ALPHA)}))) / sum(ec.cnt), 6) AS loss,
       CAST(sum(ec.cnt) AS BIGINT) AS n_tokens
FROM ec LEFT JOIN cw USING (tok) CROSS JOIN nt CROSS JOIN vs GROUP BY ec.eval_dataset""")
def q_lm_eval_loss(spark, sf):
    """Loss of the fitted model on each evaluation set (token mean)."""
    train, ev, model, v, n = _fitted(spark, sf)
    out = lm.eval_loss_full(model, ev, v, n, ALPHA)
    return out.select("eval_dataset", r6("loss").alias("loss"), "n_tokens")


# ---------------------------------------------------------------- collation
import hashlib  # noqa: E402

from ..operators import collate  # noqa: E402
from ..operators.ordinal import dense_ordinal  # noqa: E402

COLLATE_MAX, COLLATE_BS = 64, 8
SRC_MAX, TGT_MAX = 48, 16
SEP_ID = int(hashlib.md5(collate.SEP_TEXT.encode()).hexdigest()[:8], 16) % 50_000 + 4


def _pairs(spark, sf):
    """Every user turn with the assistant turn that follows it (turn + 1; NULL
    when none does), batches of 8 in (conv_id, turn) order."""
    c = table(spark, sf, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    a = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    # the ordinal sees the narrow keys; the texts join afterwards
    o = dense_ordinal(u.select("conv_id", "turn"), None, ["conv_id", "turn"], name="_ord")
    b = o.select("conv_id", "turn", F.floor(F.col("_ord") / COLLATE_BS).cast("long").alias("batch_id"))
    return u.join(a, ["conv_id", "turn"], "left").join(b, ["conv_id", "turn"])


@register("collate_causal", O.collate_causal_sql(COLLATE_MAX, SEP_ID, COLLATE_BS))
def q_collate_causal(spark, sf):
    """Prompt ######## target (the prompt alone without a target), BOS +
    truncation to 64, last separator cut out, prompt labels ignored, padded to
    the longest row of the batch."""
    p = _pairs(spark, sf).withColumn(
        "ids", collate.tokenize_causal(collate.causal_text("prompt", "target"), COLLATE_MAX)) \
        .withColumn("has_target", F.col("target").isNotNull())
    out = collate.collate_causal(p, "ids", "has_target", [SEP_ID])
    return out.select("conv_id", "turn", "batch_id", ids_string("input_ids").alias("input_ids"),
                      ids_string("attention_mask").alias("attention_mask"),
                      ids_string("labels").alias("labels"), "sep_found")


@register("collate_seq2seq", O.collate_seq2seq_sql(SRC_MAX, TGT_MAX, COLLATE_BS))
def q_collate_seq2seq(spark, sf):
    """Source (no specials, 48) and target (+EOS, 16; empty when a turn
    has no reply) padded separately; decoder inputs = shifted labels."""
    p = (_pairs(spark, sf)
         .withColumn("src", collate.tokenize_source("prompt", SRC_MAX))
         .withColumn("tgt", collate.tokenize_target(F.coalesce("target", F.lit("")), TGT_MAX)))
    out = collate.collate_seq2seq(p, "src", "tgt")
    return out.select("conv_id", "turn", "batch_id", ids_string("input_ids").alias("input_ids"),
                      ids_string("attention_mask").alias("attention_mask"),
                      ids_string("labels").alias("labels"),
                      ids_string("decoder_input_ids").alias("decoder_input_ids"))


# ---------------------------------------------------------------- unlearning and influence
from ..operators import bigram, influence as U  # noqa: E402
from ..operators.optim import Optim  # noqa: E402

SGD_LR = 5.0


def _rows(spark, sf):
    return corpora.train_rows(spark, sf), corpora.eval_rows(spark, sf)


def _infl(df, a="train_dataset", b="eval_dataset"):
    # + 0.0: no negative zero
    return df.select(a, b, "step", (r6("influence") + F.lit(0.0)).alias("influence"))


@register("unlearn_influence", O.unlearn_sql("forward", "sgd", SGD_LR, steps=2, n_micro=2))
def q_unlearn_influence(spark, sf):
    """U8 forward unlearning: every source unlearned for one epoch in 2 steps (sgd), loss
    change on bench/toxic after each step."""
    tr, ev = _rows(spark, sf)
    _, infl = U.unlearn_influence(tr, ev, Optim("sgd", lr=SGD_LR), steps=2)
    return _infl(infl)


@register("unlearn_influence_inverse", O.unlearn_sql("inverse", "sgd", SGD_LR, steps=2, eval_on="train"))
def q_unlearn_influence_inverse(spark, sf):
    """U9 inverse unlearning: unlearn each evaluation set (the whole set
    accumulated per step in micro-batches of 2), loss change on every training
    source; transposed to (train, eval)."""
    tr, ev = _rows(spark, sf)
    _, infl = U.unlearn_influence_inverse(tr, ev, Optim("sgd", lr=SGD_LR), steps=2)
    return _infl(infl, "train_dataset", "eval_dataset")


@register("unlearn_step", O.unlearn_sql("forward", "sgd", SGD_LR, steps=1, n_micro=1,
                                        eval_on="train", output="log"))
def q_unlearn_step(spark, sf):
    """One ascent step per source on the whole of it; loss of every source
    before and after - the unlearned source's own loss goes up."""
    tr, ev = _rows(spark, sf)
    model, q, w = U.fit(tr, ev, 1, alpha=ALPHA)
    log = U.unlearn_log(model, q, w, U.eval_weights(tr), 1, Optim("sgd", lr=SGD_LR))
    return log.select("run_id", "step", "eval_dataset", "metric", r6("loss").alias("value"))


@register("grad_accum_step", O.unlearn_sql("forward", "sgd", SGD_LR, steps=2, n_micro=4, accum=2))
def q_grad_accum_step(spark, sf):
    """U4: 4 micro-batches per source, accumulated 2 per step."""
    tr, ev = _rows(spark, sf)
    _, infl = U.unlearn_influence(tr, ev, Optim("sgd", lr=SGD_LR), steps=2, n_micro=4, accum=2)
    return _infl(infl)


CLIP = 0.01


@register("clip_step", O.unlearn_sql("forward", "sgd", SGD_LR, steps=2, n_micro=2, clip=CLIP, output="log",
                                     lr_rows=True))
def q_clip_step(spark, sf):
    """Global gradient-norm clipping per run (max_grad_norm 0.01); the log
    carries the pre-clip norms and the learning rate."""
    tr, ev = _rows(spark, sf)
    model, q, w = U.fit(tr, ev, 2, alpha=ALPHA)
    log = U.unlearn_log(model, q, w, U.eval_weights(ev), 2, Optim("sgd", lr=SGD_LR, max_grad_norm=CLIP),
                        with_norms=True, with_lr=True)
    return log.select("run_id", "step", "eval_dataset", "metric", r6("loss").alias("value"))


ADAM_LR = 0.01


@register("adam_step", O.unlearn_sql("forward", "adamw", ADAM_LR, steps=2, n_micro=2))
def q_adam_step(spark, sf):
    """AdamW (no weight decay) unlearning, 2 steps."""
    tr, ev = _rows(spark, sf)
    _, infl = U.unlearn_influence(tr, ev, Optim("adamw", lr=ADAM_LR), steps=2)
    return _infl(infl)


@register("adafactor_step", O.unlearn_sql("forward", "adafactor", ADAM_LR, steps=2, n_micro=2, warmup=2))
def q_adafactor_step(spark, sf):
    """Adafactor (unfactored, fixed lr) with 2 warm-up steps."""
    tr, ev = _rows(spark, sf)
    _, infl = U.unlearn_influence(tr, ev, Optim("adafactor", lr=ADAM_LR, warmup_steps=2), steps=2)
    return _infl(infl)


# ---------------------------------------------------------------- read-out and run keys
from ..operators import readout, runs  # noqa: E402
from ..session import scratch_path  # noqa: E402

RO_STEPS = 2


def _logs(spark, sf, inverse=False):
    """Run forward (or inverse) unlearning, persist trainer-state JSON + baseline, scan them back."""
    tr, ev = _rows(spark, sf)
    opt = Optim("sgd", lr=SGD_LR)
    if inverse:
        log, _ = U.unlearn_influence_inverse(tr, ev, opt, steps=RO_STEPS)
    else:
        log, _ = U.unlearn_influence(tr, ev, opt, steps=RO_STEPS)
    d = scratch_path(spark, "runs")
    readout.write_trainer_state(log, f"{d}/state", steps_per_epoch=RO_STEPS)
    readout.write_baseline(log, f"{d}/init")
    return readout.log_scan(spark, f"{d}/state"), readout.baseline_scan(spark, f"{d}/init")


def _ro(df, a="train_dataset", b="eval_dataset"):
    return df.select(a, b, r6("epoch").alias("epoch"), r6("influence").alias("influence"))


@register("log_scan", O.readout_sql("forward", SGD_LR, RO_STEPS, "log"))
def q_log_scan(spark, sf):
    """Per-run trainer-state JSON written by the runs, scanned back long."""
    lg, _ = _logs(spark, sf)
    return lg.select("run_id", "step", r6("epoch").alias("epoch"), "metric", r6("value").alias("value"))


# Steps of the runs whose logs are found by a path format.
PATH_STEPS = 3


@register("log_scan_paths", O.path_log_sql(PATH_STEPS))
def q_log_scan_paths(spark, sf):
    """R2: logs in folders named by run keys, found by a path format over a manifest.

    A run per training source; its loss after step s is the mean text size of
    the rows whose id leaves a remainder of at most s by the number of steps."""
    d = table(spark, sf, "documents")
    rows = d.select(F.col("source").alias("dataset"), F.length("text").alias("n"),
                    F.explode(F.sequence(F.pmod("doc_id", F.lit(PATH_STEPS)).cast("int") + 1, F.lit(PATH_STEPS))).alias("step"))
    argv = F.format_string(ARGV_FMT, F.col("dataset"), F.col("dataset"))
    log = (rows.groupBy("dataset", "step").agg(F.avg("n").alias("loss")).filter("dataset is not null")
           .select(runs.run_key(argv).alias("run_id"), "step", F.lit(None).cast("string").alias("eval_dataset"),
                   F.lit("eval_loss").alias("metric"), "loss"))
    root = scratch_path(spark, "runs")
    readout.write_trainer_state(log, f"{root}/logs", steps_per_epoch=PATH_STEPS)
    manifest = (d.select(F.col("source").alias("dataset")).filter("dataset is not null").distinct()
                .withColumn("argv", argv)
                # Spark's own folder names hold "=" escaped
                .withColumn("key", F.replace(runs.run_key("argv"), F.lit("="), F.lit("%3D"))))
    folders = runs.run_folders(manifest, "logs/run_id={}/", "key", run_id="dataset")
    got = readout.log_scan(spark, root, runs=folders, file="part-*")
    return got.select("run_id", "step", r6("epoch").alias("epoch"), "metric", r6("value").alias("value"))


@register("metrics_merge", O.METRICS_MERGE)
def q_metrics_merge(spark, sf):
    """A run's metrics of training, then of evaluation, end in one object;
    "rows" is in both, so the later one counts."""
    from ..operators import metrics
    d = table(spark, sf, "documents").filter("source is not null").select(F.col("source").alias("run_id"), "doc_id", "text")
    toxic = table(spark, sf, "labels").filter("toxic = 1").select("doc_id").distinct()

    def long(df, **named):
        values = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in named.items()])
        return df.groupBy("run_id").agg(values.alias("m")).select("run_id", F.inline("m"))

    path = scratch_path(spark, "metrics")
    n, size = F.count(F.lit(1)), F.avg(F.length("text"))
    metrics.save_metrics(long(d, train_samples=n, train_loss=size, rows=n), path, "train")
    metrics.save_metrics(long(d.join(toxic, "doc_id", "left_semi"), eval_samples=n, eval_loss=size, rows=n), path, "eval")
    out = [metrics.load_metrics(spark, path, s).withColumn("split", F.lit(s)) for s in ("train", "eval", metrics.MERGED)]
    return out[0].unionByName(out[1]).unionByName(out[2]).select("split", "run_id", "metric", r6("value").alias("value"))


@register("influence_log", O.readout_sql("forward", SGD_LR, RO_STEPS, "influence"))
def q_influence_log(spark, sf):
    """eval_loss_* minus the baseline JSON, zero row at epoch 0."""
    lg, base = _logs(spark, sf)
    return _ro(readout.influence(lg, base, key="epoch"))


@register("influence_inverse_log", O.readout_sql("inverse", SGD_LR, RO_STEPS, "influence"))
def q_influence_inverse_log(spark, sf):
    """Inverse unlearning read-out, transposed (rows are training datasets)."""
    lg, base = _logs(spark, sf, inverse=True)
    return _ro(readout.influence(lg, base, key="epoch", inverse=True))


@register("influence_single_metric", O.readout_sql("forward", SGD_LR, RO_STEPS, "influence",
                                                   prefix="eval_loss"))
def q_influence_single_metric(spark, sf):
    """One named metric (overall eval_loss) instead of the per-dataset prefix."""
    lg, base = _logs(spark, sf)
    return _ro(readout.influence(lg, base, key="epoch", prefix="eval_loss"))


def source_labels(spark, sf):
    """Dataset code -> label: the majority language of each source (ties: smallest)."""
    from pyspark.sql.window import Window
    c = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("source").orderBy(F.col("n").desc(), "lang")
    return (c.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1)
            .select(F.col("source").alias("dataset"), F.col("lang").alias("label")))


@register("influence_labelled", O.readout_sql("forward", SGD_LR, RO_STEPS, "labelled"))
def q_influence_labelled(spark, sf):
    """Plot-ready series for the 'bench' set with dataset labels."""
    lg, base = _logs(spark, sf)
    infl = readout.influence(lg, base, key="epoch")
    s = readout.labelled_series(infl, source_labels(spark, sf), "bench")
    return s.select("train_dataset", "label", r6("epoch").alias("epoch"), r6("influence").alias("influence"))


# The argument string of a run.
ARGV_FMT = ("--unlearn --optim adafactor --max_grad_norm 0 --model_name_or_path model/lm_00 "
            "--train_dir data/%s --dataset_names %s --eval_dir data/bench data/toxic --eval_steps 16 "
            "--logging_steps 16 --save_strategy no --num_train_epochs 1 --learning_rate 1e-4 "
            "--per_device_train_batch_size 2 --gradient_accumulation_steps 4")
ARGV_SQL = ("SELECT DISTINCT source AS dataset, printf('" + ARGV_FMT + "', source, source) AS argv FROM documents")


@register("run_key", O.run_key_sql(runs.DROP_ARGS, runs.ABBREVIATIONS, ARGV_SQL))
def q_run_key(spark, sf):
    """Run keys of the forward unlearning runs, one per training source (manifest from the data)."""
    m = (table(spark, sf, "documents").select(F.col("source").alias("dataset")).distinct()
         .withColumn("argv", F.format_string(ARGV_FMT, F.col("dataset"), F.col("dataset"))))
    return m.withColumn("run_key", runs.run_key("argv"))


# ---------------------------------------------------------------- classifier
from ..operators.models import logreg  # noqa: E402

LR_BUCKETS, LR_LR = 1024, 1.0


def _labelled(spark, sf):
    d = table(spark, sf, "documents")
    lab = table(spark, sf, "labels").select("doc_id", F.col("toxic").cast("double").alias("y"))
    return d.join(lab, "doc_id").select("doc_id", F.col("source").alias("dataset"), "lang", "text", "y")


def _lr_rows(spark, sf):
    """(doc_id, dataset, eval_dataset = language, fs, y) of the labelled documents, materialised."""
    from ..session import cut
    ld = _labelled(spark, sf).withColumnRenamed("lang", "eval_dataset")
    return cut(logreg.features(ld, ["doc_id", "dataset", "eval_dataset", "y"], buckets=LR_BUCKETS))


@register("lr_fit_step", O.logreg_sql(LR_BUCKETS, 1, LR_LR))
def q_lr_fit_step(spark, sf):
    """One full-batch gradient step of the toxic classifier from theta = 0
    (the buckets that occur)."""
    X = _lr_rows(spark, sf)
    th = logreg.fit(X, 1, LR_LR, LR_BUCKETS)
    seen = X.select(F.explode("fs").alias("f")).distinct()
    return th.join(seen, "f", "left_semi").select("f", r6("theta").alias("theta"))


@register("unlearn_influence_lr", O.logreg_sql(LR_BUCKETS, 2, LR_LR, unlearn_steps=2))
def q_unlearn_influence_lr(spark, sf):
    """Classifier fitted in 2 steps; each source unlearned (2 ascent
    steps); log-loss change on every language group of labelled documents."""
    X = _lr_rows(spark, sf)
    th = logreg.fit(X, 2, LR_LR, LR_BUCKETS)
    out = logreg.unlearn_influence(X, X, th, 2, LR_LR, LR_BUCKETS)
    return out.select("train_dataset", "eval_dataset", "step", r6("influence").alias("influence"))


@register("influence_loo_lr", O.logreg_loo_sql(LR_BUCKETS, 2, LR_LR))
def q_influence_loo_lr(spark, sf):
    """Each source left out, the classifier refitted in 2 steps on the others;
    log-loss change on every language group against the fit on all."""
    X = _lr_rows(spark, sf)
    out = logreg.influence_loo(X, X, 2, LR_LR, LR_BUCKETS)
    return out.select("train_dataset", "eval_dataset", r6("influence").alias("influence"))


# ---------------------------------------------------------------- external scorer
# Tokens of one shard of the model; the scorer holds one shard in memory.
SCORER_SHARD = 1_000_000


@register("external_scorer", f"WITH {O.lm_losses_ctes(ALPHA, EVAL_BS)} "
          "SELECT dataset, row_id, round(nll, 6) AS nll, n_tok FROM ex")
def q_external_scorer(spark, sf):
    """The fitted model saved to the shared folder in shards by token and
    used as a *user* scorer through mapInPandas; scores every evaluation row.
    Rows become (row, token, count) ordered by shard: range partitions split a
    hot shard over tasks, and a task loads one shard's weights at a time."""
    import math
    from ..functions.text import word_tokens
    _, _, model, v, n = _fitted(spark, sf)
    n_shards = max(1, -(-v // SCORER_SHARD))
    shard = F.pmod(F.xxhash64("tok"), F.lit(n_shards)).alias("shard")
    path = scratch_path(spark, "user-model")
    model.select("tok", "theta", shard).repartition(n_shards, "shard").write.partitionBy("shard").parquet(path)
    key = ["dataset", "row_id"]
    toks = (corpora.eval_rows(spark, sf).select(*key, F.explode(word_tokens("text")).alias("tok"))
            .groupBy(*key, "tok").agg(F.count(F.lit(1)).alias("n"))
            .select(*key, "tok", "n", shard)
            .repartitionByRange("shard", *key).sortWithinPartitions("shard"))
    scored = evaluate.external_scorer(toks, lm.model_scorer(path, math.log(n + ALPHA * v), ALPHA))
    return (scored.groupBy(*key).agg(F.sum("nll").alias("nll"), F.sum("n").alias("n_tok"))
            .select(*key, r6("nll").alias("nll"), F.col("n_tok").cast("long").alias("n_tok")))


# ---------------------------------------------------------------- sources and sinks
from ..sources import tables as S  # noqa: E402


@register("scan_union", """
SELECT 'documents' AS corpus, 0 AS part_no, doc_id AS key, text FROM documents
UNION ALL SELECT 'benchmark', 1, item_id, text FROM benchmark""")
def q_scan_union(spark, sf):
    """Two corpora as one table (UNION ALL, tagged, order recoverable
    as (part_no, key))."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), "text")
    bench = table(spark, sf, "benchmark").select(F.col("item_id").alias("key"), "text")
    return S.scan_union([docs, bench], tag="corpus", names=["documents", "benchmark"]) \
        .select("corpus", "part_no", "key", "text")


@register("save_and_scan", """
SELECT source AS dataset, doc_id, n_chars FROM documents WHERE source IN ('src2', 'src7', 'src11')""")
def q_save_and_scan(spark, sf):
    """S3 then S4: save the corpus partitioned by dataset, read three dataset
    directories back (partition pruning, no scan of the others)."""
    d = table(spark, sf, "documents").select(F.col("source").alias("dataset"), "doc_id", "n_chars")
    path = scratch_path(spark, "saved")
    S.save(d, path, partition_by=["dataset"])
    back = S.read_dirs(spark, [f"{path}/dataset={n}" for n in ("src2", "src7", "src11")], base_path=path)
    return back.select(F.col("dataset").cast("string").alias("dataset"), "doc_id", "n_chars")


@register("influence_loo_bigram", O.bigram_loo_sql(ALPHA))
def q_influence_loo_bigram(spark, sf):
    """U10 with the bigram model: exact leave-one-source-out influence."""
    from ..session import cut as _cut
    train, ev = _counts(spark, sf)
    v = lm.vocabulary(train, ev).count()
    tp = lm.bigram_counts(corpora.train_rows(spark, sf))
    ep = lm.bigram_counts(corpora.eval_rows(spark, sf)).withColumnRenamed("dataset", "eval_dataset")
    out = lm.influence_loo_bigram(tp, ep, v, ALPHA)
    return out.select("train_dataset", "eval_dataset", r6("influence").alias("influence"))


BIGRAM_LR, BIGRAM_CLIP = 50.0, 0.01


@register("unlearn_influence_bigram", O.bigram_unlearn_sql(BIGRAM_LR, 2))
def q_unlearn_influence_bigram(spark, sf):
    """U3, U8 with the bigram model: every source unlearned for one epoch in 2 steps (sgd)."""
    tr, ev = _rows(spark, sf)
    _, infl = bigram.unlearn_influence(tr, ev, Optim("sgd", lr=BIGRAM_LR), lm.vocabulary(*_counts(spark, sf, once=True)).count(), alpha=ALPHA)
    return _infl(infl)


@register("clip_step_bigram", O.bigram_unlearn_sql(BIGRAM_LR, 1, BIGRAM_CLIP))
def q_clip_step_bigram(spark, sf):
    """U5 with the bigram model: one step over each source, clipped to norm 0.01."""
    tr, ev = _rows(spark, sf)
    _, infl = bigram.unlearn_influence(tr, ev, Optim("sgd", lr=BIGRAM_LR, max_grad_norm=BIGRAM_CLIP),
                                       lm.vocabulary(*_counts(spark, sf, once=True)).count(), steps=1, alpha=ALPHA)
    return _infl(infl)


PAIR_MAX = 32


@register("collate_pairs", O.collate_pairs_sql(PAIR_MAX, COLLATE_BS))
def q_collate_pairs(spark, sf):
    """prediction/answer columns (the prompt and the whole reply) tokenised,
    truncated to 32 and padded per batch; no labels."""
    p = (_pairs(spark, sf)
         .withColumn("preds", collate.tokenize_source("prompt", PAIR_MAX))
         .withColumn("answers", collate.tokenize_source(F.coalesce("target", F.lit("")), PAIR_MAX)))
    out = collate.collate_pairs(p, "preds", "answers")
    return out.select("conv_id", "turn", "batch_id", ids_string("preds").alias("preds"),
                      ids_string("answers").alias("answers"))


RAGGED_BATCH, RAGGED_ACCUM = 64, 2


@register("unlearn_influence_ragged", O.unlearn_sql("forward", "sgd", SGD_LR, steps=6, accum=RAGGED_ACCUM,
                                                    rows=O.LANG_ROWS, run_batch=RAGGED_BATCH))
def q_unlearn_influence_ragged(spark, sf):
    """U8: one epoch of every language (texts without one are a dataset too) in micro-batches
    of 64 rows, 2 a step, so each run has its own number of steps.  The SQL twin is
    unrolled for epochs of up to 6 steps (768 rows a language)."""
    docs = table(spark, sf, "documents")
    tr = docs.select(F.col("lang").alias("dataset"), F.col("doc_id").alias("row_id"), "text")
    _, infl = U.unlearn_influence(tr, corpora.eval_rows(spark, sf), Optim("sgd", lr=SGD_LR),
                                  batch_rows=RAGGED_BATCH, accum=RAGGED_ACCUM)
    return _infl(infl)


EPOCH_STEPS, EPOCH_EVAL = 8, 4


@register("unlearn_influence_epoch", O.unlearn_sql("forward", "sgd", SGD_LR, steps=EPOCH_STEPS,
                                                   n_micro=EPOCH_STEPS, eval_steps=EPOCH_EVAL))
def q_unlearn_influence_epoch(spark, sf):
    """U8 + E8: one epoch in 8 slices per source, evaluated every 4 steps."""
    tr, ev = _rows(spark, sf)
    _, infl = U.unlearn_influence(tr, ev, Optim("sgd", lr=SGD_LR), steps=EPOCH_STEPS,
                                  eval_steps=EPOCH_EVAL)
    return _infl(infl)


# ---------------------------------------------------------------- CSV pairs, pass-through, metrics hook
@register("pairs_csv", f"""
SELECT prompt AS inputs, target AS labels, 'conversations' AS dataset FROM ({O.PAIRS})""")
def q_pairs_csv(spark, sf):
    """S2 + K15/K16: conversation prompt/reply pairs written as CSV to the
    shared folder, read back with the pair reader (quoted commas, quotes and
    line breaks inside values; a turn without a reply has no label), then collated in text-only mode."""
    c = table(spark, sf, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("inputs_pretokenized"))
    a = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("targets_pretokenized"))
    pairs = u.join(a, ["conv_id", "turn"], "left").withColumn("dataset", F.lit("conversations"))
    path = scratch_path(spark, "pairs-csv")
    S.save_pairs_csv(pairs, path)
    return collate.text_only(S.read_pairs_csv(spark, path))


@register("pass_through_encoded", f"""
SELECT dataset, n_ids, ids_md5 FROM ({O.encode_sql()})""")
def q_pass_through_encoded(spark, sf):
    """Rows that already hold ``input_ids`` (the encoded rows) skip
    tokenising; only the model inputs and the dataset tag ride along."""
    out = collate.pass_through(_encoded(spark, sf).withColumnRenamed("ids", "input_ids"))
    return out.select("dataset", F.size("input_ids").cast("long").alias("n_ids"),
                      F.md5(ids_string("input_ids")).alias("ids_md5"))


def _longest(pdf):
    """Partial rows of a user metric: per set, the largest token loss of one batch."""
    import pandas as pd
    worst = (pdf["nll"] / pdf["n_tok"]).groupby(pdf["dataset"]).max()
    return pd.DataFrame({"dataset": worst.index, "v": worst.values})


@register("metrics_hook", f"""
WITH {O.lm_losses_ctes(ALPHA, EVAL_BS)}
SELECT dataset, round(max(nll / n_tok), 6) AS max_loss, round(median(nll / n_tok), 6) AS median_loss
FROM ex GROUP BY dataset""")
def q_metrics_hook(spark, sf):
    """Metrics over each evaluation set's example losses - a user callable
    over Arrow batches merged by an aggregate, and the exact median."""
    import math
    from ..session import cut
    _, _, model, v, n = _fitted(spark, sf)
    ex = cut(lm.example_losses(corpora.eval_rows(spark, sf), model, math.log(n + ALPHA * v), ALPHA))
    top = evaluate.with_metrics(ex, [F.max("v").alias("max_loss")], partial=_longest,
                                schema="dataset string, v double")
    med = evaluate.exact_median(ex, F.col("nll") / F.col("n_tok"), name="median_loss")
    return (top.join(med, "dataset")
            .select("dataset", r6("max_loss").alias("max_loss"), r6("median_loss").alias("median_loss")))


@register("model_snapshot", ORACLE["lm_fit"])
def q_model_snapshot(spark, sf):
    """The fitted parameters saved as a snapshot (partitioned by run and
    step in the shared folder) and step 0 read back with partition pruning."""
    from ..operators import runs as R
    _, _, model, _, _ = _fitted(spark, sf)
    path = scratch_path(spark, "snapshots")
    R.save_snapshot(model.withColumn("run_id", F.lit("full")), path, 0)
    back = R.load_snapshot(spark, path, 0).filter(F.col("run_id") == "full")
    return back.select("tok", "count", r6("theta").alias("theta"))


# ---------------------------------------------------------------- corpus builder end to end
from ..operators import corpus  # noqa: E402

# Documents drawn from some sources before packing; the others are taken whole.
DOC_SPEC = [("src1", 40), ("src3", 10), ("src5", 120)]
DOC_SPEC_SQL = " UNION ALL ".join(f"SELECT '{d}' AS dataset, CAST({k} AS BIGINT) AS k" for d, k in DOC_SPEC)
BLOCKS_EACH, BLOCKS_TOTAL = 12, 200
BLOCKS_SPEC_SQL = " UNION ALL ".join(
    f"SELECT '{d}' AS dataset, CAST(floor({float(BLOCKS_TOTAL)!r} * {f!r}::DOUBLE) AS BIGINT) AS k"
    for d, f in zip(EIGHT, O.MIXTURE_FRACTIONS))


def _corpus(spark, sf, k, doc_counts=None):
    """The builder's blocks saved by dataset and scanned again."""
    d = table(spark, sf, "documents").select(F.col("source").alias("dataset"), "doc_id", "text")
    b = corpus.corpus_blocks(d, k, tokens.hashed_ids(F.split("text", " ")), doc_counts,
                             PACK_BLOCK, PACK_BATCH, SEED)
    path = scratch_path(spark, "corpus")
    S.save(b, path, partition_by=["dataset"])
    back = S.read_dirs(spark, [path], base_path=path)
    return back.select(F.col("dataset").cast("string").alias("dataset"), "index", "epoch",
                       F.size("input_ids").cast("long").alias("n_tokens"),
                       F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_attended"),
                       F.md5(ids_string("input_ids")).alias("block_md5"))


@register("corpus_blocks_equal", O.corpus_sql(PACK_BLOCK, PACK_BATCH, SEED, doc_spec=DOC_SPEC_SQL, k=BLOCKS_EACH))
def q_corpus_blocks_equal(spark, sf):
    """Documents sampled where a source is listed,
    hashed, packed, 12 blocks of every source, saved and scanned."""
    n = table(spark, sf, "documents").groupBy(F.col("source").alias("dataset")).agg(F.count(F.lit(1)).alias("n"))
    spec = spark.createDataFrame(DOC_SPEC, "dataset string, k long")
    counts = n.join(F.broadcast(spec), "dataset", "left").select("dataset", F.coalesce("k", "n").alias("k"))
    return _corpus(spark, sf, BLOCKS_EACH, counts)


@register("corpus_blocks_weighted", O.corpus_sql(PACK_BLOCK, PACK_BATCH, SEED, spec=BLOCKS_SPEC_SQL))
def q_corpus_blocks_weighted(spark, sf):
    """All documents hashed, packed and numbered, 200
    blocks drawn by the weighted mixture's fractions, saved and scanned."""
    fr = spark.createDataFrame(list(zip(EIGHT, O.MIXTURE_FRACTIONS)), "dataset string, frac double")
    return _corpus(spark, sf, sampling.fractions_to_counts(fr, BLOCKS_TOTAL))
