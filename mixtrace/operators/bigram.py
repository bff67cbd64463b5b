"""Unlearning with the bigram model ``p(tok|ctx) = softmax over tok of theta[ctx, tok]``.

The model has one parameter for every pair of words, V * V of them, and every
run changes its own copy.  What has to be kept is small, exactly:

* A step's gradient is ``qc(ctx) * p(tok|ctx) - q(ctx, tok)``, with q the batch's
  normalised pair counts and qc their sum in a context.  Contexts outside a
  run's dataset never move, so they are no rows: their part of a loss is a number.
* Inside a context of the run, pairs that the run doesn't train on and that
  start equal (the same training count, 0 for the unseen ones) get the same
  gradient in every step.  They are one row (``tok`` NULL, ``_c`` the count) with
  a multiplicity ``n``; the unseen class has ``V - seen(ctx)``.

So the table holds a run's pairs and (run, context, count) classes, and all that a
row needs of other rows, logZ and the counts of its classes, lies in its context.
The pairs are therefore dealt out by their context once, packed (``pair_blocks``),
and a block's parameters are arrays that are made where they are used.  What
crosses blocks is a row per (run, micro-batch) for the sizes of the batches, a row
per run and block for a clipped step's norm, and one per run, block and scheduled
step for the losses; without clipping, a block takes all steps in one pass, with it a
pass a step.  Nothing of a step passes through the driver.  ``pair_targets`` and
``initial_params`` give the same counts, targets and parameters in long form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import word_tokens
from ..session import cut, shuffle_width, spread
from . import pair_blocks as B
from .influence import epoch_steps, influence_from_log, micro_batch_rows
from .joins import same_keys
from .models import lm
from .optim import Optim, clip_scale


def run_numbers(rows: DataFrame) -> DataFrame:
    """Materialised (run_id, run): the datasets, numbered (a row per run)."""
    runs = rows.select(F.col("dataset").alias("run_id")).distinct()
    return cut(runs.withColumn("run", F.row_number().over(Window.orderBy("run_id")) - 1))


def block_number(rows: DataFrame, *more: DataFrame) -> int:
    """How many blocks the pairs of the given texts take."""
    size = lambda df: df.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(shuffle_width(rows), -(-sum(map(size, (rows, *more))) // B.BLOCK_CHARS))


def run_texts(rows: DataFrame, runs: DataFrame, n_micro: int | None = None, batch_rows: int | None = None) -> DataFrame:
    """(run, b, toks) of the training rows."""
    texts = micro_batch_rows(rows, n_micro, batch_rows=batch_rows)
    return same_keys(texts, runs, "run_id", broadcast=lm.BROADCAST_ROWS).select("run", "b", word_tokens("text").alias("toks"))


def set_texts(rows: DataFrame, names: list) -> DataFrame:
    """(run, b, toks) of the evaluation rows; set ``names[e]`` is run ``-1 - e``."""
    at = F.coalesce(*[F.when(F.col("dataset").eqNullSafe(F.lit(n)), F.lit(-1 - i)) for i, n in enumerate(names)])
    return spread(rows.select("dataset", "text")).select(at.alias("run"), F.lit(0).cast("long").alias("b"), word_tokens("text").alias("toks"))


def pair_targets(rows: DataFrame, n_micro: int | None = None, accum: int = 1,
                 batch_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Materialised (counts, targets): counts(ctx, tok, count) over all rows,
    targets(run_id, step, ctx, tok, q), each micro-batch's pair counts over its
    pairs, summed over a step's micro-batches and divided by ``accum``."""
    runs = run_numbers(rows)
    packed = B.packed_pairs(run_texts(rows, runs, n_micro, batch_rows), block_number(rows))
    mb = cut(packed.mapInArrow(B.unpack, "run int, b long, ctx string, tok string, cnt long")
             .groupBy("run", "b", "ctx", "tok").agg(F.sum("cnt").alias("cnt")))
    total = cut(mb.groupBy("run", "b").agg(F.sum("cnt").alias("_nb")))
    step = (F.floor(F.col("b") / accum) + 1).cast("long").alias("step")
    q = same_keys(same_keys(mb, total, ["run", "b"], broadcast=lm.BROADCAST_ROWS), runs, "run", broadcast=lm.BROADCAST_ROWS).groupBy(
        "run_id", step, "ctx", "tok").agg((F.sum(F.col("cnt") / F.col("_nb")) / accum).alias("q"))
    return cut(mb.groupBy("ctx", "tok").agg(F.sum("cnt").alias("count"))), q


def initial_params(counts: DataFrame, own: DataFrame, vocab_size: int, alpha: float) -> DataFrame:
    """Materialised (run_id, ctx, tok, _c, theta, n) of the runs whose pairs are ``own`` (run_id, ctx, tok)."""
    own = cut(own.join(counts, ["ctx", "tok"]))
    theta = F.log(F.col("count") + F.lit(alpha))
    per = counts.groupBy("ctx", "count").agg(F.count(F.lit(1)).alias("_N"))
    unseen = counts.groupBy("ctx").agg((F.lit(vocab_size) - F.count(F.lit(1))).alias("_N")).select(
        "ctx", F.lit(0).cast("long").alias("count"), "_N")
    classes = own.select("run_id", "ctx").distinct().join(per.unionByName(unseen), "ctx")
    used = own.groupBy("run_id", "ctx", "count").agg(F.count(F.lit(1)).alias("_A"))
    classes = same_keys(classes, used, ["run_id", "ctx", "count"], "left").withColumn(
        "n", F.col("_N") - F.coalesce("_A", F.lit(0))).filter("n > 0")
    none = F.lit(None)
    return cut(own.select("run_id", "ctx", "tok", none.cast("long").alias("_c"), theta.alias("theta"), F.lit(1).cast("long").alias("n"))
               .unionByName(classes.select("run_id", "ctx", none.cast("string").alias("tok"), F.col("count").alias("_c"),
                                           theta.alias("theta"), "n")))


def beside(blocks: DataFrame, **tables: DataFrame) -> DataFrame:
    """``blocks`` with each of the small tables as a column of all its rows."""
    out = blocks.withColumn("_one", F.lit(1))
    for name, df in tables.items():
        rows = df.agg(F.collect_list(F.struct(*df.columns)).alias(name)).withColumn("_one", F.lit(1))
        out = out.join(F.broadcast(rows), "_one")
    return out.drop("_one")


def unlearn_influence(train_rows: DataFrame, eval_rows: DataFrame, opt: Optim, vocab_size: int, steps: int = 2,
                      n_micro: int | None = None, accum: int = 1, alpha: float = 1.0, eval_steps: int = 1,
                      batch_rows: int | None = None, sign: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """U8 with the bigram model: (log, influence) as ``influence.unlearn_influence``
    gives them; the loss of a set is the mean over its adjacent word pairs.

    sgd and AdamW, with or without clipping.  Adafactor's second moments of a
    matrix are kept by rows and columns; a column runs across contexts, so
    pairs of a class would not stay equal, and this table can't hold it.
    """
    if opt.name not in ("sgd", "adamw"):
        raise ValueError(f"the bigram loop has no {opt.name}")
    runs = run_numbers(train_rows)
    if batch_rows is None:
        n_micro = n_micro or steps * accum
        steps = max(steps, -(-n_micro // accum))
        table = runs.withColumn("n_steps", F.lit(steps).cast("long"))
    else:
        table = same_keys(runs, epoch_steps(train_rows, batch_rows, accum), "run_id", broadcast=lm.BROADCAST_ROWS)
        steps = table.agg(F.max("n_steps")).first()[0] or 0
    names = sorted((r[0] for r in eval_rows.select("dataset").distinct().collect()), key=lambda n: (n is None, n))
    n_blocks = block_number(train_rows, eval_rows)
    texts = run_texts(train_rows, runs, n_micro, batch_rows)
    packed = B.packed_pairs(texts.unionByName(set_texts(eval_rows, names)) if names else texts, n_blocks)
    blocks = cut(B.blocks(packed, n_blocks, vocab_size, alpha, len(names)))
    sizes = cut(blocks.select(F.inline("sizes")).groupBy("run", "b").agg(F.sum("n").alias("n")))
    totals = {r[0]: r[1] for r in sizes.filter("run < 0").groupBy("run").agg(F.sum("n")).collect()}
    if names and names[-1] is None and totals.get(-len(names)):
        raise ValueError("an evaluation set has no name")
    # the fitted model's loss: what a run's contexts gain is added to it
    base = blocks.agg(*[F.sum(F.col("base")[e]) for e in range(len(names))]).first() if names else ()
    small = {"totals": sizes.filter("run >= 0"), "ends": table.select("run", "n_steps")}
    loop = B.Steps(opt, vocab_size, alpha, len(names), accum, eval_steps, sign)
    if opt.max_grad_norm and opt.max_grad_norm > 0:
        deltas, now = None, blocks
        for t in range(1, steps + 1):
            norms = clip_scale(beside(now, **small).mapInArrow(loop.norms(t), "run int, g double"), opt.max_grad_norm, "run")
            out = cut(beside(now, **small, scales=cut(norms.select("run", "scale"))).mapInArrow(loop.moved(t, t, t < steps, True), B.MOVED))
            due = cut(out.filter("block IS NULL").select("run", "step", "delta"))
            deltas = due if deltas is None else deltas.unionByName(due)
            now = out.filter("block IS NOT NULL").select(*blocks.columns)
    else:
        deltas = cut(beside(blocks, **small).mapInArrow(loop.moved(1, steps, False, False), B.MOVED).select("run", "step", "delta"))
    kept = [e for e in range(len(names)) if totals.get(-1 - e)]
    sums = (deltas.groupBy("run", "step").agg(*[F.sum(F.col("delta")[e]).alias(f"_e{e}") for e in kept])
            if deltas is not None else runs.select("run", F.lit(0).cast("long").alias("step"), *[F.lit(0.0).alias(f"_e{e}") for e in kept]))
    rows = F.array(*[F.struct(F.lit(names[e]).alias("eval_dataset"), F.lit("eval_loss").alias("metric"),
                              ((F.lit(float(base[e])) + F.col(f"_e{e}")) / F.lit(float(totals[-1 - e]))).alias("loss")) for e in kept])
    log = same_keys(sums, runs, "run", broadcast=lm.BROADCAST_ROWS).select("run_id", "step", F.inline(rows))
    return log, influence_from_log(log)
