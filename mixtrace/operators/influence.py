"""forward unlearning, inverse unlearning and leave-dataset-out influence.

One Spark job family runs *all* runs at once: the parameter table holds
``(run_id, tok, theta, n, m, v)`` for every run (run = the dataset being
unlearned), checkpointed into the shared folder after every step, so lineage
never grows and a lost executor only costs the current step.  Tokens a run
never trains on are collapsed, exactly, into one row per initial value with
a multiplicity ``n`` (see ``_initial_params``).

Beside it stands the run state: a row per run with logZ, the sums that its
losses need, the number of its steps and the shares of its partial steps.  It
is an aggregate of the parameters, written as ``step=T`` of one table; nothing
of it passes through the driver, and the log is a view of that table.  Per step:

1. parameters JOIN the state of the runs that still have steps (a row per run,
   broadcast up to ``lm.BROADCAST_ROWS``): runs whose epoch is over leave the
   loop, so a step rewrites the rows of active runs only;
2. gradient: LEFT JOIN the step's normalised batch counts on ``(run_id, tok)``
   - the batch side is broadcast after a size check, so the parameters do not
   move; a step too large to broadcast is a shuffle join;
3. optional per-run norm / RMS aggregates (clipping, Adafactor), joined back;
4. update expressions; checkpoint;
5. the new state; when scheduled, with the losses on the evaluation sets via an
   equi-join on ``tok`` with the pivoted evaluation counts.

An epoch of ``run_loop.LONG_STEPS`` steps or more, whose every run fits a task, is
one pass instead: each run's steps are a task's loop (``run_loop``).

The micro-batches of a run are consecutive slices of its dataset in key order:
either ``n_micro`` of them, or as many as ``batch_rows`` rows each take, so that
one epoch has more steps for a larger dataset.

A NULL dataset is a dataset (a run) like any other; evaluation sets need names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WORD_SPLIT, word_tokens
from ..session import cut, scratch_path, spread, stored
from . import run_loop
from .joins import same_keys
from .models import lm
from .optim import Optim, apply_update, clip_scale, gradient
from .ordinal import dense_ordinal


# Slices per dataset up to which a row finds its slice in a broadcast array
# of slice starts instead of a join on the key, and the bound on the
# broadcast's total entries (all datasets' slices), checked before use.
SLICE_LOOKUP_MAX = 4096
SLICE_LOOKUP_ENTRIES = 4_000_000


def n_slices(n_rows: Column, n_micro: int | None, batch_rows: int | None) -> Column:
    """Micro-batches of a dataset of ``n_rows`` rows."""
    if (n_micro is None) == (batch_rows is None):
        raise ValueError("give either n_micro or batch_rows")
    return F.ceil(n_rows / batch_rows).cast("long") if n_micro is None else F.lit(n_micro).cast("long")


def slice_no(ordinal: Column, n_rows: Column, n_micro: int | None, batch_rows: int | None) -> Column:
    """The micro-batch of the row at ``ordinal``."""
    at = F.floor(ordinal / batch_rows) if n_micro is None else F.floor(ordinal * n_micro / n_rows)
    return at.cast("long")


def micro_batch_rows(rows: DataFrame, n_micro: int | None, by: str = "dataset", key: str = "row_id",
                     text: str = "text", batch_rows: int | None = None) -> DataFrame:
    """(run_id, b, text): rows of each dataset cut by key order into
    ``n_micro`` slices, or into slices of ``batch_rows`` rows (the last may be smaller).

    The ordinal runs on the narrow key columns only.  Slices are contiguous
    key ranges, so each is known by its first key: with up to
    ``SLICE_LOOKUP_MAX`` slices, a per-dataset sorted array of slice starts
    (their total number checked against ``SLICE_LOOKUP_ENTRIES``) is
    broadcast and every text row finds its
    slice where it is read - the text is never shuffled.  Beyond that the
    slice ids are joined on the key.
    """
    o = dense_ordinal(rows.select(by, key), by, [key], name="_ord")
    n = cut(rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n")))
    slices = n_slices(F.col("_n"), n_micro, batch_rows)
    most, total = n.agg(F.max(slices), F.sum(slices)).first()
    ord_, n_ = F.col("_ord"), F.col("_n")
    o = same_keys(o, n, by, broadcast=lm.BROADCAST_ROWS).select(
        by, key, "_ord", "_n", slice_no(ord_, n_, n_micro, batch_rows).alias("b"))
    texts = spread(rows.select(by, key, text))
    if (most or 0) <= SLICE_LOOKUP_MAX and (total or 0) <= SLICE_LOOKUP_ENTRIES:
        starts = (o.filter((ord_ == 0) | (slice_no(ord_ - 1, n_, n_micro, batch_rows) != F.col("b")))
                  .groupBy(by).agg(F.array_sort(F.collect_list(F.struct(key, "b"))).alias("_s")))
        below = F.size(F.filter("_s", lambda s: s[key] <= F.col(key)))
        o = (same_keys(texts, starts, by, broadcast=True)
             .select(by, text, F.element_at("_s", below)["b"].alias("b")))
    else:
        o = same_keys(texts, cut(o.select(by, key, "b")), [by, key], broadcast=lm.BROADCAST_ROWS)
    return o.select(F.col(by).alias("run_id"), "b", F.col(text).alias("text"))


def micro_batch_counts(rows: DataFrame, n_micro: int | None, by: str = "dataset", key: str = "row_id",
                       text: str = "text", pattern: str = WORD_SPLIT, batch_rows: int | None = None) -> DataFrame:
    """(run_id, b, tok, cnt): token counts of ``micro_batch_rows``."""
    o = micro_batch_rows(rows, n_micro, by, key, text, batch_rows)
    return (o.select("run_id", "b", F.explode(word_tokens("text", pattern)).alias("tok"))
            .groupBy("run_id", "b", "tok").agg(F.count(F.lit(1)).alias("cnt")))


def batch_weighted_counts(rows: DataFrame, batch_rows: int, mean_of_batches: bool = False,
                          by: str = "dataset", key: str = "row_id", text: str = "text",
                          pattern: str = WORD_SPLIT) -> DataFrame:
    """(by, tok, cnt): token counts weighted by the batch their row falls in.

    Batches are ``batch_rows`` consecutive rows of a dataset in key order (the
    last may be smaller).  A token of a batch with ``n`` rows and ``T`` tokens
    counts ``n / T``, so ``logZ - sum(cnt * theta) / sum(cnt)`` is the
    batch-weighted loss of E4: each batch's token mean, once per row.  With
    ``mean_of_batches`` it counts ``1 / (T * B)``, ``B`` the dataset's batches:
    the mean of the micro-batch means (U4 with the whole set accumulated).
    Batches without tokens have no loss and are left out.  ``key`` is unique
    within a dataset; NULL texts have no tokens.

    Row sizes, ordinals and weights are computed on narrow rows; the text
    meets its weight in one join (broadcast after a size check) and counts are
    aggregated map-side.
    """
    texts = spread(rows.select(by, key, text))
    n_tok = F.coalesce(F.greatest(F.size(word_tokens(text, pattern)), F.lit(0)), F.lit(0))
    o = dense_ordinal(texts.select(by, key, n_tok.alias("_t")), by, [key], name="_ord", costly=True) \
        .withColumn("_b", F.floor(F.col("_ord") / batch_rows))
    per = (o.groupBy(by, "_b").agg(F.sum("_t").alias("_T"), F.count(F.lit(1)).alias("_n"))
           .filter(F.col("_T") > 0))
    if mean_of_batches:
        per = cut(per)
        total = cut(per.groupBy(by).agg(F.count(F.lit(1)).alias("_batches")))
        per = same_keys(per, total, by, broadcast=lm.BROADCAST_ROWS)
        weight = F.lit(1.0) / (F.col("_T") * F.col("_batches"))
    else:
        weight = F.col("_n") / F.col("_T")
    w = cut(same_keys(o, per.select(by, "_b", weight.alias("_w")), [by, "_b"]).select(by, key, "_w"))
    return (same_keys(texts, w, [by, key], broadcast=lm.BROADCAST_ROWS)
            .select(by, "_w", F.explode(word_tokens(text, pattern)).alias("tok"))
            .groupBy(by, "tok").agg(F.sum("_w").alias("cnt")))


def step_targets(mb: DataFrame, accum: int = 1):
    """U4: (targets(run_id, step, tok, q), weights(run_id, step, a)).

    Each micro-batch's counts are normalised by its token total; a step is
    ``accum`` consecutive micro-batches and its target is their sum / accum,
    i.e. the mean of the micro-batch gradients (a partial last step keeps the
    1/accum factor, like loss / accumulation_steps).  The totals, a row per
    micro-batch, come to the counts: those of a hot run aren't gathered by slice.
    """
    nb = cut(mb.groupBy("run_id", "b").agg(F.sum("cnt").alias("_nb")))
    q = (same_keys(mb, nb, ["run_id", "b"], broadcast=lm.BROADCAST_ROWS)
         .withColumn("step", (F.floor(F.col("b") / accum) + 1).cast("long"))
         .groupBy("run_id", "step", "tok")
         .agg((F.sum(F.col("cnt") / F.col("_nb")) / accum).alias("q")))
    w = (nb.withColumn("step", (F.floor(F.col("b") / accum) + 1).cast("long"))
         .groupBy("run_id", "step").agg((F.count(F.lit(1)) / accum).alias("a")))
    return q, w


# Parameter rows per partition of the per-run parameter table.
PARAM_ROWS_PER_PARTITION = 1_000_000


def _initial_params(model: DataFrame, active_train: DataFrame, wide: DataFrame, names: list[str],
                    runs: list[str], with_state: bool, est_rows: int,
                    wide_small: bool = True) -> tuple[DataFrame, DataFrame]:
    """Initial parameters of every run, ``(run_id, tok, _c, theta, n[, m, v])``,
    and the evaluation counts of their classes, ``(run_id, _c, _e0, ...)``.

    Exact compression of the runs x vocabulary table: a token that is in no
    step target of run r only moves through per-run scalars (logZ, clip scale,
    update RMS), so all such tokens that start from the same theta - the
    same training count - stay equal for the whole run.  They become one row
    per (run, count) with multiplicity ``n`` (``tok`` NULL, ``_c`` the count);
    every per-run aggregate weights rows by ``n``.  Class sizes are
    ``#tokens with that count - #active tokens of the run with that count``,
    and the part of an evaluation loss that falls on a class is theta times
    ``evaluation counts of all tokens with that count - those of the run's
    active tokens``.  So neither the runs x vocabulary nor the runs x
    evaluation vocabulary product is ever formed: the table holds the (run,
    token) pairs the run trains on, plus runs x distinct training counts.

    Active pairs are hash-partitioned by token once: that exchange serves the
    de-duplication and the join with the model.  The partition count comes
    from ``est_rows`` (an upper bound of the active pairs), not from the
    inputs: AQE may have coalesced the small inputs into one partition, which
    would make every later step a single task.
    """
    spark = model.sparkSession
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                  spark.sparkContext.defaultParallelism, -(-est_rows // PARAM_ROWS_PER_PARTITION))
    run_col = F.explode(F.array(*[F.lit(r).cast("string") for r in runs])).alias("run_id")
    active = active_train.select("run_id", "tok").repartition(n_parts, "tok").distinct()
    m = model.select("tok", "count", "theta")
    act = cut(active.join(m, "tok", "left"))
    lost = act.filter(F.col("theta").isNull()).limit(1).collect()
    if lost:
        raise ValueError(f"the model has no parameter for the target token {lost[0]['tok']!r}")
    w = F.broadcast(wide) if wide_small else wide
    cols = [f"_e{i}" for i in range(len(names))]
    sums = [F.sum(c).alias(c) for c in cols]
    per_count = m.groupBy("count").agg(F.first("theta").alias("theta"),
                                       F.count(F.lit(1)).alias("_N"))
    per_run = act.groupBy("run_id", "count").agg(F.count(F.lit(1)).alias("_A"))
    classes = (same_keys(per_count.select(run_col, "count", "theta", "_N"), per_run, ["run_id", "count"], "left")
               .select("run_id", "count", "theta",
                       (F.col("_N") - F.coalesce(F.col("_A"), F.lit(0))).alias("n"))
               .filter(F.col("n") > 0))
    e_all = m.join(w, "tok").groupBy("count").agg(*sums)
    e_act = (act.join(w, "tok").groupBy("run_id", "count").agg(*sums)
             .select("run_id", "count", *[F.col(c).alias(f"_a{c}") for c in cols]))
    rest = (same_keys(classes.select("run_id", "count").join(e_all, "count"), e_act, ["run_id", "count"], "left")
            .select("run_id", F.col("count").alias("_c"),
                    *[(F.col(c) - F.coalesce(F.col(f"_a{c}"), F.lit(0))).alias(c) for c in cols]))
    none = F.lit(None)
    p = (act.select("run_id", "tok", none.cast("long").alias("_c"), "theta", F.lit(1).cast("long").alias("n"))
         .unionByName(classes.select("run_id", none.cast("string").alias("tok"),
                                     F.col("count").alias("_c"), "theta", "n")))
    if with_state:
        p = p.withColumn("m", F.lit(0.0)).withColumn("v", F.lit(0.0))
    return p, cut(rest)


def run_table(weights: DataFrame, steps: int, run_steps: DataFrame | None = None) -> DataFrame:
    """Materialised (run_id, n_steps, a0, less): a run's steps, and the share of
    its micro-batches that a step holds: ``less[step]`` where it isn't ``a0``.

    ``run_steps`` (run_id, n_steps) gives the steps of each run; without it every
    run takes ``steps``.  Steps that ``weights`` lacks have no micro-batch: 0.
    """
    if "step" in weights.columns:
        r = weights.groupBy("run_id").agg(
            F.collect_list(F.when(F.col("a") != 1.0, F.struct("step", "a"))).alias("_part"),
            F.collect_list("step").alias("_there"), F.lit(1.0).alias("a0"))
    else:
        r = weights.select("run_id", F.expr("array()").cast("array<struct<step:long,a:double>>").alias("_part"),
                           F.lit(None).cast("array<long>").alias("_there"), F.col("a").cast("double").alias("a0"))
    if run_steps is None:
        r = r.withColumn("n_steps", F.lit(steps).cast("long"))
    else:
        r = same_keys(r, run_steps.select("run_id", F.col("n_steps").cast("long").alias("n_steps")), "run_id")
    every = F.sequence(F.lit(1).cast("long"), F.greatest("n_steps", F.lit(1).cast("long")))
    none = F.transform(F.array_except(every, F.coalesce("_there", every)),
                       lambda t: F.struct(t.alias("step"), F.lit(0.0).alias("a")))
    less = F.map_from_entries(F.concat(F.col("_part").cast("array<struct<step:long,a:double>>"), none))
    return cut(r.select("run_id", "n_steps", "a0", less.alias("less")))


def unlearn_log(model: DataFrame, targets: DataFrame, weights: DataFrame,
                eval_counts: DataFrame, steps: int, opt: Optim, eval_steps: int = 1,
                sign: float = 1.0, extra_eval_steps: tuple[int, ...] = (),
                with_norms: bool = False, with_lr: bool = False,
                run_steps: DataFrame | None = None) -> DataFrame:
    """U3-U9 loop: log (run_id, step, eval_dataset, metric, loss) for step 0,
    every scheduled step and the last one of each run.  ``eval_counts`` is
    (eval_dataset, tok, cnt), plain counts (token mean) or
    ``batch_weighted_counts`` (E4); rows with eval_dataset NULL are the overall
    loss over all sets.  ``targets`` and ``weights`` without a ``step`` column
    serve every step; targets of steps beyond ``steps`` raise.  With
    ``run_steps`` (run_id, n_steps) a run takes its own number of steps, and
    ``steps`` is the largest.

    With ``with_norms`` the log also carries per-run pre-clip ``grad_norm``,
    with ``with_lr`` the learning rate ``eval_lr`` that the schedule stands at
    (the next update's) at every evaluation.
    """
    spark = model.sparkSession
    state = opt.name != "sgd"
    # a long epoch's targets are read as a whole, unless a run is too large for a task
    whole = "step" in targets.columns and steps >= run_loop.LONG_STEPS

    def by_step(df: DataFrame) -> DataFrame:
        # per-step targets stored by step: each step reads only its own slice.
        # Range partitioning keeps steps contiguous (about partitions + steps
        # files) and splits a hot (step, run) over several tasks by token.
        tpath = scratch_path(spark, "targets")
        df.repartitionByRange("step", "run_id", "tok").write.partitionBy("step").parquet(tpath)
        return spark.read.parquet(tpath)

    if "step" in targets.columns:
        every = stored(targets, "targets") if whole else by_step(targets)
        per_step = {r[0]: r[1] for r in every.groupBy("step").count().collect()}
        if max(per_step, default=0) > steps:
            raise ValueError(f"the targets hold {max(per_step)} steps, more than the {steps} to run")
    else:
        # one target for every step (inverse unlearning): stored once
        every = cut(targets)
        per_step = dict.fromkeys(range(1, steps + 1), every.count())
    table = run_table(weights, steps, run_steps)
    # set-up: names of the runs and evaluation sets, and the last steps that occur
    runs = sorted((r[0] for r in table.select("run_id").collect()), key=lambda r: (r is None, r))
    ends = {r[0] for r in table.select("n_steps").distinct().collect()}
    few_runs = len(runs) <= lm.BROADCAST_ROWS
    totals = {r[0]: r[1] for r in eval_counts.groupBy("eval_dataset").agg(F.sum("cnt")).collect()}
    if None in totals:
        raise ValueError("an evaluation set has no name")
    names = sorted(totals)
    wide = cut(lm.eval_wide(eval_counts, names))
    wide_small = lm.few_cells(wide, wide.count())   # materialised: a count of the checkpoint
    params, rest = _initial_params(model, every, wide, names, runs, state, sum(per_step.values()), wide_small)
    params = cut(params)
    rest_small = lm.few_cells(rest, rest.count())
    clipped = bool(opt.max_grad_norm and opt.max_grad_norm > 0)

    def due(t: int, last: int) -> bool:
        return t % eval_steps == 0 or t in extra_eval_steps or t == last

    if whole and run_loop.fits(params, steps):
        states = run_loop.states(params, every, table, opt, sign, due, wide, len(names), wide_small, rest, rest_small)
        log = _log(states, names, totals, opt, eval_steps, extra_eval_steps, with_lr)
        return log.unionByName(_norm_log(states.filter("step > 0"))) if with_norms and clipped else log
    every = by_step(every) if whole else every
    state_path, norm_path = scratch_path(spark, "unlearn-state"), scratch_path(spark, "unlearn-norms")

    def keep_state(step: int, evaluate: bool) -> DataFrame:
        sets = (wide, len(names), wide_small, rest, rest_small) if evaluate else ()
        path = f"{state_path}/step={step}"
        lm.run_state(params, table, *sets).select(*STATE_COLUMNS).write.parquet(path)
        return spark.read.schema(STATE_SCHEMA).parquet(path)

    now = keep_state(0, True)
    for t in range(1, max(ends, default=0) + 1):
        share = F.coalesce(F.col("less")[F.lit(t).cast("long")], F.col("a0")).alias("_a")
        live = now.filter(F.col("n_steps") >= t).select("run_id", F.col("logz").alias("_z"), share)
        tq = every.filter(F.col("step") == t).drop("step") if "step" in every.columns else every
        j = gradient(same_keys(params, live, "run_id", broadcast=few_runs), F.col("_z"), tq, F.col("_a"),
                     per_step.get(t, 0) <= lm.BROADCAST_ROWS).drop("_z", "_a")
        if clipped:
            path = f"{norm_path}/step={t}"  # written: the log reads it, and the gradient is not aggregated twice
            clip_scale(j, opt.max_grad_norm).write.parquet(path)
            norms = spark.read.schema(NORM_SCHEMA).parquet(path)
            j = same_keys(j, norms, "run_id", broadcast=few_runs).withColumn("g", F.col("g") * F.col("scale"))
        new = apply_update(j, opt, t, sign, few_runs=few_runs)
        params = cut(new.select("run_id", "tok", "_c", "theta", "n", *(("m", "v") if state else ())))
        now = keep_state(t, t % eval_steps == 0 or t in extra_eval_steps or t in ends)

    log = _log(spark.read.schema(STATE_SCHEMA + ", step long").parquet(state_path), names, totals, opt, eval_steps,
               extra_eval_steps, with_lr)
    if with_norms and clipped and ends:
        log = log.unionByName(_norm_log(spark.read.schema(NORM_SCHEMA + ", step long").parquet(norm_path)))
    return log


STATE_SCHEMA = "run_id string, logz double, e array<double>, n_steps long, a0 double, less map<bigint,double>"
STATE_COLUMNS = [c.split()[0] for c in STATE_SCHEMA.split(", ")]
NORM_SCHEMA = "run_id string, grad_norm double, scale double"


def _log(states: DataFrame, names: list[str], totals: dict, opt: Optim, eval_steps: int,
         extra: tuple[int, ...], with_lr: bool) -> DataFrame:
    """The log's rows from the run states of all steps."""
    t = F.col("step")
    due = (t % eval_steps == 0) | t.isin(list(extra)) | (t == F.col("n_steps"))
    rows = [F.struct(F.lit(name).alias("eval_dataset"), F.lit("eval_loss").alias("metric"),
                     (F.col("logz") - F.col("e")[i] / F.lit(float(totals[name]))).alias("loss")) for i, name in enumerate(names)]
    none = F.lit(None).cast("string").alias("eval_dataset")
    grand = F.lit(float(sum(totals.values())))
    whole = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    rows.append(F.struct(none, F.lit("eval_loss").alias("metric"), (F.col("logz") - whole / grand).alias("loss")))
    if with_lr:
        rows.append(F.struct(none, F.lit("eval_lr").alias("metric"), opt.lr_after(t).alias("loss")))
    return states.filter(due & F.col("e").isNotNull()).select("run_id", "step", F.inline(F.array(*rows)))


def _norm_log(norms: DataFrame) -> DataFrame:
    return norms.select("run_id", "step", F.lit(None).cast("string").alias("eval_dataset"), F.lit("grad_norm").alias("metric"),
                        F.col("grad_norm").alias("loss"))


def influence_from_log(log: DataFrame, run_col: str = "train_dataset",
                       eval_col: str = "eval_dataset") -> DataFrame:
    """influence(run, e, step) = loss_e(step) - loss_e(step 0), steps >= 1."""
    ev = log.filter((F.col("metric") == "eval_loss") & F.col("eval_dataset").isNotNull())
    base = ev.filter(F.col("step") == 0).select("run_id", "eval_dataset", F.col("loss").alias("_l0"))
    return (same_keys(ev.filter(F.col("step") > 0), base, ["run_id", "eval_dataset"])
            .select(F.col("run_id").alias(run_col), F.col("eval_dataset").alias(eval_col), "step",
                    (F.col("loss") - F.col("_l0")).alias("influence")))


# Rows of an evaluation batch and of an inverse run's micro-batch (Fixed
# values: the evaluation batch size and the per-device training batch size).
EVAL_BATCH = 8
INVERSE_BATCH = 2


def fit(train_rows: DataFrame, eval_rows: DataFrame, n_micro: int | None, accum: int = 1,
        alpha: float = 1.0, batch_rows: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(model, targets, weights) of the forward runs.  The training text is tokenised
    once: per-slice counts, from which whole-dataset counts derive."""
    mb = stored(micro_batch_counts(train_rows, n_micro, batch_rows=batch_rows), "micro-batch-counts")
    train_counts = cut(mb.groupBy(F.col("run_id").alias("dataset"), "tok").agg(F.sum("cnt").alias("cnt")))
    model = cut(lm.fit_union(train_counts, lm.token_counts(eval_rows), alpha=alpha))
    return (model, *step_targets(mb, accum))


def epoch_steps(rows: DataFrame, batch_rows: int, accum: int = 1, by: str = "dataset") -> DataFrame:
    """Materialised (run_id, n_steps): the steps of one epoch over each dataset,
    in micro-batches of ``batch_rows`` rows, ``accum`` of them a step."""
    n = rows.groupBy(F.col(by).alias("run_id")).agg(F.count(F.lit(1)).alias("_n"))
    return cut(n.select("run_id", F.ceil(F.ceil(F.col("_n") / batch_rows) / accum).cast("long").alias("n_steps")))


def eval_weights(rows: DataFrame, eval_batch: int = EVAL_BATCH) -> DataFrame:
    """(eval_dataset, tok, cnt) of the batch-weighted loss (E4), materialised."""
    return cut(batch_weighted_counts(rows, eval_batch).withColumnRenamed("dataset", "eval_dataset"))


def unlearn_influence(train_rows: DataFrame, eval_rows: DataFrame, opt: Optim, steps: int = 2,
                      n_micro: int | None = None, accum: int = 1, alpha: float = 1.0,
                      eval_steps: int = 1, eval_batch: int = EVAL_BATCH,
                      batch_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """U8 forward unlearning: for every training dataset d, start from the model fitted on
    all training data, unlearn d (gradient ascent) for one epoch, and measure
    every evaluation set's batch-weighted loss.  Returns (log, influence).

    With ``batch_rows`` an epoch is what it is for a trainer: micro-batches of
    that many rows, ``accum`` of them a step, so a dataset takes as many steps
    as its size asks for and its run ends after them.  Without it every run has
    the same number of slices (``n_micro``, or ``steps * accum``); more slices
    than ``steps`` can take run as further steps.
    """
    run_steps = None
    if batch_rows is None:
        n_micro = n_micro or steps * accum
        steps = max(steps, -(-n_micro // accum))
    else:
        run_steps = epoch_steps(train_rows, batch_rows, accum)
        steps = run_steps.agg(F.max("n_steps")).first()[0] or 0
    model, q, w = fit(train_rows, eval_rows, n_micro, accum, alpha, batch_rows)
    log = unlearn_log(model, q, w, eval_weights(eval_rows, eval_batch), steps, opt, eval_steps, run_steps=run_steps)
    return log, influence_from_log(log)


def unlearn_influence_inverse(train_rows: DataFrame, eval_rows: DataFrame, opt: Optim,
                              steps: int = 2, alpha: float = 1.0, eval_steps: int = 1,
                              batch_rows: int = INVERSE_BATCH,
                              eval_batch: int = EVAL_BATCH) -> tuple[DataFrame, DataFrame]:
    """U9 inverse unlearning: unlearn each *evaluation* set (every step accumulates the
    whole set in micro-batches of ``batch_rows``) and measure the loss on every
    training dataset; the result is transposed so rows are (train_dataset,
    eval_dataset) like the forward ones."""
    train_counts = cut(lm.token_counts(train_rows))
    q = cut(batch_weighted_counts(eval_rows, batch_rows, mean_of_batches=True)
            .select(F.col("dataset").alias("run_id"), "tok", F.col("cnt").alias("q")))
    model = cut(lm.fit_union(train_counts, q, alpha=alpha))
    w = q.select("run_id", F.lit(1.0).alias("a")).distinct()
    log = unlearn_log(model, q, w, eval_weights(train_rows, eval_batch), steps, opt, eval_steps)
    return log, influence_from_log(log, run_col="eval_dataset", eval_col="train_dataset")


__all__ = ["micro_batch_counts", "step_targets", "unlearn_log", "unlearn_influence",
           "unlearn_influence_inverse", "influence_from_log",
           "batch_weighted_counts", "epoch_steps", "eval_weights", "fit"]
