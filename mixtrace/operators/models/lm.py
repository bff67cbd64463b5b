"""M-LM: softmax unigram language model as relational aggregates.

Parameters are rows ``(run_id, tok, theta)``; ``p = softmax(theta)`` within a
run.  The loss of a model on a dataset is the mean token NLL
``logZ - theta_w``; it only needs token counts, so datasets are reduced to
``(dataset, tok, cnt)`` once and every later step works on counts.

Fit (closed form, smoothing alpha): ``theta_w = ln(C(w) + alpha)``.  It is the
exact optimum of the loss on the smoothed counts, so "training" is one
``groupBy``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ...functions.text import WORD_SPLIT, word_tokens
from ...session import cut, small_enough, spread
from ..joins import same_keys

# Rows of a side that may be broadcast after a size check.
BROADCAST_ROWS = 1_000_000
# ... and its rows x columns, for tables whose width grows with the evaluation sets.
BROADCAST_CELLS = 8_000_000


def token_counts(rows: DataFrame, by: str | list[str] = "dataset", text: str = "text",
                 pattern: str = WORD_SPLIT) -> DataFrame:
    """(by..., tok, cnt): explode once, partial aggregation map-side."""
    by = [by] if isinstance(by, str) else list(by)
    return (spread(rows.select(*by, text)).select(*by, F.explode(word_tokens(text, pattern)).alias("tok"))
            .groupBy(*by, "tok").agg(F.count(F.lit(1)).alias("cnt")))


def vocabulary(*counts: DataFrame) -> DataFrame:
    """Distinct tokens over all given count tables (train and eval)."""
    toks = [c.select("tok") for c in counts]
    u = toks[0]
    for t in toks[1:]:
        u = u.union(t)
    return u.distinct()


def fit_unigram(train_counts: DataFrame, vocab: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(tok, count, theta) for every vocabulary token; count 0 if unseen in training."""
    c = train_counts.groupBy("tok").agg(F.sum("cnt").alias("count"))
    return (vocab.join(c, "tok", "left")
            .select("tok", F.coalesce("count", F.lit(0)).cast("long").alias("count"))
            .withColumn("theta", F.log(F.col("count") + F.lit(alpha))))


def fit_union(train_counts: DataFrame, *others: DataFrame, alpha: float = 1.0) -> DataFrame:
    """``fit_unigram`` with the vocabulary of ``train_counts`` and ``others``
    together: one aggregate by token, in which the others' tokens count 0, in
    place of a distinct vocabulary and a join with it."""
    rows = train_counts.select("tok", F.col("cnt").cast("long").alias("count"))
    for o in others:
        rows = rows.unionByName(o.select("tok", F.lit(0).cast("long").alias("count")))
    return (rows.groupBy("tok").agg(F.sum("count").alias("count"))
            .withColumn("theta", F.log(F.col("count") + F.lit(alpha))))


def log_partition(params: DataFrame, run: str | list[str] = "run_id") -> DataFrame:
    """(run, logz): ln sum exp(theta) per run (or per combination of columns), rows
    weighted by a multiplicity ``n`` when the table has one.

    exp is taken relative to a multiple of ``STRIDE`` near theta, so a diverging
    run doesn't overflow; a run has a handful of such strides.
    """
    keys = [run] if isinstance(run, str) else list(run)
    n = F.col("n") if "n" in params.columns else F.lit(1)
    part = (params.groupBy(*keys, stride("theta").alias("_s"))
            .agg(F.log(F.sum(n * F.exp(F.col("theta") - stride("theta")))).alias("_l")))
    x = part.groupBy(*keys).agg(F.collect_list(F.col("_s") + F.col("_l")).alias("_x"))
    top = F.array_max("_x")
    return x.select(*keys, (top + F.log(F.aggregate("_x", F.lit(0.0), lambda a, v: a + F.exp(v - top)))).alias("logz"))


STRIDE = 500.0


def stride(theta: str):
    """The multiple of STRIDE at or below theta."""
    return F.floor(F.col(theta) / STRIDE) * STRIDE


def quoted(name: str):
    """A column by name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def eval_names(eval_counts: DataFrame, col: str = "eval_dataset") -> list[str]:
    """Sorted names of the evaluation sets (a handful of strings, not data)."""
    return sorted(r[0] for r in eval_counts.select(col).distinct().collect())


def eval_wide(eval_counts: DataFrame, names: list[str], col: str = "eval_dataset",
              keys: list[str] | None = None) -> DataFrame:
    """(keys..., _e0, _e1, ...) one count column per evaluation set, in the order of
    ``names``; 0 when absent.  Columns are named by position, so a set may have any name.

    Pivot with explicit values: one row per evaluation token (or pair), so joining it
    with a run-partitioned parameter table yields every (run, eval set) pair
    from an equi-join on the keys - no cross product of runs and sets.
    """
    keys = keys or ["tok"]
    if not names:
        return eval_counts.select(*keys).distinct()
    at = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(col)) - 1
    w = eval_counts.withColumn("_at", at).groupBy(*keys).pivot("_at", list(range(len(names)))).agg(F.sum("cnt"))
    return w.select(*keys, *[F.coalesce(quoted(str(i)), F.lit(0)).alias(f"_e{i}") for i in range(len(names))])


def join_checked(big: DataFrame, small: DataFrame, on, how: str = "inner",
                 max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``small`` only after a row-count check; shuffle join beyond it."""
    if small_enough(small, max_rows):
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)


def eval_loss_full(model: DataFrame, eval_counts: DataFrame, vocab_size: int,
                   n_train: int, alpha: float = 1.0) -> DataFrame:
    """U2 for the fitted model: (eval_dataset, loss, n_tokens)."""
    logz = F.log(F.lit(float(n_train) + alpha * vocab_size))
    j = eval_counts.join(model.select("tok", "theta"), "tok", "left")
    th = F.coalesce("theta", F.log(F.lit(alpha)))
    return (j.groupBy("eval_dataset")
            .agg((F.sum(F.col("cnt") * (logz - th)) / F.sum("cnt")).alias("loss"),
                 F.sum("cnt").cast("long").alias("n_tokens")))


def influence_loo(train_counts: DataFrame, eval_counts: DataFrame, alpha: float = 1.0,
                  vocab_size: int | None = None) -> DataFrame:
    """Leave-one-dataset-out influence, exact, without retraining.

    Counts are additive, so the model without dataset d has
    ``theta_w = ln(C(w) - c_d(w) + alpha)`` and ``logZ = ln(N - N_d + alpha V)``:

        infl(d, e) = ln(N-N_d+aV) - ln(N+aV)
                     - 1/|e| sum_{w in d and e} c_e(w) [ln(C-c_d+a) - ln(C+a)]

    Only tokens shared by d and e enter the sum, so the work is one equi-join
    of the per-dataset counts with the (small) evaluation vocabulary on ``tok``.
    Output: (train_dataset, eval_dataset, influence).

    Both count tables feed several jobs here (names, vocabulary, totals, the
    join): pass them materialised (``session.cut``), as the catalogue does.
    """
    names = eval_names(eval_counts)
    if vocab_size is None:
        vocab_size = vocabulary(train_counts, eval_counts).count()
    wide = eval_wide(eval_counts, names)
    # C(w) next to every c_d(w): one shuffle on tok of already aggregated rows
    tc = train_counts.withColumn("C", F.sum("cnt").over(Window.partitionBy("tok")))
    per_d = train_counts.groupBy("dataset").agg(F.sum("cnt").cast("double").alias("n_d"))
    n_tot = per_d.agg(F.sum("n_d")).first()[0]
    totals = {r[0]: r[1] for r in eval_counts.groupBy("eval_dataset").agg(F.sum("cnt")).collect()}
    a = F.lit(alpha)
    delta = F.log(F.col("C") - F.col("cnt") + a) - F.log(F.col("C") + a)
    shared = (join_checked(tc, wide, "tok")
              .groupBy("dataset").agg(*[F.sum(F.col(f"_e{i}") * delta).alias(f"_e{i}") for i in range(len(names))]))
    each = F.array(*[F.struct(F.lit(n).alias("eval_dataset"), F.coalesce(F.col(f"_e{i}"), F.lit(0.0)).alias("b"))
                     for i, n in enumerate(names)])
    long = per_d.join(shared, "dataset", "left").select("dataset", "n_d", F.inline(each))
    tot = F.create_map(*[x for n in names for x in (F.lit(n), F.lit(float(totals[n])))])
    nv = float(n_tot) + alpha * vocab_size
    infl = (F.log(F.lit(nv) - F.col("n_d")) - F.log(F.lit(nv))
            - F.col("b") / tot[F.col("eval_dataset")])
    return long.select(F.col("dataset").alias("train_dataset"), "eval_dataset",
                       infl.alias("influence"))


def example_losses(rows: DataFrame, model: DataFrame, logz: float, alpha: float = 1.0,
                   key: str = "row_id", pattern: str = WORD_SPLIT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per-example (dataset, key, nll, n_tok) under a fitted unigram model.

    Tokens outside the model's vocabulary get the smoothing mass ln(alpha).
    Beyond a broadcast model, a row's equal tokens are counted before the join.
    """
    toks = rows.select("dataset", key, F.explode(word_tokens("text", pattern)).alias("tok"))
    small = small_enough(model, broadcast_rows)
    if small:
        toks = toks.withColumn("_n", F.lit(1))
    else:
        toks = toks.groupBy("dataset", key, "tok").agg(F.count(F.lit(1)).alias("_n"))
    theta = model.select("tok", "theta")
    j = toks.join(F.broadcast(theta) if small else theta, "tok", "left")
    nll = F.col("_n") * (F.lit(float(logz)) - F.coalesce(F.col("theta"), F.log(F.lit(alpha))))
    return j.groupBy("dataset", key).agg(F.sum(nll).alias("nll"), F.sum("_n").cast("long").alias("n_tok"))


def few_cells(df: DataFrame, rows: int) -> bool:
    """Whether a table of ``rows`` rows is small enough to broadcast, its width counted."""
    return rows <= BROADCAST_ROWS and rows * len(df.columns) <= BROADCAST_CELLS


def run_state(params: DataFrame, runs: DataFrame, wide: DataFrame | None = None, n_sets: int = 0,
              broadcast_wide: bool = False, rest: DataFrame | None = None, broadcast_rest: bool = False,
              run: str = "run_id") -> DataFrame:
    """One pass over a parameter table: a row per run that has parameters, with
    logz, ``e`` (array of sum_w c_e(w) theta_w for every evaluation set e; NULL
    without ``wide``) and the run's own columns in ``runs``.

    Rows are weighted by a multiplicity ``n`` when the table has one; rows of a
    class (``tok`` NULL, ``_c``) find the class's evaluation counts in ``rest``
    (run, _c, _e0, ...).  The evaluation counts are joined on ``tok`` (broadcast
    after a size check), so the parameter table is not shuffled: what crosses
    the network is a partial sum per run and task.  exp is taken relative to a
    multiple of ``STRIDE``, as in ``log_partition``.
    """
    n = F.col("n") if "n" in params.columns else F.lit(1)
    cols = [f"_e{i}" for i in range(n_sets)] if wide is not None else []
    j = params.select(run, "theta", n.alias("_n"))
    if cols:
        e = [F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c) for c in cols]
        w = F.broadcast(wide) if broadcast_wide else wide
        j = (params.filter(F.col("tok").isNotNull()).select(run, "tok", "theta", n.alias("_n"))
             .join(w, "tok", "left").select(run, "theta", "_n", *e))
        if rest is not None:
            r = params.filter(F.col("tok").isNull()).select(run, "_c", "theta", n.alias("_n"))
            j = j.unionByName(same_keys(r, rest, [run, "_c"], "left", broadcast_rest).select(run, "theta", "_n", *e))
    part = j.groupBy(run, stride("theta").alias("_s")).agg(
        F.log(F.sum(F.col("_n") * F.exp(F.col("theta") - stride("theta")))).alias("_l"),
        *[F.sum(F.col(c) * F.col("theta")).alias(c) for c in cols])
    part = part.select(run, (F.col("_s") + F.col("_l")).alias("_x"), *cols)
    own = [c for c in runs.columns if c != run]
    both = part.unionByName(runs, allowMissingColumns=True).groupBy(run).agg(
        F.collect_list("_x").alias("_x"), *[F.sum(c).alias(c) for c in cols],
        *[F.first(c, ignorenulls=True).alias(c) for c in own])
    top = F.array_max("_x")
    logz = top + F.log(F.aggregate("_x", F.lit(0.0), lambda a, v: a + F.exp(v - top)))
    e = F.array(*cols) if cols else F.lit(None).cast("array<double>")
    return both.filter(F.size("_x") > 0).select(run, logz.alias("logz"), e.alias("e"), *own)


def model_scorer(path: str, logz: float, alpha: float = 1.0):
    """U11 helper: a scorer factory for ``evaluate.external_scorer``.

    The model lies under ``path`` (the shared folder) in folders ``shard=K`` of a
    bounded number of tokens.  Rows are ``(shard, tok, n)``; a task holds the
    weights of one shard at a time, read with pyarrow when the shard changes,
    and scores a row as ``n`` times the token's NLL.
    """
    def load():
        import math

        import pyarrow.dataset as ds
        import pyarrow.fs as pafs
        if path.startswith("file:"):
            fs, p = pafs.LocalFileSystem(), path[len("file:"):]
        else:
            fs, p = pafs.FileSystem.from_uri(path)
        unseen = math.log(alpha)
        held: dict = {}

        def weights(shard):
            if shard not in held:
                held.clear()
                t = ds.dataset(f"{p}/shard={shard}", filesystem=fs, format="parquet") \
                    .to_table(columns=["tok", "theta"])
                held[shard] = dict(zip(t.column("tok").to_pylist(), t.column("theta").to_pylist()))
            return held[shard]

        def score(pdf):
            import pandas as pd
            out = pd.Series(0.0, index=pdf.index)
            for shard, part in pdf.groupby("shard", sort=True):
                theta = weights(shard)
                out.loc[part.index] = part["n"] * (logz - part["tok"].map(lambda w: theta.get(w, unseen)))
            return out
        return score
    return load


def word_pairs(text: str, pattern: str = WORD_SPLIT):
    """array<struct<u, v>>: the adjacent word tokens of a text."""
    t = word_tokens(text, pattern)
    n = F.greatest(F.size(t) - 1, F.lit(0))
    return F.arrays_zip(F.slice(t, 1, n).alias("u"), F.slice(t, 2, n).alias("v"))


def bigram_counts(rows: DataFrame, by: str = "dataset", text: str = "text",
                  pattern: str = WORD_SPLIT) -> DataFrame:
    """(by, u, v, cnt): adjacent word-token pairs inside each row."""
    return (spread(rows.select(by, text)).select(by, F.explode(word_pairs(text, pattern)).alias("p"))
            .select(by, F.col("p.u").alias("u"), F.col("p.v").alias("v"))
            .groupBy(by, "u", "v").agg(F.count(F.lit(1)).alias("cnt")))


def influence_loo_bigram(train_pairs: DataFrame, eval_pairs: DataFrame, vocab_size: int,
                         alpha: float = 1.0) -> DataFrame:
    """U10 for the bigram model ``p(v|u) = (C(u,v)+a) / (C(u)+aV)``, exact.

    Removing dataset d changes a context's normaliser where c_d(u) > 0 and a
    pair's count where c_d(u,v) > 0, so

      infl(d,e) = 1/|B_e| [ sum_u c_e(u.) (ln(C(u)-c_d(u)+aV) - ln(C(u)+aV))
                           - sum_uv c_e(u,v) (ln(C(u,v)-c_d(u,v)+a) - ln(C(u,v)+a)) ]

    Two equi-joins (on u and on (u,v)) of the per-dataset counts with pivoted
    evaluation counts; no dataset x token grid is built.
    """
    train_pairs, eval_pairs = cut(train_pairs), cut(eval_pairs)
    totals = {r[0]: r[1] for r in eval_pairs.groupBy("eval_dataset").agg(F.sum("cnt")).collect()}
    names = sorted(totals)
    a, av = F.lit(alpha), F.lit(alpha * vocab_size)
    cols = [f"_e{i}" for i in range(len(names))]

    def wide(keys: list[str]) -> DataFrame:
        return eval_wide(eval_pairs, names, keys=keys)

    tp = train_pairs.withColumn("C", F.sum("cnt").over(Window.partitionBy("u", "v")))
    tcx = train_pairs.groupBy("dataset", "u").agg(F.sum("cnt").alias("cnt"))
    tcx = tcx.withColumn("C", F.sum("cnt").over(Window.partitionBy("u")))
    da = F.log(F.col("C") - F.col("cnt") + av) - F.log(F.col("C") + av)
    db = F.log(F.col("C") - F.col("cnt") + a) - F.log(F.col("C") + a)
    # one row per dataset: what its contexts add, less what its pairs take
    ta = join_checked(tcx, wide(["u"]), "u").select("dataset", *[(F.col(c) * da).alias(c) for c in cols])
    tb = join_checked(tp, wide(["u", "v"]), ["u", "v"]).select("dataset", *[(-F.col(c) * db).alias(c) for c in cols])
    none = train_pairs.select("dataset", *[F.lit(0.0).alias(c) for c in cols])
    per = none.unionByName(ta).unionByName(tb).groupBy("dataset").agg(*[F.sum(c).alias(c) for c in cols])
    each = F.array(*[F.struct(F.lit(n).alias("eval_dataset"), (F.col(c) / float(totals[n])).alias("influence"))
                     for n, c in zip(names, cols)])
    return per.select(F.col("dataset").alias("train_dataset"), F.inline(each))
