"""Optimizers as column expressions over parameter rows.

A step sees, per row, ``theta`` (and optimizer state ``m``, ``v``), the
gradient ``g`` and the step number; per-run scalars (gradient norm, update
RMS) are aggregates with a row per run, joined back by ``run_id``: none of
them passes through the driver.  Unlearning negates the
loss, i.e. it moves along ``+update`` (``sign = +1``); learning uses -1.

Formulas follow the published algorithms: Adam with decoupled weight decay
(Loshchilov & Hutter) and Adafactor's unfactored form for vector parameters
(Shazeer & Stern), with a fixed learning rate (no relative step, no parameter
scaling), as configured by the reference's scripts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import same_keys


@dataclass(frozen=True)
class Optim:
    name: str = "sgd"              # sgd | adamw | adafactor
    lr: float = 5e-5
    warmup_steps: int = 0
    max_grad_norm: float = 0.0     # 0 disables clipping (all unlearning scripts)
    beta1: float = 0.9
    beta2: float = 0.999
    eps: float = 1e-8
    weight_decay: float = 0.0
    eps1: float = 1e-30            # Adafactor regulariser of g^2
    decay_rate: float = -0.8       # Adafactor beta2_t = 1 - t^decay_rate
    clip_threshold: float = 1.0    # Adafactor update RMS clip

    def lr_at(self, step: int) -> float:
        """Constant with linear warm-up; the schedule starts at 0, so the
        first of the warm-up updates (``step`` = 1) moves nothing."""
        if self.warmup_steps > 0:
            return self.lr * min(1.0, (step - 1) / self.warmup_steps)
        return self.lr

    def lr_after(self, step: Column) -> Column:
        """The learning rate of the update after ``step``."""
        if self.warmup_steps > 0:
            return F.lit(self.lr) * F.least(F.lit(1.0), step / self.warmup_steps)
        return F.lit(float(self.lr))


def mult(df: DataFrame) -> Column:
    """Row multiplicity: a parameter row may stand for ``n`` equal parameters
    (see ``influence._initial_params``); plain tables count each row once."""
    return F.col("n") if "n" in df.columns else F.lit(1)


def clip_scale(j: DataFrame, max_norm: float, run: str = "run_id") -> DataFrame:
    """(run, grad_norm, scale) with scale = min(1, c / (||g|| + 1e-6))."""
    return (j.groupBy(run).agg(F.sqrt(F.sum(mult(j) * F.col("g") * F.col("g"))).alias("grad_norm"))
            .withColumn("scale", F.least(F.lit(1.0), F.lit(max_norm) / (F.col("grad_norm") + F.lit(1e-6)))))


def moved(opt: Optim, step: int, sign: float, g, theta, m=None, v=None, sqrt=F.sqrt) -> tuple:
    """U6 without per-run scalars: the new (theta,) of sgd or (theta, m, v) of AdamW, from columns or arrays."""
    lr = opt.lr_at(step)
    if opt.name == "sgd":
        return (theta + sign * lr * g,)
    if opt.name != "adamw":
        raise ValueError(opt.name)
    m = opt.beta1 * m + (1 - opt.beta1) * g
    v = opt.beta2 * v + (1 - opt.beta2) * g * g
    u = (m / (1 - opt.beta1 ** step)) / (sqrt(v) / ((1 - opt.beta2 ** step) ** 0.5) + opt.eps)
    if opt.weight_decay:
        theta = theta * (1 - lr * opt.weight_decay)
    return theta + sign * lr * u, m, v


def moved_run(opt: Optim, step: int, sign: float, g, theta, m, v, n) -> tuple:
    """U6 on the arrays of a whole run, rows weighted by ``n``: the new (theta, m, v), None where there is no state."""
    if opt.name != "adafactor":
        state = () if opt.name == "sgd" else (m, v)
        return (*moved(opt, step, sign, g, theta, *state, sqrt=np.sqrt), None, None)[:3]
    b2 = 1.0 - step ** opt.decay_rate
    v = b2 * v + (1 - b2) * (g * g + opt.eps1)
    u = g / np.sqrt(v)
    rms = np.sqrt((n * u * u).sum() / n.sum())
    return theta + sign * opt.lr_at(step) * (u / max(1.0, rms / opt.clip_threshold)), m, v


def apply_update(j: DataFrame, opt: Optim, step: int, sign: float = 1.0,
                 run: str = "run_id", few_runs: bool = True) -> DataFrame:
    """New (theta, m, v) from rows holding theta, m, v, g.  ``few_runs``:
    a row per run may be broadcast."""
    if opt.name in ("sgd", "adamw"):
        state = ("theta",) if opt.name == "sgd" else ("theta", "m", "v")
        return j.withColumns(dict(zip(state, moved(opt, step, sign, *[F.col(c) for c in ("g", *state)]))))
    lr = opt.lr_at(step)
    g = F.col("g")
    if opt.name == "adafactor":
        b2 = 1.0 - step ** opt.decay_rate
        v = F.lit(b2) * F.col("v") + F.lit(1 - b2) * (g * g + F.lit(opt.eps1))
        out = j.withColumn("v", v).withColumn("_u", g / F.sqrt(F.col("v")))
        # per-run RMS of the update: one aggregate, joined back
        square = F.sum(mult(out) * F.col("_u") * F.col("_u")) / F.sum(mult(out))
        out = same_keys(out, out.groupBy(run).agg(F.sqrt(square).alias("_rms")), run, broadcast=few_runs)
        out = out.withColumn("_u", F.col("_u") / F.greatest(F.lit(1.0), F.col("_rms") / opt.clip_threshold)).drop("_rms")
    else:
        raise ValueError(opt.name)
    return out.withColumn("theta", F.col("theta") + F.lit(sign * lr) * F.col("_u")).drop("_u")


def gradient(params: DataFrame, logz: Column, targets: DataFrame, a: Column,
             broadcast_targets: bool, run: str = "run_id") -> DataFrame:
    """g = a * softmax(theta) - q for every parameter row (q = 0 off the batch).

    ``targets(run, tok, q)``: the step's normalised token counts (averaged over
    accumulated micro-batches); ``logz`` and ``a`` (share of accumulated
    micro-batches present in the step) are per-run scalars, columns of ``params``.
    Rows without a token (classes) have no target.
    """
    t = targets.select(F.col(run).alias("_t_run"), F.col("tok").alias("_t_tok"), "q")
    t = F.broadcast(t) if broadcast_targets else t
    j = params.join(t, F.col(run).eqNullSafe(F.col("_t_run")) & (F.col("tok") == F.col("_t_tok")), "left")
    g = (F.coalesce(a, F.lit(0.0)) * F.exp(F.col("theta") - logz)
         - F.coalesce(F.col("q"), F.lit(0.0)))
    return j.withColumn("g", g).drop("q", "_t_run", "_t_tok")
