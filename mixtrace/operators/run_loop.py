"""Long epochs of the unigram loop: all steps of a run in one pass over its parameters.

A step of ``influence.unlearn_log`` is two Spark jobs, which take most of a second
however little they do; an epoch of hundreds of steps is mostly that.  A step needs
nothing of another run, so a run whose parameter rows fit a task is one task's
loop: it holds the rows as arrays, and the targets come to it a step at a time, in
order.  Rows, formulas and log are those of the loop by steps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut
from .joins import same_keys
from .models import lm
from .optim import Optim, moved_run

#: Steps from which on an epoch is long.
LONG_STEPS = 32
#: Parameter rows of a run up to which they may be one task's arrays (some hundred bytes a row).
TASK_ROWS = 4_000_000

STATES = "run int, step long, logz double, e array<double>, grad_norm double"
_STATES = pa.schema([("run", pa.int32()), ("step", pa.int64()), ("logz", pa.float64()), ("e", pa.list_(pa.float64())), ("grad_norm", pa.float64())])


def fits(params: DataFrame, steps: int) -> bool:
    """Whether the epochs are long and every run's rows (materialised) fit a task."""
    return steps >= LONG_STEPS and not params.groupBy("run_id").count().filter(F.col("count") > TASK_ROWS).limit(1).count()


class Run:
    """A run's rows as arrays, at a step."""

    def __init__(self, opt: Optim, sign: float, due, number: int, n_steps: int, a0: float, less: dict):
        self.opt, self.sign, self.due = opt, sign, due
        self.number, self.n_steps, self.a0, self.less = number, n_steps, a0, less
        self.parts, self.step, self.out = [], 0, []

    def add(self, rid, theta, n, e) -> None:
        self.parts.append((rid, theta, n, e))

    def start(self) -> None:
        self.rid, self.theta, n, e = (np.concatenate(x) for x in zip(*self.parts))
        self.n, self.e, self.parts = n.astype(float), np.ascontiguousarray(e.T), None
        self.m = self.v = np.zeros(len(self.theta)) if self.opt.name != "sgd" else None
        self.keep(None)

    def keep(self, norm: float | None) -> None:
        """The state after a step, with the sums that the losses need when one is due."""
        top = self.theta.max()
        self.p = np.exp(self.theta - top)
        z = self.n @ self.p
        self.p /= z
        e = (self.e @ self.theta).tolist() if self.step == 0 or self.due(self.step, self.n_steps) else None
        self.out.append({"run": self.number, "step": self.step, "logz": top + np.log(z), "e": e, "grad_norm": norm})

    def to(self, step: int, rid=None, q=None) -> None:
        """On to ``step``, whose targets are given; steps between have none."""
        if self.parts is not None:
            self.start()
        while self.step < min(step, self.n_steps):
            self.step += 1
            g = self.p * self.less.get(self.step, self.a0)
            if self.step == step and rid is not None:
                g[np.searchsorted(self.rid, rid)] -= q  # a row has one target at most
            norm = None
            if self.opt.max_grad_norm and self.opt.max_grad_norm > 0:
                norm = float(np.sqrt(self.n @ (g * g)))
                g *= min(1.0, self.opt.max_grad_norm / (norm + 1e-6))
            self.theta, self.m, self.v = moved_run(self.opt, self.step, self.sign, g, self.theta, self.m, self.v, self.n)
            self.keep(norm)

    def end(self) -> pa.RecordBatch:
        self.to(self.n_steps)
        return pa.RecordBatch.from_pylist(self.out, schema=_STATES)


def loop(opt: Optim, sign: float, due):
    """Rows by (run, step, rid): the run (step -1), its parameters (0), its targets -> STATES."""
    def run(batches):
        now = None
        for batch in batches:
            number, step = (batch.column(c).to_numpy() for c in ("run", "step"))
            kind = np.minimum(step, 1)
            cuts = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (kind[1:] != kind[:-1])])) if len(step) else []
            for a, z in zip(cuts, [*cuts[1:], len(step)]):
                part = batch.slice(a, z - a)
                get = lambda c, part=part: part.column(c)
                if kind[a] == -1:
                    if now is not None:
                        yield now.end()
                    less = {x["step"]: x["a"] for x in get("less")[0].as_py()}
                    now = Run(opt, sign, due, int(number[a]), get("n_steps")[0].as_py(), get("a0")[0].as_py(), less)
                elif kind[a] == 0:
                    e = get("e")
                    now.add(*(get(c).to_numpy() for c in ("rid", "theta", "n")), e.flatten().to_numpy().reshape(z - a, -1))
                else:
                    for t, q in zip(step[a:z].tolist(), get("q")):
                        rid, values = q.values.flatten()
                        now.to(t, rid.to_numpy(), values.to_numpy())
        if now is not None:
            yield now.end()
    return run


def states(params: DataFrame, every: DataFrame, table: DataFrame, opt: Optim, sign: float, due,
           wide: DataFrame, n_sets: int, wide_small: bool, rest: DataFrame, rest_small: bool) -> DataFrame:
    """Materialised (run_id, step, logz, e, grad_norm, n_steps) of all steps; ``e`` where ``due`` (step, n_steps).

    ``params``, ``every`` (run_id, step, tok, q) and ``table`` are materialised,
    ``wide`` and ``rest`` the evaluation counts of tokens and classes.
    """
    numbers = cut(table.withColumn("run", F.row_number().over(Window.orderBy("run_id")) - 1))
    few = lm.BROADCAST_ROWS
    e = F.array(*[F.coalesce(F.col(f"_e{i}"), F.lit(0)).cast("double") for i in range(n_sets)]).alias("e")
    rows = params.withColumn("rid", F.monotonically_increasing_id())
    own = rows.filter(F.col("tok").isNotNull())
    key = ["run_id", "rid", "theta", "n"]
    held = own.join(F.broadcast(wide) if wide_small else wide, "tok", "left").select(*key, e).unionByName(
        same_keys(rows.filter(F.col("tok").isNull()), rest, ["run_id", "_c"], "left", rest_small).select(*key, e))
    held = same_keys(held, numbers.select("run_id", "run"), "run_id", broadcast=few).select(
        "run", F.lit(0).cast("long").alias("step"), "rid", "theta", "n", "e")
    q = (same_keys(every, own.select("run_id", "tok", "rid"), ["run_id", "tok"])
         .groupBy("run_id", "step").agg(F.collect_list(F.struct("rid", "q")).alias("q")))
    q = same_keys(q, numbers.select("run_id", "run"), "run_id", broadcast=few).select("run", "step", F.lit(0).cast("long").alias("rid"), "q")
    head = numbers.select("run", F.lit(-1).cast("long").alias("step"), F.lit(0).cast("long").alias("rid"), "n_steps", "a0",
                          F.expr("transform(map_entries(less), x -> struct(x.key AS step, x.value AS a))").alias("less"))
    both = head.unionByName(held, allowMissingColumns=True).unionByName(q, allowMissingColumns=True)
    parts = max(1, min(numbers.count(), 4 * every.sparkSession.sparkContext.defaultParallelism))
    out = (both.repartitionById(parts, F.col("run") % parts).sortWithinPartitions("run", "step", "rid")
           .select("run", "step", "rid", "theta", "n", "e", "q", "n_steps", "a0", "less").mapInArrow(loop(opt, sign, due), STATES))
    return cut(same_keys(out, numbers.select("run", "run_id", "n_steps"), "run", broadcast=few).drop("run"))
