"""Operator 8: toxicity severity by cumulative-link ordinal regression.

P(grade > k) = logistic(w . x - threshold_k): one weight vector for all
ordered thresholds, x the terms (lower-cased words of letters) present in the
text.  Expected severity is the sum over k of P(grade > k).

Grades may be given (``fit``: a column of 0..K-1).  Where labels only say toxic
or not, three ordered grades are made of them: 0 not toxic, 1 toxic with at
most one of the terms that toxic sample documents hold ``TELLING`` times as often
as others, 2 toxic with two or more different ones.

Terms enter the model if their presence differs between grade 0 and the others
by more than ``Z`` standard errors, in at least ``SEEN`` toxic sample documents; all such
terms do.  Benign words hence carry no weight and a long clean text gathers
none.  Training reads a bounded sample: about ``MOST_DOCS`` labelled documents of
each class (by a hash of id and text; all, if there are fewer), which bounds the model.

Defined cases: NULL and empty texts have no terms; without labels of both
classes every text has the grade shares of the labels (severity 0 without
any); labels with NULL doc_id or NULL toxic are ignored, of repeated labels the
largest counts; rows without doc_id teach nothing and are scored, rows that share
one all have its label, each different text is a training row of its own and
counts once; a term counts once however often it stands; empty tables give
empty results; extra columns are ignored.  Whole texts are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, pick, slices

MOST_DOCS = 6000
Z = 4.0
SEEN = 3
TELLING = 10
STEPS = 1500

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


@dataclass
class Model:
    """Term weights and ascending thresholds, one fewer than the grades."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = ()
    #: Severity from which a text is called toxic: the cut with the fewest errors in the sample.
    flag: float = 0.5

    def above(self, terms: set[str]) -> list[float]:
        """P(grade > k) for every k."""
        z = sum(self.weights[t] for t in sorted(terms & self.weights.keys()))
        return [1 / (1 + math.exp(min(500.0, t - z))) for t in self.thresholds]


def terms_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def _terms(sample: DataFrame) -> dict[str, bool]:
    """The model's terms, and whether each is telling."""

    def run(batches):
        for b in slices(batches, "text"):
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
                t = sorted(terms_of(text))
                yield pa.RecordBatch.from_pydict({"term": pa.array(t, pa.string()), "y": pa.array([int(y > 0)] * len(t), pa.int32())})

    n = {r[0]: r[1] for r in sample.groupBy(F.col("y") > 0).count().collect()}
    top = (sample.select("text", "y").mapInArrow(run, "term string, y int").groupBy("term")
           .agg(F.sum(1 - F.col("y")).alias("n0"), F.sum("y").alias("n1")).filter(F.col("n1") >= SEEN))
    n0, n1 = n.get(False, 0), n.get(True, 0)
    p0, p1 = (F.col("n0") + 0.5) / (n0 + 1), (F.col("n1") + 0.5) / (n1 + 1)
    pooled = (F.col("n0") + F.col("n1") + 1) / (n0 + n1 + 2)
    z = (p1 - p0) / F.sqrt(pooled * (1 - pooled) * (1 / (n0 + 1) + 1 / (n1 + 1)))
    best = top.withColumn("z", z).filter(F.abs("z") >= Z).collect()  # bounded by the sample's words
    return {r.term: (r.n1 + 0.5) / (n1 + 1) >= TELLING * (r.n0 + 0.5) / (n0 + 1) for r in best}


def _rows(sample: DataFrame, terms: list[str]) -> tuple[list[list[int]], np.ndarray]:
    """The sample's chosen terms and labels: at most MOST_DOCS x classes short lists."""
    wanted = {t: i for i, t in enumerate(terms)}

    def run(batches):
        for b in slices(batches, "text"):
            got = [sorted(wanted[t] for t in terms_of(x) & wanted.keys()) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.int32())), b.column("y")], ["t", "y"])

    got = sample.select("text", "y").mapInArrow(run, "t array<int>, y int").toArrow()
    both = sorted(zip(got.column("t").to_pylist(), got.column("y").to_pylist()))
    return [t for t, _ in both], np.array([y for _, y in both], np.int64)


def fit_rows(rows: list[list[int]], y: np.ndarray, weight: np.ndarray, n_terms: int, grades: int,
             ridge: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds by full gradient steps (Adam) on the
    weighted likelihood; thresholds are a first one and positive gaps."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    at = np.array([t for r in rows for t in r], np.int64)
    w = np.zeros(n_terms)
    level = [np.clip(np.average(y > k, weights=weight), 1e-4, 1 - 1e-4) for k in range(grades - 1)]
    cut = np.array([-math.log(p / (1 - p)) for p in level])
    gap = np.log(np.maximum(np.diff(cut), 0.05))
    theta = np.concatenate([w, cut[:1], gap])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    total = weight.sum()
    for step in range(1, STEPS + 1):
        w, first, gaps = theta[:n_terms], theta[n_terms], np.exp(theta[n_terms + 1:])
        cuts = first + np.append(0, np.cumsum(gaps))
        z = np.bincount(owner, w[at], len(rows)) if len(at) else np.zeros(len(rows))
        s = 1 / (1 + np.exp(np.clip(cuts[None, :] - z[:, None], -30, 30)))  # P(grade > k)
        full = np.concatenate([np.ones((len(rows), 1)), s, np.zeros((len(rows), 1))], axis=1)
        p = np.maximum(full[np.arange(len(y)), y] - full[np.arange(len(y)), y + 1], 1e-9)
        slope = full * (1 - full)
        up, low = slope[np.arange(len(y)), y], slope[np.arange(len(y)), y + 1]
        dz = weight * (up - low) / p
        gw = np.bincount(at, dz[owner], n_terms) if len(at) else np.zeros(n_terms)
        gc = np.zeros(grades - 1)
        np.add.at(gc, np.maximum(y - 1, 0), np.where(y > 0, -weight * up / p, 0))
        np.add.at(gc, np.minimum(y, grades - 2), np.where(y < grades - 1, weight * low / p, 0))
        tail = np.cumsum(gc[::-1])[::-1]
        g = -np.concatenate([gw - ridge * w * total / 100, tail[:1], tail[1:] * gaps]) / total
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    w, gaps = theta[:n_terms], np.exp(theta[n_terms + 1:])
    return w, theta[n_terms] + np.append(0, np.cumsum(gaps))


def _sample(docs: DataFrame, labels: DataFrame, label: str, most: int, seed: int) -> tuple[DataFrame, dict[int, int]]:
    known = (pick(labels, "doc_id", label).filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
             .filter(~held_out("doc_id")).groupBy("doc_id").agg(F.max(label).cast("int").alias("y")))
    shares = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    return labelled_sample(docs, known, most, seed), shares


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", grades: int | None = None,
        most: int = MOST_DOCS, seed: int = 3) -> Model:
    """Learns from labels of rows that aren't held out.  ``grades``: the label
    is a grade below that; None: it is 0 or 1, and three grades are made."""
    sample, shares = _sample(docs, labels, label, most, seed)
    telling = _terms(sample)
    terms = sorted(telling)
    if not terms:
        n = sum(shares.values())
        top = grades or 3
        above = [sum(c for y, c in shares.items() if y > k) / n if n else 0.0 for k in range(top - 1)]
        return Model({}, tuple(-math.log(max(p, 1e-9) / max(1 - p, 1e-9)) for p in above) if n else (500.0,) * (top - 1))
    rows, y = _rows(sample, terms)
    true = {k: shares.get(k, 0) for k in set(y.tolist())}
    weight = np.array([true[k] / max(1, (y == k).sum()) for k in y.tolist()])  # the classes' true shares
    if grades is None:
        grades = 3
        hits = np.array([sum(telling[terms[t]] for t in r) for r in rows])
        y = np.where(y > 0, np.where(hits >= 2, 2, 1), 0)
    w, cuts = fit_rows(rows, y, weight, len(terms), grades)
    model = Model(dict(zip(terms, w.tolist())), tuple(cuts.tolist()))
    # errors of every cut between neighbouring severities, from below all to above all
    severity = np.array([sum(model.above({terms[t] for t in r})) for r in rows])
    order = np.argsort(severity, kind="stable")
    s, bad = severity[order], np.where(y[order] > 0, weight[order], -weight[order])
    wrong = np.append(0, np.cumsum(bad))  # toxic below the cut less clean below it
    edge = np.concatenate([[0.0], (s[1:] + s[:-1]) / 2, [float(grades)]])
    edge[1:-1][s[1:] == s[:-1]] = np.nan  # no cut between equals
    model.flag = float(edge[np.nanargmin(np.where(np.isnan(edge), np.nan, wrong))])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, severity (expected grade), score (P(grade > 0)), grade (the
    likeliest), n_terms (model terms found), predicted (1: toxic)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # significant terms of a bounded sample
    ddl = "doc_id long, severity double, score double, grade int, n_terms int, predicted int"

    def run(batches):
        m = shared.value
        for b in slices(batches, "text"):
            out = ([], [], [], [], [])
            for text in b.column("text").to_pylist():
                terms = terms_of(text)
                p = m.above(terms)
                each = [a - c for a, c in zip([1.0, *p], [*p, 0.0])]
                out[0].append(sum(p))
                out[1].append(p[0] if p else 0.0)
                out[2].append(max(range(len(each)), key=lambda k: each[k]))
                out[3].append(len(terms & m.weights.keys()))
                out[4].append(int(bool(p) and sum(p) >= m.flag))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(out[0], pa.float64()), pa.array(out[1], pa.float64()),
                 *[pa.array(x, pa.int32()) for x in out[2:]]], ["doc_id", "severity", "score", "grade", "n_terms", "predicted"])

    return pick(docs, "doc_id", "text").selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, ddl)
