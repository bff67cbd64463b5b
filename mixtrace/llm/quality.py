"""Operator 2: quality by compression with two zstandard dictionaries.

One dictionary is trained on text labelled good, one on text labelled bad.  A
text is cut into pieces of ``PIECE`` bytes, each compressed by itself with
either, so that a long text can't learn its own language and hide what the
dictionaries know of it.  The difference of the compressed sizes over the
text's size is the evidence; a logistic curve over it and over the text's
shortness (a few bytes say little), fitted on labelled documents that the
dictionaries have not seen, turns it into a probability.

Training reads a bounded sample: about ``MOST_DOCS`` labelled documents of each
class (by a hash of id and text; all, if there are fewer).  Half of them, at most ``PIECES``
pieces each spread evenly over the text, make the dictionaries; the others are
scored whole to fit the curve.  Whole texts are scored.

Defined cases: NULL and empty texts have evidence 0; a class without labelled
text has no dictionary and gives the same score, the good labels' share (0.5
without any label), to every text; labels with NULL doc_id or NULL quality are
ignored, of repeated labels the smallest counts; rows without doc_id teach
nothing and are scored, rows that share one all have its label, each different
text is a training row of its own and counts once; empty tables give empty
results; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, pick, slices

PIECE = 2048
MOST_DOCS = 3000
PIECES = 8
DICTIONARY = 112 << 10
LEVEL = 3
GOOD = 0.7


@dataclass
class Model:
    """Raw dictionaries (empty: none) and the curve score = 1 / (1 + exp(-(a + b x + c s))),
    x the evidence and s the shortness."""

    good: bytes
    bad: bytes
    raw: tuple[bool, bool]
    a: float
    b: float
    c: float = 0.0


def shortness(size: int) -> float:
    """1 for an empty text, towards 0 for a long one: how little its evidence says."""
    return 1 / (1 + size / 128)


class _Sizes:
    """Compressors of a model, built once per task."""

    def __init__(self, model: Model):
        import zstandard as z

        self.model = model
        self.make = []
        for data, raw in zip((model.good, model.bad), model.raw):
            if data:
                d = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT if raw else z.DICT_TYPE_FULLDICT)
                d.precompute_compress(level=LEVEL)
                self.make.append(z.ZstdCompressor(dict_data=d, level=LEVEL, write_checksum=False,
                                                  write_content_size=False, write_dict_id=False))

    def evidence(self, text: str | None) -> float:
        """(size with the bad dictionary - with the good one) / bytes of the text."""
        data = (text or "").encode()
        if not data or len(self.make) < 2:
            return 0.0
        good, bad = (c.compress for c in self.make)
        diff = 0
        for i in range(0, len(data), PIECE):
            piece = data[i:i + PIECE]
            diff += len(bad(piece)) - len(good(piece))
        return diff / len(data)

    def score(self, x: float, size: int) -> float:
        m = self.model
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, m.a + m.b * x + m.c * shortness(size)))))


def _dictionary(samples: list[bytes]) -> tuple[bytes, bool]:
    """A trained dictionary, or raw content where there is too little text to train."""
    import zstandard as z

    samples = [s for s in samples if s]
    total = sum(map(len, samples))
    if not total:
        return b"", True
    try:
        if total < 8 * 1024 or len(samples) < 16:
            raise z.ZstdError("too few samples")
        return z.train_dictionary(min(DICTIONARY, total // 4), samples).as_bytes(), False
    except z.ZstdError:
        return b"".join(samples)[-DICTIONARY:], True


def _curve(x: np.ndarray, s: np.ndarray, y: np.ndarray) -> list[float]:
    """Logistic regression of y on (1, x, s) by Newton steps, slightly regularised."""
    scale = float(x.std()) or 1.0
    m = np.column_stack([np.ones(len(x)), x / scale, s])
    ridge = np.array([1e-3, 1e-2, 1e-1])
    theta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ theta, -30, 30)))
        h = (m * (p * (1 - p))[:, None]).T @ m + np.diag(ridge)
        step = np.linalg.solve(h, m.T @ (p - y) + ridge * theta)
        theta -= step
        if abs(step).max() < 1e-8:
            break
    return [float(theta[0]), float(theta[1] / scale), float(theta[2])]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_DOCS, seed: int = 2) -> Model:
    """Learns from the rows that aren't held out."""
    known = (pick(labels, "doc_id", label).filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
             .filter(~held_out("doc_id")).groupBy("doc_id").agg(F.min(label).cast("int").alias("y")))
    shares = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    good_share = shares.get(1, 0) / max(1, sum(shares.values())) if shares else 0.5
    prior = math.log(max(good_share, 1e-6) / max(1 - good_share, 1e-6))
    texts = labelled_sample(docs, known, most, seed)
    half = F.pmod(F.xxhash64(F.lit(seed + 100), F.col("doc_id").cast("string"), F.col("text")), F.lit(2))

    def cut_up(batches):
        for b in slices(batches, "text"):
            ys, pieces = [], []
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
                data = text.encode()
                n = -(-len(data) // PIECE)
                for i in sorted({int(j * n / PIECES) for j in range(PIECES)}) if n > PIECES else range(n):
                    ys.append(y)
                    pieces.append(data[i * PIECE:(i + 1) * PIECE])
            yield pa.RecordBatch.from_pydict({"y": pa.array(ys, pa.int32()), "piece": pa.array(pieces, pa.binary())})

    taught = texts.filter(half == 0).select("text", "y").mapInArrow(cut_up, "y int, piece binary").toArrow()
    y, piece = taught.column("y").to_pylist(), taught.column("piece").to_pylist()
    order = sorted(range(len(piece)), key=lambda i: piece[i])  # the same dictionaries in every run
    good, raw_good = _dictionary([piece[i] for i in order if y[i] == 1])
    bad, raw_bad = _dictionary([piece[i] for i in order if y[i] == 0])
    model = Model(good, bad, (raw_good, raw_bad), prior, 0.0)
    if not good or not bad:
        return model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        sizes = _Sizes(shared.value)
        for b in slices(batches, "text"):
            texts = b.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([sizes.evidence(t) for t in texts], pa.float64()),
                 pa.array([shortness(len(t.encode())) for t in texts], pa.float64()), b.column("y")], ["x", "s", "y"])

    seen = texts.filter(half == 1).select("text", "y").mapInArrow(measure, "x double, s double, y int").toArrow()
    x, short, y = (seen.column(c).to_numpy() for c in ("x", "s", "y"))
    if len(set(y.tolist())) < 2:
        return model
    order = np.lexsort((y, short, x))
    a, b, c = _curve(x[order], short[order], y[order].astype(float))
    # the sample's classes are level; their true shares move the curve
    mine = float(y.mean())
    return Model(good, bad, (raw_good, raw_bad), a + prior - math.log(mine / (1 - mine)), b, c)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, evidence, score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY bytes

    def run(batches):
        sizes = _Sizes(shared.value)
        for b in slices(batches, "text"):
            texts = [t or "" for t in b.column("text").to_pylist()]
            x = [sizes.evidence(t) for t in texts]
            scores = [sizes.score(v, len(t.encode())) for v, t in zip(x, texts)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(x, pa.float64()), pa.array(scores, pa.float64())],
                ["doc_id", "evidence", "score"])

    rows = pick(docs, "doc_id", "text").selectExpr("cast(doc_id as long) doc_id", "text")
    return rows.mapInArrow(run, "doc_id long, evidence double, score double")
