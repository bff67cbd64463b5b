"""Operator 1: language ID by script ranges and Viterbi over words.

A word is a run of letters (and marks after one), lower-cased.  Its script
comes from the Unicode range of its first letter; the languages that use that
script in the training text are its candidates.  Its score per candidate is
the log likelihood of its byte 2- to 4-grams (hashed into a fixed table, with
word edges), normalised over the candidates and bounded below, so that no
single word outweighs a sentence.  Viterbi finds the best labelling of a
document's words where every change of language costs ``SWITCH``; runs of one
label are the spans.  Documents are labelled in lock step, word by word, so the
work is a few array operations per step for a whole slice.

Training counts n-grams of a bounded sample: about ``MOST_DOCS`` documents of
each language (chosen by a hash; all, if there are fewer).  The model is a
table of ``BUCKETS`` x languages, whatever the corpus.

Result: the language of most letters' words, and as score the share of all
words labelled with it (words in a script of no learned language count as
unlabelled).  Defined cases: NULL text, or text without letters: ``und``, score
0, no span; letters of unknown scripts only: the language with most training
documents, score 0; ties go to the language first in code point order; with no
training text every prediction is ``und``; empty tables give empty results;
extra columns are ignored (``keep``: kept).  Whole texts are labelled.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, pick, positional, sample_per_class, slices

BUCKETS = 1 << 16
NGRAMS = (2, 3, 4)
MOST_DOCS = 4000
SWITCH = 8.0
FLOOR = -6.0
#: Share of a language's words that makes a script one of its own.
SCRIPT_SHARE = 0.02
#: Words kept per worker.
CACHED_WORDS = 300_000
#: Below this share a document is rejected by ``keep``.
LEAST = 0.3

#: First code points of script ranges (Unicode blocks), and the script.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"),
    (0x0A80, "gujarati"), (0x0B00, "other"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"),
    (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x2DE0, "cyrillic"), (0x2E00, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x31F0, "kana"),
    (0x3200, "other"), (0x3400, "han"), (0x4DC0, "other"), (0x4E00, "han"), (0xA000, "other"),
    (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"),
    (0xD800, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"), (0xFB1D, "hebrew"),
    (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF65, "kana"),
    (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x32000, "other"),
)
_STARTS = [a for a, _ in SCRIPTS]
_NAMES = sorted({s for _, s in SCRIPTS})
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def script(word: str) -> int:
    return _NAMES.index(SCRIPTS[bisect.bisect_right(_STARTS, ord(word[0])) - 1][1])


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every byte n-gram of every word, word edges included."""
    data = ("\0" + "\0".join(words) + "\0").encode()
    raw = np.frombuffer(data, np.uint8)
    edge = raw == 0
    number = np.cumsum(edge) - 1  # a word's own number; an edge has that of the word after it
    owner, bucket = [], []
    for n in NGRAMS:
        if len(raw) < n:
            continue
        h = np.full(len(raw) - n + 1, n, np.uint32)
        inside = np.zeros(len(h), bool)
        for j in range(n):
            h = (h ^ raw[j:len(raw) - n + 1 + j]) * np.uint32(0x01000193)
            if 0 < j < n - 1:
                inside |= edge[j:len(raw) - n + 1 + j]
        if n == 2:  # an edge pair would be an empty word
            inside |= edge[:-1] & edge[1:]
        at = np.flatnonzero(~inside)
        h = h[at]
        owner.append(number[at])
        bucket.append(((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.int64) % BUCKETS)
    return np.concatenate(owner), np.concatenate(bucket)


@dataclass
class Model:
    """langs in code point order; logp[bucket, lang]; allowed[script, lang]; the most frequent language."""

    langs: list[str]
    logp: np.ndarray
    allowed: np.ndarray
    common: int

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bounded log posteriors, (words, langs), and whether each word has
        evidence: its script is that of a learned language."""
        owner, bucket = features(words)
        s = np.zeros((len(words), len(self.langs)))
        for k in range(len(self.langs)):
            s[:, k] = np.bincount(owner, self.logp[bucket, k], len(words))
        s *= 0.5  # overlapping n-grams repeat their evidence
        scripts = np.array([script(w) for w in words], np.int64)
        known = self.allowed[scripts]
        s = np.where(known, s, -1e9)
        s -= s.max(axis=1, keepdims=True)
        s -= np.log(np.exp(s).sum(axis=1, keepdims=True))
        s = np.maximum(s, FLOOR)
        evidence = known.any(axis=1)
        s[~evidence] = 0.0
        return s.astype(np.float32), evidence


def fit(rows: DataFrame, most: int = MOST_DOCS, seed: int = 1) -> Model:
    """rows: doc_id, text, lang.  Rows with NULL text or lang teach nothing."""
    rows = pick(rows, "doc_id", "text", "lang").filter("text is not null and lang is not null")
    sample = sample_per_class(rows, "doc_id", "lang", most, seed)

    def count(batches):
        from collections import Counter

        held: dict[str, Counter] = {}

        def table():
            for lang, c in held.items():
                words = list(c)
                weight = np.array([c[w] for w in words], np.float64)
                owner, bucket = features(words)
                n = np.bincount(bucket, weight[owner], BUCKETS)
                by_script = np.bincount([script(w) for w in words], weight, len(_NAMES))
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_pydict({
                    "lang": [lang] * (len(at) + len(_NAMES)), "feature": np.append(at, BUCKETS + np.arange(len(_NAMES))),
                    "n": np.append(n[at], by_script).astype(np.int64)})

        for b in batches:
            for s in slices([b], "text"):
                for text, lang in zip(s.column("text").to_pylist(), s.column("lang").to_pylist()):
                    held.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, held.values())) > CACHED_WORDS:
                yield from table()
                held.clear()
        yield from table()

    counts = (sample.select("text", "lang").mapInArrow(count, "lang string, feature long, n long")
              .groupBy("lang", "feature").agg(F.sum("n").alias("n")).filter("n > 0").toArrow())
    lang = counts.column("lang").to_pylist()
    langs = sorted(set(lang))
    at = np.array([langs.index(x) for x in lang], np.int64)
    feature, n = counts.column("feature").to_numpy(), counts.column("n").to_numpy()
    full = np.zeros((BUCKETS + len(_NAMES), len(langs)))
    full[feature, at] = n
    grams, scripts = full[:BUCKETS] + 0.3, full[BUCKETS:]
    totals = scripts.sum(axis=0)
    docs = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    common = max(range(len(langs)), key=lambda i: (docs[langs[i]], -i)) if langs else -1
    return Model(langs, np.log(grams / grams.sum(axis=0)).astype(np.float32),
                 scripts >= np.maximum(SCRIPT_SHARE * totals, 1), common)


def viterbi(scores: np.ndarray, edges: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best labels of documents' words, laid end to end; document i ends at edges[i]."""
    n, langs = scores.shape
    out = np.zeros(n, np.int64)
    if not n:
        return out
    starts = np.append(0, edges[:-1])
    order = np.argsort(starts - edges, kind="stable")  # longest first
    start, size = starts[order], (edges - starts)[order]
    active = np.searchsorted(-size, -np.arange(size[0]), side="left")  # documents longer than t
    value = np.zeros((len(order), langs), np.float32)
    stay = np.zeros((n, langs), bool)
    best = np.zeros(n, np.uint8 if langs < 256 else np.int64)
    for t in range(int(size[0])):
        a = active[t]
        at = start[:a] + t
        v = value[:a]
        if t:
            top = v.argmax(axis=1)
            jump = (v[np.arange(a), top] - switch)[:, None]
            stay[at] = v >= jump
            best[at] = top
            np.maximum(v, jump, out=v)
            v -= jump  # keeps the values small
        v += scores[at]
    label = np.zeros(len(order), np.int64)
    for t in range(int(size[0]) - 1, -1, -1):
        a = active[t]
        new = active[t + 1] if t + 1 < size[0] else 0
        label[new:a] = value[new:a].argmax(axis=1)  # documents that end here
        at = start[:a] + t
        out[at] = label[:a]
        if t:
            label[:a] = np.where(stay[at, label[:a]], label[:a], best[at])
    return out


class _Labeller:
    """A model with its bounded word table, once per task."""

    def __init__(self, model: Model):
        claim("language", self.clear)
        self.model = model
        self.clear()

    def clear(self):
        self.at: dict[str, int] = {}
        self.table = np.zeros((0, len(self.model.langs)), np.float32)
        self.known = np.zeros(0, bool)

    def label(self, texts: list[str | None]):
        """For each text: word labels, and whether each word had evidence."""
        words = [words_of(t) if t else [] for t in texts]
        if not self.model.langs:
            return [(w, np.zeros(len(w), np.int64), np.zeros(len(w), bool)) for w in words]
        if len(self.at) > CACHED_WORDS:
            self.clear()
        new = list(set().union(*words).difference(self.at))
        if new:
            self.at.update(zip(new, range(len(self.table), len(self.table) + len(new))))
            scores, known = self.model.score(new)
            self.table, self.known = np.concatenate([self.table, scores]), np.concatenate([self.known, known])
        ids = np.fromiter((self.at[w] for x in words for w in x), np.int64)
        edges = np.cumsum([len(w) for w in words])
        labels, known = viterbi(self.table[ids], edges), self.known[ids]
        return zip(words, np.split(labels, edges[:-1]), np.split(known, edges[:-1]))


def _verdict(model: Model, labels: np.ndarray, known: np.ndarray) -> tuple[str, float]:
    if not len(labels) or not model.langs:
        return "und", 0.0
    votes = np.bincount(labels[known], minlength=len(model.langs))
    if not votes.any():
        return model.langs[model.common], 0.0
    k = int(votes.argmax())
    return model.langs[k], float(votes[k] / len(labels))


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])


def identify(docs: DataFrame, model: Model, spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score, n_spans, and with ``spans`` the spans as
    (first word, end word, language)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages
    schema = "doc_id long, lang_pred string, score double, n_spans long" + (
        ", spans array<struct<start:long,end:long,lang:string>>" if spans else "")

    def run(batches):
        m = shared.value
        labeller = _Labeller(m)
        for b in slices(batches, "text"):
            pred, score, count, runs = [], [], [], []
            for _, labels, known in labeller.label(b.column("text").to_pylist()):
                p, s = _verdict(m, labels, known)
                edge = np.flatnonzero(np.diff(labels)) + 1 if len(labels) else np.zeros(0, np.int64)
                pred.append(p)
                score.append(s)
                count.append(len(edge) + 1 if len(labels) and m.langs else 0)
                if spans:
                    at = [0, *edge.tolist(), len(labels)]
                    runs.append([{"start": i, "end": j, "lang": m.langs[labels[i]]} for i, j in zip(at, at[1:])]
                                if len(labels) and m.langs else [])
            columns = [b.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                       pa.array(count, pa.int64())] + ([pa.array(runs, pa.list_(_SPAN))] if spans else [])
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "n_spans", "spans"][:len(columns)])

    return pick(docs, "doc_id", "text").selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)


def keep(docs: DataFrame, model: Model, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` whose text has a language: its label covers at
    least ``least`` of the words.  Text without letters goes."""
    plain, at, names = positional(docs)
    text = at["text"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        labeller = _Labeller(shared.value)
        for b in slices(batches, text):
            good = []
            for _, labels, known in labeller.label(b.column(text).to_pylist()):
                lang, score = _verdict(shared.value, labels, known)
                good.append(lang != "und" and score >= least)
            yield b.filter(pa.array(good, pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*names)
