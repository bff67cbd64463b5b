"""Bounded training samples, and the classifiers' scores against plain code."""

import math
import re

import numpy as np
import pytest

from mixtrace.llm import neighbours, quality, toxicity
from mixtrace.llm.common import labelled_sample

SF001 = "/root/testdata/sf0.001"


def test_a_sample_is_bounded_by_rows(spark):
    """One labelled id held by most rows; repeated rows; rows without id or text."""
    rows = [(1, f"text {i}") for i in range(4000)] + [(1, "again")] * 2000
    rows += [(i, f"other {i}") for i in range(2, 12)] + [(2, "other 2"), (3, None), (None, "x")]
    known = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 0), (99, 0)], "doc_id long, y int")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(r) for r in labelled_sample(docs, known, 40, 3).collect()]
    assert 10 <= sum(y for *_, y in got) <= 90 and len(set(got)) == len(got)
    assert sorted(r for r in got if r[2] == 0) == [(2, "other 2", 0), (3, "other 3", 0), (4, "other 4", 0)]
    assert sorted(got) == sorted(map(tuple, labelled_sample(docs.repartition(2), known, 40, 3).collect()))
    assert labelled_sample(docs, known.limit(0), 40, 3).count() == 0 == labelled_sample(docs.limit(0), known, 40, 3).count()


@pytest.mark.parametrize("op,label", [(quality, "quality"), (toxicity, "toxic")])
def test_one_id_with_many_rows_does_not_flood_the_fit(spark, op, label):
    docs, labels = (spark.read.parquet(f"{SF001}/{t}.parquet") for t in ("documents", "labels"))
    many = spark.range(3000).selectExpr("0L doc_id", "concat('word', id, ' and more') text")
    model = op.fit(docs.select("doc_id", "text").unionByName(many), labels, most=30)
    assert op.score(docs, model).count() == docs.count()


def test_quality_equals_plain_compression(spark):
    import zstandard as z

    docs, labels = (spark.read.parquet(f"{SF001}/{t}.parquet") for t in ("documents", "labels"))
    m = quality.fit(docs, labels)
    got = {r.doc_id: (r.evidence, r.score) for r in quality.score(docs, m).collect()}

    def size(piece, data, raw):
        kind = z.DICT_TYPE_RAWCONTENT if raw else z.DICT_TYPE_FULLDICT
        c = z.ZstdCompressor(level=quality.LEVEL, dict_data=z.ZstdCompressionDict(data, dict_type=kind),
                             write_checksum=False, write_content_size=False, write_dict_id=False)
        return len(c.compress(piece))

    for r in docs.collect():
        raw = (r.text or "").encode()
        pieces = [raw[i:i + quality.PIECE] for i in range(0, len(raw), quality.PIECE)]
        x = sum(size(p, m.bad, m.raw[1]) - size(p, m.good, m.raw[0]) for p in pieces) / len(raw) if raw else 0.0
        # a dictionary digested for many texts may choose other matches than one used once
        assert got[r.doc_id][0] == pytest.approx(x, abs=0.02)
        short = 128 / (128 + len(raw))
        assert got[r.doc_id][1] == pytest.approx(1 / (1 + math.exp(-(m.a + m.b * got[r.doc_id][0] + m.c * short))), abs=1e-9)


def test_severity_equals_plain_sum(spark):
    docs, labels = (spark.read.parquet(f"{SF001}/{t}.parquet") for t in ("documents", "labels"))
    m = toxicity.fit(docs, labels)
    word = re.compile(r"[^\W\d_]+")
    got = {r.doc_id: r for r in toxicity.score(docs, m).collect()}
    seen = 0
    for r in docs.collect():
        if r.text is None or not r.text.isascii():
            continue
        z = sum(m.weights.get(t, 0.0) for t in set(word.findall(r.text.lower())))
        above = [1 / (1 + math.exp(c - z)) for c in m.thresholds]
        assert got[r.doc_id].severity == pytest.approx(sum(above)) and got[r.doc_id].score == pytest.approx(above[0])
        shares = -np.diff([1.0, *above, 0.0])
        assert shares[got[r.doc_id].grade] == pytest.approx(max(shares))
        seen += 1
    assert seen > 20 and m.thresholds[0] < m.thresholds[1]


def test_all_significant_terms_enter(spark):
    """More telling terms than any fixed number of old would have let in."""
    bad = [f"bad{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}" for i in range(2600)]
    bad = [b.replace("bad", "zq") for b in bad]
    rows = [(i, " ".join(bad) if i % 2 else "calm words only") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    assert len(set(bad) & set(toxicity.fit(docs, labels).weights)) == len(set(bad)) == 2600


def test_neighbours_of_repeated_ids(spark):
    """Rows that share an id are sampled each by itself and all are found."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(900, 8))
    rows = [(7 if i < 400 else i, v.tolist()) for i, v in enumerate(x)]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5, sample=50, probes=64).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r.score)
    ids = np.array([i for i, _ in rows])
    hits = 0
    for q, found in by.items():
        s = np.sort((x * x[q]).sum(axis=1)[ids != q])[::-1][:5]
        hits += sum(f >= s[-1] - 1e-12 for f in found)
        assert len(found) == 5
    assert set(by) == set(range(400, 900, 20)) and hits >= 0.8 * 5 * len(by)
