"""Operators 11 to 13 against brute force and on edge cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixtrace.llm import alignment, decontamination, lexical, registry

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ITEMS = "item_id long, text string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall((text or "").translate(LOW))


def prose(rng, n, words=("alpha", "Beta", "gamma,", "ÉTÉ", "x1", "the", "the", "of", "日本", "Z")):
    return " ".join(rng.choice(words) + str(rng.randrange(9)) * (rng.random() < .5) for _ in range(n))


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(11)
    items = [(i, prose(rng, rng.randrange(12, 40))) for i in range(12)]
    items += [(12, "Short one, É"), (13, None), (14, ""), (15, "?!"), (3, items[3][1]), (4, prose(rng, 20)),
              (16, items[0][1]), (17, " ".join(["same"] * 25)), (None, prose(rng, 15))]
    texts = [prose(rng, rng.randrange(1, 200)) for _ in range(60)]
    for i in (0, 3, 5):
        body = items[i][1]
        texts += [prose(rng, 30) + " -- " + body.upper().replace("É", "é") + "; " + prose(rng, 30), body, body + " " + body]
        texts += ["pre " + " ".join(body.split()[2:14])]
    texts += ["a short ONE,é!", "short one", None, "", " \n", "same " * 30, "same " * 9, prose(rng, 40_000), texts[0], texts[0]]
    rows = [(7 * i, t, "en", "s", 0) for i, t in enumerate(texts)]
    rows += [(None, texts[61], None, None, None), (None, texts[61], None, None, None), (0, texts[62], "de", "s", 1),
             (0, texts[0], "en", "s", 0)]
    rng.shuffle(rows)
    return rows, items


@pytest.fixture(scope="module")
def docs(spark, tables):
    return spark.createDataFrame(tables[0], DOCS).repartition(3)


@pytest.fixture(scope="module")
def items(spark, tables):
    return spark.createDataFrame(tables[1], ITEMS).repartition(2)


def clashing(df):
    return df.withColumn("key", F.lit("x")).withColumn("Text_", F.lit(1)).withColumn("_w", F.lit(2)).withColumn("h", F.lit(3))


def brute_search(rows, items, k=10):
    docs = [(d, Counter(split(t)), len(split(t))) for d, t, *_ in rows]
    docs = [x for x in docs if x[2]]
    n, total = len(docs), sum(x[2] for x in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    queries = defaultdict(list)
    for i, t in set(items):
        queries[i] += split(t)
    out = []
    for i, q in queries.items():
        scored = []
        for d, c, size in docs:
            m = 100 - 75 + (75 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in q if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [1 << 20, 700])
def test_search_equals_brute_force(docs, items, tables, block_bytes, monkeypatch):
    monkeypatch.setattr(lexical, "HEAD", 20)
    monkeypatch.setattr(lexical, "BUCKET_LEAST", 4)
    got = lexical.search(clashing(docs), clashing(items), block_bytes=block_bytes).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_search(*tables)


def test_search_prunes_and_keeps_ties(spark):
    rng = random.Random(5)
    texts = [prose(rng, 30) for _ in range(3000)] + ["needle in hay"] * 30
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    items = [(1, "needle hay"), (2, prose(rng, 5))]
    got = lexical.search(docs, spark.createDataFrame(items, ITEMS)).collect()
    want = brute_search([(i, t) for i, t in enumerate(texts)], items)
    assert sorted([tuple(r) for r in got], key=str) == want
    assert [r.doc_id for r in sorted(got, key=lambda r: r["rank"]) if r.item_id == 1] == list(range(3000, 3010))


def test_bounds_leave_out_no_answer():
    rng = np.random.default_rng(0)
    w = rng.integers(1, 9000, 40)
    for _ in range(50):
        n = 300
        t = [np.sort(rng.choice(40, rng.integers(1, 12), replace=False)) for _ in range(n)]
        v = [rng.integers(1, 10**6, len(x)) for x in t]
        order = np.argsort([-math.sqrt((x.astype(float) ** 2).sum()) for x in v], kind="stable")
        t, v = [t[i] for i in order], [v[i] for i in order]
        edge = np.append(0, np.cumsum([len(x) for x in t]))
        b = lexical.Bucket(np.arange(n), np.zeros(n, bool), np.array([math.sqrt((x.astype(float) ** 2).sum()) for x in v]),
                           edge, np.concatenate(t), np.concatenate(v))
        q = lexical.Query({int(x): int(rng.integers(1, 3)) for x in rng.choice(40, 6, replace=False)}, w)
        dense = np.zeros(40, np.int64)
        exact = b.scores(q, np.arange(n), dense)
        assert not dense.any()
        weight = dict(zip(q.t.tolist(), q.v.tolist()))
        assert exact.tolist() == [sum(weight.get(int(i), 0) * int(x) for i, x in zip(ti, vi)) for ti, vi in zip(t, v)]
        floor = int(np.sort(exact)[-10])
        assert set(np.flatnonzero(exact >= max(floor, 1))) <= set(b.survivors(q, max(floor, 1)).tolist())


def test_search_of_empty_tables(spark, docs, items):
    none_docs, none_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert lexical.search(none_docs, items).count() == 0
    assert lexical.search(docs, none_items).schema == lexical.search(none_docs, none_items).schema


def brute_windows(rows, items, size=10):
    windows = defaultdict(set)
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - size + 1)) if w else []:
            windows[tuple(w[k:k + size])].add("" if i is None else str(i))
    out = []
    for d, t, *_ in rows:
        w = split(t)
        hit, names = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                own = windows.get(tuple(w[k:k + n]))
                if own:
                    hit.update(range(k, k + n))
                    names |= own
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [{}, {"block_rows": 40}, {"block_bytes": 2000}])
def test_decontamination_equals_brute_force(docs, items, tables, block):
    got = decontamination.report(clashing(docs), clashing(items), **block).drop("items").collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_windows(*tables)


def test_decontaminated_documents(docs, items, tables):
    rows, its = tables
    kept = decontamination.remove(clashing(docs), items, how="documents")
    clean = sorted((str(d), n) for d, n, hit, *_ in brute_windows(rows, its) if not hit)
    assert sorted((str(r.doc_id), len(split(r.text))) for r in kept.collect()) == clean
    assert kept.columns == clashing(docs).columns
    cut = decontamination.remove(clashing(docs), items)
    assert cut.columns == clashing(docs).columns and cut.count() == len(rows)
    left = sorted((str(d), n - hit) for d, n, hit, *_ in brute_windows(rows, its))
    assert sorted((str(r.doc_id), len(split(r.text))) for r in cut.collect()) == left
    untouched = {d for d, _, hit, *_ in brute_windows(rows, its) if not hit}
    texts = {d: t for d, t, *_ in rows}
    assert all(r.text == texts[r.doc_id] for r in cut.collect() if r.doc_id in untouched - {0, None})
    with pytest.raises(ValueError):
        decontamination.remove(docs, items, how="other")


def test_cut_spans_keep_the_rest_as_it_was(spark):
    docs = spark.createDataFrame([(1, "«Intro: A b, c! D — e»"), (2, "b C"), (3, "nothing")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "b c")], ITEMS)
    got = {r.doc_id: r.text for r in decontamination.remove(docs, items).collect()}
    assert got == {1: "«Intro: A D — e»", 2: "", 3: "nothing"}


def test_decontamination_of_empty_tables(spark, docs, items, tables):
    none_docs, none_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert decontamination.report(none_docs, items).count() == 0
    got = decontamination.report(docs, none_items).collect()
    assert len(got) == len(tables[0]) and not any(r.contaminated for r in got)
    assert decontamination.remove(docs, none_items, how="documents").count() == len(tables[0])


def paths():
    return registry.tokenizer("byte_bpe_50k.json"), registry.tokenizer("piece_bpe_32k.model")


def align_texts():
    rng = random.Random(1)
    odd = " ▁ab\n\té😀<s>\0\xa0​'s!1\r\x85\x1c  "
    texts = ["".join(rng.choice(odd) for _ in range(rng.randrange(14))) for _ in range(600)]
    return texts + ["<|endoftext|> a", "日本語 テキスト", "", None, "x" * 500, prose(rng, 300), "Größe der Häuser, it's 12:30.", "same", "same"]


def brute_align(pair, texts):
    rows, count = [], Counter()
    for t in texts:
        raw = " " + (t or "")
        ids = [pair.a.lib.encode(raw, add_special_tokens=False).ids, pair.model.sp.encode(t or "")]
        spelt = [[table[i] for i in x] for table, x in zip(pair.bytes, ids)]
        if not t or any(b"".join(x) != raw.encode() for x in spelt):
            ids, spelt = [[], []], [[], []]
        spans = []
        for x in spelt:
            edge = np.append(0, np.cumsum([len(b) for b in x])).tolist()
            spans.append(list(zip(edge, edge[1:])))
        links = [(a, b) for a, (s, e) in zip(ids[0], spans[0]) for b, (u, v) in zip(ids[1], spans[1]) if s < v and u < e]
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = [[[str(i) for i, (s, e) in zip(ids[k], spans[k]) if low <= s < high] for k in (0, 1)]
                  for low, high in zip([0, *cuts], cuts)]
        text = ";".join("|".join(",".join(x) for x in g) for g in groups)
        rows.append((len(ids[0]), len(ids[1]), len(cuts), links, text))
        count.update(links)
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(a, b, c, len(x), sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x), g) for a, b, c, x, g in rows]


@pytest.mark.parametrize("piece,broadcast", [(64, 10**6), (7, 0)])
def test_alignment_equals_brute_force(spark, piece, broadcast):
    texts = align_texts()
    docs = clashing(spark.createDataFrame([(i if i % 5 else None, t, str(i)) for i, t in enumerate(texts)],
                                          "doc_id long, text string, n string").repartition(3))
    want = brute_align(alignment.Pair(*paths()), texts)
    key = lambda d, x: (d, *x[:6], hashlib.sha256(x[6].encode()).hexdigest() if x[6] else "")
    expect = [key(i if i % 5 else None, x) for i, x in enumerate(want)]
    got = alignment.score(docs, *paths(), piece=piece, broadcast_pairs=broadcast).collect()
    assert sorted([tuple(r) for r in got], key=str) == sorted(expect, key=str)
    full = alignment.align(docs, *paths(), piece=piece, texts=True)
    assert sorted(r.groups for r in full.collect()) == sorted(x[6] for x in want)
    assert alignment.score(docs.limit(0), *paths()).count() == 0


def test_merge_pieces_are_equal_and_independent():
    rng = np.random.default_rng(2)
    for _ in range(200):
        top = int(rng.integers(1, 400))
        a, b = (np.unique(np.append(rng.integers(1, top + 1, rng.integers(0, 200)), top)) for _ in range(2))
        whole = alignment.merge_piece(a, b, (0, 0), (len(a), len(b)))
        for piece in (1, 2, 5, 64):
            border = alignment.diagonals(a, b, piece)
            assert all(0 <= x[0] <= y[0] and x[1] <= y[1] and sum(y) - sum(x) <= piece + 1 for x, y in zip(border, border[1:]))
            parts = [alignment.merge_piece(a, b, x, y) for x, y in zip(border, border[1:])]
            for k in range(4):
                assert np.concatenate([p[k] for p in parts]).tolist() == whole[k].tolist()


def test_alignment_of_a_text_longer_than_its_slice(spark):
    text = prose(random.Random(8), 250_000)
    assert len(text) > 1 << 20
    r = alignment.score(spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string"), *paths()).filter("doc_id = 1").first()
    pair = alignment.Pair(*paths())
    ids = [pair.a.lib.encode(" " + text, add_special_tokens=False).ids, pair.model.sp.encode(text)]
    ends = [set(np.cumsum(s[np.array(x)]).tolist()) for s, x in zip(pair.size, ids)]
    assert (r.n_a, r.n_b, r.n_groups) == (len(ids[0]), len(ids[1]), len(ends[0] & ends[1]))
    assert r.n_links == len(ends[0] | ends[1])
