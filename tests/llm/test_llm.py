"""Operators of mixtrace.llm against brute force, round trips and edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mixtrace.llm import (chunks, language, mixing, neighbours, ordered, quality, registry, sentencepiece_codec, simhash,
                          substring, token_files, toxicity)
from mixtrace.llm.common import held_out
from mixtrace.llm.components import components

SF001 = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(60)] + ["Été,", "größe", "x.", "THE", "the"]
WS = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def fixture_rows():
    """Copies, near copies, shared passages, empty, NULL, blank, short and long texts."""
    rng = random.Random(3)
    passage, base = prose(rng, 70), prose(rng, 120)
    texts = [prose(rng, rng.randrange(1, 200)) for _ in range(25)]
    texts += [base, base, base + " tail", "head " + base, base.replace("w1 ", "W1 ")]
    texts += [prose(rng, 30) + " " + passage + " " + prose(rng, 30) for _ in range(4)]
    texts += [passage, passage[: len(passage) // 2], "", None, "  \n\t ", "one", "two words", "▁ a  b ", "日本語 テキスト", "é" * 40]
    texts += [" ".join(["same"] * 180), " ".join(["same"] * 120), prose(rng, 6000)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(3 * i, texts[j], ["en", "de", None][j % 3], ["a", "b", "c", None][j % 4], 0) for i, j in enumerate(order)]


@pytest.fixture(scope="module")
def rows():
    return fixture_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return WS.findall(t or "")


def clashing(docs):
    """Extra columns whose names differ from needed or made ones in case, or not at all."""
    return docs.withColumn("score", F.lit("x")).withColumn("fp", F.lit(1)).withColumn("_0", F.lit(2)).withColumn("p", F.lit(3))


def test_sentencepiece_equals_library_and_spans(docs, rows, empty):
    import sentencepiece

    path = registry.tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r for r in sentencepiece_codec.encode(clashing(docs), path).collect()}
    dig = {r.doc_id: r for r in sentencepiece_codec.encode_digests(docs, path).collect()}
    for i, text, *_ in rows:
        ids, raw = sp.encode(text or "", add_eos=True), (text or "").encode()
        assert got[i].ids == ids and got[i].decoded == sp.decode(ids)
        assert dig[i].n_tokens == len(ids)
        assert dig[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert dig[i].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
        assert b"".join(raw[s.start:s.end] for s in got[i].spans) == raw
    assert sentencepiece_codec.encode_ids(empty, path).count() == 0


def test_sentencepiece_fuzz():
    m = sentencepiece_codec.model(registry.tokenizer("piece_bpe_32k.model"))
    rng = random.Random(1)
    texts = ["".join(rng.choice(" ▁ab\n\té😀<s>\0\xa0​") for _ in range(rng.randrange(12))) for _ in range(3000)]
    for t, ids in zip(texts, m.ids(texts)):
        assert ids.tolist() == m.sp.encode(t, add_eos=True)


def test_compiled_character_map():
    # a one-node trie: 'A' -> 'bc'
    units = [0] * 256
    units[0] = 1 << 10  # children at offset 1
    at = 1 ^ ord("A")
    units[at] = ord("A") | 1 << 8 | (at ^ 128) << 10
    units[128] = 1 << 31
    cm = sentencepiece_codec.CharMap(np.array([len(units) * 4, *units], "<u4").tobytes() + b"bc\0")
    assert cm.longest(b"xAA", 1) == (1, b"bc") and cm.longest(b"xAA", 0) is None


def test_token_files_round_trip(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    path = registry.tokenizer("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    manifest = token_files.write(clashing(docs), path, shard_ids=2000)
    got = {r.doc_id: r for r in token_files.read(manifest).collect()}
    start = 0
    for i, text, *_ in sorted(rows):
        ids = lib.encode(text or "", add_special_tokens=False).ids + [1]
        assert (got[i].start, got[i].n_tokens) == (start, len(ids))
        assert got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert manifest.count() > 2
    assert token_files.read(token_files.write(empty, path)).count() == 0


@pytest.mark.parametrize("n,bits", [(0, 4), (1, 1), (1000, 9), (300_000, 3)])
def test_wavelet_matrix_queries(n, bits):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 1 << bits, n).astype("<u2")
    s = token_files.Shard(token_files.build(ids, bits, b"docs"))
    assert s.docs == b"docs" and (s.ids() == ids).all()
    for i in rng.integers(0, n, 20).tolist() if n else []:
        c = int(ids[i])
        at = np.flatnonzero(ids == c)
        assert s.access(i) == c and s.rank(c, i) == (at < i).sum() and s.count(c) == len(at)
        assert s.select(c, int((at < i).sum())) == i
    assert s.count(1 << bits) == 0
    with pytest.raises(IndexError):
        s.select(0, s.count(0))


def test_token_encoder_fuzz():
    e = token_files.encoder(registry.tokenizer("word_bpe_49k.json"), 1)
    rng = random.Random(2)
    parts = ["a", "B", "É", "ß", "İ", "́", " ", "\n", "\xa0", "\x85", "1", "²", "'s", "'T", ".", "!!", "<|endoftext|>", "Ω", "漢", "\0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(4000)]
    for t, b in zip(texts, e.encode(pa.array(texts)).to_pylist()):
        assert np.frombuffer(b, e.dtype).tolist() == e.lib.encode(t, add_special_tokens=False).ids + [1]


def test_substring_equals_brute_force(docs, rows, empty):
    seen = {}
    for i, t, *_ in sorted(rows):
        w = words(t)
        for p in range(len(w) - 49):
            seen.setdefault(tuple(w[p:p + 50]), i)
    got = {r.doc_id: r for r in substring.digests(clashing(docs)).collect()}
    texts = {r.doc_id: r.text for r in substring.apply(docs).collect()}
    removed = 0
    for i, t, *_ in rows:
        w = words(t)
        keep = [True] * len(w)
        for p in range(len(w) - 49):
            if seen[tuple(w[p:p + 50])] < i:
                keep[p:p + 50] = [False] * 50
        kept = [x for x, k in zip(w, keep) if k]
        removed += len(w) - len(kept)
        assert (got[i].n_words, got[i].n_removed) == (len(w), len(w) - len(kept))
        assert got[i].kept_sha256 == hashlib.sha256(" ".join(kept).encode()).hexdigest()
        assert words(texts[i]) == kept and (len(kept) < len(w) or texts[i] == t)
    assert removed > 300
    assert substring.digests(empty).count() == 0 and substring.apply(empty).columns == empty.columns


def test_substring_rows_sharing_an_id(spark):
    w = [f"v{i}" for i in range(60)]
    rows = [(5, " ".join(w)), (5, " ".join(w[:59])), (5, " ".join(w)), (7, " ".join(w)), (None, " ".join(w))]
    got = sorted((r.doc_id or -1, r.n_removed) for r in substring.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, 0), (5, 0), (5, 0), (5, 0), (7, 60)]


def test_substring_paths_differ_by_either_hash(docs, monkeypatch):
    want = sorted(substring.digests(docs).collect())
    made = substring._occurrences
    monkeypatch.setattr(substring, "_occurrences", lambda *a: made(*a).withColumn("s1", F.lit(0).cast("long")))
    assert sorted(substring.digests(docs).collect()) == want


def brute_fingerprint(t):
    import xxhash

    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(w[i:i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(docs, rows, empty):
    fp = {i: brute_fingerprint(t) for i, t, *_ in rows}
    label = {i: i for i in fp}
    for _ in fp:
        for i in fp:
            label[i] = min(label[j] for j in fp if (fp[i] ^ fp[j]).bit_count() <= 2)
    got = {r.doc_id: r for r in simhash.near_dedup(clashing(docs)).collect()}
    assert {i: r.fp % (1 << 64) for i, r in got.items()} == fp
    assert {i: r.component_id for i, r in got.items()} == label
    assert len(set(label.values())) < len(label)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(label.values())
    assert simhash.near_dedup(empty).count() == 0


def test_keep_first_keeps_one_row_of_each_component(spark):
    rng = random.Random(8)
    a, b, *clean = [" ".join(rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(80)) for _ in range(8)]
    rows = [(None, t, "s") for t in clean] + [(None, clean[0], "s"), (7, a, "s"), (9, a, "s"), (3, b, "s"), (7, b, "s"), (3, b, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("m", F.create_map(F.lit("x"), F.lit(1)))
    kept = simhash.keep_first(docs.repartition(4))
    assert kept.columns == docs.columns
    want = [("", t) for t in clean] + [(7, a), (3, b)]
    assert sorted((str(r.doc_id or ""), r.text) for r in kept.collect()) == sorted((str(i), t) for i, t in want)
    # copies whose ids are all the same: one stays, the same however rows are dealt
    same = spark.createDataFrame([(5, a, s) for s in "pqrs"], "doc_id long, text string, source string")
    assert len({tuple(simhash.keep_first(same.repartition(n)).collect()) for n in (1, 3)}) == 1


def test_covering_anchors_miss_no_link(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        for d in (1, 2, 2, 3):
            x = b
            for k in rng.sample(range(64), d):
                x ^= 1 << k
            fps.add(x)
    fps = sorted(fps)
    signed = {x - (1 << 64) if x >> 63 else x: x for x in fps}
    got = {tuple(sorted((signed[r.a], signed[r.b]))) for r in simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()}
    assert got == {(a, b) for i, a in enumerate(fps) for b in fps[i + 1:] if (a ^ b).bit_count() <= 2}


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, 1000 + i) for i in range(50)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {1: 1} | {1000 + i: 1 for i in range(50)}


def naive_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    pool, live, out = float(sum(sizes.values())), set(names), {}
    while True:
        total = sum(w[s] for s in live)
        over = [s for s in live if pool * w[s] / total > most * sizes[s]] if live else []
        if not over:
            return out | {s: pool * w[s] / total for s in live}
        for s in over:
            out[s] = float(most * sizes[s])
            live.discard(s)
        pool = sum(sizes.values()) - sum(out.values())


def test_mixing(spark, docs, rows, empty):
    got = mixing.plan(clashing(docs)).collect()
    sizes = {}
    for i, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    want = naive_targets(sizes)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.copies <= 3
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
    largest = {s: max(len(words(t)) for _, t, _, x, _ in rows if x == s) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= 1.5 * largest[s] for s in sizes)
    copies = {r.doc_id: r.copies for r in got}
    out = mixing.mix(docs)
    counted = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert out.columns == docs.columns and counted == {i: c for i, c in copies.items() if c}
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0
    # repeated rows, and a source without words
    twice = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, "c", None), (4, "", "z")], "doc_id long, text string, source string")
    assert all(r.target == 0 and r.copies == 0 for r in mixing.plan(twice).filter("source = 'z'").collect())
    assert mixing.mix(twice).count() == mixing.plan(twice).agg(F.sum("copies")).first()[0]


def test_mixed_rows_without_ids_keep_their_sizes(spark):
    rows = [(None, f"w{i}", "b", i) for i in range(20)] + [(None, f"v{i} " * 1000, "b", i) for i in range(20)]
    rows += [(i, "x " * 1000, "a", i) for i in range(15)] + [(None, "y " * 500, "b", i) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").coalesce(1)
    planned = {}
    for r in mixing.plan(docs).collect():
        planned[r.source, r.size] = planned.get((r.source, r.size), 0) + r.copies
    got, again = ([(r.source, r.text, r.n) for r in mixing.mix(d).collect()] for d in (docs, docs.repartition(3)))
    counted = {}
    for source, text, _ in got:
        counted[source, len(words(text))] = counted.get((source, len(words(text))), 0) + 1
    assert counted == {k: n for k, n in planned.items() if n} and sorted(got) == sorted(again)


def test_targets_are_the_resharing(spark):
    rng = random.Random(9)
    for _ in range(6):
        sizes = {f"s{i:02d}": rng.choice([0, 1, 5, 100, 3000]) for i in range(rng.randrange(1, 9))}
        if not sum(sizes.values()):
            continue
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = naive_targets(sizes)
        assert all(got[s] == pytest.approx(want[s]) for s in sizes)


def test_viterbi_equals_brute_force():
    from itertools import product

    rng = np.random.default_rng(0)
    sizes = [0, 1, 4, 0, 5, 3]
    scores = rng.normal(size=(sum(sizes), 3)).astype(np.float32)
    got, at = language.viterbi(scores, np.cumsum(sizes), 0.7), 0
    for n in sizes:
        s = scores[at:at + n]
        best = max(product(range(3), repeat=n), key=lambda p: sum(s[i, k] for i, k in enumerate(p)) - 0.7 * sum(a != b for a, b in zip(p, p[1:])))
        assert tuple(got[at:at + n]) == best
        at += n


def test_language(spark, empty):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    model = language.fit(docs.filter(~held_out("doc_id")))
    out = language.identify(clashing(docs), model).join(docs.select("doc_id", "lang"), "doc_id").filter(held_out("doc_id"))
    n, right = out.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert right >= 0.95 * n
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 ?!"), (4, "日本語"), (5, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in language.identify(odd, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[4].lang_pred in model.langs and got[4].score == 0
    assert language.keep(odd, model).count() == 0
    none = language.fit(empty)
    assert {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"}
    text = {r.lang: r.text for r in docs.filter("lang in ('en', 'de') and n_chars > 500").collect()}
    both = spark.createDataFrame([(1, text["en"] + "\n" + text["de"])], "doc_id long, text string")
    spans = language.identify(both, model).first().spans
    assert [s.lang for s in spans][0] == "en" and [s.lang for s in spans][-1] == "de"


def test_languages_of_rows_without_ids_are_learned(spark):
    """The bound of the sample takes rows of any id: NULL, shared, or their own."""
    def rows(lang, words, ids):
        return [(i, " ".join(words[(k + j) % len(words)] for j in range(8)), lang) for k, i in enumerate(ids)]
    data = rows("en", ["the", "cat", "sat", "upon", "mats"], range(300)) + rows("de", ["der", "hund", "lief", "über", "straßen"], [None] * 300)
    data += rows("fr", ["le", "chien", "dort", "sous", "la", "table"], [7] * 300)
    docs = spark.createDataFrame([(i, f"{t} {k % 97}", x) for k, (i, t, x) in enumerate(data)], "doc_id long, text string, lang string")
    model = language.fit(docs, most=30)
    got = {r.lang: r.ok for r in language.identify(docs.withColumn("doc_id", F.monotonically_increasing_id()), model, spans=False)
           .join(docs.withColumn("doc_id", F.monotonically_increasing_id()).select("doc_id", "lang"), "doc_id")
           .groupBy("lang").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("ok")).collect()}
    assert set(got) == {"en", "de", "fr"} and min(got.values()) > 0.95


def test_one_language(spark):
    rows = [(i, "plain words of one language " + prose(random.Random(i), 20), "en") for i in range(8)]
    docs = spark.createDataFrame(rows + [(8, "日本語", None), (9, "12", None)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert model.langs == ["en"] and all(got[i].lang_pred == "en" and got[i].score == 1 for i in range(8))
    assert got[8].score == 0 and got[9].lang_pred == "und"
    assert {r.doc_id for r in language.keep(docs, model).collect()} == set(range(8))


def auc(scores, y):
    s, y = np.asarray(scores), np.asarray(y)
    return np.mean((s[y == 1][:, None] > s[y == 0][None, :]) + 0.5 * (s[y == 1][:, None] == s[y == 0][None, :]))


@pytest.mark.parametrize("op,label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers(spark, empty, op, label):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = op.score(clashing(docs), op.fit(docs, labels)).join(labels, "doc_id").filter(held_out("doc_id")).collect()
    assert auc([r.score for r in out], [r[label] for r in out]) > 0.8
    assert all(0 <= r.score <= 1 for r in out)
    odd = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "x")], "doc_id long, text string")
    none = op.fit(docs, spark.createDataFrame([], f"doc_id long, {label} int"))
    assert op.score(odd, none).count() == 4
    assert op.score(empty, op.fit(empty, labels)).count() == 0


def test_ordinal_regression_orders_grades():
    rng = np.random.default_rng(1)
    rows = [sorted(set(rng.integers(0, 6, rng.integers(0, 5)).tolist())) for _ in range(600)]
    y = np.array([min(2, sum(t < 2 for t in r)) for r in rows])
    w, cuts = toxicity.fit_rows(rows, y, np.ones(len(rows)), 6, 3)
    assert cuts[0] < cuts[1] and min(w[:2]) > 2 and max(abs(w[2:])) < 1


def test_fingerprints(spark, docs, rows, empty):
    got = {r.doc_id: r for r in chunks.compare(clashing(docs)).collect()}
    order = sorted(rows)
    alone = dict(zip([i for i, *_ in order], chunks.fingerprints([t or "" for _, t, *_ in order])))
    for (i, t, *_), (j, nxt, *_) in zip(order, order[1:] + order[:1]):
        t, nxt = t or "", nxt or ""
        new = t[:len(t) - len(t) // 4] + nxt[:len(t) // 4]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert chunks.from_text(got[i].fingerprint) == alone[i] and sum(alone[i].values()) == len(t.encode())
        assert got[i].near_next == chunks.containment(alone[i], alone[j])
        assert got[i].near_edited == chunks.containment(alone[i], chunks.fingerprints([new])[0])
    assert chunks.compare(empty).count() == 0
    one = spark.createDataFrame([(None, "abcd" * 30)], "doc_id long, text string")
    assert chunks.compare(one).first().near_next == 1.0


def test_ranges_cut_ids_that_many_rows_share(spark):
    """A third of the rows without an id and a third of one id: no range is much over the mean."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else 1000 + i, f"text {i}") for i in range(9000)]
    rows += [(-(1 << 63), f"low {i}") for i in range(3)] + [(None, None), (7, "text 1"), (7, "text 1")]
    df = ordered.with_order(spark.createDataFrame(rows, "doc_id long, text string"))
    bounds = ordered.range_bounds(df, 12)
    got = df.withColumn("p", ordered.range_of(bounds)).collect()
    sizes = np.bincount([r.p for r in got], minlength=12)
    assert len(bounds) == 11 and sizes.max() < 2 * np.median(sizes)
    order = sorted(got, key=lambda r: (r._key, r._hash))
    assert [r.p for r in order] == sorted(r.p for r in got)
    ids = [r.doc_id for r in order]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_fingerprints_of_shared_and_missing_ids(spark):
    """Rows without ids, of one id, repeated rows: each is compared with the next in the stated order."""
    rng = random.Random(8)
    rows = [(rng.choice([None, None, 5, 5, 11, 12, 13]), prose(rng, 40) if i % 9 else "same text") for i in range(200)]
    df = spark.createDataFrame(rows + [(None, None), (5, "")], "doc_id long, text string")
    order = sorted(ordered.with_order(df).collect(), key=lambda r: (r._key, r._hash, r.text is not None, r.text))
    want = []
    for r, nxt in zip(order, order[1:] + order[:1]):
        a, b = r.text or "", nxt.text or ""
        new = chunks.edited(a, b)
        fa, fb, fn = chunks.fingerprints([a, b, new])
        want.append((r.doc_id, len(a), hashlib.sha256(new.encode()).hexdigest(), chunks.as_text(fa), chunks.as_text(fn),
                     chunks.containment(fa, fn), chunks.containment(fa, fb)))
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(map(tuple, chunks.compare(df.repartition(5)).collect()), key=key) == sorted(want, key=key)


def test_token_files_of_shared_and_missing_ids(spark):
    from tokenizers import Tokenizer

    path = registry.tokenizer("word_bpe_49k.json")
    lib, rng = Tokenizer.from_file(path), random.Random(9)
    rows = [(rng.choice([None, 4, 4, 6, 7]), prose(rng, 20) if i % 7 else "same") for i in range(150)] + [(None, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, start = [], 0
    order = sorted(ordered.with_order(df).collect(), key=lambda r: (r._key, r._hash))
    for r in order:
        ids = lib.encode(r.text or "", add_special_tokens=False).ids + [1]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_files.read(token_files.write(df.repartition(4), path, shard_ids=300)).collect()
    assert sorted(map(tuple, got), key=lambda x: x[1]) == want


def test_a_text_longer_than_its_slice(spark):
    """Texts of 5 MB among short ones: chunks and ids are those of the whole texts."""
    from tokenizers import Tokenizer

    path, rng = registry.tokenizer("word_bpe_49k.json"), random.Random(10)
    long = prose(rng, 1_200_000)
    assert len(long) > 4 << 20
    rows = [(1, "short one"), (2, long), (3, "short two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in token_files.read(token_files.write(df, path)).collect()}
    ids = Tokenizer.from_file(path).encode(long, add_special_tokens=False).ids + [1]
    assert (got[2].n_tokens, got[2].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    r = {x.doc_id: x for x in chunks.compare(df).collect()}[2]
    assert r.fingerprint == chunks.as_text(chunks.fingerprints([long])[0]) and r.n_chars == len(long)


def test_chunks_resist_shifts():
    rng = random.Random(5)
    text = prose(rng, 3000)
    a, b = chunks.fingerprints([text, "some words in front " + text])
    assert chunks.containment(a, b) > 0.95 and chunks.containment({}, {}) == 1 and chunks.containment(a, {}) == 0


def test_neighbours_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 12)) + 3 * rng.normal(size=(30, 12))[rng.integers(0, 30, 3000)]
    x[100:700] = x[100]  # equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(5000, None), (5020, []), (5040, [0.0] * 12), (5060, [float("nan")] * 12), (5080, [None] * 12), (5100, [1.0]), (None, [1.0] * 12)]
    got = neighbours.search(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)), k=10).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(by) == set(range(0, 3000, 20))
    hits = 0
    for q, found in by.items():
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(3000), -s))[:10].tolist()
        hits += len({v for v, _ in found} & set(want))
        assert len(found) == 10 and all(score == pytest.approx(s[v], rel=1e-12) for v, score in found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
    assert hits >= 0.9 * 10 * len(by)
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in neighbours.search(few).filter("query_id = 0").collect()].__len__() == 3
    assert neighbours.search(few.limit(0)).count() == 0


def test_neighbours_of_small_leaves(spark):
    """Outliers whose leaf holds fewer rows than k."""
    rng = np.random.default_rng(5)
    centre = np.eye(16)
    x = np.concatenate([centre[np.arange(4200) % 7], centre[[15, 15, 15]]]) + 1e-3 * rng.normal(size=(4203, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(4200, x[4200].tolist())] * 12  # 4200 asks, with copies of its own
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=10).collect()
    found = [r for r in got if r.query_id == 4200]
    assert {r.query_id for r in got} == set(range(0, 4201, 20)) and len(got) == 10 * 211
    assert {r.vec_id for r in found if r.rank <= 2} == {4201, 4202} and 4200 not in {r.vec_id for r in found}


def test_pipeline_ends_with_spans_and_decoded_text(spark):
    import corpus_pipeline as cp

    rows = [(1, "größe of  it"), (None, None)]
    got = {r.doc_id: r for r in cp.STAGES[-1][1](spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    sp = sentencepiece_codec.model(registry.tokenizer("piece_bpe_32k.model")).sp
    for i, text in rows:
        raw = (text or "").encode()
        assert got[i].ids == sp.encode(text or "", add_eos=True) and got[i].n_tokens == len(got[i].ids) == len(got[i].spans)
        assert got[i].decoded == sp.decode(got[i].ids) and b"".join(raw[s.start:s.end] for s in got[i].spans) == raw


def test_pipeline_keeps_columns_and_matches_stages(spark, tmp_path):
    import corpus_pipeline as cp

    rows = [r if r[2] else (r[0], r[1], "en", *r[3:]) for r in fixture_rows()]
    (tmp_path / "t").mkdir()
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "t/documents.parquet"))
    docs, names = spark.read.parquet(str(tmp_path / "t/documents.parquet")), DOCS
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path / "t"))
        assert out.columns == [c.split()[0] for c in names.split(", ")]
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    ids = sorted((r.doc_id, r.n_tokens) for r in cp.STAGES[-1][1](spark, docs, "").collect())
    assert ids == sorted((r.doc_id, r.n_tokens) for r in cp.run(spark, str(tmp_path / "t")).collect()) and ids
