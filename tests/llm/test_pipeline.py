"""The pipeline's rows against a plain-Python pipeline, stage by stage and whole."""

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import pytest
import regex

from mixtrace.llm import language, mixing, registry

from .test_llm import DOCS, WS, brute_fingerprint, naive_targets, words

EN = "the of and house river stone quick light morning field water carries under bridge letters".split()
DE = "der die und straße größe haus fluss schnell licht morgen feld wasser trägt unter brücke".split()
RU = "дом река камень быстро свет утро поле вода несёт мост буквы".split()


def fixture():
    rng = random.Random(21)

    def text(lang, n):
        return " ".join(rng.choice(lang) + rng.choice(["", "", "", ",", ".", str(rng.randrange(50))]) for _ in range(n))
    passage, base = text(EN, 90), text(DE, 80)
    rows = [("en", text(EN, rng.randrange(1, 90))) for _ in range(30)] + [("de", text(DE, rng.randrange(1, 90))) for _ in range(30)]
    rows += [("ru", text(RU, rng.randrange(5, 60))) for _ in range(8)]
    rows += [(None, text(EN, 20) + "  " + passage + "\n" + text(EN, 30)) for _ in range(5)] + [("en", passage)]
    rows += [("de", base), ("de", base), (None, base.upper()), ("de", base + " morgen")]  # copies and near copies
    rows += [(None, text(EN, 40) + " " + text(DE, 25)) for _ in range(4)]  # two languages
    rows += [(None, None), ("en", ""), (None, " \n"), (None, "12 34 56"), (None, "日本語 テキスト"), (None, "日本 " * 30 + "the")]
    rng.shuffle(rows)
    # sources of very unlike size, one absent
    return [(7 * i + 1, t, lang, "a" if i % 3 else ["b", "c", None, "d"][i // 3 % 4], len(t or "")) for i, (lang, t) in enumerate(rows)]


def script(word):
    return unicodedata.name(word[0]).split()[0]


def grams(word):
    s = b"\0" + word.encode() + b"\0"
    for n in language.NGRAMS:
        for i in range(len(s) - n + 1):
            h = n
            for x in s[i:i + n]:
                h = (h ^ x) * 0x01000193 % (1 << 32)
            yield ((h ^ h >> 15) * 0x2C1B3C6D % (1 << 32) >> 16) % language.BUCKETS


def letters(text):
    return regex.findall(r"\p{L}[\p{L}\p{M}]*", (text or "").lower())


def plain_language(rows):
    """doc_id -> whether the text has a language: word by word, with dicts."""
    known = [r for r in rows if r[1] is not None and r[2] is not None and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    langs = sorted({r[2] for r in known})
    count, scripts = {x: Counter() for x in langs}, {x: Counter() for x in langs}
    for _, text, lang, *_ in known:
        for w in letters(text):
            count[lang].update(grams(w))
            scripts[lang][script(w)] += 1
    total = {x: sum(count[x].values()) + 0.3 * language.BUCKETS for x in langs}

    def score(word):
        may = [x for x in langs if scripts[x][script(word)] >= max(language.SCRIPT_SHARE * sum(scripts[x].values()), 1)]
        if not may:
            return None
        s = {x: 0.5 * sum(math.log((count[x][g] + 0.3) / total[x]) for g in grams(word)) for x in may}
        top = max(s.values())
        norm = top + math.log(sum(math.exp(v - top) for v in s.values()))
        return {x: max(s[x] - norm, language.FLOOR) if x in s else language.FLOOR for x in langs}

    out = {}
    for i, text, *_ in rows:
        scores = [score(w) for w in letters(text)]
        value, back = dict.fromkeys(langs, 0.0), []
        for t, s in enumerate(scores):
            come = {}
            if t:
                best = max(langs, key=lambda x: value[x])
                for x in langs:
                    come[x] = x if value[x] >= value[best] - language.SWITCH else best
                value = {x: max(value[x], value[best] - language.SWITCH) for x in langs}
            back.append(come)
            value = {x: value[x] + (s[x] if s else 0.0) for x in langs}
        labels, now = [], max(langs, key=lambda x: value[x])
        for come in reversed(back):
            labels.append(now)
            now = come.get(now, now)
        votes = Counter(x for x, s in zip(reversed(labels), scores) if s)
        out[i] = bool(votes) and max(votes.values()) / len(scores) >= language.LEAST
    return out


def plain_near_dedup(rows):
    fp = {r[0]: brute_fingerprint(r[1]) for r in rows}
    label = {i: i for i in fp}
    for _ in fp:
        label = {i: min(label[j] for j in fp if (fp[i] ^ fp[j]).bit_count() <= 2) for i in fp}
    return [r for r in rows if label[r[0]] == r[0]]


def plain_substring(rows, window=50):
    seen = {}
    for i, text, *_ in sorted(rows):
        w = words(text)
        for p in range(len(w) - window + 1):
            seen.setdefault(tuple(w[p:p + window]), i)
    out = []
    for i, text, *rest in rows:
        at = list(WS.finditer(text or ""))
        gone = set()
        for p in range(len(at) - window + 1):
            if seen[tuple(m.group() for m in at[p:p + window])] < i:
                gone.update(range(p, p + window))
        if gone:
            pieces = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text)
            text = text[:at[0].start()] + "".join(x for k, x in enumerate(pieces) if k not in gone)
        out.append((i, text, *rest[:-1], rest[-1] if text is None else len(text)))
    return out


def plain_mix(rows):
    def unit(s):
        return int(hashlib.md5(f"{mixing.SEED}:{s}".encode()).hexdigest()[:8], 16)
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[3]].append(r)
    size = {s: sum(len(words(r[1])) for r in rs) for s, rs in by_source.items()}
    target = naive_targets(size)
    out = []
    for s, rs in by_source.items():
        rate = target[s] / size[s] if size[s] else 0.0
        u = unit(f"offset:{s or ''}") / (1 << 32)
        for k, r in enumerate(sorted(rs, key=lambda r: (len(words(r[1])), unit(r[0]), r[0])), 1):
            out += [r] * (math.floor(rate * k + u) - math.floor(rate * (k - 1) + u))
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(fixture(), DOCS).repartition(5).write.parquet(str(at / "documents.parquet"))
    return at


def test_every_stage_equals_plain_python(spark, folder):
    import corpus_pipeline as cp

    rows, sizes = fixture(), []
    keeps = plain_language(rows)
    plain = [lambda r: [x for x in r if keeps[x[0]]], plain_near_dedup, plain_substring, plain_mix]
    docs = spark.read.parquet(str(folder / "documents.parquet"))
    order = lambda r: tuple(map(str, r))
    for (name, stage), want in zip(cp.STAGES, plain):
        rows = want(rows)
        out = stage(spark, docs, str(folder))
        assert out.columns == [c.split()[0] for c in DOCS.split(", ")]
        out.write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        assert sorted(map(tuple, docs.collect()), key=order) == sorted(rows, key=order), name
        sizes.append((len(rows), sum(len(words(r[1])) for r in rows)))
    n, w = zip(*sizes)
    assert len(fixture()) > n[0] > n[1] == n[2] and w[2] < w[1]  # every stage had something to do
    assert max(Counter(r[0] for r in rows).values()) > 1


def test_the_whole_pipeline_equals_plain_python(spark, folder):
    import sentencepiece

    import corpus_pipeline as cp

    rows = fixture()
    keeps = plain_language(rows)
    rows = plain_mix(plain_substring(plain_near_dedup([r for r in rows if keeps[r[0]]])))
    sp = sentencepiece.SentencePieceProcessor(model_file=registry.tokenizer("piece_bpe_32k.model"))
    want = []
    for i, text, *_ in rows:
        ids = sp.encode(text or "", add_eos=True)
        want.append((i, len(ids), tuple(ids), sp.decode(ids)))
    out = cp.run(spark, str(folder)).collect()
    assert sorted((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded) for r in out) == sorted(want)
    raw = {r[0]: (r[1] or "").encode() for r in rows}
    for r in out:
        assert b"".join(raw[r.doc_id][s.start:s.end] for s in r.spans) == raw[r.doc_id]
