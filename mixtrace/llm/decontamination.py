"""Operator 13 (native): benchmark decontamination by a broadcast set of n-grams.

Texts are normalised (A-Z lower-cased; words are runs of digits, a-z and
non-ASCII characters).  A window is ``WINDOW`` consecutive words of a benchmark
item; an item of fewer words, but not none, is one window.  The distinct
windows, with a 64-bit hash of their words, are the broadcast hash table; every
document hashes its own windows of each length that occurs, meets the table
where it stands, and hits are verified word by word.  Only hits and one row a
document are shuffled, never a text.

The table's rows and bytes are counted before it is used.  Beyond
``BLOCK_ROWS`` or ``BLOCK_BYTES`` it is cut into blocks by hash, each broadcast
for a scan of its own, so the result is the same at any size of the benchmark.

``scan`` gives the hits, ``report`` a row per document, ``remove`` the documents
without the words that were hit (``how="spans"``) or without the documents that
hold one (``how="documents"``).  DataFrame functions only.

Defined cases: NULL text has no words; an item with a NULL id is named by the
empty string; rows with one item_id are one item; documents are known by doc_id
and text, so rows with the same doc_id (or none) get their own results and
repeated rows the same one each; empty tables give an empty result, or no hits;
extra columns are ignored (``remove``: kept).
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import pick, positional

WINDOW = 10
#: Words of the contract, once A-Z is lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows of one broadcast, and the bytes of their words.
BLOCK_ROWS, BLOCK_BYTES = 2_000_000, 128 << 20
#: Documents with hits, and their spans, that ``remove`` may broadcast.
FOUND_ROWS, FOUND_SPANS = 200_000, 2_000_000


def words(text: Column) -> Column:
    """array<string>, empty for NULL."""
    ascii_only = F.octet_length(text) == F.char_length(text)  # for these the fast function does the same
    low = F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.coalesce(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def window_hash(hashes: Column, at: Column, size: int) -> Column:
    """Hash of the ``size`` word hashes from position ``at`` (from 0).  Each is
    read by itself: ``slice`` in a lambda copies the whole array every time."""
    return F.xxhash64(*[F.get(hashes, at + j) for j in range(size)])


def window_hashes(hashes: Column, size: int) -> Column:
    """array<long>: the hash of every window of ``size`` words, in order."""
    last = F.size(hashes) - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: window_hash(hashes, i, size))) \
        .otherwise(F.array().cast("array<long>"))


def item_windows(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Materialised (windows, owners): windows(wid, w, len, h) holds each distinct window once,
    owners(wid, item) the items it occurs in."""
    it = pick(items, "item_id", "text").select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("_w"))
    n = F.size("_w")
    each = F.when(n >= window, F.transform(F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1))),
                                           lambda i: F.slice("_w", i, window))).otherwise(F.array("_w"))
    grams = it.filter(n > 0).select("item", F.explode(each).alias("w")).distinct()
    # a window's number is a 128-bit digest of its words (no word holds a space)
    grams = cut(grams.withColumn("wid", F.md5(F.concat_ws(" ", "w").cast("binary"))))
    table = grams.select("wid", "w").dropDuplicates(["wid"]).withColumn("_hw", word_hashes(F.col("w")))
    h = F.coalesce(*[F.when(F.size("w") == s, window_hash(F.col("_hw"), F.lit(0), s)) for s in range(1, window + 1)])
    table = table.select("wid", "w", F.size("w").alias("len"), h.alias("h"))
    return cut(table), grams.select("wid", "item")


def _blocks(windows: DataFrame, rows: int, size: int) -> list[DataFrame]:
    """The windows in as many blocks as keep each within its rows and bytes."""
    bytes_of = F.sum(F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 16))
    n, b = windows.agg(F.count(F.lit(1)), F.coalesce(bytes_of, F.lit(0))).first()
    many = max(1, -(-n // rows), -(-b // size))
    return [windows] if many == 1 else [windows.filter(F.pmod("h", F.lit(many)) == k) for k in range(many)]


def _scan(docs: DataFrame, windows: DataFrame, sizes: list[int], first: bool) -> DataFrame:
    """One scan of the documents with one block of windows: the row's columns,
    n_words, and pos (1-based), len, wid of each hit.  In the first scan every
    document also yields one row without a window, so none is lost."""
    n = F.col("_n")
    count = {s: F.greatest(n - (s - 1), F.lit(0)) for s in sizes}
    hashes = [window_hashes(F.col("_hw"), s) for s in sizes]
    mark = F.array(F.lit(0).cast("long"))  # position 0 stands for the document itself
    rows = docs.withColumn("_w", words(F.col("text")))
    rows = rows.select("key", "_w", F.size("_w").alias("_n"), word_hashes(F.col("_w")).alias("_hw"))
    # hashed before the rows are made: only so are generator, join and check one compiled stage,
    # which hands the words on by reference instead of copying them for every window
    rows = rows.select("key", "_w", "_n", F.concat(mark, *hashes).alias("_hashes"))
    # (outer: no array is empty, and a plain generator's test for that would hash everything twice)
    rows = rows.select("key", "_w", "_n", F.posexplode_outer("_hashes").alias("_at", "_h"))
    table = windows.select("wid", "w", "len", "h")
    if first:
        none = windows.sparkSession.range(1).select(
            F.lit(None).cast("string").alias("wid"), F.array().cast("array<string>").alias("w"),
            F.lit(0).alias("len"), F.lit(0).cast("long").alias("h"))
        table = table.unionByName(none)
    hit = rows.join(F.broadcast(table), F.col("_h") == F.col("h"))
    # windows of one length follow those of the shorter ones in the array
    before = F.lit(0)
    for s in sizes:
        before = before + F.when(F.col("len") > s, count[s]).otherwise(0)
    pos = F.col("_at") - before
    same = F.when(F.col("len") == 0, F.col("_at") == 0).otherwise(
        (F.col("_at") > 0) & (pos >= 1) & (pos + F.col("len") - 1 <= n)
        & (F.slice("_w", F.greatest(pos, F.lit(1)), F.col("len")) == F.col("w")))
    return hit.filter(same).select("key", F.col("_n").alias("n_words"), pos.alias("pos"), "len", "wid")


def row_key(doc_id: Column, text: Column) -> Column:
    """What a document is known by: doc_id and a 128-bit digest of its text."""
    return F.struct(doc_id.alias("doc_id"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"),
                    text.isNull().alias("none"))


def scan(docs: DataFrame, windows: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Materialised hits (key, n_words, copies, spans, wids), a row for each
    doc_id and text: spans array<struct<pos, stop>> of hit words (1-based, the
    stop excluded), wids the distinct windows met, copies the rows it stands for."""
    rows = pick(docs, "doc_id", "text").select(
        row_key(F.col("doc_id"), F.col("text")).alias("key"), "text")
    sizes = sorted(r[0] for r in windows.select("len").distinct().collect())  # at most WINDOW numbers
    parts = [_scan(rows, w, sizes, k == 0) for k, w in enumerate(_blocks(windows, block_rows, block_bytes))]
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    real = F.col("len") > 0
    # sets: copies of one document add nothing to them
    return cut(hits.groupBy("key").agg(
        F.max("n_words").cast("long").alias("n_words"), F.count(F.when(~real, 1)).alias("copies"),
        F.array_sort(F.collect_set(F.when(real, F.struct("pos", (F.col("pos") + F.col("len")).alias("stop"))))).alias("spans"),
        F.collect_set(F.when(real, F.col("wid"))).alias("wids")))


def covered(spans: Column) -> Column:
    """Number of words inside any of the ascending spans."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    fold = F.aggregate(spans, start, lambda a, s: F.struct(
        (a["n"] + F.greatest(s["stop"] - F.greatest(s["pos"], a["upto"]), F.lit(0))).alias("n"),
        F.greatest(a["upto"], s["stop"]).alias("upto")))
    return fold["n"].cast("long")


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW, **block) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items (sorted
    ids): one row per document."""
    windows, owners = item_windows(items, window)
    found = scan(docs, windows, **block)
    met = found.filter(F.size("wids") > 0).select("key", F.explode("wids").alias("wid"))
    names = met.join(owners, "wid").groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    names = names.withColumnRenamed("key", "_key")
    out = found.join(names, F.col("key") == F.col("_key"), "left")
    out = out.withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    n_hit = covered(F.col("spans"))
    return out.select(
        F.col("key.doc_id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "items")


def remove(docs: DataFrame, items: DataFrame, how: str = "spans", window: int = WINDOW, **block) -> DataFrame:
    """The documents, all their columns kept, without contamination:
    ``documents`` drops those with a hit, ``spans`` cuts every hit word with
    what separates it from the next."""
    if how not in ("spans", "documents"):
        raise ValueError(how)
    windows, _ = item_windows(items, window)
    found = scan(docs, windows, **block).filter(F.size("spans") > 0).select(F.col("key").alias("_key"), "spans")
    n, size = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    if n <= FOUND_ROWS and size <= FOUND_SPANS:
        found = F.broadcast(found)  # else the texts are shuffled
    plain, at, names = positional(docs)
    text = F.col(at["text"])
    rows = plain.withColumn("_row", row_key(F.col(at["doc_id"]), text))
    if how == "documents":
        kept = rows.join(found, F.col("_row") == F.col("_key"), "left_anti")
    else:
        kept = rows.join(found, F.col("_row") == F.col("_key"), "left")
        # words are found in the lower-cased text and cut from the original: both have the same characters
        mixed = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
        rest = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
        lead = F.regexp_extract(text, f"^{rest}", 0)
        pieces = F.regexp_extract_all(text, F.lit(mixed + rest), F.lit(0))
        hit = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["pos"], s["stop"] - 1))))
        # hit positions as an ascending array; words are kept in the gaps between them
        edges = F.array_sort(F.concat(F.array(F.lit(0)), hit, F.array(F.size(pieces) + 1)))
        gaps = F.flatten(F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda i: F.slice(
            pieces, F.element_at(edges, i) + 1, F.element_at(edges, i + 1) - F.element_at(edges, i) - 1)))
        kept = kept.withColumn(at["text"], F.when(F.col("spans").isNull(), text)
                               .otherwise(F.concat(lead, F.array_join(gaps, ""))))
    return kept.select(*[f"_{i}" for i in range(len(names))]).toDF(*names)


def oracle_sql(documents: str = "documents", benchmark: str = "benchmark", window: int = WINDOW) -> str:
    """DuckDB SQL for the query."""
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    split = f"coalesce(regexp_extract_all(translate(text, '{upper}', '{lower}'), '{WORD}'), [])"
    return f"""
with it as (select coalesce(item_id::varchar, '') as item, {split} as w from {benchmark}),
g as (
  select distinct item, array_to_string(w[i:i + least(len(w), {window}) - 1], ' ') as gram, least(len(w), {window}) as size
  from (select item, w, unnest(range(1, greatest(len(w) - {window - 1}, 1) + 1)) as i from it where len(w) > 0)),
d as (select doc_id, row_number() over () as r, {split} as w from {documents}),
s as (select distinct size from g),
p as (
  select r, i, size, array_to_string(w[i:i + size - 1], ' ') as gram
  from (select r, w, size, unnest(range(1, len(w) - size + 2)) as i from d, s where len(w) >= size)),
hit as (select p.r, p.i, p.size, g.item from p join g on p.gram = g.gram and p.size = g.size),
covered as (
  select r, count(distinct pos) as n_hit
  from (select r, unnest(range(i, i + size)) as pos from (select distinct r, i, size from hit)) group by r),
named as (
  select r, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct r, item from hit) group by r)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(c.n_hit, 0)::bigint as n_hit,
       coalesce(n.n_items, 0)::bigint as n_items, sha256(coalesce(n.items, '')) as items_sha256,
       coalesce(c.n_hit, 0) > 0 as contaminated
from d left join covered c on d.r = c.r left join named n on d.r = n.r"""
