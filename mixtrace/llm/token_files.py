"""Operator 9: token ids in wavelet-matrix files, one file per shard.

``write`` tokenises whole texts, appends the end id to each, deals the
documents out by ascending id (contiguous ranges) and writes each range's ids
as one or more shard files under a shared folder; it returns the manifest.
``read`` decodes every file of a manifest back into documents.  ``Shard`` gives
access(i), rank(id, i), count(id) and select(id, k) from one file, reading
only the blocks it needs.

A wavelet matrix keeps one bit per id and plane, from the highest bit down;
each plane is ordered by the bits of the planes above it (zeros before ones,
stable).  A plane's bits are stored in blocks, each compressed by itself, with
the number of ones before every block: rank reads one block, select searches
the counts and then reads one block.

Unit cache: the tokenizer's rules (checked against the file) never cross white
space, and its end-of-word mark ends every pre-token, so a white-space unit's
ids are found once per worker and kept in a bounded cache.

Defined cases: NULL text is the empty text (the end id only); NULL doc_id
sorts first; rows with equal doc_id are ordered by a hash of their texts (their
ranges are cut by it, so no id is one task); an empty table
has no file and an empty result; extra columns are ignored.  Memory: one
shard's ids (a document longer than a shard is a shard of its own).

Executors may be lost: a task writes under a fresh name and the manifest names
only the files of tasks that ended; the manifest is checkpointed, so files are
not written again when a later stage is repeated.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut, scratch_path
from .common import claim, partitions, pick, slices
from .ordered import range_bounds, range_of, with_order

MAGIC = b"WVM1"
#: Bytes of a plane's block before compression.
BLOCK = 1 << 15
#: Ids that are ordered by a plane's bit at a time (their positions stay in the processor's cache).
STRIPE = 1 << 15
#: Ids of a shard, about.
SHARD_IDS = 4_000_000
#: White-space units, and pre-tokens, kept per worker (together under 200 MB).
CACHED_UNITS, CACHED_TOKENS = 400_000, 600_000
#: Pre-token rule the unit cache knows (fixed value: the tokenizer file's own).
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Below this code point a character is its own NFC form and lower-cases by itself.
SIMPLE = "\u0180"
#: ASCII marks that end a unit as one pre-token after letters (no apostrophe: it starts some).
MARKS = b".,;:!?*&%$#|)"


class Encoder:
    """Whole texts to ids, by the tokenizers library."""

    def __init__(self, path: str, end_id: int):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        top = max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens") or []), end_id])
        self.dtype = np.dtype("<u2" if top < 1 << 16 else "<u4")
        self.bits = max(1, int(top).bit_length())
        self.end = np.array([end_id], self.dtype).tobytes()
        mark = spec["model"].get("end_of_word_suffix") or ""
        self.ends = np.zeros(top + 1, bool)
        for token, i in vocab.items():
            self.ends[i] = bool(mark) and token.endswith(mark)
        rule = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers") or []]
        self.by_unit = (bool(mark) and rule[0].get("pattern", {}).get("Regex") == PRE_TOKENS
                        and rule[0].get("behavior") == "Removed" and steps == ["NFC", "Replace", "Lowercase"]
                        and not any(t.get("normalized") or any(c.isspace() for c in t["content"])
                                    for t in spec.get("added_tokens") or []))
        self.special = {t["content"][0] for t in spec.get("added_tokens") or []}
        self.pre = regex.compile(PRE_TOKENS)
        # the same model for lists of pre-tokens, which are normalised and split already
        self.split = self.lib
        if self.by_unit and rule[1:] and rule[1]["type"] == "ByteLevel" and not rule[1].get("use_regex", True):
            self.split = Tokenizer.from_file(path)
            self.split.normalizer = None
            self.split.pre_tokenizer = pre_tokenizers.Sequence([
                pre_tokenizers.Split("\n", "removed"),
                pre_tokenizers.ByteLevel(add_prefix_space=rule[1]["add_prefix_space"], use_regex=False)])
        self.units: dict[bytes, bytes] = {}
        self.tokens: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, self.dtype).tobytes()
                for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, units: list[bytes]) -> None:
        """Puts the ids of new units into the cache."""
        odd, simple, special = [], [], self.special
        for u in units:
            word = u.rstrip(MARKS)
            s = word.decode().lower()
            if s.isalpha() and (s.isascii() or max(s) < SIMPLE):  # letters, then a run of marks
                simple.append((u, (s, u[len(word):].decode()) if len(word) < len(u) else (s,)))
                continue
            s = u.decode()
            if max(s) < SIMPLE and s.isprintable() and special.isdisjoint(s):
                simple.append((u, self.pre.findall(s.lower())))
            else:
                odd.append((u, s))
        new = list(set().union(*[ps for _, ps in simple]).difference(self.tokens))
        if new:
            ids = np.asarray(self.split.encode_batch_fast(["\n".join(new)], add_special_tokens=False)[0].ids, np.int64)
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) == len(new):
                raw, edge = ids.astype(self.dtype).tobytes(), [0, *(stop * self.dtype.itemsize).tolist()]
                self.tokens.update((p, raw[a:b]) for p, a, b in zip(new, edge, edge[1:]))
            else:
                self.tokens.update(zip(new, self._whole(new)))
        tokens = self.tokens
        self.units.update((u, b"".join([tokens[p] for p in ps])) for u, ps in simple)
        if odd:
            self.units.update(zip([u for u, _ in odd], self._whole([s for _, s in odd])))

    def encode(self, texts: pa.Array) -> pa.Array:
        """Little-endian ids of each text (NULL: empty), with the end id."""
        if not self.by_unit:
            return pa.array([x + self.end for x in self._whole([t or "" for t in texts.to_pylist()])], pa.binary())
        if len(self.units) > CACHED_UNITS:
            self.units.clear()
        if len(self.tokens) > CACHED_TOKENS:
            self.tokens.clear()
        # each different unit of the slice is looked up once, then ids are gathered
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        words = split.flatten().cast(pa.binary()).dictionary_encode()
        known = words.dictionary.to_numpy(zero_copy_only=False).tolist()  # white space at a text's ends leaves an empty unit
        new = set(known).difference(self.units)
        new.discard(b"")
        if new:
            self._learn(list(new))
        units = self.units
        ids = [units[u] if u else b"" for u in known]
        ids.append(self.end)
        width = self.dtype.itemsize
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // width
        first = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(ids), self.dtype)
        # the units of all texts end to end, each text's followed by the end id
        count = split.value_lengths().to_numpy()
        last = np.cumsum(count + 1) - 1
        code = np.empty(int(count.sum()) + len(count), np.int64)
        inner = np.ones(len(code), bool)
        inner[last] = False
        code[last] = len(known)
        code[inner] = words.indices.to_numpy()
        n = size[code]
        end = np.cumsum(n)
        out = flat[np.arange(int(end[-1])) + np.repeat(first[code] - end + n, n)]
        offsets = np.append(0, end[last] * width)
        return pa.Array.from_buffers(pa.large_binary(), len(count), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())]).cast(pa.binary())


@lru_cache(maxsize=1)
def _load(path: str, end_id: int) -> Encoder:
    return Encoder(path, end_id)


def encoder(path: str, end_id: int) -> Encoder:
    """Loaded once per Python worker; one thread, the task's own."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    claim("token files", _load.cache_clear)
    return _load(path, end_id)


def build(ids: np.ndarray, bits: int, docs: bytes) -> bytes:
    """A shard file: ids in a wavelet matrix, and ``docs``, bytes kept beside them."""
    import zstandard

    z = zstandard.ZstdCompressor(level=1)
    body, head = [], []
    at, n = 0, len(ids)
    seq = ids
    for b in range(bits - 1, -1, -1):
        ones = (seq & seq.dtype.type(1 << b)) != 0
        packed = np.packbits(ones, bitorder="little")
        blocks = [packed[i:i + BLOCK].tobytes() for i in range(0, len(packed), BLOCK)]
        before = np.append(0, np.cumsum([np.bitwise_count(np.frombuffer(x, np.uint8)).sum(dtype=np.int64)
                                         for x in blocks]))
        small = [z.compress(x) for x in blocks]
        head.append(struct.pack("<q", n - int(before[-1])) + before[:-1].astype("<i8").tobytes()
                    + (at + np.append(0, np.cumsum([len(x) for x in small]))).astype("<i8").tobytes())
        at += sum(map(len, small))
        body.extend(small)
        if b:
            down, zero, one = np.empty_like(seq), 0, n - int(before[-1])
            for i in range(0, n, STRIPE):
                part, mark = seq[i:i + STRIPE], ones[i:i + STRIPE]
                low, high = part.take(np.flatnonzero(~mark)), part.take(np.flatnonzero(mark))
                down[zero:zero + len(low)], down[one:one + len(high)] = low, high
                zero, one = zero + len(low), one + len(high)
            seq = down
    docs = z.compress(docs)
    return b"".join([MAGIC, struct.pack("<qqqq", n, bits, len(docs), ids.dtype.itemsize), *head, *body, docs])


class Shard:
    """Queries on one shard file held in ``data`` (bytes or a memory map)."""

    def __init__(self, data):
        import zstandard

        self.z = zstandard.ZstdDecompressor()
        self.data = memoryview(data)
        if bytes(self.data[:4]) != MAGIC:
            raise ValueError("not a shard file")
        self.n, self.bits, docs, width = struct.unpack("<qqqq", self.data[4:36])
        self.dtype = np.dtype(f"<u{width}")
        self.blocks = -(-(-(-self.n // 8)) // BLOCK)
        row, at = 8 * (2 + 2 * self.blocks), 36
        self.zeros, self.before, self.edge = [], [], []
        for _ in range(self.bits):
            x = np.frombuffer(self.data[at:at + row], "<i8")
            self.zeros.append(int(x[0]))
            self.before.append(x[1:1 + self.blocks])
            self.edge.append(x[1 + self.blocks:])
            at += row
        self.base = at
        end = at + (int(self.edge[-1][-1]) if self.bits else 0)
        self.docs = self.z.decompress(self.data[end:end + docs])

    def _block(self, plane: int, k: int) -> np.ndarray:
        a, b = self.edge[plane][k:k + 2]
        return np.frombuffer(self.z.decompress(self.data[self.base + int(a):self.base + int(b)]), np.uint8)

    def _rank1(self, plane: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        k, rest = divmod(i, BLOCK * 8)
        if not rest:
            return int(self.before[plane][k]) if k < self.blocks else self.n - self.zeros[plane]
        x = self._block(plane, k)
        full, odd = divmod(rest, 8)
        more = int(x[full] & (1 << odd) - 1).bit_count() if odd else 0
        return int(self.before[plane][k]) + int(np.bitwise_count(x[:full]).sum(dtype=np.int64)) + more

    def _select(self, plane: int, bit: int, j: int) -> int:
        """Position of the j-th (from 0) bit of that value in a plane."""
        ones = self.before[plane]
        count = ones if bit else np.arange(self.blocks) * BLOCK * 8 - ones
        k = int(np.searchsorted(count, j, side="right")) - 1
        bits = np.unpackbits(self._block(plane, k), bitorder="little")
        return k * BLOCK * 8 + int(np.flatnonzero(bits == bit)[j - int(count[k])])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p in range(self.bits):
            k, rest = divmod(i, BLOCK * 8)
            bit = int(self._block(p, k)[rest // 8]) >> rest % 8 & 1
            ones = self._rank1(p, i)
            value = value << 1 | bit
            i = self.zeros[p] + ones if bit else i - ones
        return value

    def _range(self, value: int, stop: int) -> tuple[int, int]:
        """Where the occurrences of ``value`` among the first ``stop`` ids end up below the last plane."""
        a, b = 0, stop
        for p in range(self.bits):
            ra, rb = self._rank1(p, a), self._rank1(p, b)
            if value >> self.bits - 1 - p & 1:
                a, b = self.zeros[p] + ra, self.zeros[p] + rb
            else:
                a, b = a - ra, b - rb
        return a, b

    def rank(self, value: int, stop: int) -> int:
        """Occurrences of ``value`` among the first ``stop`` ids."""
        if value >> self.bits:
            return 0
        a, b = self._range(value, max(0, min(stop, self.n)))
        return b - a

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of ``value``."""
        if value >> self.bits:
            raise IndexError(k)
        a, b = self._range(value, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for p in range(self.bits - 1, -1, -1):
            i = self._select(p, 1, i - self.zeros[p]) if value >> self.bits - 1 - p & 1 else self._select(p, 0, i)
        return i

    def ids(self) -> np.ndarray:
        """All ids, in order."""
        seq = np.zeros(self.n, self.dtype)
        for p in range(self.bits - 1, -1, -1):
            packed = np.concatenate([self._block(p, k) for k in range(self.blocks)] or [np.zeros(0, np.uint8)])
            ones = np.unpackbits(packed, count=self.n, bitorder="little").view(bool)
            up, zero, one = np.empty_like(seq), 0, self.zeros[p]
            top = self.dtype.type(1 << self.bits - 1 - p)
            for i in range(0, self.n, STRIPE):
                part, mark = up[i:i + STRIPE], ones[i:i + STRIPE]
                low, high = np.flatnonzero(~mark), np.flatnonzero(mark)
                part[low], part[high] = seq[zero:zero + len(low)], seq[one:one + len(high)] | top
                zero, one = zero + len(low), one + len(high)
            seq = up
        return seq


def filesystem(uri: str):
    """(file system, path) of a folder, for tasks; any that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


_DOCS = np.dtype([("doc_id", "<i8"), ("null", "<i1"), ("n", "<i8")])


def write(docs: DataFrame, tokenizer_path: str, end_id: int = 1, folder: str | None = None,
          shard_ids: int = SHARD_IDS) -> DataFrame:
    """Tokenise and write; returns the manifest, checkpointed: shard (range),
    part, path, n_docs, n_tokens, start (ids before the file), file_bytes."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-files")
    rows = pick(docs, "doc_id", "text").selectExpr("cast(doc_id as long) doc_id", "text")
    n = partitions(spark)
    rows = with_order(rows)
    bounds = range_bounds(rows, n)

    def tokenise(batches):
        e = encoder(tokenizer_path, end_id)
        for b in slices(batches, "text", 2 << 20):
            ids = e.encode(b.column("text"))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("shard", "doc_id", "_key", "_hash")], ids],
                                             ["shard", "doc_id", "_key", "_hash", "ids"])

    coded = (rows.select(range_of(bounds).alias("shard"), "doc_id", "_key", "_hash", "text")
             .mapInArrow(tokenise, "shard int, doc_id long, _key long, _hash long, ids binary")
             .repartitionById(n, F.col("shard")).sortWithinPartitions("shard", "_key", "_hash", "ids"))

    def store(batches):
        e = encoder(tokenizer_path, end_id)
        to, path = filesystem(folder)
        now, part, held, parts, rows = None, 0, 0, [], []

        def flush():
            name = f"{folder}/shard-{now:06d}-{part:04d}-{uuid.uuid4().hex}.wvm"
            ids = np.frombuffer(b"".join(parts), e.dtype)
            file = build(ids, e.bits, np.array(rows, _DOCS).tobytes())
            to.create_dir(path, recursive=True)
            with to.open_output_stream(f"{path}/{name.rpartition('/')[2]}") as f:
                f.write(file)
            return pa.RecordBatch.from_pydict({"shard": pa.array([now], pa.int32()), "part": pa.array([part], pa.int32()),
                                               "path": [name], "n_docs": [len(rows)], "n_tokens": [len(ids)],
                                               "file_bytes": [len(file)]})

        for b in batches:
            for shard, doc, ids in zip(b.column("shard").to_pylist(), b.column("doc_id").to_pylist(),
                                       b.column("ids").to_pylist()):
                size = len(ids) // e.dtype.itemsize
                if rows and (shard != now or held + size > shard_ids):
                    yield flush()
                    part, held, parts, rows = part + 1 if shard == now else 0, 0, [], []
                now = shard
                parts.append(ids)
                rows.append((doc or 0, doc is None, size))
                held += size
        if rows:
            yield flush()

    manifest = cut(coded.mapInArrow(store, "shard int, part int, path string, n_docs long, n_tokens long, file_bytes long"))
    # one row per file of millions of ids: the running sum over them is small
    w = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)))


def read(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches):
        for b in batches:
            for name, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                folder, _, last = name.rpartition("/")
                at, path = filesystem(folder)
                with at.open_input_stream(f"{path}/{last}") as f:
                    shard = Shard(f.read())
                docs = np.frombuffer(shard.docs, _DOCS)
                ids = shard.ids()
                edge = np.append(0, np.cumsum(docs["n"]))
                crc = [zlib.crc32(ids[i:j].astype("<u4")) for i, j in zip(edge[:-1].tolist(), edge[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs["doc_id"], mask=docs["null"] != 0), pa.array(edge[:-1] + start),
                     pa.array(docs["n"]), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.select("path", "start").repartition(partitions(manifest.sparkSession))
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
