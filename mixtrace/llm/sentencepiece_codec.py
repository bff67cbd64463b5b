"""Operator 5: SentencePiece encoding and decoding that preserves offsets.

The text is normalised as the model says: at each position the longest prefix
found in the compiled character map (a double array trie and a block of
NUL-ended replacements, both inside the model file) is replaced, other
characters are copied, and the map's result keeps, for every normalised byte,
the byte of the original that it came from.  The normalised length of every
piece is known from the vocabulary, so prefix sums of those lengths, read
through that alignment, give the original byte span of each piece.

Segmentation itself is the library's.  Where the vocabulary has no piece that
holds the space mark after another character, no merge crosses the boundary
before a run of spaces, and a text's ids are its units' ids end to end (a unit:
a run of spaces and what follows up to the next one).  Units then go through a
bounded cache, so each distinct unit is segmented once per worker.  A model
with a character map or such pieces gets whole texts instead.

Defined cases: NULL text is the empty text (ids: the end id only, decoded text
empty); extra columns are ignored; repeated rows give repeated results; an
empty table gives an empty result.  Whole texts are encoded; memory is bounded
by one slice of about 4 MB of text or one longer text.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import claim, pick, slices

SPACE = "▁"
#: Units kept per worker (about 100 MB).
CACHED_UNITS = 500_000
_MARK = SPACE.encode()


def _fields(buf: bytes) -> Iterator[tuple[int, int, object]]:
    """(field number, wire type, value) of one protobuf message."""
    i, n = 0, len(buf)

    def varint(i: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            b = buf[i]
            i += 1
            out |= (b & 127) << shift
            if b < 128:
                return out, i
            shift += 7

    while i < n:
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 1:
            value, i = buf[i:i + 8], i + 8
        elif kind == 2:
            size, i = varint(i)
            value, i = buf[i:i + size], i + size
        else:
            value, i = buf[i:i + 4], i + 4
        yield key >> 3, kind, value


class CharMap:
    """The compiled character map: longest-prefix lookup of replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if len(blob) >= 4 else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.text = blob[4 + size:]

    def __bool__(self) -> bool:
        return bool(self.units)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest mapped prefix of ``data[at:]`` and its replacement."""
        units, found = self.units, None
        node = self._offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = (i + 1 - at, self.text[start:self.text.index(b"\0", start)])
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 1 << 9) >> 6)


def _units(text: str) -> list[str]:
    """Runs of k >= 1 space marks with what follows up to the next mark, of
    the marked text (a mark in front, then every space a mark)."""
    if not text:
        return []
    marked = text.replace(" ", SPACE)
    if marked[0] == SPACE or marked[-1] == SPACE or SPACE * 2 in marked:
        return re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + marked)
    return [SPACE + x for x in marked.split(SPACE)]


class Model:
    """What normalisation and alignment need to know of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            blob = f.read()
        spec = next((v for k, _, v in _fields(blob) if k == 3), b"")
        spec = {k: v for k, _, v in _fields(spec)}
        self.charmap = CharMap(spec.get(2, b""))
        self.dummy_prefix = bool(spec.get(3, 1))
        self.squeeze = bool(spec.get(4, 1))
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.end = self.sp.eos_id()
        self.space = self.sp.piece_to_id(SPACE)
        #: Normalised bytes of each piece; 0 for control ids, -1 for the unknown id.
        self.length = np.array([-1 if self.sp.is_unknown(i) else 0 if self.sp.is_control(i)
                                else 1 if self.sp.is_byte(i) else len(p.encode())
                                for i, p in enumerate(pieces)], np.int64)
        self.sp_bytes = any(self.sp.is_byte(i) for i in range(len(pieces)))  # then no id is unknown
        self.by_unit = (not self.charmap and self.dummy_prefix and not self.squeeze
                        and self.space != self.sp.unk_id()
                        and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces))
        self.cache: dict[str, bytes] = {SPACE: struct.pack("<i", self.space)}

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The library's ids of each whole text, with the end id."""
        if not self.by_unit:
            return [np.asarray([*x, self.end], np.int32) for x in self.sp.encode(texts, num_threads=1)]
        cache = self.cache
        if len(cache) > CACHED_UNITS:
            cache.clear()
            cache[SPACE] = struct.pack("<i", self.space)
        units = [_units(t) for t in texts]
        new = list(set().union(*units).difference(cache))
        # the library adds one mark in front, so a unit of k marks is k-1 spaces and its rest
        plain = [u[1:].replace(SPACE, " ") for u in new]
        cache.update(zip(new, [array("i", x).tobytes() for x in self.sp.encode(plain, num_threads=1)]))
        last = struct.pack("<i", self.end)
        return [np.frombuffer(b"".join([cache[u] for u in x]) + last, np.int32) for x in units]

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each (and the end) the original byte it stands for."""
        data = text.encode()
        if self.by_unit:  # nothing but spaces changes
            wide = (np.frombuffer(data, np.uint8) == 32).view(np.uint8) * np.uint8(2) + np.uint8(1)
            at = np.arange(-3, len(data) + 1, dtype=np.int32)[3 * (not data):]
            at[:3] = 0
            return (_MARK + data.replace(b" ", _MARK) if data else b"",
                    np.repeat(at, np.concatenate([np.ones(3 * bool(data), np.uint8), wide, np.ones(1, np.uint8)])))
        if not self.charmap:
            raw = np.frombuffer(data, np.uint8)
            at = np.arange(len(raw) + 1, dtype=np.int64)
            out = data
        else:
            parts, where, i = [], [], 0
            while i < len(data):
                hit = self.charmap.longest(data, i)
                size = hit[0] if hit else 1 + (data[i] >= 0xC0) + (data[i] >= 0xE0) + (data[i] >= 0xF0)
                new = hit[1] if hit else data[i:i + size]
                parts.append(new)
                where.extend([i] * len(new) if hit else range(i, i + size))
                i += size
            out, at = b"".join(parts), np.asarray([*where, len(data)], np.int64)
        if self.squeeze:
            keep = [m.span() for m in re.finditer(rb"[^ ]+(?: (?=[^ ]))?", out)]
            chosen = np.concatenate([np.arange(a, b) for a, b in keep]) if keep else np.zeros(0, np.int64)
            out, at = b"".join(out[a:b] for a, b in keep), np.append(at[chosen], at[-1])
        # every space, and the dummy prefix, becomes the three bytes of the mark
        wide = np.where(np.frombuffer(out, np.uint8) == 32, 3, 1)
        at = np.append(np.repeat(at[:-1], wide), at[-1])
        out = out.replace(b" ", _MARK)
        if self.dummy_prefix and out:
            at, out = np.append(np.full(3, at[0]), at), _MARK + out
        return out, at

    def spans(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Original byte spans [start, end) of each id, shape (n, 2).

        The dummy prefix stands at the first byte with no width, so pieces of
        a text cover it from the first byte to the last without overlap
        (several byte pieces of one mapped character share its start).
        """
        out, at = self.normalise(text)
        size = self.length[ids]
        if not self.sp_bytes and (size < 0).any():  # unknown ids take the rest of their run; there is one per run
            lens = size.tolist()
            pos = 0
            for i, n in enumerate(lens):
                if n < 0:
                    nxt = next((self.sp.id_to_piece(int(k)).encode() for k in ids[i + 1:] if self.length[k] > 0), None)
                    stop = out.find(nxt, pos + 1) if nxt else len(out)
                    lens[i] = n = (stop if stop >= 0 else len(out)) - pos
                pos += n
            size = np.asarray(lens, np.int64)
        edge = np.append(0, np.cumsum(size))
        if edge[-1] != len(out):
            raise ValueError(f"pieces cover {edge[-1]} of {len(out)} normalised bytes")
        return np.stack([at[edge[:-1]], at[edge[1:]]], axis=1)


@lru_cache(maxsize=1)
def _load(path: str) -> Model:
    return Model(path)


def model(path: str) -> Model:
    """Loaded once per Python worker."""
    claim("sentencepiece", _load.cache_clear)
    return _load(path)


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids array<int> (with the end id), spans
    array<struct<start,end>> (byte offsets in the UTF-8 text), text decoded from the ids."""

    def run(batches):
        m = model(model_path)
        for b in slices(batches, "text", 1 << 19):  # spans are many times a text
            texts = [t or "" for t in b.column("text").to_pylist()]
            ids = m.ids(texts)
            edge = pa.array(np.append(0, np.cumsum([len(x) for x in ids])), pa.int32())
            span = np.concatenate([m.spans(t, x) for t, x in zip(texts, ids)]).astype(np.int64)
            pair = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(span[:, i])) for i in (0, 1)], fields=list(SPAN))
            back = m.sp.decode([x.tolist() for x in ids], num_threads=1)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()),
                 pa.ListArray.from_arrays(edge, pa.array(np.concatenate(ids))), pa.ListArray.from_arrays(edge, pair),
                 pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids", "spans", "decoded"])

    return pick(docs, "doc_id", "text").selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids array<int>, spans array<struct<start:long,end:long>>, decoded string")


def encode_ids(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids array<int> (with the end id): what training reads."""

    def run(batches):
        m = model(model_path)
        for b in slices(batches, "text"):
            ids = m.ids([t or "" for t in b.column("text").to_pylist()])
            edge = np.append(0, np.cumsum([len(x) for x in ids]))
            lists = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(edge)), lists], ["doc_id", "n_tokens", "ids"])

    return pick(docs, "doc_id", "text").selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids array<int>")


def encode_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """The digests of ``encode``'s columns, for tables whose ids would not be
    kept: doc_id, n_tokens, ids_sha256, decoded_sha256, and n_spanned, the
    number of ids whose original span isn't empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                        ("decoded_sha256", pa.string()), ("n_spanned", pa.int64())])

    def run(batches):
        m = model(model_path)
        names = [str(i) for i in range(len(m.length))]
        for b in slices(batches, "text"):
            out = ([], [], [], [])
            texts = [t or "" for t in b.column("text").to_pylist()]
            ids = m.ids(texts)
            listed = [x.tolist() for x in ids]
            for text, x, row, back in zip(texts, ids, listed, m.sp.decode(listed, num_threads=1)):
                span = m.spans(text, x)
                out[0].append(len(row))
                out[1].append(hashlib.sha256(" ".join([names[i] for i in row]).encode()).hexdigest())
                out[2].append(hashlib.sha256(back.encode()).hexdigest())
                out[3].append(int(np.count_nonzero(span[:, 1] > span[:, 0])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, out)], schema=schema)

    return pick(docs, "doc_id", "text").selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_spanned long")
