"""SentencePiece encoding that keeps byte offsets, and decoding.

Normalisation is ours: the model's compiled character map, a double-array trie with
replacement strings, is walked for the longest matching prefix at every place, and every
byte of the normalised text records the byte of the original that it came from. White
space handling (dummy prefix, removal of extra spaces, the space symbol) follows the
model's settings and records its alignment in the same way. The library then only
segments: it is given a copy of the model, made in memory, whose normaliser does nothing.
A piece covers a run of normalised bytes, so its original byte span can be read off.

Ids are those of the library's own ``encode`` with an end id and without sampling; tests
hold them, and the texts decoded, against it.

Defined cases: a null text is an empty one; an empty text has the end id only; bytes
without a piece are byte pieces that share their character's span; repeated rows and
null ids keep their rows; very long texts are encoded whole; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import small_batches, tidied

SPACE = "▁"


# --- the model file ----------------------------------------------------------------------


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        out |= (b[i] & 127) << shift
        shift += 7
        i += 1
        if b[i - 1] < 128:
            return out, i


def _fields(b: bytes):
    """(number, wire type, value, bytes of the whole field) of a protocol buffer message."""
    i = 0
    while i < len(b):
        start = i
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            value, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        else:
            n = 8 if kind == 1 else 4
            value, i = b[i : i + n], i + n
        yield tag >> 3, kind, value, b[start:i]


def _written(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


#: Field numbers of the published model format.
PIECE, TRAINER, NORMALIZER = 1, 2, 3
CHARS_MAP, DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE = 2, 3, 4, 5
BYTE_PIECE, USER_PIECE = 6, 4
SUFFIX_FIELD = 24


class Model:
    """Settings and pieces of a model file, and a segmenter that doesn't normalise."""

    def __init__(self, raw: bytes):
        import sentencepiece

        self.pieces, self.kinds, spec, kept, suffix = [], [], {}, [], 0
        for number, _, value, whole in _fields(raw):
            if number == PIECE:
                f = {n: v for n, _, v, _ in _fields(value)}
                self.pieces.append(f.get(1, b"").decode())
                self.kinds.append(f.get(3, 1))
            if number == TRAINER:
                suffix = {n: v for n, _, v, _ in _fields(value)}.get(SUFFIX_FIELD, 0)
            if number == NORMALIZER:
                spec = {n: v for n, _, v, _ in _fields(value)}
            else:
                kept.append(whole)
        self.dummy_prefix = bool(spec.get(DUMMY_PREFIX, 1))
        self.remove_extra = bool(spec.get(REMOVE_EXTRA, 1))
        self.space = SPACE.encode() if spec.get(ESCAPE, 1) else b" "
        self.suffix = bool(suffix)
        self.map = CharacterMap(spec.get(CHARS_MAP, b""))
        self.held = sorted((p.encode() for p, k in zip(self.pieces, self.kinds) if k == USER_PIECE), key=len, reverse=True)
        nothing = b"".join([b"\x0a" + _written(8) + b"identity", b"\x18\x00", b"\x20\x00", b"\x28\x00"])
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=b"".join(kept) + b"\x1a" + _written(len(nothing)) + nothing)
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.sizes = np.array([1 if k == BYTE_PIECE else len(p.encode()) for p, k in zip(self.pieces, self.kinds)], np.int64)
        self.end, self.unknown = self.processor.eos_id(), self.processor.unk_id()


# --- normalisation -----------------------------------------------------------------------


class CharacterMap:
    """Longest-prefix replacement by a compiled map: size of the trie, its units, the strings."""

    def __init__(self, blob: bytes):
        n = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", n // 4, 4).tolist() if n else []
        self.strings = blob[4 + n :]
        self.first = self._first_bytes() if n else np.zeros(256, bool)

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def _first_bytes(self) -> np.ndarray:
        """Bytes with which some rule begins."""
        root = self._offset(self.units[0])
        return np.array([b != 0 and (root ^ b) < len(self.units) and self.units[root ^ b] & 0x800000FF == b for b in range(256)])

    def longest(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Length of the longest rule that begins at ``at`` and what replaces it; (0, b"") if none."""
        units, place, found = self.units, self._offset(self.units[0]), (0, b"")
        for i in range(at, len(data)):
            place ^= data[i]
            if data[i] == 0 or place >= len(units) or units[place] & 0x800000FF != data[i]:
                break
            unit = units[place]
            place ^= self._offset(unit)
            if unit >> 8 & 1:
                start = units[place] & 0x7FFFFFFF
                found = (i - at + 1, self.strings[start : self.strings.index(0, start)])
        return found


def _char_size(first: int) -> int:
    return 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


def mapped(model: Model, data: bytes) -> tuple[bytes, np.ndarray]:
    """The text after the character map, and the original byte of each of its bytes."""
    if not model.map.units and not model.held:
        return data, np.arange(len(data))
    starts = model.map.first.copy()
    for piece in model.held:
        starts[piece[0]] = True
    marked = np.flatnonzero(starts[np.frombuffer(data, np.uint8)]).tolist()
    out, origin, at = [], [], 0
    for i in marked:
        if i < at or data[i] & 0xC0 == 0x80:
            continue
        held = next((p for p in model.held if data.startswith(p, i)), None)
        n, new = (len(held), held) if held else model.map.longest(data, i) if model.map.units else (0, b"")
        if not n:
            continue
        out += [data[at:i], new]
        origin += [np.arange(at, i), np.arange(i, i + n) if held else np.full(len(new), i)]
        at = i + n
    out.append(data[at:])
    origin.append(np.arange(at, len(data)))
    return b"".join(out), np.concatenate(origin)


def normalised(model: Model, data: bytes) -> tuple[bytes, np.ndarray]:
    """Normalised bytes and, for each of them and the end, the original byte it came from."""
    text, origin = mapped(model, data)
    if model.remove_extra and text:
        raw = np.frombuffer(text, np.uint8)
        blank = raw == 0x20
        keep = ~blank | np.concatenate([[False], ~blank[:-1]])  # the first of each run, none in front
        keep[len(text.rstrip(b" ")) :] = False
        text, origin = raw[keep].tobytes(), origin[keep]
    if not text:
        return b"", np.array([len(data)])
    raw = np.frombuffer(text, np.uint8)
    size = np.ones(len(raw), np.int64)
    size[raw == 0x20] = len(model.space)
    out, origin = text.replace(b" ", model.space), np.repeat(origin, size)
    if model.dummy_prefix:
        n = len(model.space)
        if model.suffix:
            out, origin = out + model.space, np.concatenate([origin, np.full(n, len(data))])
        else:
            out, origin = model.space + out, np.concatenate([np.full(n, origin[0]), origin])
    return out, np.concatenate([origin, [len(data)]])


# --- encoding and decoding ---------------------------------------------------------------


def encode(model: Model, text: str | None) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Ids (end id last), and the original byte span [start, stop) of every piece.

    The dummy prefix and the end id have empty spans of their own; a space symbol spans
    the space it stands for.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    plain, origin = normalised(model, data)
    ids = model.segmenter.encode(plain.decode("utf-8", "replace")) if plain else []
    size = model.sizes[np.array(ids, np.int64)] if ids else np.zeros(0, np.int64)
    if model.unknown in ids:  # an unknown run is as long as what the pieces around it leave
        size = _unknown_sizes(model, ids, plain, size)
    stop = np.cumsum(size)
    first = stop - size
    shown = np.frombuffer(plain, np.uint8)
    begin = first.copy()
    while True:  # a byte piece inside a character spans the character
        inside = (begin > 0) & (begin < len(shown))
        inside[inside] = shown[begin[inside]] & 0xC0 == 0x80
        if not inside.any():
            break
        begin[inside] -= 1
    end = stop.copy()
    while True:
        inside = end < len(shown)
        inside[inside] = shown[end[inside]] & 0xC0 == 0x80
        if not inside.any():
            break
        end[inside] += 1
    return [*ids, model.end], np.append(origin[begin], len(data)), np.append(origin[end], len(data))


def _unknown_sizes(model: Model, ids: list[int], plain: bytes, size: np.ndarray) -> np.ndarray:
    proto = model.segmenter.encode(plain.decode("utf-8", "replace"), out_type="immutable_proto")
    return np.array([len(p.surface.encode()) for p in proto.pieces], np.int64) if len(proto.pieces) == len(ids) else size


def encoded(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, starts and stops (arrays; byte offsets into the original text)."""

    def run(batches):
        model = Model(open(model_path, "rb").read())
        for batch in batches:
            got = [encode(model, t) for t in batch.column(1).to_pylist()]
            arrays = [pa.array([g[k] for g in got], pa.list_(pa.int32())) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "ids", "starts", "stops"])

    small_batches(docs.sparkSession, 2 << 20)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, stops array<int>")


def decoded(rows: DataFrame, model_path: str) -> DataFrame:
    """doc_id and the text that ``ids`` decode to."""

    def run(batches):
        model = Model(open(model_path, "rb").read())
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.processor.decode(i) for i in batch.column(1).to_pylist()])], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, model_path: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and n_spanned, the original
    bytes that the pieces' spans cover; computed where the ids are made, so that these never
    leave the worker. ``carry`` names further columns to keep."""
    from pyspark.sql import types as T

    small_batches(docs.sparkSession)
    kept = [docs.schema[c] for c in carry]

    def run(batches):
        model = Model(open(model_path, "rb").read())
        for batch in batches:
            n, ids_sha, text_sha, spanned = [], [], [], []
            for text in batch.column("text").to_pylist():
                ids, start, stop = encode(model, text)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(model.processor.decode(ids).encode()).hexdigest())
                reach = np.maximum.accumulate(stop)
                before = np.concatenate([[0], reach[:-1]])
                spanned.append(int(np.maximum(0, stop - np.maximum(start, before)).sum()))
            columns = [pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha), pa.array(spanned, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[batch.column(c) for c in carry], *columns], [f.name for f in schema.fields])

    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            *kept,
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
            T.StructField("n_spanned", T.LongType()),
        ]
    )
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c for c in carry if c != "text"], "text").mapInArrow(tidied(run), schema)
