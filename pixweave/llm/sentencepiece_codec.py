"""SentencePiece encoding and decoding with byte offsets into the original text.

The text is normalised here, by longest-prefix matches in the model's compiled character map (a double-array trie over
bytes), and for every normalised byte the original byte that it came from is noted. The library segments the normalised
text into ids. The pieces of a segmentation, put end to end, spell the normalised text, so the running sum of their lengths,
looked up in that alignment, is every piece's span of original bytes.

Edge cases: a null text counts as empty and has the begin and end ids only; very long texts are encoded whole; repeated
rows and null ids keep a row each; an empty table gives an empty result; other columns are ignored or passed through.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import tidied


SPACE = "\u2581".encode()


class Normalizer:
    """Longest-prefix normalisation through a compiled character map; ``align`` has one entry more than the result."""

    def __init__(self, charsmap: bytes = b"", dummy_prefix: bool = True, squeeze: bool = False, escape: bool = True, suffix: bool = False, symbols: tuple[bytes, ...] = ()):
        self.dummy_prefix, self.squeeze, self.suffix = dummy_prefix, squeeze, suffix
        self.space = SPACE if escape else b" "
        self.symbols = sorted(symbols, key=len, reverse=True)
        self.units, self.texts = (), b""
        if charsmap:
            n = struct.unpack_from("<I", charsmap)[0]
            self.units = struct.unpack_from(f"<{n // 4}I", charsmap, 4)
            self.texts = charsmap[4 + n :]

    def _match(self, raw: bytes, at: int) -> tuple[bytes, int]:
        """What the longest rule that fits at ``at`` puts there, and how many bytes it reads."""
        for s in self.symbols:
            if raw.startswith(s, at):
                return s, len(s)
        found = None
        if units := self.units:
            place = units[0] >> 10 << ((units[0] & 512) >> 6)
            for k in range(at, len(raw)):
                place ^= raw[k]
                if place >= len(units) or units[place] & 0x800000FF != raw[k]:
                    break
                unit = units[place]
                place ^= unit >> 10 << ((unit & 512) >> 6)
                if unit >> 8 & 1:
                    found = (units[place] & 0x7FFFFFFF, k + 1 - at)
        if found:
            start = found[0]
            return self.texts[start : self.texts.index(0, start)], found[1]
        lead = raw[at]
        n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return raw[at : at + n], n

    def __call__(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        if not raw:
            return b"", np.zeros(1, np.int64)
        if not self.units and not self.symbols and not self.squeeze and not self.suffix:
            return self._plain(raw)
        out, align, at, n = bytearray(), [], 0, len(raw)
        if self.squeeze:
            while at < n:
                s, k = self._match(raw, at)
                if s != b" ":
                    break
                at += k
        if at == n:
            return b"", np.array([n], np.int64)
        if self.dummy_prefix and not self.suffix:
            out += self.space
            align += [at] * len(self.space)
        after_space = self.squeeze
        while at < n:
            s, k = self._match(raw, at)
            while after_space and s.startswith(b" "):
                s = s[1:]
            same = s == raw[at : at + k]  # a character left as it is: its bytes stand for themselves
            for i, one in enumerate(s):
                put = self.space if one == 32 else bytes([one])
                out += put
                align += [at + i if same else at] * len(put)
            if s:
                after_space = self.squeeze and s.endswith(b" ")
            at += k
        end = n
        if self.squeeze:
            while out.endswith(self.space):
                end = align[len(out) - len(self.space)]
                del out[-len(self.space) :], align[-len(self.space) :]
        if self.dummy_prefix and self.suffix:
            out += self.space
            align += [end] * len(self.space)
        return bytes(out), np.array([*align, end], np.int64)

    def _plain(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        """Without a map only spaces change: the same alignment, for all bytes at once."""
        size = np.ones(len(raw), np.int64)
        size[np.frombuffer(raw, np.uint8) == 32] = len(self.space)
        head = len(self.space) if self.dummy_prefix else 0
        align = np.concatenate([np.zeros(head, np.int64), np.repeat(np.arange(len(raw)), size), [len(raw)]])
        return (self.space if self.dummy_prefix else b"") + raw.replace(b" ", self.space), align


class Codec:
    """A model's encoder with spans, and its decoder.

    The library only ever sees normalised text, through a copy of the model that changes nothing itself. If no piece
    goes on past a space or holds a line feed beside other characters, no merge can cross these places, and the parts
    between them are segmented on their own and remembered: the same ids, as every merge stays inside a part.
    """

    #: Parts remembered at most; then all are forgotten.
    REMEMBERED = 50_000

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto.FromString(model)
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        norm = spec.normalizer_spec
        symbols = tuple(p.piece.encode() for p in spec.pieces if p.type == kinds.USER_DEFINED)
        self.normalize = Normalizer(norm.precompiled_charsmap, norm.add_dummy_prefix, norm.remove_extra_whitespaces, norm.escape_whitespaces, spec.trainer_spec.treat_whitespace_as_suffix, symbols)
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bos, self.eos = self.sp.bos_id(), self.sp.eos_id()
        self.strips = norm.add_dummy_prefix or norm.remove_extra_whitespaces
        self.length = np.array([1 if p.type == kinds.BYTE else -1 if p.type == kinds.UNKNOWN else 0 if p.type == kinds.CONTROL else len(p.piece.encode()) for p in spec.pieces], np.int64)
        self.piece = [bytes([int(p.piece[3:-1], 16)]) if p.type == kinds.BYTE else b"" if p.type == kinds.CONTROL else None if p.type == kinds.UNKNOWN else p.piece.encode().replace(SPACE, b" ") for p in spec.pieces]
        inner = [p.piece for p in spec.pieces if p.type in (kinds.NORMAL, kinds.USER_DEFINED) and len(p.piece) > 1]
        self.parts = None
        if spec.trainer_spec.model_type == 2 and not any("\n" in p or re.search("[^\u2581]\u2581", p) for p in inner):
            self.parts = re.compile("\n+|\u2581+[^\u2581\n]*|[^\u2581\n]+")
        norm.precompiled_charsmap = b""
        norm.add_dummy_prefix = norm.remove_extra_whitespaces = norm.escape_whitespaces = False
        spec.trainer_spec.treat_whitespace_as_suffix = False
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        self.known: dict[str, bytes] = {}

    def _segment(self, norm: str) -> bytes:
        """The ids of normalised text, as little-endian unsigned 32-bit integers."""
        if self.parts is None:
            return np.array(self.plain.encode(norm), "<u4").tobytes()
        parts, known = self.parts.findall(norm), self.known
        if new := set(parts).difference(known):
            if len(known) + len(new) > self.REMEMBERED:
                known.clear()
                new = set(parts)
            new = list(new)
            for p, ids in zip(new, self.plain.encode(new, num_threads=1), strict=True):
                known[p] = struct.pack(f"<{len(ids)}I", *ids)
        return b"".join([known[p] for p in parts])

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids with begin and end ids, and each id's first and last original byte (half open)."""
        norm, align = self.normalize((text or "").encode())
        inner = np.frombuffer(self._segment(norm.decode()), "<u4")
        ids = np.empty(len(inner) + 2, "<u4")
        ids[0], ids[1:-1], ids[-1] = self.bos, inner, self.eos
        size = self.length[ids]
        if (size < 0).any():  # unknown pieces have no length of their own
            size[1:-1] = [len(p.surface.encode()) for p in self.plain.encode(norm.decode(), out_type="proto").pieces]
        ends = np.cumsum(size)
        if ends[-1] != len(norm):  # pieces that don't spell the normalised text; no public model has been seen to do so
            return self._by_library(text or "")
        marks = align[ends]
        return ids, np.concatenate([align[:1] * 0, marks[:-1]]), marks

    def _by_library(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``encode`` by the library's own ids and places."""
        pieces, size = self.sp.encode(text, out_type="proto").pieces, len(text.encode())
        ids = np.array([self.bos, *(p.id for p in pieces), self.eos], "<u4")
        return ids, np.array([0, *(p.begin for p in pieces), size]), np.array([0, *(p.end for p in pieces), size])

    def decode(self, ids: np.ndarray) -> str:
        """The library's decode: pieces put end to end, without the space that normalisation put in front."""
        try:
            raw = b"".join([self.piece[i] for i in ids.tolist()])
            return (raw[1:] if self.strips and raw[:1] == b" " else raw).decode()
        except (TypeError, UnicodeDecodeError):  # unknown pieces, or bytes that aren't UTF-8: the library's own signs
            return self.sp.decode(ids.tolist())


_codecs: dict[bytes, Codec] = {}


def codec_of(model: bytes) -> Codec:
    """The model's codec, made once in a Python worker."""
    key = hashlib.sha256(model).digest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(model)
    return _codecs[key]


def _mapped(docs: DataFrame, model_path: str, row, schema: T.StructType) -> DataFrame:
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    kinds = {T.LongType: pa.int64(), T.StringType: pa.string(), T.ArrayType: pa.list_(pa.int32())}
    out = [kinds.get(type(f.dataType)) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [row(codec, x) for x in part.column(1).to_pylist()]
                columns = [part.column(0), *(pa.array([r[i] for r in rows], out[i + 1]) for i in range(len(schema) - 1))]
                yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())
        codec.known.clear()  # the worker goes on to other tasks

    return docs.select("doc_id", "text").mapInArrow(lambda batches: tidied(run(batches)), schema)


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, begins, ends): the ids of every text with each piece's span of original UTF-8 bytes."""
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([docs.schema["doc_id"], T.StructField("ids", ints), T.StructField("begins", ints), T.StructField("ends", ints)])
    return _mapped(docs, model_path, lambda codec, text: codec.encode(text), schema)


def _digest(codec: Codec, text: str | None) -> tuple:
    ids, begins, ends = codec.encode(text)
    decoded = codec.decode(ids)
    spans = np.stack([begins, ends], 1).astype("<u4")
    return len(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), hashlib.sha256(spans).hexdigest(), int((ends - begins).sum())


def digest(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document the number of ids, digests of ids, decoded text and spans, and the bytes that the spans cover."""
    s, n = T.StringType(), T.LongType()
    names = (("n_tokens", n), ("ids_sha256", s), ("decoded_sha256", s), ("spans_sha256", s), ("covered_bytes", n))
    return _mapped(docs, model_path, _digest, T.StructType([docs.schema["doc_id"], *(T.StructField(*x) for x in names)]))


def encoded(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every text."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return _mapped(docs, model_path, lambda codec, text: (len(ids := codec.encode(text)[0]), ids.astype(np.int32)), schema)


def decoded(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text, n_tokens): every text after a round trip through ids."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("text", T.StringType()), T.StructField("n_tokens", T.LongType())])
    return _mapped(docs, model_path, lambda codec, text: (codec.decode(ids := codec.encode(text)[0]), len(ids)), schema)
