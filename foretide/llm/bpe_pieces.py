"""Byte-level BPE by a sentencepiece model that is serialised from a rank file.

Each token's bytes become characters (one per byte value), scored by negative rank, with identity
normalisation, so that sentencepiece's best-score merges are the rank merges.  Pre-tokens are
encoded one by one; a pre-token that is itself a token is that token, as rank encoders have it.
Decoding maps ids to bytes and joins them.

Defined cases: a null or empty text has no ids and decodes to no bytes; text of any length is
encoded whole; repeated rows are encoded one by one; other columns pass through untouched.
"""
from __future__ import annotations

import base64
import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import Shipped, give_back, released, worker_cache

#: Pre-tokens kept by a worker at a time, with their ids.
CACHE = 300_000
#: Texts of these characters only are split by `re`, whose classes agree there with the pattern's.
ODD_RE = re.compile("[^\t-\r -~¡-±´-¸º»¿-ɏ‐-‧€]")
FAST_RE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Unicode White_Space, which `\s` means in the libraries that the pattern is written for.
SPACE = r"\t-\r\x20\x85\xa0  -     　"


def splitter(pattern: str):
    """A function from a text to its pre-tokens."""
    exact = regex.compile(pattern.replace(r"[^\s", rf"[^{SPACE}").replace(r"\S", rf"[^{SPACE}]").replace(r"\s", rf"[{SPACE}]"))

    def split(text: str) -> list[str]:
        return exact.findall(text) if ODD_RE.search(text) else FAST_RE.findall(text)

    return split


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


#: One character for each byte value, away from white space and from the pieces' own mark.
BYTE_CHARS = "".join(chr(0x100 + b) for b in range(256))
TO_BYTE = {ord(c): b for b, c in enumerate(BYTE_CHARS)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: pieces in order of rank, then the unknown piece."""
    out = bytearray()
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        piece = token.decode("latin-1").translate({b: BYTE_CHARS[b] for b in range(256)}).encode()
        out += _field(1, _field(1, piece) + _field(2, -float(rank)))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(ranks) + 1) + _field(40, len(ranks)) + _field(41, (1 << 64) - 1) + _field(42, (1 << 64) - 1) + _field(43, (1 << 64) - 1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(out + _field(2, trainer) + _field(3, normalizer))


class PieceCodec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import sentencepiece

        self.split, self.ranks = splitter(pattern), ranks
        order = sorted(ranks.items(), key=lambda x: x[1])
        self.by_piece = [r for _, r in order]  # ranks may have gaps; pieces have none
        self.dense = all(i == r for i, r in enumerate(self.by_piece))
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        # The inverse mapping: where each id's bytes begin among all, and how many they are.
        self.size = np.zeros(self.by_piece[-1] + 1 if order else 0, np.int64)
        self.size[self.by_piece] = [len(b) for b, _ in order]
        self.known = np.zeros(len(self.size), bool)
        self.known[self.by_piece] = True
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(b for b, _ in order), np.uint8)
        #: pre-token -> ids as packed 32-bit integers, and in decimal where asked for
        self.packed: dict[str, bytes] = {}
        self.said: dict[str, str] = {}

    def piece_ids(self, token: str) -> list[int]:
        raw = token.encode("utf-8", "surrogatepass")
        if (whole := self.ranks.get(raw)) is not None:
            return [whole]
        ids = self.model.encode(raw.decode("latin-1").translate(BYTE_TABLE), out_type=int, num_threads=1)
        return ids if self.dense else [self.by_piece[i] for i in ids]

    def _look(self, token: str) -> bytes:
        if len(self.packed) >= CACHE:
            self.clear()
        found = self.packed[token] = np.array(self.piece_ids(token), "<u4").tobytes()
        return found

    def clear(self) -> None:
        self.packed.clear()
        self.said.clear()

    def encode(self, text: str) -> np.ndarray:
        get, look = self.packed.get, self._look
        return np.frombuffer(b"".join([get(t) or look(t) for t in self.split(text)]), "<u4")

    def _say(self, token: str) -> str:
        ids = np.frombuffer(self.packed.get(token) or self._look(token), "<u4")
        found = self.said[token] = ",".join(map(str, ids.tolist()))
        return found

    def encode_text(self, text: str) -> tuple[np.ndarray, str]:
        """The ids, and the ids in decimal joined by commas."""
        tokens = self.split(text)
        get, look = self.packed.get, self._look
        ids = np.frombuffer(b"".join([get(t) or look(t) for t in tokens]), "<u4")
        said, say = self.said.get, self._say
        return ids, ",".join([said(t) or say(t) for t in tokens])

    def decode(self, ids) -> bytes:
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return b""
        if ids.min() < 0 or ids.max() >= len(self.size) or not self.known[ids].all():
            raise KeyError("an id that the vocabulary has not")
        size = self.size[ids]
        upto = np.cumsum(size)
        return self.bytes[np.repeat(self.begin[ids] - (upto - size), size) + np.arange(int(upto[-1]))].tobytes()


BYTE_TABLE = {b: BYTE_CHARS[b] for b in range(256)}


def codec(file: Shipped, pattern: str) -> PieceCodec:
    kept, key = worker_cache(), ("pieces", file.key, pattern)
    if key not in kept:
        kept[key] = PieceCodec(read_ranks(file.data), pattern)
    return kept[key]


def id_lists(ids: list[np.ndarray]) -> pa.Array:
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([np.zeros(0, "<u4"), *ids]).astype(np.int32)))


def _free(docs: DataFrame, *names: str) -> None:
    for n in names:
        if n in docs.columns:
            raise ValueError(f"the table has a column {n} already: name another")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: each text encoded, its ids decoded."""

    def run(batches):
        own = codec(file, pattern)
        for b in batches:
            n, a, z = [], [], []
            for text in b.column(1):
                ids, said = own.encode_text(text.as_py() or "")
                n.append(len(ids))
                a.append(hashlib.sha256(said.encode()).hexdigest())
                z.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(z, pa.string())], names=names)

    file, kind = Shipped(docs.sparkSession, path), docs.schema[id_col].dataType
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
    return docs.select(id_col, text_col).mapInArrow(run, T.StructType([T.StructField(id_col, kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]))


def round_trip(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "token_ids", same_col: str = "round_trip") -> DataFrame:
    """All columns of docs, the ids of each text, and whether their inverse mapping gives it again.
    A table that has a column of either name raises."""
    _free(docs, out_col, same_col)
    file, at = Shipped(docs.sparkSession, path), docs.columns.index(text_col)

    def run(batches):
        own = codec(file, pattern)
        try:
            for b in batches:
                texts = [x.as_py() or "" for x in b.column(at)]
                ids = [own.encode(t) for t in texts]
                same = pa.array([own.decode(i) == t.encode("utf-8", "surrogatepass") for i, t in zip(ids, texts)])
                lists = id_lists(ids)
                yield pa.RecordBatch.from_arrays([*b.columns, lists, same], schema=b.schema.append(pa.field(out_col, lists.type)).append(pa.field(same_col, same.type)))
        finally:
            own.clear()
            give_back()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out_col, T.ArrayType(T.IntegerType())), T.StructField(same_col, T.BooleanType())]))


def encode_column(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """All columns of docs plus the ids of each text as an array of int (null text: empty).  A table
    that has such a column raises."""
    _free(docs, out_col)
    file, at = Shipped(docs.sparkSession, path), docs.columns.index(text_col)

    def run(batches):
        own = codec(file, pattern)
        for b in batches:
            ids = id_lists([own.encode(x.as_py() or "") for x in b.column(at)])
            yield pa.RecordBatch.from_arrays([*b.columns, ids], schema=b.schema.append(pa.field(out_col, ids.type)))

    return docs.mapInArrow(released(run), T.StructType([*docs.schema.fields, T.StructField(out_col, T.ArrayType(T.IntegerType()))]))


def decode_column(df: DataFrame, path: str, pattern: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """All columns of df plus the bytes that each row's ids stand for (null ids: no bytes).  A table that
    has such a column raises."""
    _free(df, out_col)
    file, at = Shipped(df.sparkSession, path), df.columns.index(ids_col)

    def run(batches):
        own = codec(file, pattern)
        for b in batches:
            raw = pa.array([own.decode(x.as_py() or ()) for x in b.column(at)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, raw], schema=b.schema.append(pa.field(out_col, raw.type)))

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out_col, T.BinaryType())]))
