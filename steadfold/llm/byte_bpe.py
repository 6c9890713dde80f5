"""Byte-level BPE by a sentencepiece model that is serialised directly from a rank file, and its inverse."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .recent import MARKS, Recent, groups


def byte_letters() -> list[str]:
    """One printable character for every byte: bytes that are printable in Latin-1 stand for themselves, the others
    take the code points from 256 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, each at its rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    ranked = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(ranked) != list(range(len(ranked))):
        raise ValueError("ranks must be 0, 1, 2, ... without a gap")
    return [ranked[i] for i in range(len(ranked))]


def _varint(n: int) -> bytes:
    out = b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protocol-buffer field: length-delimited, varint or 32-bit float, by the value's type."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model: token i is piece i in byte letters, scored -i, so that the lowest rank merges first.
    The unknown piece comes after them (it is never met: all 256 bytes are pieces)."""
    letters = byte_letters()
    pieces = [_field(1, _field(1, "".join(letters[b] for b in t).encode()) + _field(2, -float(i)) + _field(3, 1)) for i, t in enumerate(tokens)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens)) + b"".join(_field(k, -1 % 2**64) for k in (41, 42, 43))
    normalizer = _field(1, b"identity") + b"".join(_field(k, 0) for k in (3, 4, 5))
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class ByteBPE:
    """Encodes by the ranks at path: each match of pattern separately, a match that is itself a token as that token."""

    #: A cut before a space that a non-space follows never changes the matches: a match has a space at its start or
    #: consists of white space alone, and the run before the cut then ends where its lookahead would end it.
    CUT, ODD = re.compile(r" (?=\S)"), re.compile(r" (?!\S)")

    def __init__(self, path: str, pattern: str):
        self.tokens = read_ranks(path)
        self.ranks = {t: i for i, t in enumerate(self.tokens)}
        self.letters = byte_letters()
        self.table = {b: x for b, x in enumerate(self.letters)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.tokens))
        back = {x: b for b, x in enumerate(self.letters)}
        self.pieces = [bytes(back[x] for x in self.model.id_to_piece(i)) for i in range(len(self.tokens))]
        self.matches = regex.compile(pattern).findall
        self.simple = all(self.matches(x) == y for x, y in ((" ab.", [" ab", "."]), ("ab", ["ab"]), (" éß!", [" éß", "!"])))
        self.known = Recent(self._matches_to_ids)
        self.chunks = Recent(self._chunks_to_ids)

    def _matches_to_ids(self, matches: list[str]) -> list[bytes]:
        raw = [m.encode() for m in matches]
        whole = [self.ranks.get(r) for r in raw]
        merged = iter(self.model.encode([r.decode("latin-1").translate(self.table) for r, w in zip(raw, whole) if w is None], num_threads=1))
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in ([w] if w is not None else next(merged) for w in whole)]

    def _chunks_to_ids(self, chunks: list[str]) -> list[bytes]:
        lists = []
        for chunk in chunks:
            text = chunk[1:] if chunk[0] == " " else " " + chunk  # see encode()
            body = text[1:] if text[:1] == " " else text
            if self.simple and body.isalpha():
                lists.append([text])
            elif self.simple and body[-1:] in MARKS and body[:-1].isalpha():
                lists.append([text[:-1], text[-1]])
            else:
                lists.append(self.matches(text))
        return self.known.joined(lists)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts, as little-endian unsigned 32-bit integers."""
        cut = []
        for text in texts:
            first, *rest = self.CUT.split(text) if self.ODD.search(text) else text.split(" ")
            rest.insert(0, " " + first)  # no other chunk begins with a space: theirs is left out
            cut.append(rest)
        return self.chunks.joined(cut)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def codec(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = True, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (little-endian unsigned 32-bit integers) and
    decoded (bytes). One row for each row of docs, in any order; a null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            out: list[tuple] = []
            for ids in (ids for texts in groups(x.as_py() for x in batch.column(1)) for ids in bpe.encode(texts)):
                decoded = bpe.decode(ids)
                out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest(), *([ids, decoded] if with_ids else [])))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary()]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds[: 5 if with_ids else 3]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded binary" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
