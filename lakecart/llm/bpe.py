"""Byte-level BPE encoding and decoding (operator 1).

A sentencepiece BPE model is serialised directly from a rank file: every byte becomes one
character, every token the string of its bytes' characters, scored by its negative rank,
with an identity normaliser.  Merging the best-scored adjacent pair is then the same as
merging the pair of lowest rank, so the ids equal the rank file's own.  Texts are cut by
the vocabulary's pattern; each pre-token is encoded by itself.  Decoding is the inverse
table from id to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textvec import groups, list_array, text_buffer

#: Byte b is the character FIRST_CHAR + b in the model (two UTF-8 bytes each, no spaces).
FIRST_CHAR = 0x100

#: A character outside the model.  It is the unknown piece, which nothing merges with, so
#: it separates the pre-tokens that are encoded in one call.
SEPARATOR = chr(FIRST_CHAR + 256)

#: White space as the patterns' ``\\s`` has it.
SPACES = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

#: Pre-tokens kept per worker; a full cache is emptied (bounds memory, not results).
CACHE_SIZE = 600_000

DIGEST = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                       T.StructField("decoded_sha256", T.StringType())])


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a rank file (base64 token and rank per line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _flag(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialize_model(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece ModelProto of a rank file.

    Piece 0 is the obligatory unknown piece, so piece id = rank + 1.  Ranks must be
    0..n-1; every single byte must be a token (true of byte-level vocabularies).
    """
    by_rank = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks are not consecutive from 0")
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("a byte-level vocabulary holds all 256 bytes")
    pieces = [_field(1, _field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _flag(3, 2))]
    for token, rank in by_rank:
        text = "".join(chr(FIRST_CHAR + b) for b in token).encode()
        pieces.append(_field(1, _field(1, text) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank))))
    trainer = (_flag(3, 2) + _flag(4, len(by_rank) + 1) + _flag(24, 0) + _flag(40, 0)
               + b"".join(_varint(k << 3) + b"\xff" * 9 + b"\x01" for k in (41, 42, 43)))  # no bos, eos, pad: -1
    normalizer = _field(1, b"identity") + _flag(3, 0) + _flag(4, 0) + _flag(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encoder and decoder of one vocabulary, with a cache of chunks.

    ``space_leads``: in the pattern a space is only ever the first character of a
    pre-token or part of a run of white space.  Texts can then be looked up by the chunks
    between single spaces (each chunk with the space before it), and the pattern runs on
    new chunks only.  Texts in which white space comes before a space are cut by the
    pattern as a whole, for there a run may reach over chunks.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, space_leads: bool = False):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(serialize_model(ranks))
        self.find = regex.compile(pattern).findall
        self.space_leads = space_leads
        self.runs = [c + " " for c in SPACES]
        self.tokens = [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.names = [str(i) for i in range(len(self.tokens))]
        self.ranks = ranks
        self.mapped = {b: FIRST_CHAR + b for b in range(256)}
        self.chunks: dict[str, bytes] = {}  # with a space before them
        self.heads: dict[str, bytes] = {}  # without one
        self.pretokens: dict[str, bytes] = {}

    def _encode_pretokens(self, pretokens: list[str]) -> list[bytes]:
        """Ids of pre-tokens, all in one call.  A pre-token that is a token as a whole is
        that token, as in the rank file's own encoder."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pretokens]
        out = [None if (whole := self.ranks.get(x)) is None else struct.pack("<I", whole) for x in raw]
        rest = [i for i, x in enumerate(out) if x is None]
        if rest:
            joined = SEPARATOR.join([raw[i].decode("latin-1").translate(self.mapped) for i in rest])
            ids = np.array(self.model.encode(joined, num_threads=1), np.int64)
            cut = np.flatnonzero(ids == 0)
            data = (ids - 1).astype(np.uint32).tobytes()
            starts = np.concatenate([[0], cut + 1]) * 4
            ends = np.concatenate([cut, [len(ids)]]) * 4
            for i, a, b in zip(rest, starts.tolist(), ends.tolist(), strict=True):
                out[i] = data[a:b]
        return out

    def _learn_chunks(self, chunks: list[str], first: bool) -> dict[str, bytes]:
        cut = [self.find(c if first else " " + c) for c in chunks]
        ids = iter(self._encode_pretokens([p for parts in cut for p in parts]))
        return {c: b"".join([next(ids) for _ in parts]) for c, parts in zip(chunks, cut, strict=True)}

    def _look_up(self, store: dict[str, bytes], keys: list[str], learn) -> list[bytes]:
        found = list(map(store.get, keys))
        if None in found:
            new = learn(list({k for k, f in zip(keys, found, strict=True) if f is None}))
            found = [new[k] if f is None else f for k, f in zip(keys, found, strict=True)]
            if len(store) + len(new) > CACHE_SIZE:
                store.clear()
            store.update(new)
        return found

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (uint32) of texts; what is new in them is encoded in one call."""
        out: list = [None] * len(texts)
        plain, slow = [], []
        for i, t in enumerate(texts):
            (plain if self.space_leads and not any(r in t for r in self.runs) else slow).append(i)
        if plain:
            keys = [texts[i].split(" ") for i in plain]
            head = self._look_up(self.heads, [k[0] for k in keys], lambda x: self._learn_chunks(x, True))
            rest = self._look_up(self.chunks, [c for k in keys for c in k[1:]], lambda x: self._learn_chunks(x, False))
            at = 0
            for i, k, h in zip(plain, keys, head, strict=True):
                out[i] = np.frombuffer(h + b"".join(rest[at: at + len(k) - 1]), np.uint32)
                at += len(k) - 1
        for i in slow:
            parts = self.find(texts[i])
            known = self._look_up(self.pretokens, parts,
                                  lambda x: dict(zip(x, self._encode_pretokens(x), strict=True)))
            out[i] = np.frombuffer(b"".join(known), np.uint32)
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids) -> bytes:
        """The bytes of some ids; an id outside the vocabulary is an error."""
        table = self.tokens
        return b"".join([table[i] for i in ids])


_codecs: dict[tuple[str, str, bool], Codec] = {}


def codec(path: str, pattern: str, space_leads: bool = False) -> Codec:
    """The worker's codec for a vocabulary file (built once per worker process)."""
    key = (path, pattern, space_leads)
    if key not in _codecs:
        _codecs[key] = Codec(read_ranks(path), pattern, space_leads)
    return _codecs[key]


def _texts(texts: pa.Array):
    """Groups of texts of about a megabyte, as Python strings."""
    _, offsets = text_buffer(texts)
    for a, b in groups(offsets, 1 << 20):
        yield [t or "" for t in texts.slice(a, b - a).to_pylist()]


def encode_ids(text: Column, path: str, pattern: str, space_leads: bool = False) -> Column:
    """``array<int>`` of a text's ids, null texts as empty texts.  The vocabulary file is
    installed with its package on every worker."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def run(texts: pa.Array) -> pa.Array:
        c = codec(path, pattern, space_leads)
        ids = [x for some in _texts(texts) for x in c.encode_all(some)]
        flat = np.concatenate(ids).view(np.int32) if ids else np.empty(0, np.int32)
        return list_array(flat, np.array([len(x) for x in ids], np.int64), pa.int32())

    return run(text)


def decode_ids(ids: Column, path: str, pattern: str, space_leads: bool = False) -> Column:
    """The bytes of an ``array<int>`` of ids; null gives null."""

    @F.arrow_udf(T.BinaryType())
    def run(lists: pa.Array) -> pa.Array:
        c = codec(path, pattern, space_leads)
        return pa.array([None if not x.is_valid else c.decode(x.as_py()) for x in lists], pa.binary())

    return run(ids)


def round_trip_digest(text: Column, path: str, pattern: str, space_leads: bool = False) -> Column:
    """Encode a text, decode its ids, and return counts and digests of both, without
    moving the ids out of the worker."""

    @F.arrow_udf(DIGEST)
    def run(texts: pa.Array) -> pa.Array:
        c = codec(path, pattern, space_leads)
        n, of_ids, of_bytes = [], [], []
        for some in _texts(texts):
            for ids in c.encode_all(some):
                listed = ids.tolist()
                n.append(len(listed))
                of_ids.append(hashlib.sha256(",".join([c.names[i] for i in listed]).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(c.decode(listed)).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(of_ids, pa.string()),
                                           pa.array(of_bytes, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return run(text)


def byte_bpe_round_trip(docs: DataFrame, path: str, pattern: str, space_leads: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every text.

    One row per input row, in no order; a null or empty text has no tokens and the
    digests of the empty string; a null ``doc_id`` stays null; repeated rows are
    repeated; very long texts are encoded whole; an empty table gives an empty result.
    """
    out = docs.select("doc_id", round_trip_digest(F.col("text"), path, pattern, space_leads).alias("d"))
    return out.select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")
