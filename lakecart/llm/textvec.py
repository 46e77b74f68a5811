"""Vectorised tokenising of a whole Arrow batch of texts.

Texts stay in the batch's UTF-8 buffer.  Word boundaries are found with byte tables (all
bytes of a non-ASCII character are >= 0x80, so byte classes are exact for the words the
operators define) and every word gets a 64-bit hash from differences of a running
polynomial sum, so no Python object is made per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are cut into groups of about this many bytes (never inside a text): it bounds
#: the size of the work arrays, not what is processed.
CHUNK_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Words are runs of anything but space and \t \n \v \f \r.
SPACE_WORDS = np.ones(256, dtype=bool)
SPACE_WORDS[[32, 9, 10, 11, 12, 13]] = False

#: Words are runs of digits, letters a-z (after lower-casing) and non-ASCII characters.
ALNUM_WORDS = np.zeros(256, dtype=bool)
ALNUM_WORDS[48:58] = ALNUM_WORDS[65:91] = ALNUM_WORDS[97:123] = ALNUM_WORDS[128:] = True

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_CODE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers = {"fwd": np.ones(1, np.uint64), "inv": np.ones(1, np.uint64)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["fwd"]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        for name, base in (("fwd", _P), ("inv", _P_INV)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table)
    return _powers["fwd"], _powers["inv"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (all bits of the result depend on all bits of x)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def text_buffer(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string array; nulls count as empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset: texts.offset + len(texts) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), off


_kept: dict = {}


def kept(key: tuple, build):
    """An object that a worker keeps for the batches to come (a tokenizer, say), one at a
    time: another key, or another operator's :func:`release`, lets it go."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = build()
    return _kept[key]


def release(keep: bool = False) -> None:
    """Give memory back to the system: workers live on between tasks, stages and jobs.
    Without ``keep`` what an operator kept goes too."""
    if not keep:
        _kept.clear()
    _powers.update(fwd=np.ones(1, np.uint64), inv=np.ones(1, np.uint64))
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def groups(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes each; a longer text is a range of its own."""
    first = 0
    n = len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


class Words:
    """The words of some texts: ``hash``, byte range ``start``/``end`` (within ``data``),
    and ``first``: index of each text's first word (one entry more than texts)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
        base = int(offsets[0])
        raw = data[base: int(offsets[-1])]
        inside = kind[raw]
        before = np.empty(len(raw) + 1, bool)
        before[0] = before[-1] = False
        before[1:] = inside
        cut = (offsets[:-1] - base)[offsets[:-1] < offsets[-1]]
        prev = before[:-1].copy()
        prev[cut] = False
        nxt = np.empty(len(raw), bool)
        nxt[:-1] = inside[1:]
        if len(raw):
            nxt[-1] = False
            nxt[cut[cut > 0] - 1] = False
        start = np.flatnonzero(inside & ~prev)
        end = np.flatnonzero(inside & ~nxt) + 1
        fwd, inv = _power_tables(len(raw))
        run = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE_CODE[_LOWER[raw]] * fwd[: len(raw)], out=run[1:])
        self.hash = mix((run[end] - run[start]) * inv[start])
        self.start = start + base
        self.end = end + base
        self.first = np.searchsorted(start, offsets - base)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def word_hash(word: bytes) -> int:
    """The hash that :class:`Words` gives this word."""
    data = np.frombuffer(word, np.uint8)
    return int(Words(data, np.array([0, len(data)]), np.ones(256, bool)).hash[0])


_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB,
                                0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def ngram_hash(words: np.ndarray, n: int, skip: int = 0) -> np.ndarray:
    """Order-dependent hash of every n consecutive word hashes; ``skip`` words are left
    out after the first (skip-grams)."""
    span = n + skip
    if len(words) < span:
        return np.empty(0, np.uint64)
    m = len(words) - span + 1
    out = np.full(m, np.uint64(n * 16 + skip), np.uint64)
    for j in range(n):
        at = j if j == 0 else j + skip
        out = (out ^ words[at: at + m]) * _STEP[j % len(_STEP)]
        out ^= out >> np.uint64(29)
    return mix(out)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; with fewer words the whole sequence
    is the only shingle; without words the set is empty."""
    if len(words) == 0:
        return np.empty(0, np.uint64)
    return np.unique(ngram_hash(words, min(n, len(words))))


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark longs."""
    return x.view(np.int64)


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list array from flat values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
