"""Packing token sequences by a configuration linear program (operator 10).

Documents become pieces of at most ``capacity`` tokens.  Only the histogram of piece
lengths (at most ``capacity`` rows) reaches the driver.  There the configuration program
(use as few sequences as possible; a configuration is a multiset of lengths that fits) is
solved by multiplicative weights: each length has a price, the dearest configuration is
found by a knapsack dynamic program over the capacity, it is used a share of the times
that its scarcest length allows, and prices of lengths that lag behind rise
multiplicatively.  Rounded down, this leaves pieces that best-fit decreasing places, also
on the histogram.  Configurations then become slots: the r-th piece of a length goes to the
r-th slot of that length, so pieces are numbered within lengths in Spark and nothing else
moves.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .common import materialize
from .textvec import groups, kept, release, text_buffer

CACHE_SIZE = 150_000
PIECE = T.ArrayType(T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
                                  T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
                                  T.StructField("ids", T.BinaryType())]))


#: Words of these characters only (Latin letters, digits, punctuation) have the same lower
#: case and composition in Python as in the tokenizer.
_LATIN = regex.compile(r"[\x01-\u012F\u0131-\u024F\u2010-\u2027]+").fullmatch
_PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
#: Byte that ends a word in the merging vocabulary.
_STOP = "\0"


def _byte_characters() -> dict[str, int]:
    """Character of a byte-level vocabulary -> byte: printable bytes are themselves, the
    others follow from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class WordTokenizer:
    """Ids of texts by a ``tokenizers`` file whose pre-tokens never reach over white space;
    ids of the words between ASCII white space are kept, for words come back.

    New words of Latin characters are merged in one call over the file's own vocabulary,
    its ids as ranks (a word-end token ends in a stop byte); all others go to the tokenizer.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        special = {t.content for t in self.model.get_added_tokens_decoder().values()}
        #: words with a special token in them go to the tokenizer, which gives it its own id
        self.special = [s.encode() for s in special]
        bytes_of = _byte_characters()
        ranks = {}
        for token, i in self.model.get_vocab(with_added_tokens=True).items():
            if token not in special:
                core = token.removesuffix("</w>")
                ranks[bytes(bytes_of[c] for c in core) + (b"\0" if core != token else b"")] = i
        self.ends = np.zeros(max(ranks.values()) + 1, bool)
        self.ends[[i for x, i in ranks.items() if x.endswith(b"\0") and len(x) > 1]] = True
        self.merger = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.known: dict[bytes, bytes] = {}

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words that are not kept."""
        out, plain, pieces, counts = {}, [], [], []
        everything = b" ".join(words)
        special = [s for s in self.special if s in everything]
        for w in words:
            if special and any(s in w for s in special):
                lower = None
            elif w.isascii():
                lower = None if b"\0" in w else w.lower().decode()
            else:
                text = w.decode()
                lower = unicodedata.normalize("NFC", text).lower() if _LATIN(text) else None
            if lower is not None:
                parts = [lower] if lower.isalpha() else _PRETOKEN(lower)
                plain.append(w)
                pieces += parts
                counts.append(len(parts))
            else:
                out[w] = np.array(self.model.encode(w.decode(), add_special_tokens=False).ids, np.uint32).tobytes()
        if pieces:
            ids = np.array(self.merger.encode_ordinary(_STOP.join(pieces) + _STOP), np.uint32)
            stops = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1]) * 4
            cut = stops[np.concatenate([[0], np.cumsum(counts)])].tolist()
            data = ids.tobytes()
            out.update((w, data[a:b]) for w, a, b in zip(plain, cut, cut[1:], strict=False))
        else:
            out.update(dict.fromkeys(plain, b""))
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        words = [t.encode("utf-8", "replace").split() for t in texts]
        flat = [w for some in words for w in some]
        found = list(map(self.known.get, flat))
        if None in found:
            learnt = self._learn(list({w for w, f in zip(flat, found, strict=True) if f is None}))
            found = [learnt[w] if f is None else f for w, f in zip(flat, found, strict=True)]
            if len(self.known) + len(learnt) > CACHE_SIZE:
                self.known.clear()
            self.known.update(learnt)
        out, at = [], 0
        for some in words:
            out.append(b"".join(found[at: at + len(some)]))
            at += len(some)
        return out


def tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer for a file (kept while the worker tokenizes)."""
    return kept(("tokenizer", path), lambda: WordTokenizer(path))


def pieces_of(text: Column, path: str, end_id: int, capacity: int, with_ids: bool) -> Column:
    """Pieces of a text's ids and the end id; a null text is empty (the end id alone)."""
    tail = np.array([end_id], np.uint32).tobytes()
    size = 4 * capacity

    @F.arrow_udf(PIECE)
    def run(texts: pa.Array) -> pa.Array:
        rows = []
        _, offsets = text_buffer(texts)
        for a, b in groups(offsets, 1 << 20):
            for ids in tokenizer(path).encode_all([t or "" for t in texts.slice(a, b - a).to_pylist()]):
                ids += tail
                cut = [ids[k: k + size] for k in range(0, len(ids), size)]
                rows.append([{"piece": k, "start": k * capacity, "length": len(x) // 4, "ids_crc32": zlib.crc32(x),
                              "ids": x if with_ids else None} for k, x in enumerate(cut)])
        release(keep=True)
        return pa.array(rows, pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                                                  ("ids_crc32", pa.int64()), ("ids", pa.binary())])))

    return run(text)


def dearest(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> Counter:
    """Knapsack pricing: the multiset of lengths of largest total price that fits."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(lengths[0]), capacity + 1):
        n = int(np.searchsorted(lengths, c, "right"))
        value = prices[:n] + best[c - lengths[:n]]
        k = int(value.argmax())
        if value[k] > best[c - 1]:
            best[c], choice[c] = value[k], k
        else:
            best[c] = best[c - 1]
    out: Counter = Counter()
    c = capacity
    while c >= lengths[0]:
        if choice[c] < 0:
            c -= 1
        else:
            out[int(choice[c])] += 1
            c -= int(lengths[choice[c]])
    return out


def best_fit(lengths: list[int], counts: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: equal sequences are filled as one group."""
    open_at: dict[int, dict[tuple, int]] = defaultdict(dict)
    rooms: list[int] = []
    for length, count in sorted(zip(lengths, counts, strict=True), reverse=True):
        while count:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                content, bins = open_at[room].popitem()
                if not open_at[room]:
                    rooms.pop(k)
                used = min(bins, count)
                if used < bins:
                    if not open_at[room]:
                        insort(rooms, room)
                    open_at[room][content] = open_at[room].get(content, 0) + bins - used
                fill, added, times = room - length, (*content, length), used
            else:
                each = capacity // length
                times = count // each if count >= each else 1
                added = (length,) * (each if count >= each else count)
                fill, used = capacity - length * len(added), times * len(added)
            count -= used
            if not open_at[fill]:
                insort(rooms, fill)
            open_at[fill][added] = open_at[fill].get(added, 0) + times
    return [(content, bins) for some in open_at.values() for content, bins in some.items()]


def plan(histogram: dict[int, int], capacity: int, rounds: int = 1200, eta: float = 0.5,
         share: float = 0.5) -> list[tuple[tuple[int, ...], int]]:
    """Configurations (tuples of lengths) and how often each is used; together they hold
    the histogram exactly."""
    out = [((capacity,), histogram[capacity])] if histogram.get(capacity) else []
    lengths = np.array(sorted(x for x, n in histogram.items() if n and x < capacity))
    if len(lengths) == 0:
        return out
    need = np.array([histogram[int(x)] for x in lengths])
    left = need.copy()
    for _ in range(rounds):
        alive = np.flatnonzero(left)
        if len(alive) == 0 or (left * lengths).sum() < 4 * capacity:
            break
        done = 1 - left[alive] / need[alive]
        average = 1 - (left * lengths).sum() / (need * lengths).sum()
        prices = lengths[alive] / capacity * np.exp(eta * (average - done))
        used = {int(alive[k]): n for k, n in dearest(lengths[alive], prices, capacity).items()}
        times = min(int(left[k]) // n for k, n in used.items())
        if times == 0:
            used = {k: min(n, int(left[k])) for k, n in used.items()}
            if sum(lengths[k] * n for k, n in used.items()) < 0.98 * capacity:
                break  # best fit does better with what is left
        times = max(1, int(times * share))
        for k, n in used.items():
            left[k] -= times * n
        out.append((tuple(int(lengths[k]) for k, n in used.items() for _ in range(n)), times))
    rest = np.flatnonzero(left)
    return out + best_fit(lengths[rest].tolist(), left[rest].tolist(), capacity)


def slots(configurations: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Slots in order of length: ``length, lo`` (rank of the first piece), ``sequence``
    (of that piece; the next piece has the next sequence) and ``offset``."""
    sequence, filled, rows = 0, Counter(), []
    for content, times in configurations:
        offset = 0
        for length in content:
            rows.append((length, filled[length], sequence, offset))
            filled[length] += times
            offset += length
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return tuple(table.T)


def pack(docs: DataFrame, path: str, end_id: int = 0, capacity: int = 2048, with_ids: bool = False,
         rows_per_salt: int = 5_000) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``,
    little-endian, if asked for) of every piece of every document.

    A null or empty text is one piece with the end id; a text of more than ``capacity``
    ids is cut at multiples of it; repeated rows are packed as often as they occur; an
    empty table gives an empty result.  Which of several equal pieces takes which slot is
    fixed by ``doc_id, piece``.
    """
    spark = docs.sparkSession
    columns = ["piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    pieces = materialize(docs.select("doc_id", F.explode(pieces_of(F.col("text"), path, end_id, capacity, with_ids))
                                     .alias("p")).select("doc_id", *[f"p.{c}" for c in columns]), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    total = sum(histogram.values())
    # a table that the histogram's size bounds, whatever the number of documents
    shared = spark.sparkContext.broadcast(slots(plan(histogram, capacity)))

    salts = 1 + total // rows_per_salt
    dealt = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = W.Window.partitionBy("length").orderBy("salt").rowsBetween(W.Window.unboundedPreceding, -1)
    starts = (dealt.groupBy("length", "salt").agg(F.count("*").alias("n"))
              .withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    within = W.Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (dealt.withColumn("r", F.row_number().over(within) - 1).join(starts, ["length", "salt"])
              .withColumn("r", F.col("r") + F.col("base")))

    @F.arrow_udf(T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        sizes, lo, sequence, offset = shared.value
        n, r = length.to_numpy(), rank.to_numpy()
        at = np.searchsorted(sizes * (1 << 40) + lo, n * (1 << 40) + r, "right") - 1
        return pa.StructArray.from_arrays([pa.array(sequence[at] + r - lo[at]), pa.array(offset[at])],
                                          ["sequence_id", "offset"])

    return ranked.withColumn("s", place("length", "r")).select("doc_id", *columns, "s.sequence_id", "s.offset")
