"""Language-model scoring with an Elias-Fano n-gram trie (operator 9).

A bigram model over the words of all training documents: unigram probabilities with
add-one smoothing, mixed with a context's own counts by Dirichlet smoothing,
``p(w | v) = (c(v w) + mu p(w)) / (c(v) + mu)``; a text starts and ends with the end mark.

The model is too large for a broadcast and lives in shards.  Texts are cut into blocks; a
block sends each shard its distinct words and word pairs with their training counts (so
pairs are combined before the shuffle, and a frequent context's followers are dealt to
``SALTS`` shards).  A shard adds the counts of all blocks up and writes its trie to
memory-mapped levels: contexts as an Elias-Fano sequence, monotone Elias-Fano pointers to
their followers, follower ids relative to their context, and 8-bit codes of the pairs'
counts (smoothing follows in ``_score``).  It answers each block's own queries by successor search: a code for each
pair, the count of each word.  With these a block scores its texts.  What moves grows with
the number of distinct pairs in blocks, and no table is held whole anywhere.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .textvec import SPACE_WORDS, Words, groups, mix, text_buffer, word_hash

BLOCK_BYTES = 8 << 20
SHARD_BYTES = 8 << 20
SALTS = 16
CONTEXT_BITS = 40
#: No word contains a space, so this is no word's hash.
END = np.uint64(word_hash(b" end "))
#: Codes of pair counts: exact up to EXACT, then steps of 1 / STEPS of a natural logarithm.
EXACT = 64
STEPS = 10


def quantise(count: np.ndarray) -> np.ndarray:
    """8-bit code of a count (0: not seen)."""
    tail = EXACT + np.round(STEPS * np.log(np.maximum(count, 1) / EXACT)).astype(np.int64)
    return np.where(count <= EXACT, count, np.minimum(tail, 255)).astype(np.uint8)


#: The count that each code stands for.
CODE_VALUE = np.array([c if c <= EXACT else EXACT * np.exp((c - EXACT) / STEPS) for c in range(256)])


class EliasFano:
    """A monotone sequence: low parts as they are, high parts in unary, with a directory
    of ones for every 64 bits."""

    def __init__(self, low: np.ndarray, bits: np.ndarray, ones: np.ndarray, shift: int, n: int):
        self.low, self.bits, self.ones, self.shift, self.n = low, bits, ones, np.uint64(shift), n

    @classmethod
    def build(cls, values: np.ndarray, universe_bits: int) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        want = max(0, universe_bits - max(0, n.bit_length() - 1))
        shift = next(s for s in (8, 16, 32, 64) if s >= min(want, 64))
        kind = {8: np.uint8, 16: np.uint16, 32: np.uint32, 64: np.uint64}[shift]
        low = values.astype(kind)
        high = values >> np.uint64(shift) if shift < 64 else np.zeros(n, np.uint64)
        length = n + (int(high[-1]) if n else 0) + 2
        raw = np.zeros(-(-length // 64) * 64, np.uint8)
        raw[high.astype(np.int64) + np.arange(n)] = 1
        ones = np.concatenate([[0], np.cumsum(raw.reshape(-1, 64).sum(1, dtype=np.int64))])
        return cls(low, np.packbits(raw), ones, shift, n)

    def arrays(self) -> list[np.ndarray]:
        return [self.low, self.bits, self.ones]

    def _select(self, k: np.ndarray, directory: np.ndarray, one: bool) -> np.ndarray:
        """Bit position of the k-th one (or zero), from 0."""
        word = np.searchsorted(directory, k, "right") - 1
        word = np.minimum(word, len(directory) - 2)
        left = k - directory[word]
        out = np.empty(len(k), np.int64)
        for s in range(0, len(k), 1 << 16):
            w = word[s: s + (1 << 16)]
            rows = np.unpackbits(np.asarray(self.bits).reshape(-1, 8)[w], axis=1)
            seen = np.cumsum(rows if one else 1 - rows, axis=1, dtype=np.uint8)
            out[s: s + len(w)] = w * 64 + (seen <= left[s: s + len(w), None]).sum(1)
        return out

    def access(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        high = self._select(i, np.asarray(self.ones), True) - i
        shift = self.shift if self.shift < 64 else np.uint64(0)
        return (high.astype(np.uint64) << shift) | self.low[i].astype(np.uint64)

    def bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of indices whose values have this high part."""
        top = len(self.bits) * 8 - self.n  # zeros in all
        zeros = np.arange(len(self.ones)) * 64 - np.asarray(self.ones)
        after = np.minimum(high, top - 1)
        last = np.where(high < top, self._select(after, zeros, False) - after, self.n)
        before = np.minimum(np.maximum(high - 1, 0), top - 1)
        first = np.where(high > 0, self._select(before, zeros, False) - before, 0)
        return np.where(high > top, self.n, first), last

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each x in the sequence, -1 where it is absent."""
        if self.n == 0:
            return np.full(len(x), -1)
        high = (x >> self.shift).astype(np.int64) if self.shift < 64 else np.zeros(len(x), np.int64)
        first, last = self.bucket(high)
        return successor(self.low, first, last, x.astype(self.low.dtype))


def successor(values: np.ndarray, first: np.ndarray, last: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Index of each x within its own sorted range of ``values``, -1 where it is absent."""
    a, b = first.astype(np.int64).copy(), last.astype(np.int64).copy()
    open_ = np.flatnonzero(a < b)
    while len(open_):
        middle = (a[open_] + b[open_]) >> 1
        less = values[middle] < x[open_]
        a[open_[less]] = middle[less] + 1
        b[open_[~less]] = middle[~less]
        open_ = open_[a[open_] < b[open_]]
    at = np.minimum(a, max(0, len(values) - 1))
    return np.where((a < last) & (values[at] == x), a, -1) if len(values) else np.full(len(x), -1)


class Trie:
    """One shard's levels, memory-mapped from a file that goes with the object."""

    def __init__(self, contexts: np.ndarray, starts: np.ndarray, followers: np.ndarray, codes: np.ndarray):
        level1 = EliasFano.build(contexts, CONTEXT_BITS)
        pointers = EliasFano.build(starts, max(1, int(starts[-1]).bit_length()))
        arrays = [*level1.arrays(), *pointers.arrays(), followers, codes]
        self.file = tempfile.TemporaryFile()
        mapped = []
        places = []
        for x in arrays:
            self.file.write(b"\0" * (-self.file.tell() % 8))
            places.append(self.file.tell())
            self.file.write(x.tobytes())
        self.file.flush()
        for x, at in zip(arrays, places, strict=True):
            mapped.append(np.memmap(self.file, x.dtype, "r", at, x.shape) if len(x) else x)
        self.contexts = EliasFano(*mapped[0:3], int(level1.shift), level1.n)
        self.pointers = EliasFano(*mapped[3:6], int(pointers.shift), pointers.n)
        self.followers, self.codes = mapped[6:]

    def query(self, context: np.ndarray, count: np.ndarray, follower: np.ndarray) -> np.ndarray:
        """Codes of pairs: ``count`` followers for each context."""
        at = self.contexts.find(context)
        known = at >= 0
        first, last = np.zeros(len(context), np.int64), np.zeros(len(context), np.int64)
        first[known] = self.pointers.access(at[known])
        last[known] = self.pointers.access(at[known] + 1)
        hit = successor(self.followers, np.repeat(first, count), np.repeat(last, count), follower)
        return np.where(hit >= 0, self.codes[np.maximum(hit, 0)], 0).astype(np.uint8) if len(self.codes) else \
            np.zeros(len(follower), np.uint8)


def _pack_small(x: np.ndarray) -> bytes:
    """Counts as bytes, with those from 255 on behind."""
    big = x[x >= 255].astype(np.int64)
    return np.int64(len(big)).tobytes() + big.tobytes() + np.minimum(x, 255).astype(np.uint8).tobytes()


def _unpack_small(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    out = np.frombuffer(data, np.uint8, offset=8 + 8 * n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, np.int64, n, 8)
    return out


class Block:
    """Tokens of a block's texts, its distinct words and pairs in the order of shards."""

    def __init__(self, payload: bytes, lengths: np.ndarray, held: np.ndarray, shards: int):
        data = np.frombuffer(pa.decompress(payload, decompressed_size=int(lengths.sum()), codec="zstd", asbytes=True), np.uint8)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        parts, counts = [], []
        for a, b in groups(offsets):
            words = Words(data, offsets[a: b + 1], SPACE_WORDS)
            parts.append(words.hash)
            counts.append(words.counts)
        n = np.concatenate(counts) if counts else np.empty(0, np.int64)
        self.tokens = n + 1
        ends = np.cumsum(self.tokens) - 1
        flat = np.full(int(self.tokens.sum()), END, np.uint64)
        inner = np.ones(len(flat), bool)
        inner[ends] = False
        flat[inner] = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        del parts, inner, data
        self.owner = np.repeat(np.arange(len(n), dtype=np.int32), self.tokens)
        train = ~held[self.owner]
        self.words, word_at = np.unique(flat, return_inverse=True)
        self.word_at = word_at.astype(np.int32)
        del word_at
        self.word_count = np.bincount(self.word_at[train], minlength=len(self.words))
        # shards are equal ranges of the sorted hashes, so answers come back in their order
        word_shard = (((self.words >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)
        self.word_cut = np.searchsorted(word_shard, np.arange(shards + 1))

        # the end mark before a text starts it
        before_at = np.concatenate([[np.searchsorted(self.words, END)], self.word_at[:-1]])
        del flat
        pair = before_at.astype(np.uint64) * np.uint64(len(self.words)) + self.word_at.astype(np.uint64)
        del before_at
        pair, pair_at = np.unique(pair, return_inverse=True)
        self.pair_at = pair_at.astype(np.int32)
        del pair_at
        pair_count = np.bincount(self.pair_at[train], minlength=len(pair))
        context = mix(self.words[(pair // np.uint64(len(self.words))).astype(np.int64)])
        word = mix(self.words[(pair % np.uint64(len(self.words))).astype(np.int64)] ^ np.uint64(0x5555555555555555))
        shard = ((context >> np.uint64(CONTEXT_BITS)) + (word >> np.uint64(32)) % np.uint64(SALTS)) % np.uint64(shards)
        context &= np.uint64((1 << CONTEXT_BITS) - 1)
        follower = (word & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        order = np.lexsort((follower, context, shard))
        self.place = np.empty(len(order), np.int32)
        self.place[order] = np.arange(len(order), dtype=np.int32)
        self.shard, self.context, self.follower = shard[order].astype(np.int64), context[order], follower[order]
        self.pair_count = pair_count[order]
        self.pair_cut = np.searchsorted(self.shard, np.arange(shards + 1))

    def message(self, s: int) -> bytes:
        """What shard ``s`` gets: its words and pairs with counts."""
        w, p = slice(self.word_cut[s], self.word_cut[s + 1]), slice(self.pair_cut[s], self.pair_cut[s + 1])
        context, size = np.unique(self.context[p], return_counts=True)
        parts = [self.words[w].tobytes(), _pack_small(self.word_count[w]), context.tobytes(), _pack_small(size),
                 self.follower[p].tobytes(), _pack_small(self.pair_count[p])]
        return np.array([len(x) for x in parts], np.int64).tobytes() + b"".join(parts)


def _read_message(data: bytes) -> tuple[np.ndarray, ...]:
    sizes = np.frombuffer(data, np.int64, 6)
    at = np.concatenate([[48], 48 + np.cumsum(sizes)])
    part = [data[at[k]: at[k + 1]] for k in range(6)]
    return (np.frombuffer(part[0], np.uint64), _unpack_small(part[1]), np.frombuffer(part[2], np.uint64),
            _unpack_small(part[3]), np.frombuffer(part[4], np.uint32), _unpack_small(part[5]))


def _cut(batches):
    """Blocks of texts: one row each, texts compressed."""
    turn = 0
    for batch in batches:
        data, offsets = text_buffer(batch.column(2))
        for a, b in groups(offsets, BLOCK_BYTES):
            raw = data[offsets[a]: offsets[b]].tobytes()
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays(
                [pa.array([(TaskContext.get().partitionId() << 24) + turn]), pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())),
                 pa.array([part.column(1).to_pylist()], pa.list_(pa.bool_())),
                 pa.array([np.diff(offsets[a: b + 1])], pa.list_(pa.int64())),
                 pa.array([pa.compress(raw, "zstd", asbytes=True)], pa.binary())],
                ["block", "doc_ids", "held", "lengths", "payload"])
            turn += 1


def _load(columns, shards: int) -> Block:
    return Block(columns["payload"], np.array(columns["lengths"], np.int64), np.array(columns["held"], bool), shards)


def _send(shards: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = _load(row, shards)
                for s in range(0, shards, 16):
                    some = range(s, min(s + 16, shards))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(some), pa.int32()), pa.array([row["block"]] * len(some)),
                         pa.array([block.message(k) for k in some], pa.binary())], ["shard", "block", "message"])

    return run


def _answer(table: pa.Table) -> pa.Table:
    """A shard: adds counts up, builds the trie, answers every block."""
    messages = [_read_message(m.as_py()) for m in table.column("message")]
    words, where = np.unique(np.concatenate([m[0] for m in messages]), return_inverse=True)
    totals = np.bincount(where, np.concatenate([m[1] for m in messages]), minlength=len(words)).astype(np.int64)
    context = np.concatenate([np.repeat(m[2], m[3]) for m in messages])
    follower = np.concatenate([m[4] for m in messages])
    count = np.concatenate([m[5] for m in messages])
    seen = count > 0
    context, follower, count = context[seen], follower[seen], count[seen]
    order = np.lexsort((follower, context))
    context, follower, count = context[order], follower[order], count[order]
    new = np.ones(len(context), bool)
    new[1:] = (context[1:] != context[:-1]) | (follower[1:] != follower[:-1])
    at = np.flatnonzero(new)
    count = np.add.reduceat(count, at) if len(at) else count
    contexts, first = np.unique(context[at], return_index=True)
    trie = Trie(contexts, np.append(first, len(at)), follower[at], quantise(count))
    rows = [(-1, b"", b"", int(totals.sum()), int(np.count_nonzero(totals)))]
    for block, m in zip(table.column("block").to_pylist(), messages, strict=True):
        known = totals[np.searchsorted(words, m[0])]
        rows.append((block, _pack_small(known), trie.query(m[2], m[3], m[4]).tobytes(), 0, 0))
    columns = list(zip(*rows, strict=True))
    return pa.table({"block": pa.array(columns[0], pa.int64()), "shard": pa.array([table.column("shard")[0].as_py()] * len(rows), pa.int32()),
                     "counts": pa.array(columns[1], pa.binary()), "codes": pa.array(columns[2], pa.binary()),
                     "n": pa.array(columns[3], pa.int64()), "v": pa.array(columns[4], pa.int64())})


def _score(shards: int, total: int, distinct: int, mu: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        right = right.sort_by("shard")
        counts = np.concatenate([_unpack_small(x.as_py()) for x in right.column("counts")])
        codes = np.frombuffer(b"".join(right.column("codes").to_pylist()), np.uint8)
        for row in left.to_pylist():
            block = _load(row, shards)
            known = counts[block.word_at]
            uni = (known + 1.0) / (total + distinct + 1.0)
            end = counts[np.searchsorted(block.words, END)]
            context = np.concatenate([[end], known[:-1]])
            pair = CODE_VALUE[codes[block.place[block.pair_at]]]
            # a code above EXACT may round a count up past its context's
            p = (np.minimum(pair, context) + mu * uni) / (context + mu)
            n = len(block.tokens)
            out.append(pa.table({
                "doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": pa.array(row["held"], pa.bool_()),
                "n_tokens": pa.array(block.tokens), "n_known": pa.array(np.bincount(block.owner[known > 0], minlength=n)),
                "train_tokens": pa.array(np.full(n, total)),
                "base_score": pa.array(np.bincount(block.owner, np.log10(uni), minlength=n)),
                "score": pa.array(np.bincount(block.owner, np.log10(p), minlength=n))}))
        return pa.concat_tables(out)

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_texts(docs: DataFrame, held_out: Column, mu: float = 50.0) -> DataFrame:
    """Scores of every text of ``docs`` (``doc_id, text``) under a model of those that are
    not ``held_out``.

    One row per input row; a null or empty text is the end mark alone; a null ``held_out``
    counts as false; without training texts all counts are zero and every word is equally
    likely; repeated rows count as often as they occur; an empty table gives no rows.
    """
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(8, -(-size // SHARD_BYTES))
    blocks = materialize(rows.mapInArrow(_cut, "block long, doc_ids array<long>, held array<boolean>, "
                                               "lengths array<long>, payload binary"), "lm-blocks")
    sent = blocks.mapInArrow(_send(shards), "shard int, block long, message binary")
    answers = materialize(sent.groupBy("shard").applyInArrow(
        _answer, "block long, shard int, counts binary, codes binary, n long, v long"), "lm-answers")
    total, distinct = answers.where("block = -1").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    of_block = answers.where("block >= 0").select("block", "shard", "counts", "codes")
    return blocks.groupBy("block").cogroup(of_block.groupBy("block")).applyInArrow(
        _score(shards, total, distinct, mu), SCORES)
