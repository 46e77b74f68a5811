"""Exact n-gram Jaccard join with signature trees (operator 6).

1. Every text becomes the set of its word shingles (64-bit hashes); texts with the same
   word sequence are one node (64-bit hash of the sequence).
2. Shingles are counted over the whole corpus: blocks of texts send sorted key arrays to
   hash shards, and shards return the keys that at least two nodes hold.
3. A node's shingles in order of (count, key) begin with those nobody shares.  Two sets
   with Jaccard >= t share a key within their first ``n - ceil(t n) + 1``; chaining the
   holders of each such key, in order of size, gives families that hold every linked pair.
4. Within a family (cut into blocks of ``leaf_block`` nodes, block against block where
   sizes allow) nodes enter signature trees: a tree node holds the OR of the token bitmaps
   below it and the range of set sizes.  Two trees are walked together; a pair of tree
   nodes is dropped when its maximum possible overlap is below what the smallest sizes
   need.  Surviving leaves are verified exactly, unless they are connected already.
5. Verified links are closed to components.

Keys keep 40 bits below the shard number (which grows with the corpus); shared keys are
all that a verification needs, for unshared shingles cannot lie in an intersection.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .common import materialize
from .graph import connected_components
from .textvec import SPACE_WORDS, Words, groups, mix, release, shingle_set, signed, text_buffer

#: Text bytes that one shard should account for.
SHARD_BYTES = 16 << 20
#: Text bytes of a block that sends one message to a shard, and of a work array.
BLOCK_BYTES, WORK_BYTES = 2 << 20, 256 << 10
LOW_BITS = 40
WIDTH = 1024
FANOUT = 4

_INFO = T.StructType([T.StructField("node", T.LongType()), T.StructField("n_shingles", T.LongType()),
                      T.StructField("n_keys", T.LongType())])


def _sets(texts: pa.Array, n: int, block_bytes: int):
    """For blocks of texts: first text, node of each text (0 without words), and sets."""
    data, offsets = text_buffer(texts)
    for a, b in groups(offsets, block_bytes):
        nodes, sets = np.zeros(b - a, np.uint64), []
        for c, d in groups(offsets[a: b + 1], WORK_BYTES):
            words = Words(data, offsets[a + c: a + d + 1], SPACE_WORDS)
            for i in range(d - c):
                w = words.hash[words.first[i]: words.first[i + 1]]
                sets.append(shingle_set(w, n))
                if len(w):
                    place = np.arange(1, len(w) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    nodes[c + i] = mix(np.array([mix(w ^ mix(place)).sum()], np.uint64) + np.uint64(len(w)))[0] | np.uint64(1)
        yield a, nodes, sets


def shard_keys(hashes: np.ndarray, shards: int) -> np.ndarray:
    """``hash * shards / 2^24`` rounded down: the shard, an equal range of the hashes for any
    number of shards (below 2^24), and the ``LOW_BITS`` below it; keeps the order of hashes."""
    n, half = np.uint64(shards), np.uint64(32)
    return (((hashes >> half) * n) << np.uint64(LOW_BITS - 32)) + (((hashes & np.uint64(0xFFFFFFFF)) * n) >> np.uint64(64 - LOW_BITS))


def _info(n: int, shards: int):
    @F.arrow_udf(_INFO)
    def run(texts: pa.Array) -> pa.Array:
        node, size, keys = [], [], []
        for _, nodes, sets in _sets(texts, n, BLOCK_BYTES):
            node.append(nodes)
            size.append([len(s) for s in sets])
            keys.append([np.count_nonzero(np.diff(shard_keys(s, shards))) + 1 if len(s) else 0 for s in sets])
        node = np.concatenate(node) if node else np.empty(0, np.uint64)
        release()
        return pa.StructArray.from_arrays(
            [pa.array(signed(node), pa.int64(), mask=node == 0),
             pa.array(np.concatenate(size) if size else [], pa.int64()),
             pa.array(np.concatenate(keys) if keys else [], pa.int64())], ["node", "n_shingles", "n_keys"])

    return run


def _send(n: int, shards: int):
    """Each block's distinct keys by shard: high and low part, and the node's place."""
    def run(batches):
        for batch in batches:
            release()
            for _, nodes, sets in _sets(batch.column(0), n, BLOCK_BYTES):
                first = np.unique(nodes, return_index=True)[1]
                first = first[nodes[first] != 0]
                for k in range(0, len(first), 60_000):  # places fit 16 bits
                    some = first[k: k + 60_000]
                    parts = [np.unique(shard_keys(sets[i], shards)) for i in some]
                    if not parts:
                        continue
                    key = np.concatenate(parts)
                    place = np.repeat(np.arange(len(some), dtype=np.uint16), [len(p) for p in parts])
                    del parts
                    order = np.argsort(key, kind="stable")
                    key, place = key[order], place[order]
                    del order
                    of = (key >> np.uint64(LOW_BITS)).astype(np.uint32)
                    cut = np.append(np.flatnonzero(np.diff(of, prepend=of[0] + np.uint32(1))), len(of))
                    for r in range(0, len(cut) - 1, 16):  # shards that get a message
                        spans = [slice(x, y) for x, y in zip(cut[r: r + 16], cut[r + 1: r + 17], strict=False)]
                        used = [np.unique(place[x]) for x in spans]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([int(of[x.start]) for x in spans], pa.int32()),
                             pa.array([((key[x] >> np.uint64(8)) & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes()
                                       for x in spans], pa.binary()),
                             pa.array([(key[x] & np.uint64(0xFF)).astype(np.uint8).tobytes() for x in spans], pa.binary()),
                             pa.array([np.searchsorted(u, place[x]).astype(np.uint16).tobytes()
                                       for u, x in zip(used, spans, strict=True)], pa.binary()),
                             pa.array([nodes[some[u]].tobytes() for u in used], pa.binary())],
                            ["shard", "high", "low", "place", "nodes"])
                nodes = sets = None
                release()

    return run


def _shared(table: pa.Table) -> pa.Table:
    """Keys of a shard that two nodes or more hold: a row for each holder."""
    release()
    shard = table.column("shard")[0].as_py()
    columns = [table.column(c) for c in ("high", "low", "place", "nodes")]

    def whole(high, low):
        key = np.frombuffer(high.as_buffer(), np.uint32).astype(np.uint64) << np.uint64(8)
        key |= np.frombuffer(low.as_buffer(), np.uint8)
        return key

    often = np.empty(sum(len(lo.as_buffer()) for lo in columns[1]), np.uint64)
    at = 0
    for h, lo in zip(*columns[:2], strict=True):
        part = whole(h, lo)
        often[at: at + len(part)] = part
        at += len(part)
    often.sort()
    often = np.unique(often[1:][often[1:] == often[:-1]])  # only their holders are ever unpacked
    key, node = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    for h, lo, p, n in zip(*columns, strict=True):
        part = whole(h, lo)
        at = np.searchsorted(often, part)
        held = np.flatnonzero(often[np.minimum(at, len(often) - 1)] == part) if len(often) else []
        key.append(part[held])
        node.append(np.frombuffer(n.as_buffer(), np.uint64)[np.frombuffer(p.as_buffer(), np.uint16)[held]])
    key, node = np.concatenate(key), np.concatenate(node)
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.ones(len(key), bool)  # copies in several blocks send a key again
    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    key, node = key[new], node[new]
    _, place, count = np.unique(key, return_inverse=True, return_counts=True)
    count = count[place]
    keep = count > 1
    full = key[keep] | np.uint64(shard) << np.uint64(LOW_BITS)
    del often, place, new, order
    release()
    return pa.table({"key": pa.array(signed(full)), "node": pa.array(signed(node[keep])),
                     "holders": pa.array(count[keep].astype(np.int64))})


def _chain(num: int, den: int):
    """Edges between neighbours of the same key in order of size, where their sizes allow a
    link; and a partition's first and last row, which are joined to the next partition's."""

    def edges(key, n, node):
        near = np.flatnonzero((key[1:] == key[:-1]) & (n[:-1] * den >= n[1:] * num) & (node[1:] != node[:-1]))
        return node[near], node[near + 1]

    def rows(a, b, key=None, n=None):
        size = len(a)
        blank = pa.nulls(size, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a), blank if b is None else pa.array(b), blank if key is None else pa.array(key),
                                           blank if n is None else pa.array(n)], ["a", "b", "key", "n"])

    def run(batches):
        first = last = None
        for batch in batches:
            key, n, node = (batch.column(c).to_numpy() for c in ("key", "n", "node"))
            if not len(key):
                continue
            if last is not None:
                key, n, node = (np.concatenate([x, y]) for x, y in zip(last, (key, n, node), strict=True))
            else:
                first = key[:1], n[:1], node[:1]
            yield rows(*edges(key, n, node))
            last = key[-1:], n[-1:], node[-1:]
        if last is not None:
            for key, n, node in (first, last):
                yield rows(node, None, key, n)

    return run


class SignatureTree:
    """Levels of OR-combined bitmaps with ranges of set sizes; level 0 has the sets."""

    def __init__(self, sizes: np.ndarray, keys: list[np.ndarray]):
        bits = np.zeros((len(keys), WIDTH), np.uint8)
        for row, k in zip(bits, keys, strict=True):
            row[(k.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 10)] = 1
        maps = np.packbits(bits, axis=1).view(np.uint64)
        #: tokens that share a bit with another token of the same set
        extra = np.array([len(k) for k in keys]) - np.bitwise_count(maps).sum(1)
        self.levels = [(maps, sizes, sizes, extra)]
        while len(maps) > 1:
            cut = np.arange(0, len(maps), FANOUT)
            _, low, high, extra = self.levels[-1]
            maps = np.bitwise_or.reduceat(maps, cut)
            self.levels.append((maps, np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut),
                                np.maximum.reduceat(extra, cut)))

    def level(self, k: int):
        return self.levels[min(k, len(self.levels) - 1)]


def dual_traversal(a: SignatureTree, b: SignatureTree, same: bool, num: int, den: int):
    """Pairs of leaves whose largest possible overlap can reach Jaccard ``num / den``."""
    need = num / (num + den)  # share of both sizes' sum that an overlap must reach
    top = max(len(a.levels), len(b.levels)) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for k in range(top, -1, -1):
        (ma, la, ha, ea), (mb, lb, hb, eb) = a.level(k), b.level(k)
        keep = (ha[i] * den >= lb[j] * num) & (hb[j] * den >= la[i] * num)
        i, j = i[keep], j[keep]
        bound = np.empty(len(i), np.int64)
        for s in range(0, len(i), 65_536):
            x, y = i[s: s + 65_536], j[s: s + 65_536]
            bound[s: s + 65_536] = np.bitwise_count(ma[x] & mb[y]).sum(1, dtype=np.int64) + np.minimum(ea[x], eb[y])
        keep = bound >= np.ceil(need * (la[i] + lb[j]) - 1e-9)
        i, j, bound = i[keep], j[keep], bound[keep]
        if k == 0:
            break
        for tree, side in ((a, 0), (b, 1)):
            if k < len(tree.levels):  # else its root stands for itself on this level
                n = len(tree.level(k - 1)[1])
                moved = (i, j)[side][:, None] * FANOUT + np.arange(FANOUT)[None, :]
                other = np.repeat((j, i)[side], FANOUT)
                moved = moved.ravel()
                ok = moved < n
                i, j = (moved[ok], other[ok]) if side == 0 else (other[ok], moved[ok])
        if same:
            ok = i <= j
            i, j = i[ok], j[ok]
    if same:
        ok = i < j
        i, j, bound = i[ok], j[ok], bound[ok]
    return i, j, bound


def family_links(nodes, sizes, keys, side, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning set of the links within one block (``side`` all 0) or between two."""
    same = not side.any()
    sets = [np.sort(k) for k in keys]
    order = np.array(sorted(range(len(sets)), key=lambda i: (sets[i][:1].tolist(), sizes[i])))
    left = order[side[order] == 0]
    right = left if same else order[side[order] == 1]
    if len(left) == 0 or len(right) == 0:
        return []
    tree_a = SignatureTree(sizes[left], [sets[i] for i in left])
    tree_b = tree_a if same else SignatureTree(sizes[right], [sets[i] for i in right])
    i, j, bound = dual_traversal(tree_a, tree_b, same, num, den)
    i, j = left[i], right[j]
    best = np.argsort(-(bound / (sizes[i] + sizes[j])), kind="stable")
    root = np.arange(len(sets))
    out = []
    for s in range(0, len(best), 2048):
        x, y = i[best[s: s + 2048]], j[best[s: s + 2048]]
        while True:  # full path compression
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        apart = root[x] != root[y]
        for p, q in zip(x[apart].tolist(), y[apart].tolist(), strict=True):
            p0, q0 = p, q
            while root[p0] != p0:
                p0 = root[p0]
            while root[q0] != q0:
                q0 = root[q0]
            if p0 == q0:
                continue
            common = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
            if den * common >= num * (sizes[p] + sizes[q] - common):
                root[max(p0, q0)] = min(p0, q0)
                out.append((int(nodes[p]), int(nodes[q])))
    return out


def _links(num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        lists = table.column("keys").combine_chunks()
        flat = lists.flatten().to_numpy()
        cut = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        keys = [flat[cut[i]: cut[i + 1]] for i in range(len(lists))]
        found = family_links(table.column("node").to_numpy(), table.column("n").to_numpy(), keys,
                             table.column("side").to_numpy(), num, den)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()),
                         "b": pa.array([y for _, y in found], pa.int64())})

    return run


def jaccard_components(docs: DataFrame, shingle: int = 5, num: int = 75, den: int = 100,
                       leaf_block: int = 400) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (``doc_id, text``).

    ``component_id``: smallest ``doc_id`` reachable by links of Jaccard >= num/den.  Words
    are split at ASCII white space, with A-Z lower-cased.  A null text, or one without
    words, has an empty set and links with nothing (its own id); a text of fewer words
    than a shingle is one shingle; repeated rows share a component; a null ``doc_id`` is
    never the smallest.
    """
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(8, -(-size // SHARD_BYTES))
    info = materialize(docs.withColumn("i", _info(shingle, shards)("text")).select("doc_id", "i.*"), "sets")
    nodes = (info.where(F.col("node").isNotNull()).groupBy("node")
             .agg(F.min("doc_id").alias("first_id"), F.min("n_shingles").alias("n"), F.min("n_keys").alias("n_keys")))
    sent = docs.select("text").mapInArrow(_send(shingle, shards),
                                          "shard int, high binary, low binary, place binary, nodes binary")
    held = sent.groupBy("shard").applyInArrow(_shared, "key long, node long, holders long")

    # the first keys in order of (holders, key): unshared ones come first and join nothing;
    # most nodes end here, and only the others' shared keys are kept
    prefix = F.col("n") - F.ceil(F.col("n") * num / float(den)) + 1
    shared = held.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("holders", "key"))).alias("keys"))
    open_ = materialize(shared.join(nodes.select("node", "n", "n_keys"), "node")
                        .withColumn("first", (prefix - (F.col("n_keys") - F.size("keys"))).cast("int"))
                        .where(F.col("first") > 0)
                        .select("node", "n", F.col("keys.key").alias("keys"), "first"), "shared-keys")
    ranked = open_.select("node", "n", F.explode(F.slice("keys", 1, F.col("first"))).alias("key"))
    # a range partitioning cuts the holders of a hot key into pieces, which are chained inside
    # and, by the first and last row of each partition, across
    ordered = ranked.repartitionByRange("key", "n", "node").sortWithinPartitions("key", "n", "node")
    chained = materialize(ordered.select("key", "n", "node").mapInArrow(_chain(num, den), "a long, b long, key long, n long"),
                          "chains")
    by_key = W.Window.partitionBy("key").orderBy("n", "a")
    across = (chained.where(F.col("b").isNull()).withColumn("before", F.lag("a").over(by_key))
              .withColumn("m", F.lag("n").over(by_key)).where(F.col("m") * den >= F.col("n") * num)
              .select(F.col("before").alias("a"), F.col("a").alias("b")))
    edges = chained.where(F.col("b").isNotNull()).select("a", "b").unionByName(across)
    family = connected_components(edges, "families")

    # members are numbered within the pieces of a range partitioning, so that a large family is
    # not one task's; blocks need no common numbering, only their ranges of sizes
    placed = materialize(family.join(open_.select("node", "n"), "node").repartitionByRange("component", "n", "node")
                         .select("node", "component", "n", F.spark_partition_id().cast("long").alias("run")), "placed")
    within = F.row_number().over(W.Window.partitionBy("component", "run").orderBy("n", "node")) - 1
    member = placed.withColumn("block", F.col("run") * (1 << 32) + F.floor(within / leaf_block)).drop("run")
    member = materialize(open_.select("node", "keys").join(member, "node"), "family-members")
    spans = member.groupBy("component", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    other = spans.select(F.col("component").alias("c2"), F.col("block").alias("b2"), F.col("low").alias("low2"),
                         F.col("high").alias("high2"))
    pairs = (spans.join(other, (F.col("component") == F.col("c2")) & (F.col("block") <= F.col("b2")))
             .where((F.col("high") * den >= F.col("low2") * num) & (F.col("high2") * den >= F.col("low") * num))
             .select(F.col("component").alias("c"), F.col("block").alias("b1"), "b2"))
    sides = pairs.select("c", "b1", "b2", F.explode(F.when(F.col("b1") == F.col("b2"), F.array(F.lit(0)))
                                                    .otherwise(F.array(F.lit(0), F.lit(1)))).alias("side"))
    sides = sides.withColumn("at", F.when(F.col("side") == 0, F.col("b1")).otherwise(F.col("b2")))
    work = (member.join(sides, (F.col("component") == F.col("c")) & (F.col("block") == F.col("at")))
            .select("c", "b1", "b2", "side", "node", "n", "keys"))
    links = work.groupBy("c", "b1", "b2").applyInArrow(_links(num, den), "a long, b long")
    joined = connected_components(links, "links").withColumnRenamed("component", "label")

    labelled = nodes.join(joined, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    by_content = labelled.select("node", "label").join(smallest, "label").select("node", "component_id")
    return (info.select("doc_id", "n_shingles", "node").join(by_content, "node", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))
