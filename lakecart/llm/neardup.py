"""Embedding near-duplicates by sorted projection passes (operator 5).

Equal vectors are one node.  In each pass a vector's key is the concatenation of 63 random
hyperplane hashes of the vector less the mean direction; nodes are put in lexicographic
order of the key by a range partitioning (ties by node, so a crowd of equal keys is split
too), cut into runs of ``window`` nodes, and each run is compared with itself and with the
run before it, in double precision.  Verified pairs of all passes are closed to families.
A window is bounded, a family isn't: its members are then compared with each other, block
against block, so that a dense group loses no link and nothing is capped.  Only counts
leave these comparisons, never pairs.

The number of passes follows from the number of vectors and from how a bounded sample of
them lies (:func:`measured_passes`), so that a lone pair at the threshold is found with the
stated chance at any size, in spread-out vectors, in a cone, or in several clusters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .common import materialize
from .graph import connected_components

BITS = 63


def measured_passes(units: np.ndarray, nodes: int, window: int, least: float, recall: float) -> int:
    """Passes in which a pair with cosine ``least`` meets with a mean chance of ``recall``.

    ``units``: unit vectors.  Less their mean, two vectors share a bit with chance
    ``1 - angle / pi``; from the angles within the sample follows, for each of its vectors,
    how many leading bits leave at most ``window`` of all nodes beside it that it has no
    link with (a window full of links joins what it should).  A partner at the threshold
    must share those bits, which gives the chance q of one pass.
    """
    if not len(units):
        return 1
    x = units - units.mean(0)
    size = np.sqrt((x * x).sum(1))
    x /= np.maximum(size, 1e-300)[:, None]
    share = np.where(units @ units.T >= least, 0, 1 - np.arccos(np.clip(x @ x.T, -1, 1)) / np.pi)
    bits, crowd = np.full(len(x), BITS), share.copy()
    for b in range(BITS):
        around = (nodes - 1) * ((crowd if b else share > 0).sum(1) / max(1, len(x) - 1))
        bits = np.where((bits == BITS) & (around <= window), b, bits)
        if b:
            crowd *= share
    # closer to the mean than this there are no lone pairs: everything links with everything
    far = np.maximum(size * size, 1 - least)
    met = (1 - np.arccos(np.clip(1 - (1 - least) / far, -1, 1)) / np.pi) ** bits
    passes = 1
    while np.mean((1 - met) ** passes) > 1 - recall:
        passes += max(1, passes // 16)
    return passes


def usable(vector: Column) -> Column:
    """Whether a vector can link: no null in it, all finite, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow or underflow of the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def keys_of(x: np.ndarray, passes: int, seed: int, mean: np.ndarray | None) -> np.ndarray:
    """Keys of unit vectors, a column for each pass."""
    dim = x.shape[1]
    out = np.empty((len(x), passes), np.int64)
    weight = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    for p in range(passes):
        planes = np.random.default_rng([seed, dim, p]).standard_normal((dim, BITS))
        out[:, p] = (x @ planes > (0 if mean is None else mean @ planes)) @ weight
    return out


def hash_keys(vector: Column, passes: int, seed: int, means: dict[int, np.ndarray]) -> Column:
    """``array<long>``: a vector's key for each pass; ``means`` by dimension."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def run(lists: pa.Array) -> pa.Array:
        sizes = np.asarray(lists.value_lengths())
        out = np.zeros((len(lists), passes), np.int64)
        for dim in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == dim)
            for some in np.split(at, range(1024, len(at), 1024)):
                out[some] = keys_of(_unit(_matrix(lists.take(pa.array(some)), dim)), passes, seed, means.get(dim))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1, dtype=np.int32) * passes), pa.array(out.ravel()))

    return run(vector)


def window_links(x: np.ndarray, window: int, least: float, start: int = 0) -> list[tuple[int, int]]:
    """A spanning set of the links of rows with those up to ``window`` places before them
    (unit vectors in order); rows before ``start`` are only compared with later ones."""
    root = list(range(len(x)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for a in range(start, len(x), window):
        left, low = x[a: a + window], max(0, a - window)
        i, j = np.nonzero(left @ x[low: a + window].T >= least)
        i, j = i + a, j + low
        for p, q in zip(i[j < i].tolist(), j[j < i].tolist(), strict=True):
            p0, q0 = find(p), find(q)
            if p0 != q0:
                root[max(p0, q0)] = min(p0, q0)
                out.append((p, q))
    return out


def _windows(window: int, least: float):
    """Verified pairs within windows, of each run of nodes a spanning set."""

    def run(batches):
        tail = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            old = 0
            if tail is not None:
                old, table = tail.num_rows, pa.concat_tables([tail, table])
            turn, dim, node = (table.column(c).to_numpy() for c in ("turn", "dim", "node"))
            lists = table.column("vector").combine_chunks()
            edges = []
            change = np.flatnonzero((np.diff(turn) != 0) | (np.diff(dim) != 0)) + 1
            for a, b in zip(np.append(0, change), np.append(change, len(turn)), strict=True):
                x = _unit(_matrix(lists.slice(a, b - a), int(dim[a])))
                edges += [(node[a + p], node[a + q]) for p, q in window_links(x, window, least, max(0, old - a))]
            tail = table.slice(max(0, len(table) - window)).combine_chunks()
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in edges], pa.int64()),
                                              pa.array([q for _, q in edges], pa.int64())], ["a", "b"])

    return run


def _block_counts(least: float):
    """Links of the nodes of two blocks of a family (of one block with itself): copies of
    the linked nodes, for either side."""

    def run(table: pa.Table) -> pa.Table:
        side, node, copies = (table.column(c).to_numpy() for c in ("side", "node", "copies"))
        x = _unit(_matrix(table.column("vector").combine_chunks(), table.column("dim")[0].as_py()))
        left = np.flatnonzero(side == 0)
        right = left if not side.any() else np.flatnonzero(side == 1)
        links = np.zeros(len(node), np.int64)
        for some in np.split(left, range(256, len(left), 256)):
            close = (x[some] @ x[right].T) >= least
            if right is left:
                close[np.arange(len(some)), np.searchsorted(left, some)] = False
            else:
                links[right] += close.T @ copies[some]
            links[some] += close @ copies[right]
        return pa.table({"node": pa.array(node), "links": pa.array(links)})

    return run


def _samples(nodes: DataFrame, rows: int, dims: int) -> dict[int, tuple[int, np.ndarray]]:
    """For the ``dims`` most frequent dimensions: number of nodes, and unit vectors of at
    most ``rows`` of them, those of the smallest hashes."""
    counts = nodes.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(dims).collect()
    out = {}
    for r in counts:
        some = nodes.where(F.col("dim") == r["dim"]).select("node", "vector").orderBy("node").limit(rows).collect()
        out[r["dim"]] = r["count"], _unit(np.array([v["vector"] for v in some], np.float64))
    return out


def near_duplicates(vectors: DataFrame, least: float = 0.9, passes: int | None = None, window: int = 256, seed: int = 11,
                    block: int = 2048, recall: float = 0.99, sample_rows: int = 1000, sample_dims: int = 4,
                    run_rows: int = 16_384) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors`` (``vec_id,
    embedding``).

    ``n_links``: other rows with a cosine of at least ``least`` in this row's family, equal
    vectors included; ``component_id``: smallest ``vec_id`` of the family; ``kept``: the
    row has that id.  Rows whose vector is null, empty, zero or holds a null or non-finite
    component have no links and their own id; vectors of different lengths never link.
    Without ``passes`` there are as many as ``recall`` needs.  Mean and angles come from
    ``sample_rows`` vectors of each of the ``sample_dims`` most frequent lengths (other
    lengths are hashed without a mean); every vector is hashed and compared.
    """
    # the hash names a vector's value; -0.0 and 0.0 are the same
    rows = vectors.select("vec_id", "embedding").withColumn(
        "node", F.when(usable(F.col("embedding")), F.xxhash64(F.transform("embedding", lambda x: x + 0.0))))
    nodes = materialize(rows.where(F.col("node").isNotNull()).groupBy("node")
                        .agg(F.first("embedding").alias("vector"), F.count("*").alias("copies"),
                             F.min("vec_id").alias("first_id")).withColumn("dim", F.size("vector")), "vectors")
    samples = _samples(nodes, sample_rows, sample_dims)
    means = {dim: x.mean(0) for dim, (_, x) in samples.items()}
    if passes is None:
        passes = max((measured_passes(x, n, window, least, recall) for dim, (n, x) in samples.items()), default=1)
    total = sum(n for n, _ in samples.values())
    turns = nodes.select("node", "dim", "vector", F.posexplode(hash_keys(F.col("vector"), passes, seed, means)).alias("turn", "key"))
    # long runs: windows end where a partition ends
    ordered = (turns.repartitionByRange(max(1, total * passes // run_rows), "turn", "dim", "key", "node")
               .sortWithinPartitions("turn", "dim", "key", "node").select("turn", "dim", "node", "vector"))
    edges = ordered.mapInArrow(_windows(window, least), "a long, b long")
    family = connected_components(edges, "vector-families")

    # numbered within the pieces of a range partitioning: a large family is not one task's
    placed = materialize(family.repartitionByRange("component", "node")
                         .select("node", "component", F.spark_partition_id().cast("long").alias("run")), "placed-vectors")
    place = F.row_number().over(W.Window.partitionBy("component", "run").orderBy("node")) - 1
    block_of = F.dense_rank().over(W.Window.partitionBy("component").orderBy("run", "cut")) - 1
    placed = placed.withColumn("cut", F.floor(place / block))
    number = placed.select("component", "run", "cut").distinct().withColumn("at", block_of)  # one row per block
    member = materialize(nodes.join(placed, "node").join(number, ["component", "run", "cut"]).drop("run", "cut"), "family-vectors")
    last = member.groupBy("component").agg(F.max("at").alias("last"))
    pairs = (last.select(F.col("component").alias("c"), F.col("last"), F.explode(F.sequence(F.lit(0), "last")).alias("b1"))
             .select("c", "b1", F.explode(F.sequence("b1", "last")).alias("b2")))
    sides = pairs.select("c", "b1", "b2", F.explode(F.when(F.col("b1") == F.col("b2"), F.array(F.lit(0)))
                                                    .otherwise(F.array(F.lit(0), F.lit(1)))).alias("side"))
    sides = sides.withColumn("of", F.when(F.col("side") == 0, F.col("b1")).otherwise(F.col("b2")))
    counts = (member.join(sides, (F.col("component") == F.col("c")) & (F.col("at") == F.col("of")))
              .groupBy("c", "b1", "b2").applyInArrow(_block_counts(least), "node long, links long")
              .groupBy("node").agg(F.sum("links").alias("links")))
    smallest = member.groupBy("component").agg(F.min("first_id").alias("smallest"))
    known = (nodes.select("node", "copies", "first_id").join(counts, "node", "left").join(family, "node", "left")
             .join(smallest, "component", "left")
             .select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                     F.coalesce("smallest", "first_id").alias("component_id")))
    out = rows.select("vec_id", "node").join(known, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
