"""Exact top-k search by multi-resolution segment statistics (operator 11).

Components are quantised to integers and vectors are kept in blocks.  A vector is cut into
1, 4, 16, ... segments and, last, into segments of two components; each segment has
its mean and deviation.  For a segment of length L the squared distance of two vectors is
at least ``L ((m - m')^2 + (s - s')^2)``, so with both norms known the inner product is at
most ``sum L (m m' + s s')``: a product of two short feature rows.  From coarse to fine, pairs
whose lower-bound distance puts them below the query's k-th best are dropped; the inner
products of the survivors are exact integers.

The k-th best of a query begins as that among the queries themselves (which are rows too),
so a candidate's block sees a bound that all rows of the table can only raise.

Queries go to the candidates' tasks in groups of at most ``GROUP_BYTES``; candidates are
scanned where they are and only each task's k best of a query leave it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import materialize

#: Vectors and bytes of a block, queries compared at once, and bytes of a query group.
BLOCK_ROWS, BLOCK_BYTES = 4096, 4 << 20
TILE_ROWS = 512
GROUP_BYTES = 32 << 20
#: Integer sums below this are exact in a double, in any order.
EXACT = float(1 << 53)
LONG = (1 << 63) - 1
TOP = np.finfo(np.float64).max

_BLOCK = "block long, dim int, rows int, kind string, ids binary, data binary"


def _pack(values: np.ndarray) -> tuple[str, bytes]:
    """Integers (as doubles) in the least type that holds them."""
    top = np.abs(values).max(initial=0)
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<f8"
    return kind, values.astype(kind).tobytes()


def _blocks(batches):
    """Vectors of each dimension in blocks of quantised components."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        sizes = np.asarray(batch.column(1).value_lengths())
        for dim in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == dim)
            step = int(max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(dim, 1)))))
            for s in range(0, len(at), step):
                some = at[s: s + step]
                x = batch.column(1).take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                with np.errstate(over="ignore"):
                    kind, data = _pack(np.clip(np.floor(256 * x), -TOP, TOP))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dim], pa.int32()), pa.array([len(some)], pa.int32()), pa.array([kind]),
                     pa.array([ids[some].astype("<i8").tobytes()], pa.binary()), pa.array([data], pa.binary())],
                    ["dim", "rows", "kind", "ids", "data"])


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(row["data"], row["kind"]).astype(np.float64).reshape(row["rows"], row["dim"])
    return np.frombuffer(row["ids"], "<i8"), x


def resolutions(dim: int) -> list[int]:
    """Numbers of segments, coarse to fine: 1, 4, 16, ... and segments of two."""
    out = [4 ** i for i in range(32) if 4 ** i < dim / 2]
    return out + [-(-dim // 2)] if dim > 1 else out


def segment_features(x: np.ndarray, segments: int) -> np.ndarray:
    """``sqrt(L)`` times mean and deviation of each segment: products of two rows of this
    bound the inner product from above."""
    edges = np.linspace(0, x.shape[1], segments + 1).astype(np.int64)
    length = np.diff(edges)
    total = np.add.reduceat(x, edges[:-1], axis=1)
    square = np.add.reduceat(x * x, edges[:-1], axis=1)
    spread = np.sqrt(np.maximum(square - total * total / length, 0))
    return np.concatenate([total / np.sqrt(length), spread], axis=1)


class Side:
    """Vectors with their features at every resolution."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.top = float(np.abs(x).max(initial=0))
        self.norm = np.sqrt((x * x).sum(1)) if self.top < 1e100 else np.full(len(x), np.inf)
        self._levels: dict[int, np.ndarray] = {}

    def level(self, segments: int) -> np.ndarray:
        if segments not in self._levels:
            self._levels[segments] = segment_features(self.x, segments)
        return self._levels[segments]


def search_tile(q: Side, rows: slice, c: Side, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, candidate, score) of a tile whose score may reach the query's floor."""
    dim = q.x.shape[1]
    exact = q.top * c.top * dim < EXACT
    slack = 1e-9 * c.norm.max(initial=0) * q.norm[rows] + 1e-6
    alive = pair = None
    for segments in resolutions(dim) if exact else ():
        fq, fc = q.level(segments)[rows], c.level(segments)
        if pair is None:
            reach = fq @ fc.T >= (floor - slack)[:, None]
            alive = reach if alive is None else alive & reach
            if alive.mean() < 0.05:
                pair = np.nonzero(alive)
        else:
            i, j = pair
            ok = np.empty(len(i), bool)
            for s in range(0, len(i), 65_536):
                a, b = i[s: s + 65_536], j[s: s + 65_536]
                ok[s: s + 65_536] = np.einsum("ij,ij->i", fq[a], fc[b]) >= (floor - slack)[a]
            pair = i[ok], j[ok]
    if pair is None:
        pair = np.nonzero(np.ones((len(floor), len(c.x)), bool) if alive is None else alive)
    i, j = pair
    x = q.x[rows]
    score = np.empty(len(i), np.int64)
    if exact:
        if len(i) > 0.2 * len(x) * len(c.x):
            score[:] = (x @ c.x.T)[i, j]
        else:
            for s in range(0, len(i), 65_536):
                score[s: s + 65_536] = np.einsum("ij,ij->i", x[i[s: s + 65_536]], c.x[j[s: s + 65_536]])
    else:  # beyond a double's integers: whole numbers of any size, clipped to a long
        left = [[int(v) for v in r] for r in x]
        right = [[int(v) for v in r] for r in c.x]
        for n, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            score[n] = max(-LONG - 1, min(LONG, sum(u * v for u, v in zip(left[a], right[b], strict=True))))
    ok = score >= floor[i]
    return i[ok], j[ok], score[ok]


def best(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int):
    """The k highest scores of each query, ties to the smaller id."""
    order = np.lexsort((ids, np.invert(score), query))
    query, score, ids = query[order], score[order], ids[order]
    first = np.searchsorted(query, query)
    keep = np.arange(len(query)) - first < k
    return query[keep], score[keep], ids[keep]


def _scan(shared, k: int, floors):
    """Each task's k best candidates of every query of the group."""

    def run(batches):
        group = shared.value
        sides = {dim: Side(x) for dim, (_, x) in group.items()}
        floor = {dim: (np.full(len(ids), -LONG - 1) if floors is None else floors.value[dim].copy())
                 for dim, (ids, _) in group.items()}
        found = {}
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                if dim not in group:
                    continue
                qids = group[dim][0]
                ids, x = _unpack(row)
                side = Side(x)
                got = [found[dim]] if dim in found else []
                for s in range(0, len(qids), TILE_ROWS):
                    rows = slice(s, min(s + TILE_ROWS, len(qids)))
                    i, j, score = search_tile(sides[dim], rows, side, floor[dim][rows])
                    other = qids[i + s] != ids[j]
                    got.append(best(i[other] + s, score[other], ids[j[other]], k))
                merged = best(*(np.concatenate(part) for part in zip(*got, strict=True)), k)
                found[dim] = merged
                full = np.flatnonzero(np.bincount(merged[0], minlength=len(qids)) == k)
                last = np.searchsorted(merged[0], full, "right") - 1
                floor[dim][full] = np.maximum(floor[dim][full], merged[1][last])
        for dim, (query, score, ids) in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(query), dim, np.int32)), pa.array(query.astype(np.int64)),
                 pa.array(group[dim][0][query]), pa.array(ids), pa.array(score)],
                ["dim", "q", "query_id", "vec_id", "score"])

    return run


_FOUND = "dim int, q long, query_id long, vec_id long, score long"


def _top(found: DataFrame, k: int, *more: str) -> DataFrame:
    by = W.Window.partitionBy(*more, "dim", "q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _gathered(rows: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    parts: dict[int, list] = {}
    for row in rows:
        parts.setdefault(row["dim"], []).append(_unpack(row.asDict()))
    return {dim: (np.concatenate([i for i, _ in some]), np.concatenate([x for _, x in some]))
            for dim, some in parts.items()}


def top_inner_products(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose ``vec_id`` is divisible by
    ``every`` the k highest integer inner products with rows of another ``vec_id``.

    ``vectors``: ``vec_id, embedding``; components are quantised to ``floor(256 x)``.  Vectors
    that are null or hold a null or non-finite component, and rows without an id, take no
    part.  Vectors of different lengths are not compared; empty vectors score 0 with each
    other.  A repeated row is a query, and a candidate, as often as it occurs; a row never
    finds its own id.  Equal scores go to the smaller id.  Scores beyond a long are clipped
    to it.  A query with fewer candidates has fewer rows, an empty table none.
    """
    spark = vectors.sparkSession
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = (vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
              .where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~bad))
    shape = "dim int, rows int, kind string, ids binary, data binary"
    blocks = materialize(usable.mapInArrow(_blocks, shape), "candidate-blocks")
    asked = materialize(usable.where(F.col("vec_id") % every == 0).mapInArrow(_blocks, shape)
                        .withColumn("block", F.monotonically_increasing_id()), "query-blocks")
    # blocks, not vectors, are numbered; the running sum of their bytes cuts the groups
    held = (F.col("rows").cast("long") * (F.col("dim") + 1) * 8)
    cut = F.floor((F.sum(held).over(W.Window.orderBy("block")) - 1) / GROUP_BYTES)
    group_of = materialize(asked.select("block", "rows", "dim").withColumn("group", cut).select("block", "group"),
                           "query-groups")
    groups = [r["group"] for r in group_of.select("group").distinct().orderBy("group").collect()]
    out = None
    for g in groups:
        rows = asked.join(group_of.where(F.col("group") == g), "block", "left_semi").orderBy("block").collect()
        group = _gathered(rows)
        shared = spark.sparkContext.broadcast(group)
        among = _top(asked.mapInArrow(_scan(shared, k, None), _FOUND), k).where(F.col("rank") == k)
        floor = {dim: np.full(len(ids), -LONG - 1) for dim, (ids, _) in group.items()}
        for r in among.select("dim", "q", "score").toLocalIterator():
            floor[r["dim"]][r["q"]] = r["score"]
        floors = spark.sparkContext.broadcast(floor)
        found = materialize(blocks.mapInArrow(_scan(shared, k, floors), _FOUND), "nearest").withColumn("group", F.lit(g))
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], _FOUND + ", group long")
    return _top(out, k, "group").select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x::DOUBLE)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
  FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
