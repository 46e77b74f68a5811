"""Operator 11 against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakecart.llm import topk

SCHEMA = "vec_id long, embedding array<double>"


def plain_top(rows, k=5, every=50):
    quantised = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
                 if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, left in quantised:
        if q % every:
            continue
        scores = sorted((-sum(a * b for a, b in zip(left, right, strict=True)), c) for c, right in quantised
                        if c != q and len(right) == len(left))[:k]
        out += [(q, r, c, -s) for r, (s, c) in enumerate(scores, 1)]
    return sorted(out)


def cones(seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((4, dim))
    x = centres[rng.integers(0, 4, n)] + spread * rng.standard_normal((n, dim))
    return x / np.sqrt((x * x).sum(1, keepdims=True))


@pytest.mark.parametrize("dim,spread", [(64, 0.3), (64, 5.0), (7, 1.0), (1, 1.0), (2, 1.0)])
def test_matches_plain_python(spark, dim, spread):
    rows = [(i, v.tolist()) for i, v in enumerate(cones(dim, 900, dim, spread))]
    rows += [(1000 + i, rows[3][1]) for i in range(60)]  # a group of copies: ties go to small ids
    found = topk.top_inner_products(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert sorted(tuple(r) for r in found.collect()) == plain_top(rows)


def test_edges(spark):
    rng = random.Random(3)
    rows = [(0, [0.5, -0.25]), (0, [0.5, -0.25]), (50, None), (100, [math.nan, 1.0]), (150, [None, 1.0]),
            (200, []), (201, []), (250, [0.0, 0.0]), (None, [1.0, 1.0]), (-50, [-1.0, 3.0]), (300, [math.inf, 0.0]),
            (350, [1.0, 2.0, 3.0]), (400, [1e9, 1e9]), (401, [1e12, -1e9]), (451, [1.0])]
    rows += [(i, [rng.uniform(-1, 1), rng.uniform(-1, 1)]) for i in range(1, 50)]
    df = spark.createDataFrame(rows, SCHEMA)
    clash = df.withColumns({c: F.lit("clash") for c in ("q", "rank", "score", "dim", "block", "group", "label")})
    limit = (1 << 63) - 1
    expected = [(q, r, c, max(-limit - 1, min(limit, s))) for q, r, c, s in plain_top(rows)]
    assert sorted(tuple(r) for r in topk.top_inner_products(clash).collect()) == expected
    assert topk.top_inner_products(df.where("false")).count() == 0
    alone = topk.top_inner_products(df.where("vec_id = 350"))
    assert alone.count() == 0 and alone.columns == ["query_id", "rank", "vec_id", "score"]


def test_floats_and_groups(spark, monkeypatch):
    monkeypatch.setattr(topk, "GROUP_BYTES", 2000)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 8)
    monkeypatch.setattr(topk, "TILE_ROWS", 3)
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(cones(5, 700, 16, 1.0))]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("embedding", F.col("embedding").cast("array<float>"))
    assert sorted(tuple(r) for r in topk.top_inner_products(df, k=3, every=10).collect()) == plain_top(rows, 3, 10)


def test_values_beyond_doubles_integers(spark):
    rows = [(0, [1e300, 1.0]), (1, [1e10, 2e10]), (2, [-1e300, 1e300]), (3, [2.0, 1.7e308]), (4, [3e7, 3e7])]
    found = topk.top_inner_products(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(found, key=lambda r: r["rank"])][0] == (1, 1)
    assert {r["vec_id"] for r in found} == {1, 2, 3, 4}


def test_bounds_hold():
    rng = np.random.default_rng(1)
    for dim in (1, 2, 3, 17, 64):
        a, b = (np.floor(256 * rng.standard_normal((50, dim))) for _ in range(2))
        for segments in topk.resolutions(dim):
            bound = topk.segment_features(a, segments) @ topk.segment_features(b, segments).T
            assert (bound + 1e-6 >= a @ b.T).all()
