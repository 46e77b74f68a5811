"""Tables that look small to the planner and aren't don't go through the driver."""

import random

from pyspark.sql import functions as F

from lakecart.operators import payloads, search


def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_search_broadcasts_nothing_and_finds_terms_around_the_gram_length(spark):
    rng = random.Random(5)
    texts = [(i, "".join(rng.choice("ab1 ") for _ in range(rng.randint(0, 14))), rng.choice([None, "Aab1ab1b", "bb"])) for i in range(60)]
    terms = sorted({"".join(rng.choice("ab1") for _ in range(n)) for n in range(1, 10) for _ in range(6)} | {"ab1ab1", "ab1ab1b", "aab1ab1b", "zz"})
    products = spark.createDataFrame(texts, "product_id long, title string, description string")
    found = search.term_matches(products, spark.createDataFrame([(t,) for t in terms], "term string"))
    want = [(t, i) for t in terms for i, a, b in texts if t in a.lower() or t in (b or "").lower()]
    assert any(len(t) > search.GRAM for t, _ in want)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    whole = search.search_many(
        products.withColumn("price", F.lit(1).cast("decimal(18,2)")).withColumn("stock", F.lit(1)).withColumn("created_at", F.lit(1)),
        spark.createDataFrame([(1, "ab", None, None, 3)], "request_id int, q string, min_price int, max_price int, limit int"))
    assert "Broadcast" not in _plan(whole)


def test_sanitize_payload_broadcasts_nothing(spark):
    docs = spark.createDataFrame([(1, '{"a":{"b":["x",{}]}}'), (2, "[]")], "id int, payload string")
    clean = payloads.sanitize_payload(docs, "id")
    assert {r.id: r.payload for r in clean.collect()} == {1: '{"a":{"b":["x",{}]}}', 2: "[]"}
    assert "Broadcast" not in _plan(clean)
