"""Nested-document functions, catalog scalars, evaluation summaries and exact order
statistics (against brute force)."""

import math
import statistics
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from lakecart.operators import catalog, evals
from lakecart.plans.views import Views

from .conftest import SF_SMALL

ITEM = "array<struct<productId:string,quantity:int,unitAmount:int>>"


def test_nested_functions(spark):
    df = spark.sql(f"""SELECT
      CAST(array(named_struct('productId','a','quantity',2,'unitAmount',150),
                 named_struct('productId','b','quantity',1,'unitAmount',999)) AS {ITEM}) AS items,
      CAST(array(named_struct('productId','b','quantity',1,'unitAmount',1),
                 named_struct('productId','a','quantity',2,'unitAmount',2)) AS {ITEM}) AS other,
      CAST(array() AS {ITEM}) AS empty,
      CAST(NULL AS {ITEM}) AS none""")
    r = df.select(
        catalog.order_total("items").alias("t1"), catalog.order_total("empty", F.lit(5), F.lit(3)).alias("t2"),
        catalog.order_total("none", F.lit(5), F.lit(3)).alias("t3"), catalog.order_total("none").alias("t4"),
        catalog.items_count("items").alias("c1"), catalog.items_count("empty", F.lit(4)).alias("c2"),
        catalog.items_count("none").alias("c3"),
        catalog.same_items("items", "other").alias("same"), catalog.valid_cart("items").alias("v1"),
        catalog.valid_cart("empty").alias("v2"),
        catalog.changed(F.struct(F.lit(1).alias("x")), F.struct(F.lit(None).cast("int").alias("x"))).alias("ch"),
    ).first()
    assert (r.t1, r.t2, r.t3, r.t4) == (1299, 0, 15, None)
    assert (r.c1, r.c2, r.c3) == (3, 4, 0)
    assert r.same and r.v1 and not r.v2 and r.ch


def test_thumbnail_path(spark):
    df = spark.createDataFrame([("a/x-full.webp",), ("a/x-thumb.png",), ("a/x.jpg",), ("a/full.webp",)], "p string")
    assert [r[0] for r in df.select(catalog.thumbnail_path("p")).collect()] == [
        "a/x-thumb.webp", "a/x-thumb.png", None, None]


def test_keyed_diff_second_run_is_all_same(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, None), (4, "w")], "k int, v string")
    d = {r.k: r.action for r in catalog.keyed_diff(a, b, "k", ["v"]).collect()}
    assert d == {1: "delete", 2: "update", 3: "same", 4: "create"}
    assert {r.action for r in catalog.keyed_diff(a, a, "k", ["v"]).collect()} == {"same"}


def _half_up(x):
    return Decimal(x).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)


def test_order_stats_match_brute_force(spark):
    ev = Views(spark, SF_SMALL).events.select("event_type", F.col("value").cast("decimal(18,2)").alias("v"))
    got = {r.event_type: (r.median, r.p95) for r in evals.order_stats(ev, ["event_type"], "v").collect()}
    groups = {}
    for r in ev.collect():
        groups.setdefault(r.event_type, []).append(r.v)
    for k, vals in groups.items():
        s = sorted(vals)
        p95 = s[max(0, math.ceil(len(s) * 0.95) - 1)]
        assert got[k] == (_half_up(statistics.median(s)), p95)


def test_summary_and_gate(spark):
    scores = spark.createDataFrame([
        ("a", "domain", "domain_correct", 1.0, None), ("b", "domain", "domain_correct", 0.0, None),
        ("c", "guardrail", "domain_correct", None, None), ("c", "guardrail", "guardrail_correct", 1.0, None),
        ("d", "guardrail", "guardrail_correct", None, "boom")],
        "case_id string, kind string, evaluator string, score double, error string")
    s = {(r.kind, r.evaluator): (r.score, r.scored, r.skipped) for r in evals.summarize(scores).collect()}
    assert s[("(all)", "domain_correct")] == (0.5, 2, 1)
    assert s[("guardrail", "guardrail_correct")] == (1.0, 1, 0)
    gate = {r.evaluator: r.passed for r in evals.threshold_gate(evals.summarize(scores)).collect()}
    assert gate["guardrail_correct"] and not gate["domain_correct"]
    assert gate["no_pii_leak"]  # it never ran: skipped, not failed
    fails = [(r.case_id, r.evaluator) for r in evals.failures(scores).collect()]
    assert fails == [("b", "domain_correct")]
    conf = spark.createDataFrame([(True, True), (True, False), (False, False)], "e boolean, a boolean")
    m = {(r.expected, r.actual): r.n for r in evals.confusion(conf, "e", "a", [False, True]).collect()}
    assert m == {(False, False): 1, (False, True): 0, (True, False): 1, (True, True): 1}


def test_confusion_counts_every_case(spark):
    from lakecart.plans import eval_queries
    sf = "/root/testdata/sf0.001"
    cases = {r["kind"]: r["count"] for r in eval_queries.labelled_cases(spark, sf).groupBy("kind").count().collect()}
    got = eval_queries.v11(spark, sf).collect()
    assert {r["kind"] for r in got} == {"domain", "guardrail"} and len(got) == 8
    assert {k: sum(r["n"] for r in got if r["kind"] == k) for k in cases} == cases


def test_contract_rules(spark):
    from lakecart.operators import quality
    prods = spark.createDataFrame([
        (" Polo ", "Algodón", "19.90", "5"), ("", "x", "1.99", "-1"), ("t" * 161, "", "12.345", "1.5"),
        ("ok", "ok", "999999.99", "2147483647"), ("ok", "ok", "1000000", "2147483648")],
        "title string, description string, price string, stock string")
    errs = [r.errors for r in quality.validate_products(prods).collect()]
    assert errs == [[], ["title", "price", "stock"], ["title", "description", "price", "stock"], [],
                    ["price", "stock"]]
    u = "11111111-1111-4111-8111-111111111111"
    batch = spark.createDataFrame([
        ("op-1", [(u, 3)]), ("", [(u, 0), (u, 2)]), ("op-3", []), ("op-4", [("bad", 1)])],
        "operation_id string, adjustments array<struct<productId:string,delta:long>>")
    errs = [r.errors for r in quality.validate_stock_batch(batch).collect()]
    assert errs == [[], ["operation_id", "delta", "duplicate_product"], ["lines"], ["product_id"]]
