"""Registered search for a table of requests, with an oracle that tries every pair."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search
from ..registry import register
from .views import Views

_TITLE = "p_name || ' ' || p_brand || ' ' || CAST(p_partkey AS VARCHAR)"


def _products(spark, sf_dir):
    k = F.col("p_partkey")
    return Views(spark, sf_dir).part.select(
        k.alias("product_id"), F.concat_ws(" ", "p_name", "p_brand", k.cast("string")).alias("title"), F.col("p_type").alias("description"),
        F.when(k % 50 != 0, F.col("p_retailprice").cast("decimal(18,2)")).alias("price"), (F.col("p_size") - 1).alias("stock"),
        F.when(k % 77 != 0, k % 365).alias("created_at"))


def _requests(spark, sf_dir):
    """A request of every customer: words, parts of words, ids, signs, blanks; price ranges,
    some of them empty or upside down; limits, some of them too large."""
    k = F.col("c_custkey")
    q = (F.when(k % 8 == 0, F.lit(None)).when(k % 8 == 1, "  RING ").when(k % 8 == 2, F.concat(F.lit("brand#"), (k % 25).cast("string")))
         .when(k % 8 == 3, k.cast("string")).when(k % 8 == 4, "e").when(k % 8 == 5, F.when(k % 3 == 0, "xyzzy").otherwise("o%_"))
         .when(k % 8 == 6, F.substring("c_mktsegment", 1, 2)).otherwise(F.concat(F.lit("gear brand#"), (k % 9).cast("string"))))
    return Views(spark, sf_dir).customer.select(
        k.alias("request_id"), q.alias("q"), F.when(k % 3 == 0, 890 + (k % 90)).cast("decimal(18,2)").alias("min_price"),
        F.when(k % 4 < 2, F.expr("CAST(905.55 AS DECIMAL(18,2))") + k % 97).cast("decimal(18,2)").alias("max_price"),
        F.when(k % 10 != 0, (1 + k % 11).cast("int")).alias("limit"))


@register("f2_search_many", f"""WITH p AS (SELECT p_partkey AS product_id, {_TITLE} AS title, p_type AS description, p_size - 1 > 0 AS available,
    CASE WHEN p_partkey % 50 <> 0 THEN CAST(p_retailprice AS DECIMAL(18,2)) END AS price, CASE WHEN p_partkey % 77 <> 0 THEN p_partkey % 365 END AS created
  FROM part),
r AS (SELECT c_custkey AS k, CASE c_custkey % 8 WHEN 0 THEN NULL WHEN 1 THEN 'ring' WHEN 2 THEN 'brand#' || (c_custkey % 25) WHEN 3 THEN c_custkey::VARCHAR
      WHEN 4 THEN 'e' WHEN 5 THEN CASE WHEN c_custkey % 3 = 0 THEN 'xyzzy' ELSE 'o%_' END WHEN 6 THEN lower(substr(c_mktsegment, 1, 2))
      ELSE 'gear brand#' || (c_custkey % 9) END AS q,
    CASE WHEN c_custkey % 3 = 0 THEN CAST(890 + c_custkey % 90 AS DECIMAL(18,2)) END AS lo,
    CASE WHEN c_custkey % 4 < 2 THEN CAST(905.55 + c_custkey % 97 AS DECIMAL(18,2)) END AS hi,
    CASE WHEN c_custkey % 10 <> 0 THEN 1 + c_custkey % 11 ELSE 5 END AS lim FROM customer),
ok AS (SELECT * FROM r WHERE NOT coalesce(lo > hi, false) AND lim BETWEEN 1 AND 10),
hit AS (SELECT ok.k, ok.lim, p.*, count(*) OVER (PARTITION BY ok.k) AS total,
    row_number() OVER (PARTITION BY ok.k ORDER BY p.created DESC NULLS LAST, p.product_id) AS place
  FROM ok JOIN p ON (ok.q IS NULL OR contains(lower(p.title), ok.q) OR contains(lower(p.description), ok.q))
    AND (ok.lo IS NULL OR p.price >= ok.lo) AND (ok.hi IS NULL OR p.price <= ok.hi))
SELECT r.k AS request_id, CASE WHEN ok.k IS NOT NULL THEN coalesce(hit.total, 0) END AS total, CAST(hit.place AS INTEGER) AS place, hit.product_id, hit.title,
  CAST(hit.price AS VARCHAR) AS price_text, hit.available, hit.description, CASE WHEN ok.k IS NULL THEN 'invalid_filters' END AS error
FROM r LEFT JOIN ok ON ok.k = r.k LEFT JOIN hit ON hit.k = r.k AND hit.place <= hit.lim""")
def f2(spark, sf_dir):
    return search.search_many(_products(spark, sf_dir), _requests(spark, sf_dir))
