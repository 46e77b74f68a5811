"""Registered catalog / order lookup queries and scalar helpers, with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import cents_to_text, money_to_cents
from ..functions.text import input_decision
from ..operators import catalog
from ..registry import register
from .mart import stock_band
from .views import Views, sql_ctes

SEARCH_TERM, SEARCH_MIN, SEARCH_MAX = "an", "900", "1500"
DUE_NOW, DUE_K = "1998-01-01 00:00:00", 20
PER_BUYER = 5


def _catalog(v):
    """Products with a description (the part type) and a deterministic image path."""
    p = v.part.select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("title"), F.col("p_type").alias("description"),
        F.when(F.col("p_partkey") % 100 != 0, F.col("p_type")).alias("category"),
        F.col("p_retailprice").cast("decimal(18,2)").alias("price"), (F.col("p_size") - 1).alias("stock"),
        F.lit("PEN").alias("currency"))
    path = F.concat(F.lit("img/"), F.col("product_id").cast("string"),
                    F.when(F.col("product_id") % 3 == 0, "-full.webp").when(F.col("product_id") % 3 == 1, "-thumb.png")
                    .otherwise(".jpg"))
    return p.withColumn("image_path", path)


_CATALOG_SQL = ("catalog", """SELECT p.*, t.p_type AS description,
    'img/' || CAST(p.product_id AS VARCHAR) || CASE p.product_id % 3 WHEN 0 THEN '-full.webp' WHEN 1 THEN '-thumb.png'
      ELSE '.jpg' END AS image_path
  FROM v_products p JOIN part t ON t.p_partkey = p.product_id""")


@register("n8_n12_product_scalars", sql_ctes("""SELECT product_id,
  CASE WHEN stock <= 0 THEN 'out_of_stock' WHEN stock <= 10 THEN 'low' WHEN stock <= 40 THEN 'ok'
    WHEN stock IS NOT NULL THEN 'high' END AS stock_band,
  CAST(round(price * 100) AS BIGINT) AS price_cents,
  CAST(CAST(CAST(round(price * 100) AS BIGINT) AS DECIMAL(20,2)) / 100 AS DECIMAL(20,2))::VARCHAR AS price_text,
  stock > 0 AS available,
  CASE WHEN regexp_matches(image_path, '-thumb\\.[^.]+$') THEN image_path
       WHEN regexp_matches(image_path, '-full\\.[^.]+$') THEN regexp_replace(image_path, '-full\\.([^.]+)$', '-thumb.\\1')
  END AS thumbnail_path,
  substr(title, 1, 20) AS title_short,
  replace(replace('product {product_id} in order {order_id}', '{product_id}', CAST(product_id AS VARCHAR)),
    '{order_id}', '00000000-0000-4000-8000-000000000001') AS bound_text
FROM catalog""", ["v_products"], [_CATALOG_SQL]))
def scalars(spark, sf_dir):
    c = _catalog(Views(spark, sf_dir))
    cents = money_to_cents("price")
    return c.select(
        "product_id", stock_band("stock").alias("stock_band"), cents.alias("price_cents"),
        cents_to_text(cents).alias("price_text"), (F.col("stock") > 0).alias("available"),
        catalog.thumbnail_path("image_path").alias("thumbnail_path"),
        catalog.truncate("title", 20).alias("title_short"),
        catalog.bind_placeholders(F.lit("product {product_id} in order {order_id}"),
                                  product_id="{product_id}").alias("bound_text"),
    ).withColumn("bound_text", F.replace(F.col("bound_text"), F.lit("{product_id}"), F.col("product_id").cast("string")))


@register("f1_search_catalog", sql_ctes(f"""SELECT product_id, title, description, price FROM catalog
WHERE (contains(lower(title), '{SEARCH_TERM}') OR contains(lower(description), '{SEARCH_TERM}'))
  AND price >= {SEARCH_MIN} AND price <= {SEARCH_MAX}""", ["v_products"], [_CATALOG_SQL]))
def f1(spark, sf_dir):
    c = _catalog(Views(spark, sf_dir)).withColumn("created_at", F.col("product_id"))
    return catalog.search_catalog(c, SEARCH_TERM, SEARCH_MIN, SEARCH_MAX).select(
        "product_id", "title", "description", "price")


@register("f4_orders_of", sql_ctes(f"""SELECT order_id, customer_id, order_date, status, total_amount, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY order_date DESC NULLS LAST, order_id DESC)
    AS INTEGER) AS rank
  FROM v_orders WHERE status = 'pending') WHERE rank <= {PER_BUYER}""", ["v_orders"]))
def f4(spark, sf_dir):
    o = Views(spark, sf_dir).v_orders
    return catalog.orders_of(o, status="pending", limit=PER_BUYER).select(
        "order_id", "customer_id", "order_date", "status", "total_amount", "rank")


@register("f10_due_jobs", sql_ctes(f"""SELECT payment_id, order_id, created_at FROM v_payments
WHERE status = 'pending' AND created_at <= TIMESTAMP '{DUE_NOW}'
ORDER BY created_at, payment_id LIMIT {DUE_K}""", ["v_payments"]))
def f10(spark, sf_dir):
    q = Views(spark, sf_dir).v_payments.where(F.col("status") == "pending")
    return catalog.due_jobs(q, DUE_NOW, DUE_K, due="created_at", order=("created_at", "payment_id")).select(
        "payment_id", "order_id", "created_at")


@register("j8_snapshot_diff", sql_ctes("""SELECT coalesce(l.product_id, r.product_id) AS product_id,
  CASE WHEN r.product_id IS NULL THEN 'create' WHEN l.product_id IS NULL THEN 'delete'
    WHEN (r.quantity_on_hand, r.quantity_reserved, r.warehouse) IS DISTINCT FROM
         (l.quantity_on_hand, l.quantity_reserved, l.warehouse) THEN 'update' ELSE 'same' END AS action
  FROM (SELECT * FROM v_inventory WHERE snapshot_date = DATE '2001-09-30' AND quantity_available > 0) r
  FULL JOIN (SELECT * FROM v_inventory WHERE snapshot_date = DATE '2001-09-23' AND quantity_on_hand > 0) l
    ON r.product_id = l.product_id""", ["v_inventory"]))
def j8(spark, sf_dir):
    inv = Views(spark, sf_dir).v_inventory
    remote = inv.where((F.col("snapshot_date") == F.lit("2001-09-30").cast("date")) & (F.col("quantity_available") > 0))
    local = inv.where((F.col("snapshot_date") == F.lit("2001-09-23").cast("date")) & (F.col("quantity_on_hand") > 0))
    return catalog.keyed_diff(remote, local, "product_id", ["quantity_on_hand", "quantity_reserved", "warehouse"])


@register("q13_guard_event_counts")
def q13(spark, sf_dir):
    """Q13: counts per (guardrail, reason, action) of the input guard over every user turn
    (regex guard: no SQL oracle)."""
    t = Views(spark, sf_dir).v_turns.where(F.col("type") == "human")
    d = t.select(input_decision("text").alias("d"))
    return d.groupBy(F.lit("input").alias("guardrail"), F.coalesce("d.reason", F.lit("ok")).alias("reason"),
                     F.when(F.col("d.reason").isNotNull(), "blocked")
                     .when(F.col("d.redacted"), "redacted").otherwise("passed").alias("action")).agg(
        F.count(F.lit(1)).alias("events"))


@register("e14_payment_reconciliation", sql_ctes("""SELECT order_id, max(total) AS total_amount, CAST(sum(paid) AS DECIMAL(38,2)) AS paid_amount,
  CASE WHEN NOT bool_or(side = 'p') THEN 'missing_payment' WHEN NOT bool_or(side = 's') THEN 'payment_without_sale'
    WHEN count(DISTINCT currency) > 1 THEN 'currency_mismatch' WHEN coalesce(sum(paid) = max(total), false) THEN 'ok' ELSE 'amount_mismatch' END AS reason
FROM (SELECT 's' AS side, order_id, CAST(total_amount AS DECIMAL(38,2)) AS total, NULL::DECIMAL(38,2) AS paid, currency FROM v_orders WHERE status IN ('confirmed', 'shipped')
  UNION ALL SELECT 'p', order_id, NULL, amount, currency FROM v_payments WHERE status = 'succeeded') GROUP BY order_id""", ["v_orders", "v_payments"]))
def e14(spark, sf_dir):
    from ..operators.payments import payment_reconciliation
    v = Views(spark, sf_dir)
    return payment_reconciliation(v.v_orders, v.v_payments)
