"""Registered checkout, outcome and order-creation queries, with oracles.

The tables the shop keeps beside its orders are views of the order and payment tables: a
checkout row for every payment, an inbox with right, wrong, repeated and late outcomes,
cancel requests of owners and strangers, and order requests that come twice.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checkout
from ..registry import register
from .views import Views, sql_ctes

NOW = "1998-01-01 00:00:00"

_ORDERS = ("shop_orders", """SELECT order_id, customer_id, CASE WHEN status = 'rejected' AND order_id % 2 = 0 THEN 'expired'
    ELSE status END AS status, order_date AS created_at,
    order_date + INTERVAL 15 MINUTE AS expires_at FROM v_orders""")
_CHECKOUTS = ("checkouts", """SELECT order_id,
    CASE WHEN status IN ('succeeded', 'failed') AND order_id % 3 <> 0 THEN status WHEN order_id % 6 = 4 THEN 'creating' ELSE 'open' END AS state,
    CASE WHEN order_id % 6 <> 4 THEN 'ck-' || CAST(order_id AS VARCHAR) END AS checkout_id,
    CASE WHEN order_id % 6 <> 4 AND order_id % 9 <> 0 THEN 'https://pay/' || CAST(order_id AS VARCHAR) END AS checkout_url,
    CASE WHEN order_id % 6 <> 4 THEN created_at + INTERVAL 30 MINUTE END AS expires_at,
    CAST(amount * 100 AS BIGINT) AS amount, lower(currency) AS currency FROM v_payments""")
_INBOX = ("inbox", """SELECT 'ev' || CAST(k AS VARCHAR) || '-' || CAST(order_id AS VARCHAR) AS event_id, order_id,
    CASE WHEN order_id % 11 = 0 THEN NULL WHEN order_id % 7 = 0 THEN 'ck-x' ELSE 'ck-' || CAST(order_id AS VARCHAR) END AS checkout_id,
    CASE WHEN (order_id + k) % 4 = 0 THEN 'failed' ELSE 'succeeded' END AS outcome,
    CAST(total_amount * 100 AS BIGINT) + CASE WHEN order_id % 13 = 0 THEN 1 ELSE 0 END AS amount, lower(currency) AS currency,
    order_date + INTERVAL 5 MINUTE * ((order_id + k * 7) % 10) AS occurred_at
  FROM v_orders CROSS JOIN (SELECT unnest([1, 2]) AS k) WHERE k = 1 OR order_id % 5 = 0""")
_APPLIED = ("applied", """SELECT event_id, order_id, outcome, occurred_at, amount, currency,
    CASE WHEN action = 'applied' AND turn > 1 THEN 'ignored' ELSE action END AS action,
    CASE WHEN action = 'applied' AND turn > 1 THEN 'terminal_state' ELSE reason END AS reason
  FROM (SELECT *, row_number() OVER (PARTITION BY order_id, action ORDER BY occurred_at, event_id) AS turn FROM (
    SELECT i.*, CASE
        WHEN c.order_id IS NULL OR (i.checkout_id IS NOT NULL AND c.checkout_id IS NULL) THEN 'retry'
        WHEN (i.outcome = 'succeeded' AND i.checkout_id IS NULL) OR coalesce(i.checkout_id <> c.checkout_id, false) THEN 'ignored'
        WHEN i.outcome = 'succeeded' AND (i.amount IS DISTINCT FROM c.amount OR i.currency IS DISTINCT FROM c.currency) THEN 'ignored'
        WHEN i.outcome = 'succeeded' AND coalesce(o.status IN ('cancelled', 'expired'), false) THEN 'late'
        WHEN c.state IN ('succeeded', 'failed') THEN 'ignored' ELSE 'applied' END AS action,
      CASE
        WHEN c.order_id IS NULL OR (i.checkout_id IS NOT NULL AND c.checkout_id IS NULL) THEN 'checkout_not_ready'
        WHEN (i.outcome = 'succeeded' AND i.checkout_id IS NULL) OR coalesce(i.checkout_id <> c.checkout_id, false) THEN 'checkout_mismatch'
        WHEN i.outcome = 'succeeded' AND (i.amount IS DISTINCT FROM c.amount OR i.currency IS DISTINCT FROM c.currency) THEN 'amount_mismatch'
        WHEN i.outcome = 'succeeded' AND coalesce(o.status IN ('cancelled', 'expired'), false) THEN NULL
        WHEN c.state IN ('succeeded', 'failed') THEN 'terminal_state' END AS reason
    FROM inbox i LEFT JOIN checkouts c ON c.order_id = i.order_id LEFT JOIN shop_orders o ON o.order_id = i.order_id))""")
_BASE = ["v_orders", "v_payments"]


def _text(c) -> F.Column:
    return F.col(c).cast("string")


def tables(spark, sf_dir):
    """(orders, checkout rows, inbox) of the shop views."""
    v = Views(spark, sf_dir)
    k = F.col("order_id")
    orders = v.v_orders.select(
        "order_id", "customer_id", F.when((F.col("status") == "rejected") & (k % 2 == 0), "expired").otherwise(F.col("status")).alias("status"),
        F.col("order_date").alias("created_at"), (F.col("order_date") + F.expr("INTERVAL 15 MINUTE")).alias("expires_at"))
    known = k % 6 != 4
    checkouts = v.v_payments.select(
        "order_id", F.when(F.col("status").isin("succeeded", "failed") & (k % 3 != 0), F.col("status"))
        .when(~known, "creating").otherwise("open").alias("state"),
        F.when(known, F.concat(F.lit("ck-"), _text("order_id"))).alias("checkout_id"),
        F.when(known & (k % 9 != 0), F.concat(F.lit("https://pay/"), _text("order_id"))).alias("checkout_url"),
        F.when(known, F.col("created_at") + F.expr("INTERVAL 30 MINUTE")).alias("expires_at"),
        (F.col("amount") * 100).cast("bigint").alias("amount"), F.lower("currency").alias("currency"))
    twice = v.v_orders.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).where((F.col("k") == 1) | (k % 5 == 0))
    inbox = twice.select(
        F.concat(F.lit("ev"), _text("k"), F.lit("-"), _text("order_id")).alias("event_id"), "order_id",
        F.when(k % 11 == 0, F.lit(None)).when(k % 7 == 0, "ck-x").otherwise(F.concat(F.lit("ck-"), _text("order_id"))).alias("checkout_id"),
        F.when((k + F.col("k")) % 4 == 0, "failed").otherwise("succeeded").alias("outcome"),
        ((F.col("total_amount") * 100).cast("bigint") + F.when(k % 13 == 0, 1).otherwise(0)).alias("amount"),
        F.lower("currency").alias("currency"),
        (F.col("order_date") + F.make_dt_interval(mins=(5 * ((k + F.col("k") * 7) % 10)).cast("int"))).alias("occurred_at"))
    return orders, checkouts, inbox


def _applied(spark, sf_dir):
    orders, checkouts, inbox = tables(spark, sf_dir)
    return checkout.apply_outcomes(inbox, orders, checkouts), orders


@register("e12_apply_outcomes", sql_ctes("SELECT * FROM applied", _BASE, [_ORDERS, _CHECKOUTS, _INBOX, _APPLIED]))
def e12(spark, sf_dir):
    return _applied(spark, sf_dir)[0]


@register("e12_orders_after", sql_ctes("""SELECT o.order_id, CASE WHEN o.status = 'pending' AND EXISTS (SELECT 1 FROM applied a
    WHERE a.order_id = o.order_id AND a.action = 'applied' AND a.outcome = 'succeeded') THEN 'confirmed' ELSE o.status END AS status
FROM shop_orders o""", _BASE, [_ORDERS, _CHECKOUTS, _INBOX, _APPLIED]))
def e12_after(spark, sf_dir):
    return checkout.orders_after(*_applied(spark, sf_dir))


@register("e13_late_payments", sql_ctes("""SELECT order_id, event_id AS late_event_id, occurred_at AS late_at, amount AS late_amount
FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY occurred_at, event_id) AS rn FROM applied WHERE action = 'late')
WHERE rn = 1""", _BASE, [_ORDERS, _CHECKOUTS, _INBOX, _APPLIED]))
def e13(spark, sf_dir):
    return checkout.late_payments(_applied(spark, sf_dir)[0])


_REQUESTS = ("requests", """SELECT order_id * 10 AS request_id, CASE WHEN order_id % 40 = 1 THEN order_id + 10000000 ELSE order_id END AS order_id,
    CASE WHEN order_id % 12 = 5 THEN customer_id + 1 ELSE customer_id END AS buyer,
    CASE order_id % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'succeeded' WHEN 3 THEN 'expired' END AS remote_status
  FROM v_orders""")


@register("e9_cancel_orders", sql_ctes("""SELECT request_id, order_id, decision,
  CASE WHEN decision = 'cancelled' AND state IS NOT NULL THEN 'order-cancel:' || CAST(order_id AS VARCHAR) END AS close_event_id
FROM (SELECT r.request_id, r.order_id, c.state, CASE WHEN o.customer_id IS NULL OR o.customer_id <> r.buyer THEN 'not_found'
    WHEN o.status = 'cancelled' THEN 'already_cancelled' WHEN o.status <> 'pending' THEN 'conflict'
    WHEN coalesce(c.state = 'succeeded', false) OR coalesce(r.remote_status IN ('confirmed', 'succeeded'), false) THEN 'conflict'
    WHEN c.checkout_id IS NOT NULL AND r.remote_status IS NULL THEN 'retry' ELSE 'cancelled' END AS decision
  FROM requests r LEFT JOIN shop_orders o ON o.order_id = r.order_id LEFT JOIN checkouts c ON c.order_id = r.order_id)""",
                                       _BASE, [_ORDERS, _CHECKOUTS, _REQUESTS]))
def e9(spark, sf_dir):
    orders, checkouts, _ = tables(spark, sf_dir)
    k = F.col("order_id")
    requests = Views(spark, sf_dir).v_orders.select(
        (k * 10).alias("request_id"), F.when(k % 40 == 1, k + 10000000).otherwise(k).alias("order_id"),
        F.when(k % 12 == 5, F.col("customer_id") + 1).otherwise(F.col("customer_id")).alias("buyer"),
        F.when(k % 5 == 0, "open").when(k % 5 == 1, "confirmed").when(k % 5 == 2, "succeeded").when(k % 5 == 3, "expired")
        .alias("remote_status"))
    return checkout.cancel_orders(requests, orders, checkouts)


@register("e20_republish_pending", sql_ctes(f"""SELECT order_id FROM shop_orders o WHERE status = 'pending'
  AND expires_at > TIMESTAMP '{NOW}' AND NOT EXISTS (SELECT 1 FROM checkouts c WHERE c.order_id = o.order_id)""",
                                            _BASE, [_ORDERS, _CHECKOUTS]))
def e20(spark, sf_dir):
    orders, checkouts, _ = tables(spark, sf_dir)
    return checkout.republish_pending(orders, checkouts, NOW)


@register("e21_open_payment_rows", sql_ctes("""SELECT r.order_id, r.event_id, r.amount, 'creating' AS state,
  CASE o.status WHEN 'cancelled' THEN 'order-cancel:' || CAST(r.order_id AS VARCHAR)
    WHEN 'expired' THEN 'order-expire:' || CAST(r.order_id AS VARCHAR) END AS close_event_id
FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY occurred_at, event_id) AS rn FROM inbox) r
JOIN shop_orders o ON o.order_id = r.order_id WHERE rn = 1""", _BASE, [_ORDERS, _INBOX]))
def e21(spark, sf_dir):
    orders, _, inbox = tables(spark, sf_dir)
    return checkout.open_payment_rows(inbox, orders)


@register("f9_open_checkouts", sql_ctes("""SELECT order_id, CASE WHEN shown THEN checkout_id END AS checkout_id,
  CASE WHEN shown THEN checkout_url END AS checkout_url, CASE WHEN shown THEN expires_at END AS checkout_expires_at
FROM (SELECT c.*, o.status = 'pending' AND c.state = 'open' AND c.checkout_id IS NOT NULL AND c.checkout_url IS NOT NULL
    AND c.expires_at IS NOT NULL AS shown FROM shop_orders o JOIN checkouts c ON c.order_id = o.order_id)""",
                                        _BASE, [_ORDERS, _CHECKOUTS]))
def f9(spark, sf_dir):
    orders, checkouts, _ = tables(spark, sf_dir)
    return checkout.open_checkouts(orders, checkouts)


_LINES = ("lines", """SELECT order_id, product_id, CAST(sum(quantity) AS BIGINT) AS quantity FROM v_order_items GROUP BY order_id, product_id""")
# Three requests of every fourth order (one of the others).  The first of every eighth asks for
# too much and creates nothing; the second may have another buyer or other quantities; the
# third repeats the first's lines as they should have been.
_CREATE = ("create_requests", """SELECT l.order_id * 10 + k AS request_id, l.order_id, o.customer_id + CASE WHEN k = 2 AND l.order_id % 3 = 1 THEN 1 ELSE 0 END AS buyer,
    l.product_id, l.quantity + CASE WHEN k = 2 AND l.order_id % 3 = 2 THEN 1 WHEN k = 1 AND l.order_id % 8 = 4 THEN 90000 ELSE 0 END AS quantity
  FROM lines l JOIN v_orders o ON o.order_id = l.order_id CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) WHERE k = 1 OR l.order_id % 4 = 0""")


@register("e19_create_orders", sql_ctes("""SELECT r.request_id, r.order_id, CASE WHEN r.request_id > f.request_id THEN
    CASE WHEN r.buyer = f.buyer AND r.cart = f.cart THEN 'existing' ELSE 'conflict' END ELSE r.verdict END AS decision,
  CASE WHEN r.request_id = f.request_id THEN r.total END AS total
FROM judged r LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY request_id) AS place FROM judged WHERE verdict = 'created') f
  ON f.order_id = r.order_id AND f.place = 1""", ["v_orders", "v_order_items", "v_products"], [_LINES, _CREATE, ("judged", """SELECT *,
    CASE WHEN missing THEN 'price_unavailable' WHEN total > 99999999 THEN 'amount_invalid' ELSE 'created' END AS verdict FROM (
  SELECT request_id, order_id, buyer, string_agg(c.product_id || 'x' || quantity, ',' ORDER BY c.product_id) AS cart,
    bool_or(p.price IS NULL) AS missing, CAST(sum(CAST(p.price * 100 AS BIGINT) * quantity) AS BIGINT) AS total
  FROM create_requests c LEFT JOIN v_products p ON p.product_id = c.product_id AND p.product_id % 50 <> 0 GROUP BY request_id, order_id, buyer)""")]))
def e19(spark, sf_dir):
    v = Views(spark, sf_dir)
    k = F.col("order_id")
    lines = v.v_order_items.groupBy("order_id", "product_id").agg(F.sum("quantity").alias("quantity"))
    carts = lines.groupBy("order_id").agg(F.collect_list(F.struct("product_id", "quantity")).alias("items"))
    x = carts.join(v.v_orders.select("order_id", "customer_id"), "order_id").withColumn("k", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    x = x.where((F.col("k") == 1) | (k % 4 == 0))
    second = F.col("k") == 2
    more = F.when(second & (k % 3 == 2), 1).when((F.col("k") == 1) & (k % 8 == 4), 90000).otherwise(0)
    requests = x.select(
        (k * 10 + F.col("k")).alias("request_id"), "order_id",
        (F.col("customer_id") + F.when(second & (k % 3 == 1), 1).otherwise(0)).alias("buyer"),
        F.transform("items", lambda i: F.struct(i["product_id"].alias("product_id"), (i["quantity"] + more).alias("quantity"))).alias("items"))
    prices = v.v_products.where(F.col("product_id") % 50 != 0).select(
        "product_id", (F.col("price") * 100).cast("bigint").alias("unit_amount"))
    return checkout.create_orders(requests, prices)
