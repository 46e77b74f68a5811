"""Registered order/stock/payment state queries over the saga event log, with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import saga, stock
from ..registry import register
from .views import Views, sql_ctes

# Evaluation instant for the expiry rules (an explicit parameter keeps runs reproducible).
NOW = "2024-01-15 00:00:00"

_FIRST = "row_number() OVER (PARTITION BY {k} ORDER BY occurred_at, event_id)"

_PLACED = ("placed", f"""SELECT order_key, occurred_at AS placed_at, event_id AS placed_event FROM (
    SELECT order_key, occurred_at, event_id, {_FIRST.format(k='order_key')} AS rn
    FROM v_saga WHERE subject = 'orders.placed') WHERE rn = 1""")
_TERM = ("term", """SELECT s.order_key, s.event_id, s.occurred_at,
    CASE WHEN s.subject = 'payment.succeeded' THEN 'confirmed' ELSE 'rejected' END AS status,
    CASE WHEN s.subject = 'payment.failed' THEN s.reason WHEN s.subject = 'inventory.released' THEN 'payment_failed'
         WHEN s.subject = 'inventory.rejected' THEN s.reason END AS rejection_reason
  FROM v_saga s JOIN placed p ON s.order_key = p.order_key
  WHERE s.subject IN ('payment.succeeded', 'payment.failed', 'inventory.released', 'inventory.rejected')
    AND (s.occurred_at > p.placed_at OR (s.occurred_at = p.placed_at AND s.event_id > p.placed_event))""")
_DECIDED = ("decided", f"""SELECT order_key, status, rejection_reason, occurred_at AS decided_at, event_id AS decided_event
  FROM (SELECT *, {_FIRST.format(k='order_key')} AS rn FROM term) WHERE rn = 1""")
_STATUS = ("status", """SELECT p.order_key, p.placed_at, coalesce(d.status, 'pending') AS status, d.rejection_reason,
    d.decided_at, d.decided_event FROM placed p LEFT JOIN decided d ON p.order_key = d.order_key""")
_STATUS_CTES = (_PLACED, _TERM, _DECIDED, _STATUS)
_DUE = ("due", f"""SELECT order_key, placed_at + INTERVAL 15 MINUTE AS expires_at FROM status
  WHERE status = 'pending' AND placed_at + INTERVAL 15 MINUTE <= TIMESTAMP '{NOW}'""")


def _status(spark, sf_dir):
    ev = Views(spark, sf_dir).v_saga
    return ev, saga.order_status(ev)


@register("e1_order_status", sql_ctes("SELECT * FROM status", ["v_saga"], _STATUS_CTES))
def e1(spark, sf_dir):
    return _status(spark, sf_dir)[1]


@register("e6_deadlines", sql_ctes("""SELECT o.order_id, o.status, CASE WHEN o.base IS NOT NULL THEN greatest(o.base, c.last + INTERVAL 120 SECOND) END AS expires_at
FROM (SELECT order_id, status, CASE WHEN order_id % 3 <> 0 THEN order_date + INTERVAL 20 MINUTE
    WHEN status = 'pending' THEN order_date + INTERVAL 15 MINUTE END AS base FROM v_orders) o
LEFT JOIN (SELECT order_id, max(created_at + (payment_id % 40) * INTERVAL 1 MINUTE) AS last FROM v_payments WHERE amount > 100000 GROUP BY order_id) c
  ON c.order_id = o.order_id""", ["v_orders", "v_payments"]))
def e6(spark, sf_dir):
    """Every third order has no stored expiry; larger payments have an opened checkout."""
    v = Views(spark, sf_dir)
    k = F.col("order_id")
    orders = v.v_orders.select(k.alias("order_key"), F.col("order_date").alias("placed_at"), "status",
                               F.when(k % 3 != 0, F.col("order_date") + F.make_dt_interval(mins=F.lit(20))).alias("expires_at"))
    checkouts = v.v_payments.where("amount > 100000").select(
        k.alias("order_key"), (F.col("created_at") + F.make_dt_interval(mins=(F.col("payment_id") % 40).cast("int"))).alias("checkout_expires_at"))
    return saga.deadlines(orders, checkouts).select(F.col("order_key").alias("order_id"), "status", "expires_at")


@register("e7_expire_orders", sql_ctes(f"""SELECT order_key, expires_at, 'expired' AS status,
  'order_expired' AS rejection_reason, CASE WHEN EXISTS (SELECT 1 FROM v_saga r WHERE r.subject = 'inventory.reserved'
    AND r.quantity > 0 AND r.order_key = d.order_key) THEN 'order-expire:' || CAST(order_key AS VARCHAR) END AS close_event_id
FROM due d WHERE NOT EXISTS (SELECT 1 FROM v_saga s WHERE s.subject = 'payment.succeeded' AND s.order_key = d.order_key)""",
                                        ["v_saga"], _STATUS_CTES + (_DUE,)))
def e7(spark, sf_dir):
    ev, st = _status(spark, sf_dir)
    return saga.expire_orders(st, ev, NOW)


@register("e8_expiry_skipped_paid", sql_ctes("""SELECT order_key, expires_at FROM due d
WHERE EXISTS (SELECT 1 FROM v_saga s WHERE s.subject = 'payment.succeeded' AND s.order_key = d.order_key)""",
                                              ["v_saga"], _STATUS_CTES + (_DUE,)))
def e8(spark, sf_dir):
    ev, st = _status(spark, sf_dir)
    return saga.expiry_skipped_paid(st, ev, NOW)


@register("e5_released_stock", sql_ctes(f"""SELECT r.product_id, count(*) AS releases,
  CAST(sum(r.quantity) AS BIGINT) AS released_units
FROM res r WHERE EXISTS (SELECT 1 FROM v_saga f WHERE f.subject = 'payment.failed' AND f.order_key = r.order_key
  AND (f.occurred_at > r.occurred_at OR (f.occurred_at = r.occurred_at AND f.event_id > r.event_id)))
GROUP BY r.product_id""", ["v_saga"], [("res", f"""SELECT * FROM (SELECT order_key, event_id, occurred_at, product_id,
    quantity, {_FIRST.format(k='order_key')} AS rn FROM v_saga WHERE subject = 'inventory.reserved' AND quantity > 0)
  WHERE rn = 1""")]))
def e5(spark, sf_dir):
    return saga.released_stock(Views(spark, sf_dir).v_saga)


@register("e11_inbox", sql_ctes("""SELECT event_id, order_key, occurred_at, subject, quantity, product_id, value, reason
FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY occurred_at, event_id) AS rn FROM v_saga
  WHERE length(CAST(event_id AS VARCHAR)) <= 200) WHERE rn = 1""", ["v_saga"]))
def e11(spark, sf_dir):
    return saga.inbox(Views(spark, sf_dir).v_saga)


@register("e22_notifications", sql_ctes(f"""SELECT idempotency_key, subject, order_key, event_id, occurred_at,
  notification_subject FROM (
  SELECT subject || '/' || CAST(order_key AS VARCHAR) AS idempotency_key, subject, order_key, event_id, occurred_at,
    CASE subject WHEN 'payment.succeeded' THEN 'Pedido confirmado'
      WHEN 'inventory.rejected' THEN 'No pudimos completar tu pedido'
      WHEN 'payment.failed' THEN 'El pago no se completó' END AS notification_subject,
    row_number() OVER (PARTITION BY subject, order_key ORDER BY occurred_at, event_id) AS rn
  FROM v_saga WHERE subject IN ('payment.succeeded', 'inventory.rejected', 'payment.failed')
    AND NOT (subject = 'payment.failed' AND coalesce(reason IN ('order_cancelled', 'order_expired'), false)))
WHERE rn = 1""", ["v_saga"]))
def e22(spark, sf_dir):
    return saga.notifications(Views(spark, sf_dir).v_saga)


_E2_SQL = """WITH RECURSIVE {views},
d AS (SELECT s.event_id, s.product_id, s.occurred_at,
    CAST(CASE WHEN s.subject = 'inventory.reserved' THEN -s.quantity ELSE s.quantity END AS BIGINT) AS delta,
    row_number() OVER (PARTITION BY s.product_id ORDER BY s.occurred_at, s.event_id) AS rn,
    CAST(p.stock AS BIGINT) AS initial
  FROM v_saga s LEFT JOIN v_products p ON p.product_id = s.product_id
  WHERE s.subject IN ('inventory.reserved', 'inventory.released')),
walk AS (
  SELECT event_id, product_id, occurred_at, delta, rn, initial AS stock_before,
    CASE WHEN initial IS NULL THEN NULL WHEN delta IS NULL OR delta = 0 OR initial + delta < 0
      OR initial + delta > 2147483647 THEN initial ELSE initial + delta END AS stock_after
  FROM d WHERE rn = 1
  UNION ALL
  SELECT d.event_id, d.product_id, d.occurred_at, d.delta, d.rn, w.stock_after,
    CASE WHEN w.stock_after IS NULL THEN NULL WHEN d.delta IS NULL OR d.delta = 0 OR w.stock_after + d.delta < 0
      OR w.stock_after + d.delta > 2147483647 THEN w.stock_after ELSE w.stock_after + d.delta END
  FROM walk w JOIN d ON d.product_id = w.product_id AND d.rn = w.rn + 1)
SELECT event_id, product_id, occurred_at, delta,
  CASE WHEN stock_before IS NULL THEN 'product_not_found' WHEN delta IS NULL OR delta = 0 THEN 'invalid_delta'
    WHEN stock_before + delta < 0 THEN 'insufficient_stock' WHEN stock_before + delta > 2147483647 THEN 'stock_limit'
    ELSE 'applied' END AS result,
  stock_before, stock_after
FROM walk"""


def _e2_sql() -> str:
    from .views import SQL_VIEWS
    views = ",\n".join(f"{n} AS ({SQL_VIEWS[n]})" for n in ("v_saga", "v_products"))
    return _E2_SQL.format(views=views)


@register("e2_adjust_stock", _e2_sql())
def e2(spark, sf_dir):
    v = Views(spark, sf_dir)
    return stock.adjust_stock(v.v_products, stock.stock_deltas(v.v_saga))


@register("f8_active_reservations", sql_ctes(f"""SELECT r.order_key, r.product_id, r.quantity,
  r.occurred_at AS reserved_at, 'reserved' AS status
FROM res r WHERE NOT EXISTS (SELECT 1 FROM v_saga x WHERE x.subject = 'inventory.released' AND x.order_key = r.order_key
  AND (x.occurred_at > r.occurred_at OR (x.occurred_at = r.occurred_at AND x.event_id > r.event_id)))""",
                                              ["v_saga"], [("res", f"""SELECT * FROM (SELECT order_key, event_id,
    occurred_at, product_id, quantity, {_FIRST.format(k='order_key')} AS rn FROM v_saga
    WHERE subject = 'inventory.reserved' AND quantity > 0) WHERE rn = 1""")]))
def f8(spark, sf_dir):
    return saga.active_reservations(Views(spark, sf_dir).v_saga)
