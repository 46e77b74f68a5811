"""Registered basket and reservation queries, with recursive oracles that walk the log one
event at a time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stock
from ..registry import register
from .views import SQL_VIEWS, Views

# The fixture: stock events as operations on two products each.  Some deliveries share an
# operation id, with the same lines or with others; product 49 isn't in the catalogue; a
# quantity of 0 is outside the contract.
_FITS = """CASE WHEN stocks[{p} + 1] IS NULL THEN 'product_not_found' WHEN stocks[{p} + 1] + {d} < 0 THEN 'insufficient_stock'
  WHEN stocks[{p} + 1] + {d} > 2147483647 THEN 'stock_limit' END"""
_STOCKS = "s0 AS (SELECT list(p.stock ORDER BY i.i) AS stocks FROM range(50) i(i) LEFT JOIN v_products p ON p.product_id = i.i AND i.i <> 49)"


def _products(spark, sf_dir):
    return Views(spark, sf_dir).v_products.where("product_id <> 49")


def _operations(spark, sf_dir):
    ev = Views(spark, sf_dir).v_saga.where(F.col("subject").isin("inventory.reserved", "inventory.released"))
    e = F.col("event_id")
    key = F.when(e % 20 < 3, e - e % 20).otherwise(e)
    sign = F.when(key % 5 < 2, 1).otherwise(-1)
    lines = F.array(F.struct((key % 50).alias("product_id"), (sign * (key % 5)).alias("delta")),
                    F.struct(((key * 7 + 3) % 50).alias("product_id"), (sign * (1 + key % 3)).alias("delta")))
    name = F.when(e % 20 < 5, F.concat(F.lit("op-"), F.floor(e / 20).cast("string"))).otherwise(F.concat(F.lit("ev-"), e.cast("string")))
    return ev.select("event_id", "occurred_at", name.alias("operation_id"), lines.alias("lines"))


_E3 = f"""WITH RECURSIVE v_saga AS ({SQL_VIEWS['v_saga']}), v_products AS ({SQL_VIEWS['v_products']}),
d AS (SELECT event_id, occurred_at, k, row_number() OVER (ORDER BY occurred_at, event_id) AS n,
    CASE WHEN event_id % 20 < 5 THEN 'op-' || (event_id // 20) ELSE 'ev-' || event_id END AS op, k % 50 AS a, (k * 7 + 3) % 50 AS b,
    CASE WHEN k % 5 < 2 THEN 1 ELSE -1 END * (k % 5) AS da, CASE WHEN k % 5 < 2 THEN 1 ELSE -1 END * (1 + k % 3) AS db
  FROM (SELECT *, CASE WHEN event_id % 20 < 3 THEN event_id - event_id % 20 ELSE event_id END AS k FROM v_saga
    WHERE subject IN ('inventory.reserved', 'inventory.released'))),
{_STOCKS},
w AS (SELECT 0::BIGINT AS n, stocks, []::VARCHAR[] AS ids, []::VARCHAR[] AS whole, NULL::BIGINT AS event_id, NULL::VARCHAR AS op,
    NULL::TIMESTAMP AS occurred_at, NULL::VARCHAR AS result FROM s0
  UNION ALL
  SELECT n, CASE WHEN r = 'applied' THEN [CASE i WHEN a THEN stocks[i + 1] + da WHEN b THEN stocks[i + 1] + db ELSE stocks[i + 1] END
      FOR i IN range(50)] ELSE stocks END, CASE WHEN r = 'applied' THEN list_append(ids, op) ELSE ids END,
    CASE WHEN r = 'applied' THEN list_append(whole, op || '|' || k) ELSE whole END, event_id, op, occurred_at, r
  FROM (SELECT d.n, d.event_id, d.op, d.occurred_at, d.k, d.a, d.b, d.da, d.db, w.stocks, w.ids, w.whole,
      CASE WHEN d.da = 0 THEN 'invalid_operation' WHEN list_contains(w.whole, d.op || '|' || d.k) THEN 'already_applied'
        WHEN list_contains(w.ids, d.op) THEN 'changed_operation'
        ELSE coalesce(CASE WHEN d.a < d.b THEN coalesce({_FITS.format(p='a', d='da')}, {_FITS.format(p='b', d='db')})
          ELSE coalesce({_FITS.format(p='b', d='db')}, {_FITS.format(p='a', d='da')}) END, 'applied') END AS r
    FROM w JOIN d ON d.n = w.n + 1))"""


@register("e3_adjust_stock_batches", _E3 + " SELECT event_id, op AS operation_id, occurred_at, result FROM w WHERE n > 0")
def e3(spark, sf_dir):
    return stock.adjust_stock_batches(_products(spark, sf_dir), _operations(spark, sf_dir))


@register("e3_stock_after", _E3 + """ SELECT p.product_id, coalesce(l.stock, p.stock) AS stock FROM v_products p
LEFT JOIN (SELECT unnest(range(50)) AS product_id, unnest(stocks) AS stock FROM w ORDER BY n DESC LIMIT 50) l ON l.product_id = p.product_id
WHERE p.product_id <> 49""")
def e3_after(spark, sf_dir):
    products, ops = _products(spark, sf_dir), _operations(spark, sf_dir)
    return stock.stock_after_batches(products, ops, stock.adjust_stock_batches(products, ops))


# Placements: signups and views, six events in a row belong to one order; failures: errors.
_CONTENTS = "CASE WHEN event_id % 7 = 0 THEN event_id ELSE event_id // 6 END"


def _orders(spark, sf_dir):
    ev = Views(spark, sf_dir).events
    e = F.col("event_id")
    key = F.when(e % 7 == 0, e).otherwise(F.floor(e / 6))
    first = F.struct((key % 50).alias("product_id"), (key % 5).alias("quantity"))
    second = F.struct(((key * 7 + 3) % 50).alias("product_id"), (1 + key % 3).alias("quantity"))
    base = ev.select("event_id", F.col("ts").alias("occurred_at"), F.floor(e / 6).alias("order_id"), "event_type",
                     (key % 50).alias("product_id"), (key % 5).alias("quantity"), F.when(key % 3 == 0, F.array(first, second)).alias("items"))
    return base.where(F.col("event_type").isin("signup", "view")).drop("event_type"), base.where("event_type = 'error'")


_HELD = "list_filter(held, lambda h: h.order_id = d.order_id)[1]"


@register("e4_reserve", f"""WITH RECURSIVE v_products AS ({SQL_VIEWS['v_products']}),
d AS (SELECT event_id, ts AS occurred_at, event_id // 6 AS order_id, event_type = 'error' AS fails, k % 50 AS a, -(k % 5) AS da, k % 3 = 0 AS cart,
    CASE WHEN k % 3 = 0 THEN (k * 7 + 3) % 50 ELSE k % 50 END AS b, CASE WHEN k % 3 = 0 THEN -(1 + k % 3) ELSE 0 END AS db,
    row_number() OVER (ORDER BY ts, event_id) AS n
  FROM (SELECT *, {_CONTENTS} AS k FROM events WHERE event_type IN ('signup', 'view', 'error'))),
{_STOCKS},
w AS (SELECT 0::BIGINT AS n, stocks, []::STRUCT(order_id BIGINT, a BIGINT, da BIGINT, b BIGINT, db BIGINT, cart BOOLEAN, back BOOLEAN)[] AS held,
    NULL::BIGINT AS event_id, NULL::BIGINT AS order_id, NULL::TIMESTAMP AS occurred_at, false AS fails, NULL::VARCHAR AS r FROM s0
  UNION ALL
  SELECT n, CASE WHEN r = 'takes' THEN [CASE WHEN i = a THEN stocks[i + 1] + da WHEN i = b AND cart THEN stocks[i + 1] + db ELSE stocks[i + 1] END
        FOR i IN range(50)]
      WHEN r = 'gives' THEN [CASE WHEN i = h.a THEN stocks[i + 1] - h.da WHEN i = h.b AND h.cart THEN stocks[i + 1] - h.db ELSE stocks[i + 1] END
        FOR i IN range(50)] ELSE stocks END,
    CASE WHEN r = 'takes' THEN list_append(held, {{'order_id': order_id, 'a': a, 'da': da, 'b': b, 'db': db, 'cart': cart, 'back': false}})
      WHEN r = 'gives' THEN [CASE WHEN x.order_id = order_id THEN {{'order_id': x.order_id, 'a': x.a, 'da': x.da, 'b': x.b, 'db': x.db,
        'cart': x.cart, 'back': true}} ELSE x END FOR x IN held] ELSE held END, event_id, order_id, occurred_at, fails, r
  FROM (SELECT *, CASE WHEN fails THEN CASE WHEN h IS NOT NULL AND NOT h.back THEN 'gives' END
      WHEN da = 0 THEN 'invalid_quantity' WHEN h IS NOT NULL AND (h.a, h.da, h.b, h.db, h.cart) IS DISTINCT FROM (a, da, b, db, cart) THEN 'changed_order'
      WHEN h.back THEN 'reservation_released' WHEN h IS NOT NULL THEN 'again'
      ELSE coalesce(CASE WHEN a <= b OR NOT cart THEN coalesce({_FITS.format(p='a', d='da')}, CASE WHEN cart THEN {_FITS.format(p='b', d='db')} END)
        ELSE coalesce({_FITS.format(p='b', d='db')}, {_FITS.format(p='a', d='da')}) END, 'takes') END AS r
    FROM (SELECT d.*, w.stocks, w.held, {_HELD} AS h FROM w JOIN d ON d.n = w.n + 1)))
SELECT event_id, CAST(order_id AS VARCHAR) AS order_id, occurred_at, CASE WHEN r IN ('takes', 'again') THEN 'reserved' WHEN r = 'changed_order' THEN 'error'
    WHEN r = 'reservation_released' THEN 'ignored' ELSE 'rejected' END AS outcome, CASE WHEN r NOT IN ('takes', 'again') THEN r END AS reason
FROM w WHERE n > 0 AND NOT fails""")
def e4(spark, sf_dir):
    placed, failed = _orders(spark, sf_dir)
    return stock.reserve(placed, failed, _products(spark, sf_dir))
