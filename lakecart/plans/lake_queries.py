"""Registered lake / data-quality queries with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.normalize import TABLES, normalize
from ..operators import quality
from ..registry import register
from ..session import scratch_path
from .lake_views import LAKE_SQL, lake_frame, render_raw
from .views import Views, sql_with


def _ntz(df):
    """Timestamps as UTC wall-clock (timestamp_ntz) so both engines compare naive values."""
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c)
                       for c, t in df.dtypes])


def _roundtrip(table):
    def run(spark, sf_dir):
        clean = lake_frame(Views(spark, sf_dir), table)
        return _ntz(normalize(render_raw(clean, table), table))
    run.__name__ = f"normalize_{table}"
    return run


for _t in TABLES:
    _sql, _views = LAKE_SQL[_t]
    register(f"n5_normalize_{_t}", sql_with(_sql, *_views))(_roundtrip(_t))


def _lake_ctes(*tables):
    views = []
    for t in tables:
        for v in LAKE_SQL[t][1]:
            if v not in views:
                views.append(v)
    body = ",\n".join(f"lake_{t} AS ({LAKE_SQL[t][0]})" for t in tables)
    return views, body


def _with_lake(body: str, *tables: str) -> str:
    views, ctes = _lake_ctes(*tables)
    if views:
        return sql_with(body, *views).replace("\n" + body, f",\n{ctes}\n{body}", 1)
    return f"WITH {ctes}\n{body}"


_ALL = tuple(TABLES)


@register("d1_verify_curated", _with_lake(" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count, " + (
        "count_if(status IS NULL OR status NOT IN ('confirmed', 'pending', 'rejected', 'cancelled', 'shipped', 'unknown'))"
        if t == "orders" else "CAST(0 AS BIGINT)") + f" AS invalid_status_rows FROM lake_{t}" for t in _ALL), *_ALL))
def d1(spark, sf_dir):
    v = Views(spark, sf_dir)
    frames = {t: normalize(render_raw(lake_frame(v, t), t), t) for t in _ALL}
    return quality.verify_curated(frames)


#: Rows that the curated side of D2 loses on purpose: the check has to see them missing.
_LOST = {"orders": "CAST(order_id AS BIGINT) % 500 = 0", "payments": "CAST(payment_id AS BIGINT) % 700 = 0"}


@register("d2_reconcile_counts", _with_lake(" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS raw_rows, count(*) FILTER (WHERE NOT ({_LOST.get(t, 'false')})) AS curated_rows, "
    f"count(*) FILTER (WHERE {_LOST.get(t, 'false')}) = 0 AS equal FROM lake_{t}" for t in _ALL), *_ALL))
def d2(spark, sf_dir):
    """Counts of the raw rows against the curated files as they were written."""
    v = Views(spark, sf_dir)
    raw = {t: render_raw(lake_frame(v, t), t) for t in _ALL}
    curated = {}
    for t, df in raw.items():
        path = scratch_path(spark, f"curated-{t}")
        out = normalize(df, t)
        (out.where(f"NOT ({_LOST[t]})") if t in _LOST else out).write.parquet(path)
        curated[t] = spark.read.parquet(path)
    return quality.reconcile_counts(raw, curated)


_FK_RULES = (
    ("order_items.order_id", "v_order_items", "order_id", "v_orders", "order_id"),
    ("order_items.product_id", "v_order_items", "product_id", "v_products", "product_id"),
    ("orders.customer_id", "v_orders", "customer_id", "v_customers", "customer_id"),
    ("payments.order_id", "v_payments", "order_id", "v_orders", "order_id"),
    ("inventory.product_id", "v_inventory", "product_id", "v_products", "product_id"),
)


#: Keys that D4's children carry without a parent: every 97th key is moved out of range.
_MOVED = 1_000_000_000


@register("d4_foreign_keys", sql_with(" UNION ALL ".join(
    f"SELECT DISTINCT '{n}' AS rule, CAST(c.key AS VARCHAR) AS key FROM (SELECT CASE WHEN {ck} % 97 = 0 THEN {ck} + {_MOVED} ELSE {ck} END AS key FROM {c}) c "
    f"WHERE c.key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} p WHERE p.{pk} = c.key)"
    for n, c, ck, p, pk in _FK_RULES), "v_orders", "v_order_items", "v_products", "v_customers", "v_payments",
    "v_inventory"))
def d4(spark, sf_dir):
    v = Views(spark, sf_dir)

    def child(name, key):
        return getattr(v, name).withColumn(key, F.when(F.col(key) % 97 == 0, F.col(key) + _MOVED).otherwise(F.col(key)))

    return quality.foreign_keys([(n, child(c, ck), ck, getattr(v, p), pk) for n, c, ck, p, pk in _FK_RULES])


@register("d5_total_vs_lines", sql_with("""SELECT o.order_id, o.total_amount, l.lines_total,
  coalesce(l.lines, 0) AS lines, CAST(o.total_amount - coalesce(l.lines_total, 0) AS DECIMAL(38,2)) AS difference
FROM v_orders o LEFT JOIN (SELECT order_id, CAST(sum(line_total) AS DECIMAL(38,2)) AS lines_total, count(*) AS lines
  FROM v_order_items GROUP BY order_id) l ON o.order_id = l.order_id
WHERE o.total_amount IS NOT NULL AND o.total_amount - coalesce(l.lines_total, 0) <> 0""", "v_orders", "v_order_items"))
def d5(spark, sf_dir):
    v = Views(spark, sf_dir)
    return quality.total_vs_lines(v.v_orders, v.v_order_items)


_BAND = """CASE WHEN stock <= 0 THEN 'out_of_stock' WHEN stock <= 10 THEN 'low' WHEN stock <= 40 THEN 'ok'
  WHEN stock IS NOT NULL THEN 'high' END"""


@register("d6_stock_arithmetic", _with_lake(f"""SELECT 'available_is_on_hand_minus_reserved' AS rule,
  count_if(CAST(product_id AS BIGINT) % 19 = 0) AS violations, count(*) AS checked FROM lake_inventory_snapshots
UNION ALL SELECT 'quantities_not_negative', count_if(CASE WHEN CAST(product_id AS BIGINT) % 23 = 0 THEN -1 - quantity_on_hand ELSE quantity_on_hand END < 0
    OR quantity_reserved < 0), count(*) FROM lake_inventory_snapshots
UNION ALL SELECT 'stock_status_matches_band', count_if(CASE WHEN CAST(product_id AS BIGINT) % 17 = 0 THEN 'ok' ELSE {_BAND} END IS DISTINCT FROM ({_BAND})),
  count(*) FROM lake_products""", "inventory_snapshots", "products"))
def d6(spark, sf_dir):
    """The lake tables with planted violations: availability off by one, negative stock, a
    wrong status."""
    v = Views(spark, sf_dir)
    k = F.col("product_id").cast("bigint")
    inv = lake_frame(v, "inventory_snapshots")
    on_hand = F.when(k % 23 == 0, -1 - F.col("quantity_on_hand")).otherwise(F.col("quantity_on_hand"))
    available = on_hand - F.col("quantity_reserved") + F.when(k % 19 == 0, 1).otherwise(0)
    inv = inv.withColumn("quantity_available", available).withColumn("quantity_on_hand", on_hand)
    products = lake_frame(v, "products")
    products = products.withColumn("stock_status", F.when(k % 17 == 0, "ok").otherwise(F.col("stock_status")))
    return quality.stock_arithmetic(inv, products)


@register("d12_unique_keys", """SELECT l_orderkey AS order_id, l_linenumber AS line_number, count(*) AS rows
FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def d12(spark, sf_dir):
    v = Views(spark, sf_dir)
    items = v.lineitem.select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_number"))
    return quality.unique_keys(items, ["order_id", "line_number"])
