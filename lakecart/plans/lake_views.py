"""The six curated lake tables, shaped from the fixture views, and their dirty raw-text
renderings (what a CSV drop looks like before the ETL).

``lake_frame`` gives exactly the registry columns and types; ``render_raw`` turns it into
all-text columns with the noise the ETL must undo (padding, mixed case, status spellings,
null tokens, timestamp offsets), deterministically by row key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import TABLES
from .mart import stock_band
from .views import Views


def lake_frame(v: Views, table: str) -> DataFrame:
    if table == "customers":
        df = v.v_customers.select(
            F.col("customer_id").cast("string").alias("customer_id"),
            F.date_add(F.lit("2020-01-01").cast("date"), (F.col("customer_id") % 1000).cast("int")).alias("signup_date"),
            "city", "segment",
            F.concat(F.lit("buyer"), F.col("customer_id").cast("string"), F.lit("@example.pe")).alias("email"))
    elif table == "products":
        df = v.v_products.select(
            F.col("product_id").cast("string").alias("product_id"), "title", "category", "price", "stock",
            stock_band("stock").alias("stock_status"), "currency")
    elif table == "orders":
        df = v.v_orders.select(
            F.col("order_id").cast("string").alias("order_id"),
            F.col("customer_id").cast("string").alias("customer_id"),
            F.col("order_date").cast("timestamp").alias("order_date"),
            F.coalesce("status", F.lit("unknown")).alias("status"),
            "total_amount", "currency", "channel")
    elif table == "order_items":
        li = v.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
        price = v.part.select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
        df = li.join(price, "l_partkey", "left").select(
            F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")])
            .alias("order_item_id"),
            F.col("l_orderkey").cast("string").alias("order_id"),
            F.col("l_partkey").cast("string").alias("product_id"),
            F.col("l_quantity").cast("int").alias("quantity"),
            F.col("p_retailprice").cast("decimal(18,2)").alias("unit_price"),
            F.when(F.col("l_partkey") % 250 == 0, F.lit(None))
            .otherwise(F.col("l_extendedprice").cast("decimal(18,2)")).alias("line_total"))
    elif table == "inventory_snapshots":
        df = v.v_inventory.select(
            F.concat_ws("-", F.col("product_id").cast("string"), F.col("snapshot_date").cast("string")).alias("snapshot_id"),
            F.col("product_id").cast("string").alias("product_id"),
            "snapshot_date", "quantity_on_hand", "quantity_reserved", "quantity_available", "warehouse")
    elif table == "payments":
        df = v.v_payments.select(
            F.col("payment_id").cast("string").alias("payment_id"),
            F.col("order_id").cast("string").alias("order_id"),
            "amount", "currency", "status", F.lit("polar").alias("provider"),
            F.concat(F.lit("Ref-"), F.col("payment_id").cast("string")).alias("provider_ref"),
            F.col("created_at").cast("timestamp").alias("created_at"),
            F.col("paid_at").cast("timestamp").alias("paid_at"))
    else:
        raise ValueError(table)
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in TABLES[table].items()])


def _key(df: DataFrame) -> Column:
    first = df.columns[0]
    return F.abs(F.xxhash64(F.col(first)))


_NULL_TOKENS = ("", "null", " N/A ", "None", "NULL")


def _render(c: str, t: str, k: Column) -> Column:
    col = F.col(c)
    if t == "timestamp":
        z = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss'Z'")
        plus2 = F.concat(F.date_format(col + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
        space = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        text = F.when(k % 3 == 0, z).when(k % 3 == 1, plus2).otherwise(space)
    elif c == "status" or c == "stock_status":
        s = col.cast("string")
        text = (F.when(col == "cancelled", F.when(k % 2 == 0, F.lit(" Canceled ")).otherwise(F.lit("CANCELLED")))
                .when(col == "canceled", F.lit(" CANCELLED "))
                .when(col == "unknown", F.lit("Not A Status"))
                .when(k % 4 == 0, F.upper(s))
                .when(k % 4 == 1, F.concat(F.lit("  "), F.initcap(s), F.lit(" ")))
                .when(k % 4 == 2, F.regexp_replace(s, "_", " - "))
                .otherwise(s))
    elif c.endswith("_id") or c in ("email", "segment", "channel", "provider"):
        text = F.when(k % 2 == 0, F.concat(F.lit(" "), F.upper(col.cast("string")), F.lit(" "))).otherwise(col.cast("string"))
    elif c in ("currency", "warehouse"):
        text = F.when(k % 2 == 0, F.concat(F.lit(" "), F.lower(col), F.lit(" "))).otherwise(col)
    elif t.startswith("decimal") or t == "int":
        text = F.when(k % 3 == 0, F.concat(F.lit(" "), col.cast("string"), F.lit(" "))).otherwise(col.cast("string"))
    else:
        text = col.cast("string")
    token = F.element_at(F.array(*[F.lit(x) for x in _NULL_TOKENS]), (k % len(_NULL_TOKENS) + 1).cast("int"))
    return F.when(col.isNull(), token).otherwise(text).alias(c)


def render_raw(df: DataFrame, table: str) -> DataFrame:
    """All-text rendering of a lake table with the noise the ETL normalises away."""
    k = _key(df)
    return df.select(*[_render(c, t, k) for c, t in TABLES[table].items()])


# The same lake tables as SQL text over the fixture views (DuckDB oracle).
_BAND_SQL = ("CASE WHEN stock <= 0 THEN 'out_of_stock' WHEN stock <= 10 THEN 'low' WHEN stock <= 40 THEN 'ok' "
             "WHEN stock IS NOT NULL THEN 'high' END")

LAKE_SQL = {
    "customers": ("""SELECT CAST(customer_id AS VARCHAR) AS customer_id,
    CAST(DATE '2020-01-01' + CAST(customer_id % 1000 AS INTEGER) AS DATE) AS signup_date, city, segment,
    'buyer' || CAST(customer_id AS VARCHAR) || '@example.pe' AS email FROM v_customers""", ("v_customers",)),
    "products": (f"""SELECT CAST(product_id AS VARCHAR) AS product_id, title, category, price, stock,
    {_BAND_SQL} AS stock_status, currency FROM v_products""", ("v_products",)),
    "orders": ("""SELECT CAST(order_id AS VARCHAR) AS order_id, CAST(customer_id AS VARCHAR) AS customer_id,
    order_date, coalesce(status, 'unknown') AS status, total_amount, currency, channel FROM v_orders""", ("v_orders",)),
    "order_items": ("""SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
      CAST(l_partkey AS VARCHAR)) AS order_item_id,
    CAST(l_orderkey AS VARCHAR) AS order_id, CAST(l_partkey AS VARCHAR) AS product_id,
    CAST(l_quantity AS INTEGER) AS quantity, CAST(p_retailprice AS DECIMAL(18,2)) AS unit_price,
    CASE WHEN l_partkey % 250 = 0 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS line_total
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""", ()),
    "inventory_snapshots": ("""SELECT CAST(product_id AS VARCHAR) || '-' || CAST(snapshot_date AS VARCHAR) AS snapshot_id,
    CAST(product_id AS VARCHAR) AS product_id, snapshot_date, quantity_on_hand, quantity_reserved,
    quantity_available, warehouse FROM v_inventory""", ("v_inventory",)),
    "payments": ("""SELECT CAST(payment_id AS VARCHAR) AS payment_id, CAST(order_id AS VARCHAR) AS order_id, amount,
    currency, status, 'polar' AS provider, 'Ref-' || CAST(payment_id AS VARCHAR) AS provider_ref, created_at, paid_at
  FROM v_payments""", ("v_payments",)),
}
