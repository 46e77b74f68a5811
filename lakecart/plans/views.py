"""Deterministic commerce views over the star-schema test tables.

Each view exists twice, once as a DataFrame plan and once as SQL text for the DuckDB
oracle; both follow the same rules, so every mart query can be checked value by value.
The views inject the NULLs and mixed values the shop seed has (missing city, segment,
category, month and amount; a second currency; unknown statuses).

All views are narrow projections (plus one join to the fixed 25-row nation table), so
they add no shuffle of their own; Catalyst prunes the columns a query does not use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import Tables

# Fixed values of the fixture rules.
SNAPSHOT_DAY = "2001-09-30"
SNAPSHOT_OFFSETS = (0, 7, 14, 30)
WAREHOUSES = ("LIMA", "AREQUIPA", "TRUJILLO")
CHANNELS = ("web", "mobile", "api")
SAGA_SUBJECTS = {
    "signup": "orders.placed",
    "view": "inventory.reserved",
    "purchase": "payment.succeeded",
    "error": "payment.failed",
    "click": "inventory.released",
}
# payment.failed reasons by event_id % 4; the first two are closures that must not
# notify the buyer.
FAILURE_REASONS = ("order_expired", "order_cancelled", "card_declined", "insufficient_funds")
TURN_TYPES = {"user": "human", "assistant": "ai", "system": "system"}


def _null_when(cond: Column, value: Column) -> Column:
    return F.when(cond, F.lit(None)).otherwise(value)


def _order_status(status: Column, priority: Column) -> Column:
    first = F.substring(priority, 1, 1)
    p_status = (F.when(first == "1", "shipped").when(first == "2", "rejected")
                .when(first == "3", "cancelled").when(first == "4", "unknown")
                .when(first == "5", "confirmed"))
    return (F.when(status == "F", "confirmed").when(status == "O", "pending")
            .when(status == "P", p_status))


def _by_mod(key: Column, values) -> Column:
    expr = None
    for i, v in enumerate(values):
        expr = F.when(key % len(values) == i, v) if expr is None else expr.when(key % len(values) == i, v)
    return expr


def v_customers(t: Tables) -> DataFrame:
    c = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    n = t.nation.select("n_nationkey", "n_name")
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").select(
        F.col("c_custkey").alias("customer_id"),
        _null_when(F.col("c_custkey") % 50 == 0, F.col("n_name")).alias("city"),
        _null_when(F.col("c_custkey") % 40 == 1, F.lower("c_mktsegment")).alias("segment"),
    )


def v_products(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("title"),
        _null_when(F.col("p_partkey") % 100 == 0, F.col("p_type")).alias("category"),
        F.col("p_retailprice").cast("decimal(18,2)").alias("price"),
        (F.col("p_size") - 1).alias("stock"),
        F.lit("PEN").alias("currency"),
    )


def v_orders(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.select(
        k.alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        _null_when(k % 500 == 0, F.col("o_orderdate")).alias("order_date"),
        _order_status(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("status"),
        _null_when(k % 200 == 0, F.col("o_totalprice").cast("decimal(18,2)")).alias("total_amount"),
        F.when(k % 10 == 0, "USD").otherwise("PEN").alias("currency"),
        _by_mod(k, CHANNELS).alias("channel"),
    )


def v_order_items(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        _null_when(F.col("l_partkey") % 250 == 0, F.col("l_extendedprice").cast("decimal(18,2)")).alias("line_total"),
    )


def v_inventory(t: Tables) -> DataFrame:
    offsets = F.array(*[F.lit(o) for o in SNAPSHOT_OFFSETS])
    base = t.part.select("p_partkey", "p_size", F.explode(offsets).alias("off"))
    on_hand = F.greatest(F.col("p_size") * 4 - F.col("off"), F.lit(0))
    return (base.select(
        F.col("p_partkey").alias("product_id"),
        F.date_sub(F.lit(SNAPSHOT_DAY).cast("date"), F.col("off")).alias("snapshot_date"),
        on_hand.cast("int").alias("quantity_on_hand"),
        F.least(F.col("p_partkey") % 15, on_hand).cast("int").alias("quantity_reserved"),
        _by_mod(F.col("p_partkey"), WAREHOUSES).alias("warehouse"),
    ).withColumn("quantity_available", F.col("quantity_on_hand") - F.col("quantity_reserved")))


def v_payments(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    status = _order_status(F.col("o_orderstatus"), F.col("o_orderpriority"))
    pay_status = (F.when(status.isin("confirmed", "shipped"), "succeeded").when(status == "rejected", "failed")
                  .when(status == "cancelled", "canceled").otherwise("pending"))
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    return t.orders.where(k % 30 != 7).select(
        k.alias("payment_id"),
        k.alias("order_id"),
        F.when(k % 97 == 0, (amount + F.lit(1)).cast("decimal(18,2)")).otherwise(amount).alias("amount"),
        F.when(k % 10 == 0, "USD").otherwise("PEN").alias("currency"),
        pay_status.alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.when(pay_status == "succeeded", F.col("o_orderdate")).alias("paid_at"),
    )


def v_saga(t: Tables) -> DataFrame:
    e = F.col("event_type")
    subject = None
    for src, dst in SAGA_SUBJECTS.items():
        subject = F.when(e == src, dst) if subject is None else subject.when(e == src, dst)
    return t.events.select(
        "event_id",
        (F.col("user_id") * 1000 + F.dayofyear("ts")).alias("order_key"),
        F.col("ts").alias("occurred_at"),
        subject.alias("subject"),
        (F.expr("try_cast(get_json_object(props, '$.k') AS INT)") % 5).alias("quantity"),
        (F.col("event_id") % 50).alias("product_id"),
        F.col("value"),
        F.when(e == "error", _by_mod(F.col("event_id"), FAILURE_REASONS)).alias("reason"),
    )


def v_turns(t: Tables) -> DataFrame:
    r = F.col("role")
    kind = None
    for src, dst in TURN_TYPES.items():
        kind = F.when(r == src, dst) if kind is None else kind.when(r == src, dst)
    return t.conversations.select("conv_id", "turn", kind.alias("type"), "text")


SPARK_VIEWS = {
    "v_customers": v_customers,
    "v_products": v_products,
    "v_orders": v_orders,
    "v_order_items": v_order_items,
    "v_inventory": v_inventory,
    "v_payments": v_payments,
    "v_saga": v_saga,
    "v_turns": v_turns,
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return SPARK_VIEWS[name](Tables(spark, sf_dir))


class Views:
    """``Views(spark, sf_dir).v_orders`` etc."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.tables = Tables(spark, sf_dir)

    def __getattr__(self, name: str) -> DataFrame:
        if name in SPARK_VIEWS:
            return SPARK_VIEWS[name](self.tables)
        return getattr(self.tables, name)


# ---------------------------------------------------------------------------------
# The same views as SQL text (DuckDB dialect, also valid Spark SQL except where noted),
# used by the oracle queries in __spark_entry__.oracle_sql().

_STATUS_SQL = """CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'pending'
  WHEN 'P' THEN CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'shipped' WHEN '2' THEN 'rejected'
    WHEN '3' THEN 'cancelled' WHEN '4' THEN 'unknown' WHEN '5' THEN 'confirmed' END END"""

SQL_VIEWS = {
    "v_customers": """SELECT c.c_custkey AS customer_id,
    CASE WHEN c.c_custkey % 50 = 0 THEN NULL ELSE n.n_name END AS city,
    CASE WHEN c.c_custkey % 40 = 1 THEN NULL ELSE lower(c.c_mktsegment) END AS segment
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""",
    "v_products": """SELECT p_partkey AS product_id, p_name AS title,
    CASE WHEN p_partkey % 100 = 0 THEN NULL ELSE p_type END AS category,
    CAST(p_retailprice AS DECIMAL(18,2)) AS price, p_size - 1 AS stock, 'PEN' AS currency
  FROM part""",
    "v_orders": f"""SELECT o_orderkey AS order_id, o_custkey AS customer_id,
    CASE WHEN o_orderkey % 500 = 0 THEN NULL ELSE o_orderdate END AS order_date,
    {_STATUS_SQL} AS status,
    CASE WHEN o_orderkey % 200 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS total_amount,
    CASE WHEN o_orderkey % 10 = 0 THEN 'USD' ELSE 'PEN' END AS currency,
    CASE o_orderkey % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'mobile' ELSE 'api' END AS channel
  FROM orders""",
    "v_order_items": """SELECT l_orderkey AS order_id, l_partkey AS product_id,
    CAST(l_quantity AS INTEGER) AS quantity,
    CASE WHEN l_partkey % 250 = 0 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS line_total
  FROM lineitem""",
    "v_inventory": """SELECT product_id, snapshot_date, quantity_on_hand, quantity_reserved,
    quantity_on_hand - quantity_reserved AS quantity_available, warehouse
  FROM (SELECT p_partkey AS product_id, CAST(DATE '2001-09-30' - off AS DATE) AS snapshot_date,
      CAST(greatest(p_size * 4 - off, 0) AS INTEGER) AS quantity_on_hand,
      CAST(least(p_partkey % 15, greatest(p_size * 4 - off, 0)) AS INTEGER) AS quantity_reserved,
      CASE p_partkey % 3 WHEN 0 THEN 'LIMA' WHEN 1 THEN 'AREQUIPA' ELSE 'TRUJILLO' END AS warehouse
    FROM (SELECT p_partkey, p_size, unnest([0, 7, 14, 30]) AS off FROM part))""",
    "v_payments": f"""SELECT order_id AS payment_id, order_id, amount, currency, status, created_at,
    CASE WHEN status = 'succeeded' THEN created_at END AS paid_at
  FROM (SELECT o_orderkey AS order_id,
      CASE WHEN o_orderkey % 97 = 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) + 1 AS DECIMAL(18,2))
           ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS amount,
      CASE WHEN o_orderkey % 10 = 0 THEN 'USD' ELSE 'PEN' END AS currency,
      CASE WHEN ({_STATUS_SQL}) IN ('confirmed', 'shipped') THEN 'succeeded'
           WHEN ({_STATUS_SQL}) = 'rejected' THEN 'failed'
           WHEN ({_STATUS_SQL}) = 'cancelled' THEN 'canceled' ELSE 'pending' END AS status,
      o_orderdate AS created_at
    FROM orders WHERE o_orderkey % 30 <> 7)""",
    "v_saga": """SELECT event_id, user_id * 1000 + dayofyear(ts) AS order_key, ts AS occurred_at,
    CASE event_type WHEN 'signup' THEN 'orders.placed' WHEN 'view' THEN 'inventory.reserved'
      WHEN 'purchase' THEN 'payment.succeeded' WHEN 'error' THEN 'payment.failed'
      WHEN 'click' THEN 'inventory.released' END AS subject,
    TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 AS quantity,
    event_id % 50 AS product_id, value,
    CASE WHEN event_type = 'error' THEN CASE event_id % 4 WHEN 0 THEN 'order_expired' WHEN 1 THEN 'order_cancelled'
      WHEN 2 THEN 'card_declined' ELSE 'insufficient_funds' END END AS reason
  FROM events""",
    "v_turns": """SELECT conv_id, turn,
    CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'ai' WHEN 'system' THEN 'system' END AS type, text
  FROM conversations""",
}


def sql_with(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs of the named views."""
    ctes = ",\n".join(f"{n} AS (\n  {SQL_VIEWS[n]}\n)" for n in names)
    return f"WITH {ctes}\n{body}" if names else body


def sql_ctes(body: str, views=(), ctes=()) -> str:
    """``WITH`` the named views, then extra ``(name, sql)`` CTEs, then ``body``."""
    parts = [f"{n} AS (\n  {SQL_VIEWS[n]}\n)" for n in views] + [f"{n} AS (\n  {q}\n)" for n, q in ctes]
    return ("WITH " + ",\n".join(parts) + "\n" + body) if parts else body
