"""Payment-provider webhooks to outcomes (E10) and retry schedules.

Webhook bodies are parsed with one explicit schema (``from_json``); the decision table
is an ordered ``when`` chain, so a batch of webhooks maps in one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WEBHOOK = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("timestamp", T.StringType()),
    T.StructField("data", T.StructType([
        T.StructField("id", T.StringType()), T.StructField("status", T.StringType()),
        T.StructField("paid", T.BooleanType()), T.StructField("checkout_id", T.StringType()),
        T.StructField("subtotal_amount", T.LongType()), T.StructField("currency", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ])),
])

# Failure reasons of the provider mapping.
ORDER_VOID = "polar_order_void"
CHECKOUT_EXPIRED = "polar_checkout_expired"
CHECKOUT_FAILED = "polar_checkout_failed"

WEBHOOK_RETRY_SECONDS = 2
CHECKOUT_RETRY_SECONDS = 30
CATALOG_BASE_SECONDS, CATALOG_MAX_RETRY_AFTER, CATALOG_MAX_ATTEMPTS = 30, 3600, 5


# What the provider's documents may hold.
UUID_RE = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
ORDER_STATES = ("draft", "pending", "paid", "refunded", "partially_refunded", "void")
CHECKOUT_STATES = ("open", "confirmed", "succeeded", "failed", "expired")
ORDER_EVENTS = ("order.paid", "order.updated")
CHECKOUT_EVENTS = ("checkout.updated", "checkout.expired")


def _holds(*rules: Column) -> Column:
    """All rules true (NULL counts as false)."""
    out = F.lit(True)
    for r in rules:
        out = out & F.coalesce(r, F.lit(False))
    return out


def map_payment_events(raw: DataFrame, body: str = "body", event_id: str = "event_id") -> DataFrame:
    """One row per webhook with ``action`` in (``outcome``, ``drop``, ``error``) and the
    outcome columns.  First matching rule wins:

    unparsable body, type or time -> error; metadata without ``order_id`` -> drop; an order
    or checkout document that breaks its schema (ids, states, amount, currency) -> error;
    ``order.paid`` not paid -> error; ``order.paid`` -> succeeded (amount = subtotal);
    ``order.updated`` void and unpaid -> failed ``polar_order_void``; other order events ->
    drop; checkout expired/failed -> failed; anything else -> drop."""
    e = F.from_json(F.col(body), WEBHOOK)
    x = raw.select(F.col(event_id).alias("event_id"), e.alias("e")).withColumn(
        "at", F.when(F.col("e.timestamp").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}.*(Z|[+-]\d{2}:\d{2})$"),
                     F.col("e.timestamp").try_cast("timestamp")))
    t, d = F.col("e.type"), F.col("e.data")
    order_id = F.try_element_at(d["metadata"], F.lit("order_id"))
    foreign = d["metadata"].isNotNull() & ~F.map_contains_key(d["metadata"], F.lit("order_id"))
    is_order, is_checkout = t.isin(*ORDER_EVENTS), t.isin(*CHECKOUT_EVENTS)
    named = (d["id"].rlike(UUID_RE), order_id.rlike(UUID_RE))
    order_fits = _holds(*named, d["checkout_id"].rlike(UUID_RE), d["status"].isin(*ORDER_STATES), d["paid"].isNotNull(),
                        d["subtotal_amount"] >= 0, F.length(d["currency"]) == 3)
    checkout_fits = _holds(*named, d["status"].isin(*CHECKOUT_STATES))
    paid = _holds(d["status"] == "paid", d["paid"])
    action = (F.when(F.col("e").isNull() | t.isNull() | F.col("at").isNull(), "error")
              .when(F.coalesce(foreign, F.lit(False)), "drop")
              .when((is_order & ~order_fits) | (is_checkout & ~checkout_fits), "error")
              .when((t == "order.paid") & ~paid, "error")
              .when((t == "order.paid") | (is_order & _holds(d["status"] == "void", ~d["paid"])), "outcome")
              .when(is_checkout & d["status"].isin("expired", "failed"), "outcome")
              .otherwise("drop"))
    reason = (F.when(t == "order.updated", F.lit(ORDER_VOID))
              .when(is_checkout, F.when(d["status"] == "expired", F.lit(CHECKOUT_EXPIRED)).otherwise(F.lit(CHECKOUT_FAILED))))
    columns = {
        "outcome": F.when(t == "order.paid", "succeeded").otherwise("failed"), "reason": reason, "order_id": order_id,
        "checkout_id": F.when(is_order, d["checkout_id"]).otherwise(d["id"]),
        "provider_order_id": F.when(is_order, d["id"]), "amount": F.when(t == "order.paid", d["subtotal_amount"]),
        "currency": F.when(t == "order.paid", d["currency"]), "occurred_at": F.col("at")}
    return x.withColumn("action", action).select(
        "event_id", "action", *[F.when(F.col("action") == "outcome", c).alias(n) for n, c in columns.items()])


def webhook_retry_at(now: Column) -> Column:
    """A failed webhook job is retried 2 s later, without limit."""
    return now + F.make_dt_interval(secs=F.lit(WEBHOOK_RETRY_SECONDS))


def checkout_retry_at(now: Column) -> Column:
    """A checkout job is retried 30 s later."""
    return now + F.make_dt_interval(secs=F.lit(CHECKOUT_RETRY_SECONDS))


def catalog_retry_at(now: Column, attempt: Column, rejected: Column, retry_after: Column | None = None) -> Column:
    """Catalog sync waits ``max(30·2^(attempt−1), clamp(retry_after, 0, 3600))`` s and
    stops (NULL) at attempt 5 or on rejection."""
    ra = F.lit(0) if retry_after is None else F.coalesce(
        F.least(F.greatest(retry_after, F.lit(0)), F.lit(CATALOG_MAX_RETRY_AFTER)), F.lit(0))
    delay = F.greatest(F.lit(CATALOG_BASE_SECONDS) * F.pow(F.lit(2), attempt - 1), ra.cast("double"))
    stopped = rejected | (attempt >= CATALOG_MAX_ATTEMPTS)
    return F.when(~stopped, now + F.make_dt_interval(secs=delay.cast("decimal(18,6)")))


def payment_reconciliation(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Sales orders against their succeeded payments, one row per order with a
    reason — ``missing_payment``, ``amount_mismatch``, ``currency_mismatch``,
    ``payment_without_sale`` or ``ok``.  Payments are summed per order first; that
    aggregate is already partitioned by order id, so the full join adds no exchange on
    the payments side."""
    sales = orders.where(F.col("status").isin("confirmed", "shipped")).select(
        "order_id", "total_amount", F.col("currency").alias("order_currency"), F.lit(True).alias("sold"))
    paid = payments.where(F.col("status") == "succeeded").groupBy("order_id").agg(
        F.sum("amount").cast("decimal(38,2)").alias("paid_amount"),
        F.min("currency").alias("paid_currency"),
        F.count_distinct("currency").alias("currencies"), F.lit(True).alias("collected"))
    j = sales.join(paid, "order_id", "full")
    reason = (F.when(F.col("collected").isNull(), "missing_payment")
              .when(F.col("sold").isNull(), "payment_without_sale")
              .when((F.col("currencies") > 1) | (F.col("paid_currency") != F.col("order_currency")), "currency_mismatch")
              .when(~F.col("paid_amount").eqNullSafe(F.col("total_amount").cast("decimal(38,2)")), "amount_mismatch")
              .otherwise("ok"))
    return j.select("order_id", F.col("total_amount").cast("decimal(38,2)").alias("total_amount"), "paid_amount",
                    reason.alias("reason"))
