"""Order saga state derived from the event log.

Input: an event frame with ``event_id, order_key, occurred_at, subject, quantity,
product_id, value, reason``.  The log's total order is ``(occurred_at, event_id)``.

Every rule is "first writer wins" (the operational store did insert-or-ignore and
conditional updates), which is a ``min_by`` over that order: a declarative aggregate, so
Spark combines it partially on the map side and a hot order key reaches the exchange as
one partial row per task.  Where a rule needs the placement time, the per-order placement
(one row per key) is joined to the events; the planner broadcasts it when small and AQE
splits skewed partitions otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACED = "orders.placed"
RESERVED = "inventory.reserved"
RELEASED = "inventory.released"
REJECTED = "inventory.rejected"
SUCCEEDED = "payment.succeeded"
FAILED = "payment.failed"

# Notification subject lines per event subject, and the payment-failure
# reasons that are closures (no buyer notification).
NOTIFICATION_SUBJECTS = {
    "payment.succeeded": "Pedido confirmado",
    "inventory.rejected": "No pudimos completar tu pedido",
    "payment.failed": "El pago no se completó",
}
SILENT_FAILURE_REASONS = ("order_cancelled", "order_expired")
ORDER_TTL_MINUTES = 15
CHECKOUT_GRACE_SECONDS = 120


def log_order() -> Column:
    """The total order of the log as one comparable value."""
    return F.struct("occurred_at", "event_id")


def first_per(df: DataFrame, keys: list[str], cols: list[str], prefix: str = "") -> DataFrame:
    """W6 first-writer-wins: per key, the columns of the earliest event in log order."""
    o = log_order()
    return df.groupBy(*keys).agg(*[F.min_by(c, o).alias(prefix + c) for c in cols])


def inbox(events: DataFrame) -> DataFrame:
    """Keep the first delivery per event id (ids longer than 200 chars are refused)."""
    ok = events.where(F.length(F.col("event_id").cast("string")) <= 200)
    cols = [c for c in ok.columns if c != "event_id"]
    return first_per(ok, ["event_id"], cols)


def placements(events: DataFrame) -> DataFrame:
    """First ``orders.placed`` per order: ``order_key, placed_at, placed_event``."""
    p = events.where(F.col("subject") == PLACED)
    return p.groupBy("order_key").agg(
        F.min_by("occurred_at", log_order()).alias("placed_at"),
        F.min_by("event_id", log_order()).alias("placed_event"))


def _after_placement(events: DataFrame, placed: DataFrame) -> DataFrame:
    j = events.join(placed, "order_key")
    later = (F.col("occurred_at") > F.col("placed_at")) | (
        (F.col("occurred_at") == F.col("placed_at")) & (F.col("event_id") > F.col("placed_event")))
    return j.where(later)


CLOSING = (SUCCEEDED, FAILED, RELEASED, REJECTED)


def closing_columns(s: Column, reason: Column) -> list[Column]:
    """``status`` and ``rejection_reason`` that a closing event gives its order."""
    return [F.when(s == SUCCEEDED, "confirmed").when(s.isin(FAILED, RELEASED, REJECTED), "rejected").alias("status"),
            F.when(s.isin(FAILED, REJECTED), reason).when(s == RELEASED, F.lit("payment_failed")).alias("rejection_reason")]


def terminal_events(events: DataFrame) -> DataFrame:
    """Events that close an order, mapped to ``(status, rejection_reason)``."""
    s = F.col("subject")
    return events.where(s.isin(*CLOSING)).select("order_key", "event_id", "occurred_at",
                                                 *closing_columns(s, F.col("reason")))


def order_status(events: DataFrame) -> DataFrame:
    """Every placed order starts ``pending``; the first closing event after the
    placement decides it and nothing leaves a terminal state."""
    placed = placements(events)
    decided = (_after_placement(terminal_events(events), placed)
               .groupBy("order_key").agg(
                   F.min_by("status", log_order()).alias("status"),
                   F.min_by("rejection_reason", log_order()).alias("rejection_reason"),
                   F.min("occurred_at").alias("decided_at"),
                   F.min_by("event_id", log_order()).alias("decided_event")))
    return placed.join(decided, "order_key", "left").select(
        "order_key", "placed_at", F.coalesce("status", F.lit("pending")).alias("status"),
        "rejection_reason", "decided_at", "decided_event")


def expires_at(placed_at: Column, checkout_expires_at: Column | None = None,
               ttl_minutes: int = ORDER_TTL_MINUTES) -> Column:
    """Creation + TTL; an opened checkout extends it to its own expiry + 120 s
    (``greatest`` skips a NULL checkout expiry)."""
    if ttl_minutes <= 0:
        raise ValueError("ttl must be positive")
    base = placed_at + F.make_dt_interval(mins=F.lit(ttl_minutes))
    if checkout_expires_at is None:
        return base
    return F.greatest(base, checkout_expires_at + F.make_dt_interval(secs=F.lit(CHECKOUT_GRACE_SECONDS)))


def checkout_rows(events: DataFrame) -> DataFrame:
    """Orders with a checkout row: the first reservation of an order opens one."""
    return events.where((F.col("subject") == RESERVED) & (F.col("quantity") > 0)).select("order_key").distinct()


def deadlines(orders: DataFrame, checkouts: DataFrame | None = None, ttl_minutes: int = ORDER_TTL_MINUTES) -> DataFrame:
    """``orders`` (``order_key, placed_at, status``) with ``expires_at``.  A stored
    ``expires_at`` stays; a pending order without one gets its creation plus the TTL (the
    back-fill), other orders keep NULL.  Opened checkouts (``order_key,
    checkout_expires_at``) extend it to the last of them plus the grace."""
    if ttl_minutes <= 0:
        raise ValueError("ttl must be positive")
    filled = F.when(F.col("status") == "pending", F.col("placed_at") + F.make_dt_interval(mins=F.lit(ttl_minutes)))
    base = F.coalesce(F.col("expires_at"), filled) if "expires_at" in orders.columns else filled
    others = [c for c in orders.columns if c != "expires_at"]
    if checkouts is None:
        return orders.select(*others, base.alias("expires_at"))
    last = checkouts.groupBy("order_key").agg(F.max("checkout_expires_at").alias("_c"))
    later = F.greatest(base, F.col("_c") + F.make_dt_interval(secs=F.lit(CHECKOUT_GRACE_SECONDS)))
    return orders.join(last, "order_key", "left").select(*others, F.when(base.isNotNull(), later).alias("expires_at"))


def _due(status: DataFrame, now, checkouts: DataFrame | None = None) -> DataFrame:
    pending = deadlines(status.where(F.col("status") == "pending"), checkouts)
    return pending.select("order_key", "expires_at").where(F.col("expires_at") <= F.lit(now).cast("timestamp_ntz"))


def expire_orders(status: DataFrame, events: DataFrame, now, checkouts: DataFrame | None = None) -> DataFrame:
    """Pending orders past their deadline (E6) with no succeeded payment (anti join, J6)
    become ``expired`` with reason ``order_expired``; those with a checkout row also get a
    close event id, others NULL."""
    paid = events.where(F.col("subject") == SUCCEEDED).select("order_key")
    rows = checkout_rows(events).withColumn("has_checkout", F.lit(True))
    return _due(status, now, checkouts).join(paid, "order_key", "left_anti").join(rows, "order_key", "left").select(
        "order_key", "expires_at", F.lit("expired").alias("status"), F.lit("order_expired").alias("rejection_reason"),
        F.when(F.col("has_checkout"), F.concat(F.lit("order-expire:"), F.col("order_key").cast("string")))
        .alias("close_event_id"))


def expiry_skipped_paid(status: DataFrame, events: DataFrame, now) -> DataFrame:
    """Pending orders past expiry that do have a succeeded payment (semi join, J5),
    reported once per order."""
    paid = events.where(F.col("subject") == SUCCEEDED).select("order_key")
    return _due(status, now).join(paid, "order_key", "left_semi")


def released_stock(events: DataFrame) -> DataFrame:
    """E5: an active reservation (first ``inventory.reserved`` with a positive quantity)
    followed by a payment failure gives its stock back exactly once; Σ per product."""
    res = first_per(events.where((F.col("subject") == RESERVED) & (F.col("quantity") > 0)),
                    ["order_key"], ["event_id", "occurred_at", "product_id", "quantity"], "res_")
    fail = events.where(F.col("subject") == FAILED).select("order_key", "event_id", "occurred_at")
    after = fail.join(res, "order_key").where(
        (F.col("occurred_at") > F.col("res_occurred_at"))
        | ((F.col("occurred_at") == F.col("res_occurred_at")) & (F.col("event_id") > F.col("res_event_id"))))
    released = after.groupBy("order_key").agg(
        F.first("res_product_id").alias("product_id"), F.first("res_quantity").alias("quantity"))
    return released.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("releases"), F.sum("quantity").cast("bigint").alias("released_units"))


def notifications(events: DataFrame) -> DataFrame:
    """One buyer notification per ``subject/order`` (idempotency key), for payment
    succeeded, inventory rejected and payment failed — except failures that are closures."""
    s = F.col("subject")
    subject_line = None
    for k, v in NOTIFICATION_SUBJECTS.items():
        subject_line = F.when(s == k, v) if subject_line is None else subject_line.when(s == k, v)
    wanted = events.where(s.isin(*NOTIFICATION_SUBJECTS) & ~(
        (s == FAILED) & F.coalesce(F.col("reason").isin(*SILENT_FAILURE_REASONS), F.lit(False))))
    keyed = wanted.select(
        F.concat(s, F.lit("/"), F.col("order_key").cast("string")).alias("idempotency_key"),
        "subject", "order_key", "event_id", "occurred_at", subject_line.alias("notification_subject"))
    return first_per(keyed, ["idempotency_key"], ["subject", "order_key", "event_id", "occurred_at",
                                                   "notification_subject"])


def active_reservations(events: DataFrame) -> DataFrame:
    """F8: an order's reservation (first ``inventory.reserved`` with a positive quantity)
    that no later ``inventory.released`` has released, shaped with status ``reserved``."""
    res = first_per(events.where((F.col("subject") == RESERVED) & (F.col("quantity") > 0)),
                    ["order_key"], ["event_id", "occurred_at", "product_id", "quantity"], "res_")
    rel = events.where(F.col("subject") == RELEASED).select("order_key", "event_id", "occurred_at")
    released = rel.join(res, "order_key").where(
        (F.col("occurred_at") > F.col("res_occurred_at"))
        | ((F.col("occurred_at") == F.col("res_occurred_at")) & (F.col("event_id") > F.col("res_event_id")))
    ).select("order_key")
    return res.join(released, "order_key", "left_anti").select(
        "order_key", F.col("res_product_id").alias("product_id"), F.col("res_quantity").alias("quantity"),
        F.col("res_occurred_at").alias("reserved_at"), F.lit("reserved").alias("status"))
