"""Checkouts, payment outcomes and order creation.

Inputs are tables: orders (``order_id, customer_id, status, created_at, expires_at``),
checkout rows (``order_id, state, checkout_id, checkout_url, expires_at, amount, currency``;
at most one per order) and the inbox of outcomes (``event_id, order_id, checkout_id, outcome,
amount, currency, occurred_at``).  What the services decided under row locks, one request at
a time, is decided here per order by the inbox's order ``(occurred_at, event_id)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .catalog import same_items

MIN_CENTS, MAX_CENTS = 200, 99_999_999
DONE = ("succeeded", "failed")
CLOSED = ("cancelled", "expired")


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def apply_outcomes(inbox: DataFrame, orders: DataFrame, checkouts: DataFrame) -> DataFrame:
    """Each outcome with ``action`` and ``reason``.

    ``retry`` checkout_not_ready: no checkout row, or the outcome names a checkout the row
    doesn't have yet; ``late``: a correct success for an order that is cancelled or expired;
    ``ignored``: checkout_mismatch, amount_mismatch, or terminal_state (the row is done, by
    itself or by an earlier outcome); else ``applied``.  Only an applied outcome changes a
    row, and the first one ends it, so one window over each order's applicable outcomes
    replaces the fold."""
    o = orders.select("order_id", F.col("status").alias("order_status"))
    c = checkouts.select("order_id", "state", F.col("checkout_id").alias("row_checkout"), F.col("amount").alias("row_amount"),
                         F.col("currency").alias("row_currency"))
    x = inbox.join(c, "order_id", "left").join(o, "order_id", "left")
    success = F.col("outcome") == "succeeded"
    not_ready = F.col("state").isNull() | (F.col("checkout_id").isNotNull() & F.col("row_checkout").isNull())
    mismatch = (success & F.col("checkout_id").isNull()) | _yes(F.col("checkout_id") != F.col("row_checkout"))
    wrong = success & (~F.col("amount").eqNullSafe(F.col("row_amount")) | ~F.col("currency").eqNullSafe(F.col("row_currency")))
    def says(action: str, reason: str | None = None) -> Column:
        return F.struct(F.lit(action).alias("action"), F.lit(reason).cast("string").alias("reason"))

    verdict = (F.when(not_ready, says("retry", "checkout_not_ready"))
               .when(mismatch, says("ignored", "checkout_mismatch"))
               .when(wrong, says("ignored", "amount_mismatch"))
               .when(success & _yes(F.col("order_status").isin(*CLOSED)), says("late"))
               .when(F.col("state").isin(*DONE), says("ignored", "terminal_state"))
               .otherwise(says("applied")))
    x = x.withColumn("v", verdict)
    turn = F.row_number().over(Window.partitionBy("order_id", F.col("v.action")).orderBy("occurred_at", "event_id"))
    again = (F.col("v.action") == "applied") & (F.col("turn") > 1)
    return x.withColumn("turn", turn).select(
        "event_id", "order_id", "outcome", "occurred_at", "amount", "currency",
        F.when(again, F.lit("ignored")).otherwise(F.col("v.action")).alias("action"),
        F.when(again, F.lit("terminal_state")).otherwise(F.col("v.reason")).alias("reason"))


def orders_after(applied: DataFrame, orders: DataFrame) -> DataFrame:
    """Order status after the inbox: a pending order with an applied success is
    confirmed; nothing else changes here."""
    paid = applied.where((F.col("action") == "applied") & (F.col("outcome") == "succeeded")).select(
        "order_id", F.lit(True).alias("paid"))
    return orders.join(paid, "order_id", "left").select(
        "order_id", F.when((F.col("status") == "pending") & F.col("paid"), "confirmed").otherwise(F.col("status")).alias("status"))


def late_payments(applied: DataFrame) -> DataFrame:
    """The first correct success of each cancelled or expired order."""
    at = F.struct("occurred_at", "event_id")
    return applied.where(F.col("action") == "late").groupBy("order_id").agg(
        F.min_by("event_id", at).alias("late_event_id"), F.min_by("occurred_at", at).alias("late_at"),
        F.min_by("amount", at).alias("late_amount"))


def cancel_orders(requests: DataFrame, orders: DataFrame, checkouts: DataFrame) -> DataFrame:
    """``request_id, order_id, decision`` (and the close event of a cancelled order that
    has a checkout row) for requests ``request_id, order_id, buyer, remote_status``; a null
    remote status is unknown.  First rule wins: unknown or another buyer's order
    ``not_found``; ``already_cancelled``; not pending ``conflict``; paid here or confirmed at
    the provider ``conflict``; an open checkout of unknown remote status ``retry``; else
    ``cancelled``."""
    o = orders.select("order_id", F.col("customer_id").alias("owner"), "status")
    c = checkouts.select("order_id", "state", F.col("checkout_id").alias("row_checkout"))
    x = requests.join(o, "order_id", "left").join(c, "order_id", "left")
    paid = (F.col("state") == "succeeded") | F.col("remote_status").isin("confirmed", "succeeded")
    decision = (F.when(~_yes(F.col("owner") == F.col("buyer")), "not_found")
                .when(F.col("status") == "cancelled", "already_cancelled")
                .when(F.col("status") != "pending", "conflict")
                .when(_yes(paid), "conflict")
                .when(F.col("row_checkout").isNotNull() & F.col("remote_status").isNull(), "retry")
                .otherwise("cancelled"))
    return x.withColumn("decision", decision).select(
        "request_id", "order_id", "decision",
        F.when((F.col("decision") == "cancelled") & F.col("state").isNotNull(),
               F.concat(F.lit("order-cancel:"), F.col("order_id").cast("string"))).alias("close_event_id"))


def create_orders(requests: DataFrame, prices: DataFrame) -> DataFrame:
    """Requests (``request_id, order_id, buyer, items`` array of struct(product_id,
    quantity)) decided by key ``order_id``, in order of ``request_id``.

    The first request that can be created creates the order; a later one with the same buyer
    and the same lines in any order (A3) gets it (``existing``), any other is a ``conflict``.  A
    request that comes while there is no order is judged by itself: a line without a ready
    price (``product_id, unit_amount``) gives ``price_unavailable``, a total over the maximum
    ``amount_invalid``, and nothing is remembered of it.
    """
    priced = (requests.select("request_id", F.explode_outer("items").alias("l"))
              .select("request_id", F.col("l.product_id").alias("product_id"), F.col("l.quantity").alias("q")).join(prices, "product_id", "left")
              .groupBy("request_id").agg(F.count_if(F.col("unit_amount").isNull()).alias("missing"),
                                         F.sum(F.col("unit_amount") * F.col("q")).cast("bigint").alias("total")))
    own = F.when(F.col("missing") > 0, "price_unavailable").when(F.col("total") > MAX_CENTS, "amount_invalid").otherwise("created")
    x = requests.join(priced, "request_id").withColumn("own", own)
    order = (x.where("own = 'created'").groupBy("order_id")
             .agg(F.min_by(F.struct("request_id", "buyer", "items"), "request_id").alias("o")))
    x = x.join(order, "order_id", "left")
    later = F.coalesce(F.col("request_id") > F.col("o.request_id"), F.lit(False))
    same = F.col("buyer").eqNullSafe(F.col("o.buyer")) & same_items("items", "o.items", "product_id")
    decision = F.when(later, F.when(same, "existing").otherwise("conflict")).otherwise(F.col("own"))
    return x.select("request_id", "order_id", decision.alias("decision"), F.when(decision == "created", F.col("total")).alias("total"))


def republish_pending(orders: DataFrame, checkouts: DataFrame, now) -> DataFrame:
    """Pending, unexpired orders that have no checkout row yet."""
    alive = orders.where((F.col("status") == "pending") & (F.col("expires_at") > F.lit(now).cast("timestamp_ntz")))
    return alive.join(checkouts.select("order_id"), "order_id", "left_anti").select("order_id")


def open_payment_rows(reserved: DataFrame, orders: DataFrame) -> DataFrame:
    """One checkout row per order, of its first reservation (``order_id, event_id,
    occurred_at, amount``); an order that is closed already also gets its close event."""
    at = F.struct("occurred_at", "event_id")
    rows = reserved.groupBy("order_id").agg(F.min_by("event_id", at).alias("event_id"), F.min_by("amount", at).alias("amount"))
    x = rows.join(orders.select("order_id", "status"), "order_id")
    event = F.when(F.col("status") == "cancelled", "order-cancel:").when(F.col("status") == "expired", "order-expire:")
    return x.select("order_id", "event_id", "amount", F.lit("creating").alias("state"),
                    F.concat(event, F.col("order_id").cast("string")).alias("close_event_id"))


def open_checkouts(orders: DataFrame, checkouts: DataFrame) -> DataFrame:
    """each order of a checkout row with its checkout (id, url, expiry), NULL unless the
    order is pending and the row open and complete."""
    c = checkouts.select("order_id", "state", "checkout_id", "checkout_url", F.col("expires_at").alias("checkout_expires_at"))
    x = orders.select("order_id", "status").join(c, "order_id")
    shown = _yes((F.col("status") == "pending") & (F.col("state") == "open")) & F.col("checkout_id").isNotNull() \
        & F.col("checkout_url").isNotNull() & F.col("checkout_expires_at").isNotNull()
    return x.select("order_id", *[F.when(shown, F.col(k)).alias(k) for k in ("checkout_id", "checkout_url", "checkout_expires_at")])
