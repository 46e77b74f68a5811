"""Event envelopes (S7, D7) and Structured Streaming twins of the saga jobs
(E11 inbox, E22 notifications, E1 order status).

Events are JSON lines ``{"subject": ..., "payload": {...}}``.  The same parsing and
validation serve batch (``spark.read``) and streaming (``spark.readStream``) sources;
contract violations go to a reject output and the stream goes on.

Streaming state is as permanent as the rules are: an event id or a notification key is
known for ever, so there is no watermark and no late row is dropped (a state store on disk
keeps the keys).  Order status keeps one row per order and the closing events before its
decision; ``stream_order_status`` can let a decided order's state go after a grace time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.normalize import md5_uuid
from ..operators import saga

# ---------------------------------------------------------------------------- contract
SUBJECTS = ("orders.placed", "inventory.reserved", "inventory.released", "inventory.rejected",
            "payment.succeeded", "payment.failed")
REJECT_REASONS = ("invalid_quantity", "product_not_found", "insufficient_stock", "stock_limit")
UUID_RE = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
ISO_UTC_RE = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"
MAX_CART_LINES = 20
INT_MAX = 2**31 - 1

ITEM = T.StructType([T.StructField("productId", T.StringType()), T.StructField("quantity", T.LongType())])
PAYLOAD = T.StructType([
    T.StructField("version", T.LongType()), T.StructField("orderId", T.StringType()),
    T.StructField("productId", T.StringType()), T.StructField("quantity", T.DoubleType()),
    T.StructField("items", T.ArrayType(ITEM)), T.StructField("buyerId", T.StringType()),
    T.StructField("occurredAt", T.StringType()), T.StructField("reason", T.StringType()),
    T.StructField("provider", T.StringType()), T.StructField("eventId", T.StringType()),
    T.StructField("checkoutId", T.StringType()), T.StructField("providerOrderId", T.StringType()),
])
ENVELOPE = T.StructType([T.StructField("subject", T.StringType()), T.StructField("payload", PAYLOAD)])


def parse_envelopes(lines: DataFrame, col: str = "value") -> DataFrame:
    """Text lines -> parsed envelope columns plus the raw line; unknown extra fields are
    ignored, unparsable lines have a NULL ``env``."""
    return lines.select(F.col(col).alias("raw"), F.from_json(F.col(col), ENVELOPE).alias("env"))


def _cart_ok(items: Column) -> Column:
    return (F.size(items).between(1, MAX_CART_LINES)
            & F.forall(items, lambda i: i["quantity"].between(1, INT_MAX) & i["productId"].rlike(UUID_RE))
            & (F.size(F.array_distinct(F.transform(items, lambda i: i["productId"]))) == F.size(items)))


def validate_events(parsed: DataFrame) -> DataFrame:
    """One row per line with ``errors`` (empty when valid) and typed columns."""
    p = F.col("env.payload")
    s = F.col("env.subject")
    rules = [
        (F.col("env").isNull(), "unparsable"),
        (~F.coalesce(s.isin(*SUBJECTS), F.lit(False)), "unknown_subject"),
        (~F.coalesce(p["version"] == 1, F.lit(False)), "version"),
        (~F.coalesce(p["orderId"].rlike(UUID_RE), F.lit(False)), "order_id"),
        (~F.coalesce(p["productId"].rlike(UUID_RE), F.lit(False)), "product_id"),
        (~F.coalesce((p["quantity"] > 0) & (p["quantity"] == F.floor(p["quantity"])) & (p["quantity"] <= INT_MAX),
                     F.lit(False)), "quantity"),
        (p["items"].isNotNull() & ~F.coalesce(_cart_ok(p["items"]), F.lit(False)), "items"),
        (~F.coalesce(p["occurredAt"].rlike(ISO_UTC_RE), F.lit(False)) | p["occurredAt"].try_cast("timestamp").isNull(),
         "occurred_at"),
        ((s == "payment.failed") & ~F.coalesce(F.length(p["reason"]).between(1, 160), F.lit(False)), "reason"),
        ((s == "inventory.rejected") & ~F.coalesce(p["reason"].isin(*REJECT_REASONS), F.lit(False)), "reason"),
        (p["eventId"].isNotNull() & ~F.length(p["eventId"]).between(1, 200), "event_id"),
        (p["checkoutId"].isNotNull() & ~p["checkoutId"].rlike(UUID_RE), "checkout_id"),
        (p["provider"].isNotNull() & (p["provider"] != "polar"), "provider"),
    ]
    errors = F.filter(F.array(*[F.when(c, F.lit(name)) for c, name in rules]), lambda x: x.isNotNull())
    return parsed.select(
        "raw", errors.alias("errors"),
        s.alias("subject"), p["orderId"].alias("order_id"), p["productId"].alias("product_id"),
        p["quantity"].cast("long").alias("quantity"), p["items"].alias("items"), p["buyerId"].alias("buyer_id"),
        p["occurredAt"].try_cast("timestamp").cast("timestamp_ntz").alias("occurred_at"), p["reason"].alias("reason"),
        F.coalesce(p["eventId"], F.sha2(F.col("raw"), 256)).alias("event_id"))


def read_events(spark: SparkSession, path: str, streaming: bool = False, max_files: int | None = None):
    """(good, rejected) frames from JSON-lines files, batch or streaming."""
    if streaming:
        reader = spark.readStream.format("text")
        if max_files:
            reader = reader.option("maxFilesPerTrigger", max_files)
        lines = reader.load(path)
    else:
        lines = spark.read.text(path)
    checked = validate_events(parse_envelopes(lines))
    good = checked.where(F.size("errors") == 0).drop("errors", "raw")
    bad = checked.where(F.size("errors") > 0).select("raw", "errors")
    return good, bad


def saga_envelopes(saga_events: DataFrame) -> DataFrame:
    """The fixture saga log as v1 envelopes (one JSON text per event, UUIDs derived
    from the keys), for feeding file or Kafka sources."""
    ts = F.date_format(F.col("occurred_at"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    payload = F.struct(
        F.lit(1).alias("version"), md5_uuid(F.concat(F.lit("order:"), F.col("order_key").cast("string"))).alias("orderId"),
        md5_uuid(F.concat(F.lit("product:"), F.col("product_id").cast("string"))).alias("productId"),
        F.col("quantity").alias("quantity"), F.lit(None).cast("string").alias("buyerId"), ts.alias("occurredAt"),
        F.col("reason").alias("reason"), F.col("event_id").cast("string").alias("eventId"))
    return saga_events.select(F.col("occurred_at"), F.col("event_id"),
                              F.to_json(F.struct(F.col("subject"), payload.alias("payload"))).alias("value"))


def as_saga_rows(good: DataFrame) -> DataFrame:
    """Validated envelopes in the shape the saga jobs take."""
    return good.select(F.col("event_id"), F.col("order_id").alias("order_key"), "occurred_at", "subject",
                       "quantity", F.col("product_id"), F.lit(None).cast("double").alias("value"), "reason")


# ----------------------------------------------------------------------- streaming twins
def stream_inbox(events: DataFrame) -> DataFrame:
    """E11 streaming: the first delivery of each event id, whenever it comes.  The id is a
    permanent key: its state has no watermark."""
    return events.where(F.length("event_id") <= 200).dropDuplicates(["event_id"])


def stream_notifications(events: DataFrame) -> DataFrame:
    """E22 streaming, for the ``update`` output mode: one row per idempotency key, sent
    again if an earlier event of the key comes late.  A sink keyed by it ends with the rows
    of the batch job, in whatever order the log arrives."""
    return saga.notifications(events)


STATUS_OUT = T.StructType([
    T.StructField("order_key", T.StringType()), T.StructField("placed_at", T.TimestampNTZType()),
    T.StructField("status", T.StringType()), T.StructField("rejection_reason", T.StringType()),
    T.StructField("decided_at", T.TimestampNTZType()), T.StructField("version", T.LongType()),
])
_CLOSING = T.ArrayType(T.StructType([
    T.StructField("at", T.TimestampNTZType()), T.StructField("event", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("reason", T.StringType())]))
STATUS_STATE = T.StructType([
    T.StructField("placed_at", T.TimestampNTZType()), T.StructField("placed_event", T.StringType()),
    T.StructField("closing", _CLOSING), T.StructField("version", T.LongType()),
])


def _order_step(grace_ms: int | None):
    """Per order: the earliest placement, and closing events up to the decision (later
    ones can't change it).  Rows are folded batch by batch."""

    def step(key, pdfs: Iterator[pd.DataFrame], state):
        if state.hasTimedOut:
            state.remove()
            return
        placed, closing, version = None, [], 0
        if state.exists:
            at, event, kept, version = state.get
            placed = (at, event) if at is not None else None
            closing = [tuple(c) for c in kept]

        def decision():
            after = [c for c in closing if placed is not None and (c[0], c[1]) > placed]
            return min(after) if after else None

        before = (placed, decision())
        for pdf in pdfs:
            first = pdf[pdf["subject"] == saga.PLACED]
            if len(first):
                at, event = min(zip(first["occurred_at"].dt.to_pydatetime(), first["event_id"], strict=True))
                placed = min(placed, (at, event)) if placed else (at, event)
            last = pdf[pdf["status"].notna()]
            closing += zip(last["occurred_at"].dt.to_pydatetime(), last["event_id"], last["status"],
                           last["rejection_reason"].where(last["rejection_reason"].notna(), None), strict=True)
            decided = decision()
            if decided:  # later events can't come before it, earlier ones may if the placement moves
                closing = [c for c in set(closing) if (c[0], c[1]) <= decided[:2]]
        decided = decision()
        if (placed, decided) != before and placed is not None:
            version += 1
            status, reason = decided[2:] if decided else ("pending", None)
            yield pd.DataFrame([{"order_key": str(key[0]), "placed_at": placed[0], "status": status,
                                 "rejection_reason": reason, "decided_at": decided[0] if decided else None, "version": version}])
        state.update((placed[0] if placed else None, placed[1] if placed else None, sorted(closing, key=lambda c: c[:2]), version))
        if decided and grace_ms:
            state.setTimeoutDuration(grace_ms)

    return step


def stream_order_status(events: DataFrame, grace_days: int | None = None) -> DataFrame:
    """E1 streaming twin: per order, emits the (placement, decision) whenever it changes;
    the last version per order equals the batch ``order_status``.  Event ids are texts and
    break ties as in the log's order.

    ``grace_days``: for queries that run on, a decided order's state goes so long after its
    last event (by the clock, so no row counts as late).  Without it state is kept, one
    small row per order, which is what a run that ends (``availableNow``) needs."""
    s = F.col("subject")
    closing = saga.closing_columns(s, F.col("reason"))
    ev = events.where(s.isin(saga.PLACED, *saga.CLOSING)).select(
        F.col("order_key").cast("string").alias("order_key"), "occurred_at",
        F.col("event_id").cast("string").alias("event_id"), "subject", *closing)
    return ev.groupBy("order_key").applyInPandasWithState(
        _order_step(grace_days and grace_days * 86_400_000), STATUS_OUT, STATUS_STATE, "update",
        GroupStateTimeout.ProcessingTimeTimeout if grace_days else GroupStateTimeout.NoTimeout)
