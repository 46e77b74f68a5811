"""Order deadlines as a stream (E6, E7): an order that is neither paid nor closed expires
at its deadline, without a new event of its own.

Each order has one event-time timer.  It is set when the order is placed, moved when a
checkout is opened (the deadline is then the checkout's expiry plus a grace, if later) or
an earlier placement comes late, and dropped when the order closes.  It fires when the watermark
passes it, so an order expires only after everything that may still be under way has had
``delay`` to arrive; what comes later than that is too late for the order, as it is for
the batch job that has run.

State lives in RocksDB, a small row per order that is not closed, and goes when the order
closes or expires.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import saga

CHECKOUT_OPENED = "checkout.opened"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

EXPIRED = T.StructType([
    T.StructField("order_key", T.StringType()), T.StructField("expires_at", T.TimestampType()),
    T.StructField("status", T.StringType()), T.StructField("rejection_reason", T.StringType()),
    T.StructField("close_event_id", T.StringType())])
#: Microseconds of: first placement, last closing event, last checkout expiry (-1: none);
#: whether a succeeded payment and a reservation were seen.
_ORDER = T.StructType([
    T.StructField("placed", T.LongType()), T.StructField("placed_event", T.StringType()),
    T.StructField("closed", T.LongType()), T.StructField("closed_event", T.StringType()),
    T.StructField("checkout", T.LongType()), T.StructField("paid", T.BooleanType()),
    T.StructField("reserved", T.BooleanType()), T.StructField("done", T.BooleanType())])


class _Deadlines(StatefulProcessor):
    def __init__(self, ttl_us: int, grace_us: int):
        self.ttl_us, self.grace_us = ttl_us, grace_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.order = handle.getValueState("order", _ORDER)

    def _deadline(self, placed: int, checkout: int) -> int:
        return max(placed + self.ttl_us, checkout + self.grace_us if checkout >= 0 else 0)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        placed = closed = None
        checkout, paid, reserved, done = -1, False, False, False
        if self.order.exists():
            p, pe, c, ce, checkout, paid, reserved, done = self.order.get()
            placed, closed = (p, pe) if p >= 0 else None, (c, ce) if c >= 0 else None
        for pdf in rows:
            for subject, at, event, quantity, opened in zip(pdf["subject"], pdf["us"], pdf["event_id"], pdf["quantity"],
                                                            pdf["checkout_us"], strict=True):
                mark = (int(at), event)
                if subject == saga.PLACED:
                    placed = min(placed, mark) if placed else mark
                elif subject in saga.CLOSING:
                    closed = max(closed, mark) if closed else mark
                    paid = paid or subject == saga.SUCCEEDED
                elif subject == saga.RESERVED:
                    reserved = reserved or quantity > 0
                else:
                    checkout = max(checkout, int(opened))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        pending = placed is not None and not done and not paid and not (closed and closed > placed)
        if pending:  # timers are in milliseconds; one due in part of a millisecond fires after it
            self.handle.registerTimer(-(-self._deadline(placed[0], checkout) // 1000))
        self.order.update((*(placed or (-1, "")), *(closed or (-1, "")), checkout, paid, reserved, done))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        p, pe, c, ce, checkout, paid, reserved, _ = self.order.get()
        self.order.update((p, pe, c, ce, checkout, paid, reserved, True))
        yield pd.DataFrame({
            "order_key": [key[0]], "expires_at": [pd.Timestamp(self._deadline(p, checkout), unit="us")], "status": ["expired"],
            "rejection_reason": ["order_expired"], "close_event_id": [f"order-expire:{key[0]}" if reserved else None]})

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def stream_expire_orders(events: DataFrame, delay: str = "1 hour", ttl_minutes: int = saga.ORDER_TTL_MINUTES,
                         grace_seconds: int = saga.CHECKOUT_GRACE_SECONDS) -> DataFrame:
    """E7 as a stream: a row for every order that expires, once, in the columns of
    ``operators.saga.expire_orders``.

    ``events``: ``event_id, order_key, occurred_at, subject, quantity`` and, for
    ``checkout.opened``, ``checkout_expires_at``.  The session needs :func:`use_rocksdb`.
    """
    if ttl_minutes <= 0 or grace_seconds < 0:
        raise ValueError("the ttl must be positive and the grace not negative")
    use_rocksdb(events.sparkSession)
    opened = F.col("checkout_expires_at") if "checkout_expires_at" in events.columns else F.lit(None).cast("timestamp")
    wanted = (saga.PLACED, *saga.CLOSING, saga.RESERVED, CHECKOUT_OPENED)
    rows = events.where(F.col("subject").isin(*wanted)).select(
        F.col("order_key").cast("string").alias("order_key"), F.col("occurred_at").cast("timestamp").alias("occurred_at"),
        F.col("event_id").cast("string").alias("event_id"), "subject", F.coalesce("quantity", F.lit(0)).cast("long").alias("quantity"),
        F.coalesce(F.unix_micros(opened.cast("timestamp")), F.lit(-1)).alias("checkout_us"))
    rows = rows.withColumn("us", F.unix_micros("occurred_at")).withWatermark("occurred_at", delay)
    return rows.groupBy("order_key").transformWithStateInPandas(
        statefulProcessor=_Deadlines(ttl_minutes * 60_000_000, grace_seconds * 1_000_000), outputStructType=EXPIRED,
        outputMode="append", timeMode="eventTime")
