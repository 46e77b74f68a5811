"""Streaming twins give the batch result for a log that comes in any order, in many files,
with repeated deliveries and events that are days late."""

import datetime as dt
import json

from pyspark.sql import functions as F

from lakecart.operators import saga
from lakecart.plans.views import Views
from lakecart.session import scratch_path
from lakecart.streaming import events as S

from .conftest import SF_SMALL

ORDER, PRODUCT = "11111111-1111-4111-8111-111111111111", "22222222-2222-4222-8222-222222222222"


def _write_log(spark, scratch):
    """The fixture log, shuffled over several files, every seventh event twice."""
    env = S.saga_envelopes(Views(spark, SF_SMALL).v_saga)
    again = env.where("event_id % 7 = 0")
    env.unionByName(again).repartition(5, F.xxhash64("event_id", F.rand(3))).orderBy(F.rand(5)).select("value") \
        .repartition(5).write.mode("overwrite").text(f"{scratch}/log")
    bad = spark.createDataFrame([("not json",), ('{"subject":"orders.placed","payload":{"version":2}}',)], "value string")
    bad.coalesce(1).write.mode("append").text(f"{scratch}/log")
    return f"{scratch}/log"


def _run(df, name, spark, mode="append"):
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", scratch_path(spark, name)).trigger(availableNow=True).start())
    assert q.awaitTermination(150)
    return spark.table(name)


def _same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_twins_equal_batch_for_a_shuffled_log(spark, scratch):
    path = _write_log(spark, scratch)
    good_b, bad_b = S.read_events(spark, path)
    assert bad_b.count() >= 2  # the two bad lines, and the log's own invalid quantities
    good_s, _ = S.read_events(spark, path, streaming=True, max_files=2)
    batch, stream = S.as_saga_rows(good_b), S.as_saga_rows(good_s)

    inbox = _run(S.stream_inbox(stream), "inbox_twin", spark)
    assert _same(inbox.select("event_id", "occurred_at"), saga.inbox(batch).select("event_id", "occurred_at"))

    sent = _run(S.stream_notifications(stream), "notif_twin", spark, "update")
    last = sent.groupBy("idempotency_key").agg(F.min_by("event_id", F.struct("occurred_at", "event_id")).alias("event_id"))
    assert _same(last, saga.notifications(batch).select("idempotency_key", "event_id"))

    status = _run(S.stream_order_status(stream), "status_twin", spark, "update")
    last = status.groupBy("order_key").agg(F.max_by(F.struct("status", "rejection_reason", "decided_at"),
                                                    "version").alias("s")).select("order_key", "s.*")
    assert _same(last, saga.order_status(batch).select(F.col("order_key").cast("string"), "status", "rejection_reason",
                                                       "decided_at"))


def _event(i, at, subject="orders.placed", **more):
    payload = {"version": 1, "orderId": ORDER, "productId": PRODUCT, "quantity": 1, "occurredAt": at, "eventId": f"e-{i}"} | more
    return json.dumps({"subject": subject, "payload": payload})


def test_late_and_odd_events(spark, scratch):
    now = dt.datetime(2024, 1, 10)
    first = [_event(i, (now + dt.timedelta(hours=i)).isoformat() + "Z") for i in range(5)]
    late = [_event(9, "2024-01-01T00:00:00Z"), _event(10, "2024-13-01T00:00:00Z"), _event(11, "2024-01-12T00:00:00Z", eventId=None)]
    for k, lines in enumerate((first, late)):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(f"{scratch}/in")
        good, bad = S.read_events(spark, f"{scratch}/in", streaming=True, max_files=1)
    ids = {r.event_id for r in _run(S.stream_inbox(S.as_saga_rows(good)), "late_inbox", spark).collect()}
    assert {"e-0", "e-9"} <= ids and len(ids) == 7  # the unique event that is days late comes out too
    errors = S.read_events(spark, f"{scratch}/in")[1].collect()
    assert [r.errors for r in errors] == [["occurred_at"]]  # a well-shaped date that doesn't exist
    assert _run(S.stream_order_status(S.as_saga_rows(good)), "late_status", spark, "update").count() >= 1
