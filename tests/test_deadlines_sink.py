"""Deadlines as a stream give the batch result; a keyed table survives a run that stops
between writing a batch and committing it."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lakecart.operators import saga
from lakecart.plans.views import Views
from lakecart.session import scratch_path
from lakecart.streaming import deadlines as D
from lakecart.streaming.sink import KeyedTable, deliver

from .conftest import SF_SMALL

NOW = dt.datetime(2024, 1, 15)
SCHEMA = ("event_id long, order_key string, occurred_at timestamp_ntz, subject string, quantity long, "
          "checkout_expires_at timestamp_ntz")


def _log(spark):
    """The fixture log, and checkouts opened after some reservations."""
    ev = Views(spark, SF_SMALL).v_saga.select(
        "event_id", F.col("order_key").cast("string").alias("order_key"), "occurred_at", "subject",
        F.col("quantity").cast("long").alias("quantity"), F.col("reason"), F.lit(None).cast("timestamp_ntz").alias("checkout_expires_at"))
    opened = ev.where("subject = 'orders.placed' AND event_id % 3 = 0").select(
        (F.col("event_id") + 10_000_000).alias("event_id"), "order_key", "occurred_at", F.lit(D.CHECKOUT_OPENED).alias("subject"),
        "quantity", "reason", (F.col("occurred_at") + F.make_dt_interval(days=(F.col("event_id") % 30).cast("int"))).alias("checkout_expires_at"))
    return ev.unionByName(opened)


def _clock(spark, at):
    return spark.createDataFrame([(-1, "clock", at, saga.PLACED, 1, None)], SCHEMA)


def _expired(spark, path, scratch, delay):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(path)
    table = KeyedTable(spark, f"{scratch}/expired", D.EXPIRED, ["order_key"], ["expires_at"])
    run = deliver(D.stream_expire_orders(stream, delay), table, f"{scratch}/checkpoint").trigger(availableNow=True).start()
    assert run.awaitTermination(240) and run.exception() is None
    return table


def test_stream_of_deadlines_equals_batch(spark, scratch):
    log = _log(spark)
    path = f"{scratch}/log"
    log.drop("reason").repartition(5, F.xxhash64("event_id")).write.parquet(path)
    _clock(spark, NOW + dt.timedelta(days=400)).coalesce(1).write.mode("append").parquet(path)  # the delay, so all rows are in time
    got = _expired(spark, path, scratch, "400 days").read()
    checkouts = log.where(F.col("subject") == D.CHECKOUT_OPENED).select("order_key", "checkout_expires_at")
    events = log.where(F.col("subject") != D.CHECKOUT_OPENED)
    batch = saga.expire_orders(saga.order_status(events), events, NOW, checkouts)
    rows = {(r.order_key, r.expires_at, r.close_event_id) for r in got.withColumn("expires_at", F.col("expires_at").cast("timestamp_ntz")).collect()}
    expected = {(r.order_key, r.expires_at, r.close_event_id) for r in batch.collect()}
    assert rows == expected and len(expected) > 20
    moved = saga.expire_orders(saga.order_status(events), events, NOW)
    assert {r.order_key for r in moved.collect()} != {k for k, *_ in expected}  # checkouts did move some


def test_a_timer_fires_without_an_event_and_closing_drops_it(spark, scratch):
    t = dt.datetime(2024, 1, 1, 12)

    def minutes(m):
        return t + dt.timedelta(minutes=m)

    files = [[(1, "a", t, saga.PLACED, 1, None), (2, "b", t, saga.PLACED, 1, None), (3, "c", t, saga.PLACED, 1, None),
              (9, "d", t, saga.PLACED, 1, None)],
             [(4, "b", minutes(3), saga.SUCCEEDED, 1, None), (5, "c", minutes(4), D.CHECKOUT_OPENED, 1, minutes(20)),
              (6, "a", minutes(1), saga.RESERVED, 2, None), (10, "d", minutes(2), saga.REJECTED, 1, None)],
             [(7, "clock", minutes(16), saga.PLACED, 1, None)], [(8, "clock", minutes(23), saga.PLACED, 1, None)]]
    seen = []
    for rows in files:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{scratch}/log")
        table = _expired(spark, f"{scratch}/log", scratch, "0 seconds")
        seen.append(sorted((r.order_key, r.close_event_id) for r in table.read().collect()))
    assert seen == [[], [], [("a", "order-expire:a")], [("a", "order-expire:a"), ("c", None)]]


def test_delivery_survives_a_stop_between_write_and_commit(spark, scratch):
    schema = "event_id string, at long, value long"
    for k in range(4):  # the second half repeats events of the first
        rows = [(f"e{i % 30}", 100 - k, 10 * k + i) for i in range(20 * k, 20 * k + 20)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{scratch}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{scratch}/in")

    def table(name):
        return KeyedTable(spark, f"{scratch}/{name}", stream.schema, ["event_id"], ["at"])

    clean = table("clean")
    assert deliver(stream, clean, scratch_path(spark, "clean")).trigger(availableNow=True).start().awaitTermination(120)

    class Stops(KeyedTable):
        def commit(self, batch_id, replaces=None):
            if batch_id == 2:
                raise RuntimeError("stopped here")
            super().commit(batch_id, replaces)

    checkpoint = scratch_path(spark, "killed")
    broken = Stops(spark, f"{scratch}/killed", stream.schema, ["event_id"], ["at"])
    with pytest.raises(Exception, match="stopped here"):
        deliver(stream, broken, checkpoint).trigger(availableNow=True).start().awaitTermination(120)
    killed = table("killed")
    assert sorted(killed.committed()) == [0, 1]
    assert killed.read().count() < clean.read().count() or killed.read().exceptAll(clean.read()).count() > 0
    assert deliver(stream, killed, checkpoint).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(killed.committed()) == [0, 1, 2, 3]

    def rows(t):
        return sorted(map(tuple, t.read().collect()))

    assert rows(killed) == rows(clean) and len(rows(clean)) == 30
    killed.write_batch(spark.createDataFrame([("e0", -5, -5)], schema), 2)  # a batch that is committed comes again
    assert rows(killed) == rows(clean)
    killed.compact()
    assert len(killed.committed()) == 1 and rows(killed) == rows(clean)
    killed.write_batch(spark.createDataFrame([("e0", 0, -1), ("new", 1, 1)], schema), 4)
    assert dict((r[0], r[2]) for r in rows(killed))["e0"] == -1 and len(rows(killed)) == 31
    assert table("empty").read().count() == 0
