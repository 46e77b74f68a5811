"""Provider webhook mapping (E10) and retry schedules."""

import datetime as dt
import json

from pyspark.sql import functions as F

from lakecart.operators import payments as P

OID = "11111111-1111-4111-8111-111111111111"


def _hook(t, data):
    return json.dumps({"type": t, "timestamp": "2026-09-01T00:00:00Z", "data": data})


PO, CK = "22222222-2222-4222-8222-222222222222", "33333333-3333-4333-8333-333333333333"


def _order(**changes):
    return {"id": PO, "status": "paid", "paid": True, "checkout_id": CK, "subtotal_amount": 1990, "currency": "pen",
            "metadata": {"order_id": OID}} | changes


def _checkout(**changes):
    return {"id": CK, "status": "expired", "metadata": {"order_id": OID}} | changes


def test_map_payment_events(spark):
    no_meta = _order()
    del no_meta["metadata"]
    bodies = {
        "paid": _hook("order.paid", _order()),
        "not_paid": _hook("order.paid", _order(status="pending", paid=False)),
        "void": _hook("order.updated", _order(status="void", paid=False)),
        "updated": _hook("order.updated", _order()),
        "expired": _hook("checkout.updated", _checkout()),
        "failed": _hook("checkout.updated", _checkout(status="failed")),
        "confirmed": _hook("checkout.updated", _checkout(status="confirmed")),
        "foreign": _hook("order.paid", _order(metadata={"other": "x"})),
        "other": _hook("refund.created", {"id": "r"}),
        "broken": "not json",
        "no_meta": _hook("order.paid", no_meta),
        "bad_uuid": _hook("order.paid", _order(id="po")),
        "bad_state": _hook("order.updated", _order(status="lost")),
        "negative": _hook("order.paid", _order(subtotal_amount=-1)),
        "currency": _hook("order.paid", _order(currency="soles")),
        "bad_checkout": _hook("checkout.updated", _checkout(status="gone")),
        "bad_time": _hook("order.paid", _order()).replace("2026-09-01T00:00:00Z", "not a time"),
        "no_day": _hook("order.paid", _order()).replace("2026-09-01", "2026-13-01"),
    }
    frame = spark.createDataFrame(list(bodies.items()), "event_id string, body string")
    out = {r.event_id: r for r in P.map_payment_events(frame).collect()}
    assert {k: r.action for k, r in out.items()} == {
        "paid": "outcome", "not_paid": "error", "void": "outcome", "updated": "drop", "expired": "outcome",
        "failed": "outcome", "confirmed": "drop", "foreign": "drop", "other": "drop", "broken": "error", "no_meta": "error",
        "bad_uuid": "error", "bad_state": "error", "negative": "error", "currency": "error", "bad_checkout": "error",
        "bad_time": "error", "no_day": "error"}
    assert (out["paid"].outcome, out["paid"].amount, out["paid"].checkout_id, out["paid"].provider_order_id) == \
        ("succeeded", 1990, CK, PO)
    assert (out["void"].outcome, out["void"].reason, out["void"].amount) == ("failed", P.ORDER_VOID, None)
    assert (out["expired"].reason, out["expired"].checkout_id) == (P.CHECKOUT_EXPIRED, CK)
    assert out["failed"].reason == P.CHECKOUT_FAILED


def test_retry_schedules(spark):
    df = spark.createDataFrame([(1, False, None), (3, False, 500), (2, False, 99999), (5, False, None), (1, True, None)],
                               "attempt int, rejected boolean, ra int").withColumn(
        "now", F.lit("2026-01-01 00:00:00").cast("timestamp_ntz"))
    got = [r[0] for r in df.select(P.catalog_retry_at(F.col("now"), F.col("attempt"), F.col("rejected"),
                                                      F.col("ra"))).collect()]
    base = dt.datetime(2026, 1, 1)
    assert got == [base + dt.timedelta(seconds=30), base + dt.timedelta(seconds=500),
                   base + dt.timedelta(seconds=3600), None, None]
    r = df.select(P.webhook_retry_at(F.col("now")), P.checkout_retry_at(F.col("now"))).first()
    assert (r[0], r[1]) == (base + dt.timedelta(seconds=2), base + dt.timedelta(seconds=30))
