"""Lake ETL: the reference's dirty vectors, strict headers, end-to-end round trip."""

import pytest
from pyspark.sql import functions as F

from lakecart.functions.normalize import TABLES, normalize, stable_key
from lakecart.operators import quality
from lakecart.plans.lake_views import lake_frame, render_raw
from lakecart.plans.views import Views
from lakecart.sources import lake

from .conftest import SF_SMALL


def test_normalize_dirty_orders(spark):
    cols = list(TABLES["orders"])
    df = spark.createDataFrame([
        (" ORDER-1 ", " CUSTOMER-1 ", "2026-09-17T13:13:45Z", " Canceled ", "0.10", " pen ", " WEB "),
        ("order-2", "customer-2", "invalid-date", " N/A ", "bad-price", "PEN", "api"),
        ("order-3", "customer-3", "2026-09-18T02:00:00+02:00", "Not A Status", "NULL", "PEN", "api"),
    ], cols)
    out = normalize(df, "orders").withColumn("order_date", F.col("order_date").cast("timestamp_ntz"))
    rows = {r.order_id: r for r in out.collect()}
    r1, r2, r3 = rows["order-1"], rows["order-2"], rows["order-3"]
    assert (r1.customer_id, r1.status, str(r1.total_amount), r1.currency, r1.channel) == (
        "customer-1", "cancelled", "0.10", "PEN", "web")
    assert r1.order_date.isoformat() == "2026-09-17T13:13:45"
    assert r2.order_date is None and r2.total_amount is None and r2.status == "unknown"
    assert r3.order_date.isoformat() == "2026-09-18T00:00:00" and r3.status == "unknown" and r3.total_amount is None
    assert out.schema["total_amount"].dataType.simpleString() == "decimal(18,2)"


def test_normalize_payment_and_casts(spark):
    df = spark.createDataFrame([(" PAYMENT-1 ", " ORDER-1 ", "12.34", "pen", " CANCELLED ", " POLAR ", "Ref-1",
                                 "2026-09-01T03:00:00Z", "")], list(TABLES["payments"]))
    p = normalize(df, "payments").first()
    assert (p.status, p.provider, p.provider_ref, p.paid_at) == ("canceled", "polar", "Ref-1", None)
    ints = spark.createDataFrame([("3.7",), ("1e2",), ("-2",), ("x",)], "stock string")
    from lakecart.functions.normalize import safe_cast
    assert [r[0] for r in ints.select(safe_cast(F.col("stock"), "int")).collect()] == [3, None, -2, None]


def test_header_mismatch_raises(spark, scratch):
    spark.createDataFrame([("a", "b")], "col1 string, col2 string").write.option("header", True).csv(
        f"{scratch}/raw/orders")
    with pytest.raises(lake.HeaderMismatch):
        lake.read_raw(spark, f"{scratch}/raw", "orders")


def test_etl_round_trip_and_rerun(spark, scratch):
    v = Views(spark, SF_SMALL)
    raw, cur = f"{scratch}/raw", f"{scratch}/curated"
    for t in TABLES:
        render_raw(lake_frame(v, t), t).write.option("header", True).option("escape", '"').csv(f"{raw}/{t}")
    ev = lake.run_etl(spark, raw, cur)
    ev2 = lake.run_etl(spark, raw, cur)  # rerun overwrites, never duplicates
    counts = {r.table: r.rows for r in ev.collect()}
    assert counts == {r.table: r.rows for r in ev2.collect()}
    for t in TABLES:
        got = lake.read_curated(spark, cur, t)
        exp = lake_frame(v, t)
        assert got.count() == counts[t] == exp.count()
        assert got.exceptAll(exp).isEmpty() and exp.exceptAll(got).isEmpty(), t
    files = lake.with_source_file(lake.read_curated(spark, cur, "orders"))
    report = quality.verify_curated({"orders": files})
    assert report.where("invalid_status_rows > 0").isEmpty()
    assert quality.check_schema(lake.read_curated(spark, cur, "orders"), TABLES["orders"]) == []


def test_empty_table_is_an_error(spark, scratch):
    spark.createDataFrame([], ", ".join(f"{c} string" for c in TABLES["customers"])).coalesce(1).write.option(
        "header", True).csv(f"{scratch}/raw/customers")
    with pytest.raises(lake.EmptyTable):
        lake.run_etl(spark, f"{scratch}/raw", f"{scratch}/cur")


def test_stable_key_layout(spark):
    import hashlib
    import uuid
    k = spark.range(1).select(stable_key(F.lit("customer"), F.lit("7"))).first()[0]
    b = bytearray(hashlib.sha256(b"customer:7").digest()[:16])
    b[6] = (b[6] & 0x0F) | 0x40
    b[8] = (b[8] & 0x3F) | 0x80
    assert k == str(uuid.UUID(bytes=bytes(b)))
