"""What a task has to hold: plans without the tables and sorts that grew with the input."""

import re
from decimal import Decimal

from lakecart.operators import quality
from lakecart.plans import mart


def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def _sales(spark):
    items = spark.createDataFrame(
        [(1, 7, 2, Decimal("1.50")), (1, 7, 3, None), (1, 8, 1, Decimal("4.00")), (2, 7, 1, Decimal("2.00")), (3, 7, 9, Decimal("9.00")),
         (4, 7, 5, Decimal("0.10")), (1, None, 1, Decimal("5.00")), (2, 9, 1, Decimal("5.00")), (2, 8, 1, None), (1, 7, 1, Decimal("1.50"))],
        "order_id long, product_id long, quantity int, line_total decimal(18,2)")
    orders = spark.createDataFrame([(1, "confirmed", "PEN"), (2, "shipped", "PEN"), (3, "rejected", "PEN"), (4, "confirmed", "USD")],
                                   "order_id long, status string, currency string")
    products = spark.createDataFrame([(7, "a", None, Decimal("1.00"), "PEN"), (8, "b", "c", None, "PEN")],
                                     "product_id long, title string, category string, price decimal(18,2), currency string")
    return items, orders, products


def test_product_sales_counts_orders_without_a_table_of_them(spark):
    sold = mart.product_sales(*_sales(spark))
    got = {(r.product_id, r.sales_currency): (r.order_count, r.units_sold, r.item_count, r.items_with_amount, r.product_sales_amount)
           for r in sold.collect()}
    assert got == {(7, "PEN"): (2, 7, 4, 3, Decimal("5.00")), (7, "USD"): (1, 5, 1, 1, Decimal("0.10")),
                   (8, "PEN"): (2, 2, 2, 1, Decimal("4.00"))}
    keys = re.findall(r"Aggregate\(keys?=\[([^\]]*)\]", _plan(sold))
    assert keys and not any("order_id" in k for k in keys)


def test_foreign_keys_meet_in_one_aggregate(spark):
    child = spark.createDataFrame([(1,), (1,), (2,), (3,), (3,), (None,)], "k int")
    parent = spark.createDataFrame([(1,), (2**32 + 3,), (None,), (9,), (9,)], "p long")
    found = quality.foreign_keys([("a", child, "k", parent, "p"), ("b", parent, "p", child, "k")])
    assert sorted(map(tuple, found.collect())) == [("a", "2"), ("a", "3"), ("b", "4294967299"), ("b", "9")]
    assert not re.search(r"Join|\bSort\b", _plan(found))
