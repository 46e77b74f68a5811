"""Rules that a first version had wrong: failed order requests, topics over several lines,
sales without an amount."""

from pyspark.sql import functions as F

from lakecart.operators import checkout, domain, payments


def test_a_request_that_created_nothing_is_not_remembered(spark):
    item = "array<struct<product_id:long,quantity:long>>"
    rows = [(1, "a", "x", [(9, 1)]), (2, "a", "y", [(1, 1)]), (3, "a", "y", [(1, 1)]), (4, "a", "x", [(9, 1)]),  # 9 has no price
            (5, "b", "x", [(9, 1)]), (6, "b", "x", [(9, 1)]), (7, "c", "x", [(1, 10**7)]), (8, "c", "x", [(1, 2), (2, 1)]), (9, "c", "x", [(2, 1), (1, 2)]),
            (10, "d", None, [(1, 1)]), (11, "d", None, [(1, 1)]), (12, "e", "x", []), (13, "f", "x", None)]
    requests = spark.createDataFrame(rows, f"request_id long, order_id string, buyer string, items {item}")
    prices = spark.createDataFrame([(1, 500), (2, 300)], "product_id long, unit_amount long")
    got = {r.request_id: (r.decision, r.total) for r in checkout.create_orders(requests, prices).collect()}
    none = ("price_unavailable", None)
    assert got == {1: none, 2: ("created", 500), 3: ("existing", None), 4: ("conflict", None), 5: none, 6: none, 7: ("amount_invalid", None),
                   8: ("created", 1300), 9: ("existing", None), 10: ("created", 500), 11: ("existing", None), 12: none, 13: none}


def test_wares_are_looked_for_in_one_line(spark):
    texts = ["busco zapatillas\npara la tarea, un libro", "busco para la tarea un libro", "pagoß", "Tarea٣ de hoy"]
    turns = spark.createDataFrame([(i, 0, "human", t) for i, t in enumerate(texts)], "conv_id long, turn long, type string, text string")
    got = {r.conv_id: r.category for r in domain.classify_domain(turns).collect()}
    assert got == {0: "fuera_de_dominio", 1: "productos", 2: "pagos_envios", 3: "fuera_de_dominio"}


def test_a_sale_without_amount_and_currency_is_a_sale(spark):
    orders = spark.createDataFrame([(1, "confirmed", None, None), (2, "confirmed", 5, "PEN"), (4, "confirmed", 5, "PEN")],
                                   "order_id long, status string, total_amount int, currency string").withColumn("total_amount", F.col("total_amount").cast("decimal(18,2)"))
    paid = spark.createDataFrame([(1, 5, "PEN", "succeeded"), (3, 5, "PEN", "succeeded"), (2, None, "PEN", "succeeded")],
                                 "order_id long, amount int, currency string, status string").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    got = {r.order_id: r.reason for r in payments.payment_reconciliation(orders, paid).collect()}
    assert got == {1: "amount_mismatch", 2: "amount_mismatch", 3: "payment_without_sale", 4: "missing_payment"}
