"""Carts as rows ``owner, product_id, quantity, unit_amount, line``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .catalog import INT_MAX, MAX_CART_LINES
from .checkout import MAX_CENTS, MIN_CENTS


def merge_carts(saved: DataFrame, guest: DataFrame, locked: DataFrame) -> DataFrame:
    """Saved lines first, then guest lines; quantities of a product are added up to the
    largest int; products after the 20th line are left out.  Owners in ``locked`` (an open
    checkout) keep their saved cart."""
    open_guests = guest.join(locked.select("owner"), "owner", "left_anti")
    both = saved.withColumn("side", F.lit(0)).unionByName(open_guests.withColumn("side", F.lit(1)))
    first = F.min(F.struct("side", "line"))
    merged = both.groupBy("owner", "product_id").agg(
        F.least(F.sum("quantity"), F.lit(INT_MAX)).cast("bigint").alias("quantity"), first.alias("at"))
    line = F.row_number().over(Window.partitionBy("owner").orderBy("at", "product_id"))
    return merged.withColumn("line", line).where(F.col("line") <= MAX_CART_LINES).select("owner", "product_id", "quantity", "line")


def cart_after_order(cart: DataFrame, bought: DataFrame) -> DataFrame:
    """A10: the cart without what its own order bought (``owner, product_id, quantity``);
    lines that fall to zero go."""
    b = bought.groupBy("owner", "product_id").agg(F.sum("quantity").alias("bought"))
    left = F.col("quantity") - F.coalesce("bought", F.lit(0))
    return cart.join(b, ["owner", "product_id"], "left").select("owner", "product_id", left.alias("quantity")).where("quantity > 0")


def cart_totals(cart: DataFrame, stored: DataFrame) -> DataFrame:
    """Units and cents of each cart; a stored order total (``owner, total``) wins."""
    sums = cart.groupBy("owner").agg(F.sum("quantity").cast("bigint").alias("units"),
                                     F.sum(F.col("quantity") * F.col("unit_amount")).cast("bigint").alias("summed"))
    return sums.join(stored, "owner", "left").select("owner", "units", F.coalesce("total", "summed").alias("amount"))


def checkout_amount(reserved: Column, priced: Column) -> Column:
    """A4: ``struct(amount, reason)`` of reserved lines (product, quantity) against priced
    lines (product, quantity, unit_amount): both must have the same products and
    quantities at the same places and valid prices (else ``polar_price_unavailable``), and
    the total must lie within the provider's bounds (else ``polar_amount_invalid``)."""
    pairs = F.zip_with(reserved, priced, lambda r, p: F.coalesce(
        (r["product_id"] == p["product_id"]) & (r["quantity"] == p["quantity"])
        & p["unit_amount"].between(MIN_CENTS, MAX_CENTS), F.lit(False)))
    fits = F.coalesce((F.size(reserved) == F.size(priced)) & (F.size(priced) > 0) & F.forall(pairs, lambda x: x), F.lit(False))
    total = F.aggregate(priced, F.lit(0).cast("bigint"), lambda t, p: t + (p["unit_amount"] * p["quantity"]).cast("bigint"))
    reason = F.when(~fits, "polar_price_unavailable").when(~total.between(MIN_CENTS, MAX_CENTS), "polar_amount_invalid")
    return F.struct(F.when(reason.isNull(), total).alias("amount"), reason.alias("reason"))
