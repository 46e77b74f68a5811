"""Exact decimal money.

Money is ``decimal(18,2)``; sums are widened to ``decimal(38,2)``.  Averages are rounded
HALF_UP to cents from the exact integer quotient, so the result never depends on an
intermediate rounding step (Spark's own ``avg`` rounds to 6 places first).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
MONEY_SUM = "decimal(38,2)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c) -> Column:
    return _c(c).cast(MONEY)


def sum_money(c) -> Column:
    return F.sum(_c(c)).cast(MONEY_SUM)


def idiv(a: Column, b: Column) -> Column:
    """Integral division (SQL ``a div b``), exact on bigints."""
    return F.call_function("div", a, b)


def half_up_cents(cents: Column, n: Column) -> Column:
    """round(cents / n) HALF_UP (away from zero) as decimal(18,2) money; NULL when n = 0.
    Whole-number arithmetic in ``decimal(38,0)``, so sums of any column of money fit."""
    whole = "decimal(38,0)"
    c, k = cents.cast(whole), F.nullif(n.cast(whole), F.lit(0).cast(whole))
    twice = (F.abs(c) * 2).cast(whole) + k
    step = (k * 2).cast(whole)
    q = ((twice - twice % step).cast(whole) / step).cast("decimal(30,0)")
    return F.when(n > 0, (F.when(c < 0, -q).otherwise(q) * F.lit(Decimal("0.01"))).cast(MONEY))


def avg_money(c) -> Column:
    """HALF_UP average to cents; NULL for an empty group."""
    col = _c(c)
    return half_up_cents((F.sum(col) * 100).cast("decimal(38,0)"), F.count(col))


def half_up_sql(cents: str, n: str) -> str:
    """SQL text of :func:`half_up_cents` (DuckDB and Spark SQL)."""
    return (f"CAST(CAST(CASE WHEN ({cents}) >= 0 THEN (2 * ({cents}) + ({n})) // (2 * nullif({n}, 0)) "
            f"ELSE -((-2 * ({cents}) + ({n})) // (2 * nullif({n}, 0))) END AS DECIMAL(20,0)) * 0.01 AS DECIMAL(18,2))")


def avg_money_sql(x: str) -> str:
    """SQL text of :func:`avg_money`."""
    return half_up_sql(f"CAST(sum({x}) * 100 AS BIGINT)", f"count({x})")


def sum_money_sql(x: str) -> str:
    return f"CAST(sum({x}) AS DECIMAL(38,2))"


def cents_to_text(cents) -> Column:
    """Integer cents -> text with two decimals (``1999`` -> ``'19.99'``); NULL stays NULL."""
    return (_c(cents).cast("decimal(20,0)") / 100).cast("decimal(20,2)").cast("string")


def money_to_cents(price) -> Column:
    """``round(price * 100)`` as bigint (HALF_UP, as PostgreSQL rounds numerics)."""
    return F.round(_c(price).cast("decimal(20,4)") * 100, 0).cast("bigint")
