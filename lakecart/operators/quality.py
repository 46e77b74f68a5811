"""Data-quality checks and contracts.

Every check returns a DataFrame of findings (or counts), so a gate is a plain filter or
an ``isEmpty()`` probe; nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normalize import STATUS_VALUES, UNKNOWN
from ..plans.mart import stock_band


def verify_curated(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows per table (and per source file when a ``source_file`` column is present),
    plus, for orders, the rows whose status is NULL or outside the domain + ``unknown``.
    The per-table aggregates are stacked with ``unionByName`` (O3)."""
    parts = []
    allowed = list(STATUS_VALUES["orders"]) + [UNKNOWN]
    for name, df in frames.items():
        keys = ["source_file"] if "source_file" in df.columns else []
        if name == "orders":
            invalid = F.count_if(F.col("status").isNull() | ~F.col("status").isin(*allowed))
        else:
            invalid = F.lit(0).cast("bigint")
        agg = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"), invalid.alias("invalid_status_rows"))
        parts.append(agg.select(F.lit(name).alias("table_name"), *keys, "row_count", "invalid_status_rows"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def reconcile_counts(raw: dict[str, DataFrame], curated: dict[str, DataFrame]) -> DataFrame:
    """Rows per table before and after; a table missing on either side shows NULL."""
    def counts(frames, col):
        return reduce(lambda a, b: a.unionByName(b), [
            df.agg(F.count(F.lit(1)).alias(col)).select(F.lit(n).alias("table_name"), col)
            for n, df in frames.items()])
    r = counts(raw, "raw_rows")
    c = counts(curated, "curated_rows")
    return r.join(c, "table_name", "full").select(
        "table_name", "raw_rows", "curated_rows",
        F.coalesce(F.col("raw_rows") == F.col("curated_rows"), F.lit(False)).alias("equal"))


def check_schema(df: DataFrame, required: dict[str, str]) -> list[str]:
    """D3: problems with a frame's schema (metadata only): missing columns or wrong types."""
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    problems = []
    for col, typ in required.items():
        if col not in actual:
            problems.append(f"missing column {col}")
        elif actual[col] != T._parse_datatype_string(typ).simpleString():
            problems.append(f"column {col} is {actual[col]}, expected {typ}")
    return problems


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, rule: str) -> DataFrame:
    """One referential rule: distinct child keys without a parent.  Keys of both sides meet in
    one aggregate, combined before the exchange, so a hot key is shuffled once per task and a
    task holds one table of its distinct keys: no side is sorted for a join."""
    keys = child.select(F.col(child_key).alias("key"), F.lit(False).alias("parent"))
    kind = keys.schema["key"].dataType
    # a parent key outside the children's type is no child's parent
    par = parent.select(F.col(parent_key).try_cast(kind).alias("key"), F.lit(True).alias("parent"))
    found = keys.unionByName(par).where(F.col("key").isNotNull()).groupBy("key").agg(F.bool_or("parent").alias("found"))
    return found.where(~F.col("found")).select(F.lit(rule).alias("rule"), F.col("key").cast("string").alias("key"))


def foreign_keys(rules: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Orphans of every rule ``(name, child, child_key, parent, parent_key)``."""
    return reduce(lambda a, b: a.unionByName(b), [orphans(c, ck, p, pk, n) for n, c, ck, p, pk in rules])


def total_vs_lines(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Orders whose total differs from the sum of their line totals (NULL totals are
    not checked).  Lines are summed per order before the join (partial aggregation)."""
    lines = items.groupBy("order_id").agg(F.sum("line_total").cast("decimal(38,2)").alias("lines_total"),
                                          F.count(F.lit(1)).alias("lines"))
    o = orders.where(F.col("total_amount").isNotNull()).select("order_id", "total_amount")
    j = o.join(lines, "order_id", "left")
    diff = (F.col("total_amount") - F.coalesce("lines_total", F.lit(0))).cast("decimal(38,2)")
    return j.select("order_id", "total_amount", "lines_total", F.coalesce("lines", F.lit(0)).alias("lines"),
                    diff.alias("difference")).where(F.col("difference") != 0)


def stock_arithmetic(inventory: DataFrame, products: DataFrame) -> DataFrame:
    """available = on_hand - reserved, no negative quantities, and the product's
    stock status equal to its band (N8).  One row per rule with the number of violations."""
    inv = inventory.agg(
        F.count_if(F.col("quantity_available") != F.col("quantity_on_hand") - F.col("quantity_reserved")).alias("a"),
        F.count_if((F.col("quantity_on_hand") < 0) | (F.col("quantity_reserved") < 0)).alias("b"),
        F.count(F.lit(1)).alias("n1"))
    prod = products.agg(F.count_if(~F.col("stock_status").eqNullSafe(stock_band("stock"))).alias("c"),
                        F.count(F.lit(1)).alias("n2"))
    rows = [
        inv.select(F.lit("available_is_on_hand_minus_reserved").alias("rule"), F.col("a").alias("violations"),
                   F.col("n1").alias("checked")),
        inv.select(F.lit("quantities_not_negative").alias("rule"), F.col("b").alias("violations"),
                   F.col("n1").alias("checked")),
        prod.select(F.lit("stock_status_matches_band").alias("rule"), F.col("c").alias("violations"),
                    F.col("n2").alias("checked")),
    ]
    return reduce(lambda a, b: a.unionByName(b), rows)


def unique_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Business keys held by more than one row, with their multiplicity."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


# ------------------------------------------------------------------ contract rules
UUID_RE = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
INT_MAX = 2**31 - 1


def _errors(rules) -> F.Column:
    return F.filter(F.array(*[F.when(c, F.lit(name)) for c, name in rules]), lambda x: x.isNotNull())


def _strip(c: str) -> F.Column:
    return F.regexp_replace(F.col(c), r"^\s+|\s+$", "")


def validate_products(df: DataFrame) -> DataFrame:
    """Product form rows (all text) with the list of failed rules: title 1…160 and
    description 1…5000 characters after trimming; price text with at most two decimals
    in 2…999 999.99; stock integer text in 0…2^31-1."""
    title, desc, price, stock = _strip("title"), _strip("description"), _strip("price"), _strip("stock")
    price_ok = price.rlike(r"^\d+(?:\.\d{1,2})?$") & price.try_cast("decimal(20,2)").between(2, 999999.99)
    stock_ok = stock.rlike(r"^\d+$") & stock.try_cast("decimal(38,0)").between(0, INT_MAX)
    rules = [
        (~F.coalesce(F.length(title).between(1, 160), F.lit(False)), "title"),
        (~F.coalesce(F.length(desc).between(1, 5000), F.lit(False)), "description"),
        (~F.coalesce(price_ok, F.lit(False)), "price"),
        (~F.coalesce(stock_ok, F.lit(False)), "stock"),
    ]
    return df.withColumn("errors", _errors(rules))


def validate_stock_batch(df: DataFrame) -> DataFrame:
    """Stock batch rows (``operation_id``, ``adjustments`` array of
    struct(productId, delta)) with failed rules: id 1…100 characters; 1…20 lines; each
    delta a non-zero integer within ±(2^31-1); product ids valid and unique."""
    adj = F.col("adjustments")
    rules = [
        (~F.coalesce(F.length("operation_id").between(1, 100), F.lit(False)), "operation_id"),
        (~F.coalesce(F.size(adj).between(1, 20), F.lit(False)), "lines"),
        (~F.coalesce(F.forall(adj, lambda a: (a["delta"] != 0) & a["delta"].between(-INT_MAX, INT_MAX)),
                     F.lit(False)), "delta"),
        (~F.coalesce(F.forall(adj, lambda a: a["productId"].rlike(UUID_RE)), F.lit(False)), "product_id"),
        (~F.coalesce(F.size(F.array_distinct(F.transform(adj, lambda a: a["productId"]))) == F.size(adj),
                     F.lit(False)), "duplicate_product"),
    ]
    return df.withColumn("errors", _errors(rules))
