"""Catalog and order lookups.

All are column expressions, filters, per-key windows with a limit, or joins — the
set-based forms of what the services did one request at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import cents_to_text, money_to_cents

LIST_TEXT_CHARS = 200
DETAIL_TEXT_CHARS = 1000
MAX_CART_LINES = 20
INT_MAX = 2**31 - 1
PLACEHOLDER_ID = "00000000-0000-4000-8000-000000000001"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ------------------------------------------------------------------------------ scalars
def thumbnail_path(path) -> Column:
    """``…-full.EXT`` -> ``…-thumb.EXT``; a thumb path is kept; anything else NULL."""
    p = _c(path)
    return (F.when(p.rlike(r"-thumb\.[^.]+$"), p)
            .when(p.rlike(r"-full\.[^.]+$"), F.regexp_replace(p, r"-full\.([^.]+)$", "-thumb.$1")))


def truncate(text, n: int) -> Column:
    """First ``n`` characters."""
    return F.substring(_c(text), 1, n)


def bind_placeholders(text, product_id: str = PLACEHOLDER_ID, order_id: str = PLACEHOLDER_ID) -> Column:
    """Replace the ``{product_id}`` and ``{order_id}`` literals."""
    t = F.replace(_c(text), F.lit("{product_id}"), F.lit(product_id))
    return F.replace(t, F.lit("{order_id}"), F.lit(order_id))


# ------------------------------------------------------------------------------- search
def search_catalog(products: DataFrame, q: str | None = None, min_price=None, max_price=None,
                   text_cols=("title", "description"), order=("created_at", "product_id")) -> DataFrame:
    """optional case-insensitive literal substring on any text column, inclusive price
    bounds; newest first with the id as tie-break.  ``contains`` on lower-cased text is a
    literal match, so ``%``, ``_`` and ``\\`` in the term need no escaping."""
    df = products
    if q is not None and q.strip():
        term = q.strip().lower()
        cond = None
        for c in text_cols:
            m = F.coalesce(F.lower(F.col(c)).contains(term), F.lit(False))
            cond = m if cond is None else cond | m
        df = df.where(cond)
    if min_price is not None:
        df = df.where(F.col("price") >= F.lit(min_price).cast("decimal(18,2)"))
    if max_price is not None:
        df = df.where(F.col("price") <= F.lit(max_price).cast("decimal(18,2)"))
    created, key = order
    return df.orderBy(F.col(created).desc_nulls_last(), F.col(key).asc_nulls_last())


def product_summary(products: DataFrame) -> DataFrame:
    """F2 summary projection: price text, availability, description cut to 200."""
    cols = [F.col("product_id"), F.col("title"),
            cents_to_text(money_to_cents("price")).alias("price_text"),
            (F.col("stock") > 0).alias("available")]
    if "description" in products.columns:
        cols.append(truncate("description", LIST_TEXT_CHARS).alias("description"))
    return products.select(*cols)


def orders_of(orders: DataFrame, buyers: DataFrame | None = None, status: str | None = None,
              limit: int | None = None, buyer: str = "customer_id", created: str = "order_date",
              key: str = "order_id") -> DataFrame:
    """Each buyer's own orders, newest first (id desc as tie-break); the status
    filter applies before the limit.  ``row_number() <= limit`` lets Spark keep a partial
    top-``limit`` per buyer before the exchange (WindowGroupLimit), so a buyer with a third
    of all orders ships only ``limit`` rows per task."""
    df = orders
    if buyers is not None:
        df = df.join(buyers.select(buyer).distinct(), buyer, "left_semi")
    if status is not None:
        df = df.where(F.col("status") == status)
    if limit is None:
        return df
    w = Window.partitionBy(buyer).orderBy(F.col(created).desc_nulls_last(), F.col(key).desc())
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def clean_search_params(requests: DataFrame, strict: bool = True) -> DataFrame:
    """Search requests (``q, min_price, max_price`` texts) cleaned: the term trimmed,
    empty to NULL, ``valid`` false beyond 100 characters; a price must be digits with at
    most two decimals, ``''`` is none.  ``min > max`` is invalid in the strict form, and
    drops both bounds in the lenient one."""
    price = r"^\d+(\.\d{1,2})?$"
    q = F.nullif(F.trim("q"), F.lit(""))
    low, high = (F.nullif(F.col(c), F.lit("")) for c in ("min_price", "max_price"))
    fits = (F.coalesce(F.length(q), F.lit(0)) <= 100) & F.coalesce(low.rlike(price), F.lit(True)) & F.coalesce(high.rlike(price), F.lit(True))
    lo, hi = (F.when(c.rlike(price), c.try_cast("decimal(18,2)")) for c in (low, high))
    crossed = F.coalesce(lo > hi, F.lit(False))
    rest = [c for c in requests.columns if c not in ("q", "min_price", "max_price")]
    if strict:
        return requests.select(*rest, q.alias("q"), lo.alias("min_price"), hi.alias("max_price"), (fits & ~crossed).alias("valid"))
    return requests.select(*rest, q.alias("q"), F.when(~crossed, lo).alias("min_price"), F.when(~crossed, hi).alias("max_price"),
                           fits.alias("valid"))


def lookup_stock(products: DataFrame, requests: DataFrame) -> DataFrame:
    """``request_id, ids`` (1 to 10) -> a row for every id in its place; an unknown id
    has ``found`` and ``available`` false and no stock."""
    ids = requests.where(F.size("ids").between(1, 10)).select("request_id", F.posexplode("ids").alias("place", "product_id"))
    p = products.select("product_id", "stock", F.lit(True).alias("seen"))
    return ids.join(p, "product_id", "left").select(
        "request_id", "place", "product_id", F.coalesce("seen", F.lit(False)).alias("found"), "stock",
        F.coalesce(F.col("stock") > 0, F.lit(False)).alias("available"))


def order_detail(orders: DataFrame, items: DataFrame, requests: DataFrame) -> DataFrame:
    """a row for every line of each requested order (``order_id, buyer``) that is the
    buyer's own: title, quantity and unit price text; other orders give no row."""
    own = requests.join(orders.select("order_id", F.col("customer_id").alias("buyer"), "status"), ["order_id", "buyer"])
    return own.join(items, "order_id").select("order_id", "status", "product_id", "title", "quantity",
                                              cents_to_text("unit_amount").alias("unit_price_text"))


def due_jobs(queue: DataFrame, now, k: int, due: str = "next_attempt_at", order=("next_attempt_at",),
             processed: str | None = "processed_at") -> DataFrame:
    """unprocessed jobs due at ``now``, first ``k`` in queue order (TakeOrdered)."""
    df = queue.where(F.col(due) <= F.lit(now).cast(dict(queue.dtypes)[due]))
    if processed is not None and processed in queue.columns:
        df = df.where(F.col(processed).isNull())
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in order]).limit(k)


# ------------------------------------------------------------------------ nested (A*)
def order_total(items, product_amount=None, quantity=None) -> Column:
    """A1: items present -> Σ unitAmount × quantity (an empty array is 0); else the single
    product snapshot's unitAmount × quantity; else NULL."""
    it = _c(items)
    total = F.aggregate(it, F.lit(0).cast("long"),
                        lambda acc, x: acc + x["unitAmount"].cast("long") * x["quantity"].cast("long"))
    single = (_c(product_amount).cast("long") * _c(quantity).cast("long")) if product_amount is not None else F.lit(None)
    return F.when(it.isNotNull(), total).otherwise(single)


def items_count(items, quantity=None) -> Column:
    """A2: Σ quantity over items; if that is 0 or items is NULL, the single quantity or 0."""
    s = F.aggregate(_c(items), F.lit(0).cast("long"), lambda acc, x: acc + x["quantity"].cast("long"))
    q = _c(quantity).cast("long") if quantity is not None else F.lit(None).cast("long")
    return F.coalesce(F.nullif(s, F.lit(0)), q, F.lit(0).cast("long"))


def same_items(a, b, product: str = "productId") -> Column:
    """A3: multiset equality on (productId, quantity), order ignored."""
    def norm(x):
        return F.array_sort(F.transform(_c(x), lambda i: F.struct(i[product].alias("p"), i["quantity"].alias("q"))))
    return norm(a) == norm(b)


def valid_cart(items) -> Column:
    """A5: 1…20 lines, quantity 1…2^31-1, product ids unique."""
    it = _c(items)
    return (F.size(it).between(1, MAX_CART_LINES)
            & F.forall(it, lambda i: i["quantity"].between(1, INT_MAX))
            & (F.size(F.array_distinct(F.transform(it, lambda i: i["productId"]))) == F.size(it)))


def changed(old, new) -> Column:
    """Null-safe document inequality (``IS DISTINCT FROM`` on structs)."""
    return ~_c(old).eqNullSafe(_c(new))


# -------------------------------------------------------------------------- J8 / O4
def keyed_diff(remote: DataFrame, local: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """What makes ``remote`` equal to ``local``, by key: ``create`` (only local),
    ``delete`` (only remote), ``update`` (document differs, NULL-safe), ``same``."""
    r = remote.select(F.col(key), F.struct(*cols).alias("r_doc"), F.lit(True).alias("r_seen"))
    lo = local.select(F.col(key), F.struct(*cols).alias("l_doc"), F.lit(True).alias("l_seen"))
    j = r.join(lo, key, "full")
    action = (F.when(F.col("r_seen").isNull(), "create").when(F.col("l_seen").isNull(), "delete")
              .when(changed("r_doc", "l_doc"), "update").otherwise("same"))
    return j.select(key, action.alias("action"))


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    """Set union."""
    return a.unionByName(b).distinct()
