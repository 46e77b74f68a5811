"""Catalogue search for a table of requests (F2).

No request meets a product it doesn't need:

* Grams of one to six characters of the searched fields are an index (gram -> product), of
  which only asked grams are kept.  Terms of up to six characters are grams themselves, so the
  index holds their matches.  A longer term contains its rarest gram: an equi-join on that
  gram gives all products that can match, the exact substring test follows.  Requests with
  the same term share the work.
* Prices are the leaves of a tree with sixteen branches to a node.  For each term every
  node knows how many of its products match and the newest of them.  A price range is a
  few nodes of each level; joining on (term, node) gives the total, which no limit cuts,
  and the newest products.  A request's work doesn't grow with its matches.

Joins of exploded rows are sort-merge joins: the planner takes an exploded array for one
element, and would send tables of grams or nodes whole to the driver to broadcast them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import money_to_cents
from ..session import materialize
from .catalog import product_summary

GRAM = 6
MAX_LIMIT, DEFAULT_LIMIT = 10, 5
MAX_TERM = 100
BRANCH_BITS = 4
#: The node of all products, priced or not: requests without a price bound.
ROOT = -1


def _grams(text: Column, longest: int = GRAM) -> Column:
    """Distinct substrings of 1 to ``longest`` characters."""
    def of(n: int) -> Column:
        return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1),
                                                       lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of(n) for n in range(1, longest + 1)]))


def term_matches(products: DataFrame, terms: DataFrame, fields: tuple[str, ...] = ("title", "description")) -> DataFrame:
    """``term, product_id`` for every product whose fields contain the (lower-cased) term.

    ``terms``: ``term``, distinct and not empty.
    """
    grams = terms.select("term", F.when(F.length("term") <= GRAM, F.array("term"))
                         .otherwise(F.filter(_grams(F.col("term")), lambda g: F.length(g) == GRAM)).alias("grams"))
    asked = grams.select("term", F.explode("grams").alias("gram"))
    lowered = [F.coalesce(F.lower(F.col(f)), F.lit("")) for f in fields]
    index = (products.select("product_id", F.explode(F.array_distinct(F.concat(*[_grams(t) for t in lowered]))).alias("gram"))
             .join(asked.select("gram").distinct().hint("merge"), "gram", "left_semi"))
    index = materialize(index, "search-grams")
    sizes = index.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = (asked.join(sizes.hint("merge"), "gram", "left").groupBy("term")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).select("term", "r.gram"))
    found = rarest.join(index.hint("merge"), "gram").select("term", "product_id")
    short = F.length("term") <= GRAM
    text = products.select("product_id", *[t.alias(f"_f{i}") for i, t in enumerate(lowered)])
    holds = None
    for i in range(len(fields)):
        c = F.contains(F.col(f"_f{i}"), F.col("term"))
        holds = c if holds is None else holds | c
    held = found.where(~short).join(text.hint("merge"), "product_id").where(holds)
    return found.where(short).unionByName(held.select("term", "product_id"))


def _range_nodes(low: Column, high: Column, levels: int) -> Column:
    """Nodes ``(level, node)`` that make up the leaves ``low`` to ``high``."""
    def named(level: int):
        return lambda n: F.struct(F.lit(level).alias("level"), n.alias("node"))

    parts = []
    for level in range(levels):
        size, up = 1 << (BRANCH_BITS * level), 1 << (BRANCH_BITS * (level + 1))
        first, end = F.ceil(low / F.lit(size)), F.floor((high + 1) / F.lit(size))
        if level == levels - 1:
            spans = [(first, end)]
        else:  # blocks of the next level take the middle
            inner, outer = F.ceil(low / F.lit(up)) * (1 << BRANCH_BITS), F.floor((high + 1) / F.lit(up)) * (1 << BRANCH_BITS)
            spans = [(first, F.when(inner < outer, inner).otherwise(end)), (F.when(inner < outer, outer).otherwise(end), end)]
        for a, b in spans:
            nodes = F.when(a < b, F.sequence(a.cast("long"), b.cast("long") - 1)).otherwise(F.array().cast("array<long>"))
            parts.append(F.transform(nodes, named(level)))
    return F.concat(*parts)


def search_many(products: DataFrame, requests: DataFrame, created: str = "created_at",
                fields: tuple[str, ...] = ("title", "description")) -> DataFrame:
    """``request_id, total, place, product_id, title, price_text, available,
    description, error`` for every request: its newest products (``place`` from 1, at most
    ``limit``; equal dates by id) and how many match in all.

    ``requests``: ``request_id, q, min_price, max_price, limit``.  ``q`` is a literal
    substring of a field, without regard to case; blank: all products.  Price bounds are
    inclusive; products without a price only match requests without bounds.  A NULL limit
    is 5.  A request without matches has one row with total 0.  One with ``min_price`` above
    ``max_price``, a limit outside 1 to 10 or a term of more than 100 characters has one
    row with ``error`` and no total.
    """
    r = requests.select("request_id", F.lower(F.trim(F.coalesce("q", F.lit("")))).alias("term"),
                        F.col("min_price").cast("decimal(18,2)").alias("low"), F.col("max_price").cast("decimal(18,2)").alias("high"),
                        F.coalesce(F.col("limit"), F.lit(DEFAULT_LIMIT)).alias("limit"))
    bad = F.coalesce(F.col("low") > F.col("high"), F.lit(False)) | ~F.col("limit").between(1, MAX_LIMIT) | (F.length("term") > MAX_TERM)
    r = r.withColumn("error", F.when(bad, "invalid_filters"))
    good = r.where(F.col("error").isNull())

    cents = money_to_cents("price")
    bounds = products.agg(F.min(cents).alias("low"), F.max(cents).alias("high")).first()
    base, top = bounds["low"] or 0, bounds["high"] or 0
    levels = max(1, -(-max(1, (top - base).bit_length()) // BRANCH_BITS))
    terms = good.where("term <> ''").select("term").distinct()
    matches = term_matches(products, terms, fields).unionByName(
        products.select(F.lit("").alias("term"), "product_id"))  # the blank term matches all
    keyed = matches.join(products.select("product_id", F.col(created).alias("created"), (cents - base).alias("leaf")).hint("merge"), "product_id")
    at = F.array(F.struct(F.lit(ROOT).alias("level"), F.lit(0).cast("long").alias("node")),
                 *[F.struct(F.lit(k).alias("level"), F.floor(F.col("leaf") / F.lit(1 << (BRANCH_BITS * k))).cast("long").alias("node"))
                   for k in range(levels)])
    # only nodes that a request asks for are kept
    low = F.coalesce(money_to_cents("low") - base, F.lit(0))
    high = F.coalesce(money_to_cents("high") - base, F.lit(top - base))
    whole = F.col("low").isNull() & F.col("high").isNull()
    nodes = F.when(whole, F.array(F.struct(F.lit(ROOT).alias("level"), F.lit(0).cast("long").alias("node")))).otherwise(
        _range_nodes(F.greatest(low, F.lit(0)), F.least(high, F.lit(top - base)), levels))
    wanted = good.select("request_id", "term", "limit", F.explode(nodes).alias("x")).select("request_id", "term", "limit", "x.level", "x.node")
    placed = (keyed.select("term", "product_id", "created", F.explode(at).alias("x")).where(F.col("x.node").isNotNull())
              .select("term", "product_id", "created", "x.level", "x.node")
              .join(wanted.select("term", "level", "node").distinct().hint("merge"), ["term", "level", "node"], "left_semi"))
    node = ("term", "level", "node")
    totals = (wanted.join(placed.groupBy(*node).agg(F.count("*").alias("n")).hint("merge"), list(node))
              .groupBy("request_id").agg(F.sum("n").alias("total")))
    newest = (F.col("created").desc_nulls_last(), F.col("product_id").asc())
    heads = (placed.withColumn("r", F.row_number().over(Window.partitionBy(*node).orderBy(*newest))).where(F.col("r") <= MAX_LIMIT).drop("r"))
    shown = (wanted.join(heads.hint("merge"), list(node))
             .withColumn("place", F.row_number().over(Window.partitionBy("request_id").orderBy(*newest)))
             .where(F.col("place") <= F.col("limit")).select("request_id", "place", "product_id"))
    listed = shown.join(product_summary(products).hint("merge"), "product_id")
    columns = ["place", "product_id", "title", "price_text", "available", "description"]
    return (r.select("request_id", "error").join(totals.hint("merge"), "request_id", "left").join(listed.hint("merge"), "request_id", "left")
            .select("request_id", F.when(F.col("error").isNull(), F.coalesce("total", F.lit(0))).alias("total"), *columns, "error"))


