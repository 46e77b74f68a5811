"""Registered lookup, cart, catalogue-sync and evaluation queries, with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import carts, catalog, evals, sync
from ..registry import register
from .views import Views, sql_ctes

NOW = "1998-01-01 00:00:00"
SERVER = "sandbox"


# ------------------------------------------------------------------------------ lookups
@register("n15_clean_search_params", """SELECT order_key, q, min_price, max_price,
  length(coalesce(q, '')) <= 100 AND lo_ok AND hi_ok AND NOT coalesce(min_price > max_price, false) AS valid
FROM (SELECT o_orderkey AS order_key, nullif(trim(o_orderpriority, ' '), '') AS q, lo_ok, hi_ok,
    CASE WHEN lo_ok THEN TRY_CAST(nullif(lo, '') AS DECIMAL(18,2)) END AS min_price,
    CASE WHEN hi_ok THEN TRY_CAST(nullif(hi, '') AS DECIMAL(18,2)) END AS max_price
  FROM (SELECT o_orderkey, o_orderpriority, lo, hi, coalesce(regexp_full_match(nullif(lo, ''), '\\d+(\\.\\d{1,2})?'), true) AS lo_ok,
      coalesce(regexp_full_match(nullif(hi, ''), '\\d+(\\.\\d{1,2})?'), true) AS hi_ok
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '  ' ELSE ' ' || o_orderpriority || ' ' END AS o_orderpriority,
        CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN CAST(o_orderkey AS VARCHAR) WHEN 2 THEN '12.345' ELSE '100.5' END AS lo,
        CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '-3' ELSE '900' END AS hi FROM orders)))""")
def n15(spark, sf_dir):
    k = F.col("o_orderkey")
    r = Views(spark, sf_dir).orders.select(
        k.alias("order_key"), F.when(k % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit(" "))).alias("q"),
        F.when(k % 4 == 0, "").when(k % 4 == 1, k.cast("string")).when(k % 4 == 2, "12.345").otherwise("100.5").alias("min_price"),
        F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, "-3").otherwise("900").alias("max_price"))
    return catalog.clean_search_params(r)


@register("f3_lookup_stock", sql_ctes("""SELECT r.request_id, CAST(r.place AS INTEGER) AS place, r.product_id, p.product_id IS NOT NULL AS found,
  p.stock, coalesce(p.stock > 0, false) AS available
FROM (SELECT order_id AS request_id, product_id + CASE WHEN product_id % 9 = 0 THEN 10000000 ELSE 0 END AS product_id,
    row_number() OVER (PARTITION BY order_id ORDER BY product_id) - 1 AS place, count(*) OVER (PARTITION BY order_id) AS n
  FROM (SELECT DISTINCT order_id, product_id FROM v_order_items)) r
LEFT JOIN v_products p ON p.product_id = r.product_id WHERE n <= 10""", ["v_order_items", "v_products"]))
def f3(spark, sf_dir):
    v = Views(spark, sf_dir)
    ids = v.v_order_items.groupBy(F.col("order_id").alias("request_id")).agg(F.sort_array(F.collect_set("product_id")).alias("ids"))
    ids = ids.withColumn("ids", F.transform("ids", lambda i: i + F.when(i % 9 == 0, 10000000).otherwise(0)))
    return catalog.lookup_stock(v.v_products, ids)


@register("f5_order_detail", sql_ctes("""SELECT o.order_id, o.status, i.product_id, p.title, i.quantity,
  CAST(CAST(round(p.price * 100) / 100 AS DECIMAL(20,2)) AS VARCHAR) AS unit_price_text
FROM v_orders o JOIN v_order_items i ON i.order_id = o.order_id JOIN v_products p ON p.product_id = i.product_id
WHERE o.order_id % 5 <> 0""", ["v_orders", "v_order_items", "v_products"]))
def f5(spark, sf_dir):
    v = Views(spark, sf_dir)
    k = F.col("order_id")
    requests = v.v_orders.select("order_id", (F.col("customer_id") + F.when(k % 5 == 0, 1).otherwise(0)).alias("buyer"))
    items = v.v_order_items.join(v.v_products.select("product_id", "title", (F.col("price") * 100).cast("bigint").alias("unit_amount")),
                                 "product_id")
    return catalog.order_detail(v.v_orders, items, requests)


# -------------------------------------------------------------------------------- carts
_CARTS = (("saved", """SELECT customer_id AS owner, product_id, quantity, line, unit_amount FROM cart_lines WHERE order_id % 2 = 0"""),
          ("guest", """SELECT customer_id AS owner, product_id, quantity, line, unit_amount FROM cart_lines WHERE order_id % 2 = 1"""))
_CART_LINES = ("cart_lines", """SELECT o.customer_id, i.order_id, i.product_id, CAST(sum(i.quantity) AS BIGINT) AS quantity,
    i.order_id * 100 + i.product_id % 100 AS line, CAST(max(p.price) * 100 AS BIGINT) AS unit_amount
  FROM v_order_items i JOIN v_orders o ON o.order_id = i.order_id JOIN v_products p ON p.product_id = i.product_id
  GROUP BY o.customer_id, i.order_id, i.product_id""")
_ALL_LINES = ("all_lines", "SELECT customer_id AS owner, product_id, quantity, line, unit_amount FROM cart_lines")
_CART_VIEWS = ["v_orders", "v_order_items", "v_products"]


def _cart_lines(spark, sf_dir):
    v = Views(spark, sf_dir)
    x = (v.v_order_items.groupBy("order_id", "product_id").agg(F.sum("quantity").alias("quantity"))
         .join(v.v_orders.select("order_id", F.col("customer_id").alias("owner")), "order_id")
         .join(v.v_products.select("product_id", (F.col("price") * 100).cast("bigint").alias("unit_amount")), "product_id"))
    return x.withColumn("line", F.col("order_id") * 100 + F.col("product_id") % 100)


@register("a9_merge_carts", sql_ctes("""SELECT owner, product_id, quantity, CAST(line AS INTEGER) AS line FROM (
  SELECT owner, product_id, quantity, row_number() OVER (PARTITION BY owner ORDER BY spot, product_id) AS line FROM (
    SELECT owner, product_id, CAST(least(sum(quantity), 2147483647) AS BIGINT) AS quantity, min((side, line)) AS spot FROM (
      SELECT owner, product_id, quantity, 0 AS side, line FROM saved
      UNION ALL SELECT owner, product_id, quantity, 1, line FROM guest WHERE owner % 5 <> 0)
    GROUP BY owner, product_id)) WHERE line <= 20""", _CART_VIEWS, [_CART_LINES, *_CARTS]))
def a9(spark, sf_dir):
    x = _cart_lines(spark, sf_dir)
    columns = ("owner", "product_id", "quantity", "line")
    locked = x.where(F.col("owner") % 5 == 0).select("owner").distinct()
    return carts.merge_carts(x.where("order_id % 2 = 0").select(*columns), x.where("order_id % 2 = 1").select(*columns), locked)


@register("a10_cart_after_order", sql_ctes("""SELECT owner, product_id, quantity FROM (
  SELECT s.owner, s.product_id, CAST(s.quantity - coalesce(b.bought, 0) AS BIGINT) AS quantity FROM (SELECT owner, product_id,
      CAST(sum(quantity) AS BIGINT) AS quantity FROM all_lines GROUP BY owner, product_id) s
    LEFT JOIN (SELECT owner, product_id, sum(quantity) AS bought FROM all_lines WHERE line % 3 = 0 GROUP BY owner, product_id) b
      ON b.owner = s.owner AND b.product_id = s.product_id) WHERE quantity > 0""", _CART_VIEWS, [_CART_LINES, _ALL_LINES]))
def a10(spark, sf_dir):
    x = _cart_lines(spark, sf_dir)
    cart = x.groupBy("owner", "product_id").agg(F.sum("quantity").alias("quantity"))
    return carts.cart_after_order(cart, x.where("line % 3 = 0").select("owner", "product_id", "quantity"))


@register("a13_cart_totals", sql_ctes("""SELECT owner, CAST(sum(quantity) AS BIGINT) AS units,
  CAST(CASE WHEN owner % 4 = 0 THEN owner * 1000 ELSE sum(quantity * unit_amount) END AS BIGINT) AS amount
FROM all_lines GROUP BY owner""", _CART_VIEWS, [_CART_LINES, _ALL_LINES]))
def a13(spark, sf_dir):
    x = _cart_lines(spark, sf_dir)
    stored = x.where("owner % 4 = 0").select("owner", (F.col("owner") * 1000).alias("total")).distinct()
    return carts.cart_totals(x, stored)


@register("a4_checkout_amount", sql_ctes("""SELECT order_id, CASE WHEN reason IS NULL THEN total END AS amount, reason FROM (
  SELECT order_id, total, CASE WHEN order_id % 6 = 1 OR order_id % 10 = 3 OR low < 200 OR high > 99999999 THEN 'polar_price_unavailable'
    WHEN total NOT BETWEEN 200 AND 99999999 THEN 'polar_amount_invalid' END AS reason
  FROM (SELECT order_id, CAST(sum(quantity * unit_amount) AS BIGINT) AS total, min(unit_amount) AS low, max(unit_amount) AS high
    FROM cart_lines GROUP BY order_id))""", _CART_VIEWS, [_CART_LINES]))
def a4(spark, sf_dir):
    x = _cart_lines(spark, sf_dir).groupBy("order_id").agg(F.sort_array(F.collect_list(F.struct("product_id", "quantity", "unit_amount"))).alias("priced"))
    k = F.col("order_id")
    reserved = F.transform("priced", lambda p: F.struct(p["product_id"].alias("product_id"),
                                                        (p["quantity"] + F.when(k % 6 == 1, 1).otherwise(0)).alias("quantity")))
    x = x.withColumn("reserved", F.when(k % 10 == 3, F.concat(reserved, reserved)).otherwise(reserved))
    return x.select("order_id", carts.checkout_amount(F.col("reserved"), F.col("priced")).alias("a")).select("order_id", "a.amount", "a.reason")


# ------------------------------------------------------------------------ catalogue sync
_SYNC = ("sync_rows", f"""SELECT p_partkey AS product_id, '{SERVER}' AS server, CASE WHEN p_partkey % 5 = 0 THEN p_name || ' old' ELSE p_name END AS title,
    p_partkey % 13 = 0 AS archived, CAST(p_partkey % 4 + 1 AS INTEGER) AS version, CAST(p_partkey % 4 + 1 - p_partkey % 2 AS INTEGER) AS synced_version,
    CASE p_partkey % 4 WHEN 0 THEN 'synced' WHEN 1 THEN 'error' WHEN 2 THEN 'creating' ELSE 'queued' END AS state,
    CASE WHEN p_partkey % 3 <> 0 THEN 'r-' || CAST(p_partkey AS VARCHAR) END AS remote_id,
    CASE WHEN p_partkey % 4 = 1 THEN 'e' END AS error_code, CAST(p_partkey % 6 AS INTEGER) AS attempt_count,
    CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE TIMESTAMP '1997-01-01 00:00:00' END AS next_attempt_at
  FROM part WHERE p_partkey % 7 <> 0""")


def _sync_rows(spark, sf_dir):
    k = F.col("p_partkey")
    return Views(spark, sf_dir).part.where(k % 7 != 0).select(
        k.alias("product_id"), F.lit(SERVER).alias("server"),
        F.struct(F.when(k % 5 == 0, F.concat("p_name", F.lit(" old"))).otherwise(F.col("p_name")).alias("title"),
                 (k % 13 == 0).alias("archived")).alias("desired"),
        (k % 4 + 1).cast("int").alias("version"), (k % 4 + 1 - k % 2).cast("int").alias("synced_version"),
        F.when(k % 4 == 0, "synced").when(k % 4 == 1, "error").when(k % 4 == 2, "creating").otherwise("queued").alias("state"),
        F.when(k % 3 != 0, F.concat(F.lit("r-"), k.cast("string"))).alias("remote_id"), F.when(k % 4 == 1, "e").alias("error_code"),
        (k % 6).cast("int").alias("attempt_count"),
        F.when(k % 3 != 0, F.lit("1997-01-01 00:00:00").cast("timestamp_ntz")).alias("next_attempt_at"))


@register("e16_reconcile_catalog", sql_ctes(f"""SELECT product_id, server, title, archived, CAST(CASE WHEN fresh THEN 1 WHEN moved THEN version + 1 ELSE version END AS INTEGER) AS version,
  coalesce(synced_version, 0) AS synced_version,
  CASE WHEN fresh THEN 'queued' WHEN moved THEN CASE WHEN state = 'creating' AND remote_id IS NULL THEN 'creating' ELSE 'queued' END ELSE state END AS state,
  remote_id, CASE WHEN NOT fresh AND NOT moved THEN error_code END AS error_code,
  CASE WHEN fresh OR moved THEN 0 ELSE attempt_count END AS attempt_count,
  CASE WHEN fresh OR moved THEN TIMESTAMP '{NOW}' ELSE next_attempt_at END AS next_attempt_at
FROM (SELECT *, NOT fresh AND (title IS DISTINCT FROM was_title OR archived IS DISTINCT FROM was_archived) AS moved FROM (
  SELECT coalesce(s.product_id, p.product_id) AS product_id, '{SERVER}' AS server, s.version IS NULL AS fresh, s.version, s.synced_version, s.state,
    s.remote_id, s.error_code, s.attempt_count, s.next_attempt_at, s.title AS was_title, s.archived AS was_archived,
    CASE WHEN p.product_id IS NOT NULL THEN p.title ELSE s.title END AS title,
    CASE WHEN p.product_id IS NOT NULL THEN false ELSE true END AS archived
  FROM sync_rows s FULL JOIN (SELECT product_id, title FROM v_products WHERE product_id % 11 <> 0) p ON p.product_id = s.product_id))""",
                                            ["v_products"], [_SYNC]))
def e16(spark, sf_dir):
    products = Views(spark, sf_dir).v_products.where("product_id % 11 <> 0").select(
        "product_id", F.struct("title", F.lit(False).alias("archived")).alias("desired"))
    out = sync.reconcile_catalog(products, _sync_rows(spark, sf_dir), SERVER, NOW)
    return out.select("product_id", "server", "desired.title", "desired.archived", "version", "synced_version", "state", "remote_id",
                      "error_code", "attempt_count", "next_attempt_at")


@register("e17_sync_results", sql_ctes(f"""SELECT product_id, server, version,
  CASE WHEN ok THEN job ELSE synced_version END AS synced_version,
  CASE WHEN ok IS NULL THEN state WHEN ok THEN CASE WHEN job = version THEN 'synced' ELSE 'queued' END WHEN product_id % 9 = 1 THEN 'creating'
    WHEN job = version THEN 'error' ELSE 'queued' END AS state,
  CASE WHEN ok THEN 'n-' || CAST(product_id AS VARCHAR) ELSE remote_id END AS remote_id,
  CASE WHEN ok IS NULL THEN error_code WHEN NOT ok AND job = version THEN 'x' END AS error_code,
  CASE WHEN ok IS NULL THEN next_attempt_at WHEN ok AND job = version THEN NULL WHEN job = version THEN TIMESTAMP '1999-01-01 00:00:00'
    ELSE TIMESTAMP '{NOW}' END AS next_attempt_at
FROM (SELECT *, CASE WHEN product_id % 2 = 0 THEN product_id % 8 <> 0 END AS ok, CAST(version - CASE WHEN product_id % 10 = 0 THEN 1 ELSE 0 END AS INTEGER) AS job
  FROM sync_rows)""", (), [_SYNC]))
def e17(spark, sf_dir):
    rows = _sync_rows(spark, sf_dir)
    k = F.col("product_id")
    results = rows.where(k % 2 == 0).select(
        "product_id", "server", (F.col("version") - F.when(k % 10 == 0, 1).otherwise(0)).cast("int").alias("job_version"), (k % 8 != 0).alias("ok"),
        F.concat(F.lit("n-"), k.cast("string")).alias("remote_id"), (k % 9 == 1).alias("uncertain"), F.lit("x").alias("error_code"),
        F.lit("1999-01-01 00:00:00").cast("timestamp_ntz").alias("retry_at"))
    return sync.sync_results(rows, results, NOW)


@register("e18_restart_stopped", sql_ctes(f"""SELECT product_id, server, CASE WHEN stopped AND state <> 'creating' THEN 'queued' ELSE state END AS state,
  CASE WHEN stopped THEN 0 ELSE attempt_count END AS attempt_count, CASE WHEN stopped THEN TIMESTAMP '{NOW}' ELSE next_attempt_at END AS next_attempt_at
FROM (SELECT *, state <> 'synced' AND next_attempt_at IS NULL AS stopped FROM sync_rows)""", (), [_SYNC]))
def e18(spark, sf_dir):
    return sync.restart_stopped(_sync_rows(spark, sf_dir), SERVER, NOW)


@register("q12_billing_readiness", sql_ctes("""SELECT p.product_id, CASE WHEN s.state = 'synced' AND s.version = s.synced_version AND s.remote_id IS NOT NULL THEN 'ready'
  WHEN s.state = 'error' OR (s.state IS NOT NULL AND s.next_attempt_at IS NULL) THEN 'failed' ELSE 'pending' END AS readiness
FROM v_products p LEFT JOIN sync_rows s ON s.product_id = p.product_id""", ["v_products"], [_SYNC]))
def q12(spark, sf_dir):
    return sync.billing_readiness(Views(spark, sf_dir).v_products, _sync_rows(spark, sf_dir), SERVER)


@register("v12_sync_dataset", """SELECT count(*) FILTER (WHERE r.k IS NULL) AS created, count(*) FILTER (WHERE r.text <> l.text) AS updated,
  count(*) FILTER (WHERE l.k IS NULL) AS deleted,
  (SELECT count(*) FROM (SELECT item_id FROM benchmark WHERE item_id % 4 <> 0 GROUP BY item_id HAVING count(*) > 1)) AS duplicate_ids
FROM (SELECT item_id AS k, text FROM benchmark WHERE item_id % 4 <> 0) r
FULL JOIN (SELECT item_id AS k, CASE WHEN item_id % 6 = 1 THEN text || '!' ELSE text END AS text FROM benchmark WHERE item_id % 5 <> 0) l
  ON l.k = r.k""")
def v12(spark, sf_dir):
    b = Views(spark, sf_dir).benchmark
    remote = b.where("item_id % 4 <> 0").select("item_id", "text")
    local = b.where("item_id % 5 <> 0").select("item_id", F.when(F.col("item_id") % 6 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return sync.sync_dataset(remote, local, "item_id", ["text"])


# --------------------------------------------------------------------------- evaluation
_CASES = ("cases", """SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS case_id,
    CASE turn % 4 WHEN 0 THEN 'domain' WHEN 1 THEN 'routing' WHEN 2 THEN 'tools' ELSE 'proposal' END AS kind, conv_id, turn, role FROM conversations""")


@register("v1_v4_scores", sql_ctes("""SELECT case_id, evaluator, CASE evaluator
    WHEN 'category_correct' THEN CASE WHEN kind = 'domain' THEN CAST(role = CASE WHEN conv_id % 3 = 0 THEN 'user' ELSE role END AS INTEGER) END
    WHEN 'route_correct' THEN CASE WHEN kind = 'routing' THEN CAST(conv_id % 2 = turn % 2 AS INTEGER) END
    WHEN 'tool_selected' THEN CASE WHEN kind = 'tools' THEN CAST(conv_id % 3 <> 0 AND conv_id % 4 <> 0 AS INTEGER) END
    WHEN 'proposal_not_executed' THEN CASE WHEN kind = 'proposal' THEN CAST(conv_id % 5 <> 0 AS INTEGER) END END::DOUBLE AS score
FROM cases CROSS JOIN (SELECT unnest(['category_correct', 'route_correct', 'tool_selected', 'proposal_not_executed']) AS evaluator)""", (), [_CASES]))
def v1_v4(spark, sf_dir):
    c, t = F.col("conv_id"), F.col("turn")
    x = Views(spark, sf_dir).conversations.select(
        F.concat(c.cast("string"), F.lit("-"), t.cast("string")).alias("case_id"),
        F.when(t % 4 == 0, "domain").when(t % 4 == 1, "routing").when(t % 4 == 2, "tools").otherwise("proposal").alias("kind"),
        F.lit(None).cast("boolean").alias("expected_in_domain"), F.lit(None).cast("boolean").alias("in_domain"),
        F.lit(None).cast("boolean").alias("expected_blocked"), F.lit(None).cast("boolean").alias("blocked"), F.lit("").alias("answer"),
        F.lit(None).cast("string").alias("error"), F.col("role").alias("category"),
        F.when(c % 3 == 0, "user").otherwise(F.col("role")).alias("expected_category"),
        (c % 2).cast("string").alias("agent"), (t % 2).cast("string").alias("expected_agent"),
        F.when(c % 3 == 0, F.array(F.lit("other"))).when(c % 4 == 0, F.array(F.lit("find"), F.lit("drop"))).otherwise(F.array(F.lit("find"))).alias("tools_called"),
        F.array(F.lit("find"), F.lit("list")).alias("accepted_tools"), F.array(F.lit("drop")).alias("forbidden_tools"),
        F.lit("add").alias("proposal_kind"), F.lit("add").alias("expected_proposal_kind"),
        F.when(c % 5 == 0, F.array(F.lit("write"))).otherwise(F.array().cast("array<string>")).alias("executed_writes"))
    wanted = ("category_correct", "route_correct", "tool_selected", "proposal_not_executed")
    return evals.score_cases(x).where(F.col("evaluator").isin(*wanted)).select("case_id", "evaluator", "score")
