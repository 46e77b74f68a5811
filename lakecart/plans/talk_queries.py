"""Registered queries over conversations with tools: evidence and grounding, the model's
window, open calls, stored input; and the keyed folds over events.

The conversations name no prices.  The fixture puts a phrase in front of each assistant's text
and adds a tool's answer after each human turn of two conversations out of three; the
oracles know what these say and derive the verdicts from that.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grounding, messages, proposals
from ..registry import register
from .views import SQL_VIEWS, Views, sql_ctes

_P = "(10 + conv_id % 90)"
_K = "(conv_id + turn) % 8"
_SAID = {0: f"'Cuesta S/ ' || {_P} || '.50. '", 1: f"'Cuesta S/ ' || ({_P} * 6) || '.00, '", 2: "'Cuesta 9999 soles. '", 3: "'Por 150 soles, '",
         4: "'Stock: ' || ((turn - 1) % 30) || '. '", 5: "'quedan 31 unidades. '", 6: "'sk-abc123 '", 7: "''"}
_PHRASE = "CASE " + _K + " " + " ".join(f"WHEN {k} THEN {v}" for k, v in _SAID.items()) + " END"


def _talk(spark, sf_dir):
    """Messages at ten times their turn; tools' answers five later."""
    t = Views(spark, sf_dir).v_turns
    p = F.expr(_P)
    text = (F.when(F.col("type") == "ai", F.concat(F.expr(_PHRASE), F.col("text")))
            .when((F.col("type") == "human") & F.expr("(conv_id + turn) % 5 = 0"), F.concat(F.lit("menos de 150 soles, "), F.col("text")))
            .otherwise(F.col("text")))
    said = t.select("conv_id", (F.col("turn") * 10).alias("turn"), "type", text.alias("text"), F.lit(None).cast("string").alias("payload"))
    payload = F.format_string('{"products":[{"title":"x","price_pen":"%d.50","stock":%d,"extra":{"more":[{"unit_price_pen":%d},5]}}],'
                              '"total_pen":"1,%d.00","stock":"7","description":"S/ 777","ok":true}',
                              p, F.col("turn") % 30, p * 2, 100 + p)
    tools = t.where("type = 'human' AND conv_id % 3 <> 0").select(
        "conv_id", (F.col("turn") * 10 + 5).alias("turn"), F.lit("tool").alias("type"), F.lit("").alias("text"), payload.alias("payload"))
    return said.unionByName(tools)


_PROOF = ("proof", f"""SELECT DISTINCT conv_id, turn, kind, CAST(value AS DECIMAL(38,6)) AS value FROM (
  SELECT conv_id, turn * 10 + 5 AS turn, 'price' AS kind, q * ({_P} + 0.5) AS value FROM v_turns, range(1, 21) r(q) WHERE type = 'human' AND conv_id % 3 <> 0
  UNION ALL SELECT conv_id, turn * 10 + 5, 'price', q * 2 * {_P} FROM v_turns, range(1, 21) r(q) WHERE type = 'human' AND conv_id % 3 <> 0
  UNION ALL SELECT conv_id, turn * 10 + 5, 'price', 1000 + 100 + {_P} FROM v_turns WHERE type = 'human' AND conv_id % 3 <> 0
  UNION ALL SELECT conv_id, turn * 10 + 5, 'stock', turn % 30 FROM v_turns WHERE type = 'human' AND conv_id % 3 <> 0
  UNION ALL SELECT conv_id, turn * 10, 'price', 150 FROM v_turns WHERE type = 'human' AND (conv_id + turn) % 5 = 0)""")
_CLAIMS = ("claims", f"""SELECT conv_id, turn, k, CASE WHEN k < 4 THEN 'price' WHEN k < 6 THEN 'stock' END AS kind, CAST(CASE k WHEN 0 THEN {_P} + 0.5 WHEN 1 THEN {_P} * 6
    WHEN 2 THEN 9999 WHEN 3 THEN 150 WHEN 4 THEN (turn - 1) % 30 WHEN 5 THEN 31 END AS DECIMAL(38,6)) AS value, phrase || text AS text
  FROM (SELECT *, {_K} AS k, {_PHRASE} AS phrase FROM v_turns WHERE type = 'ai')""")


@register("a7_evidence", sql_ctes("SELECT * FROM proof", ["v_turns"], [_PROOF]))
def a7(spark, sf_dir):
    return grounding.evidence(_talk(spark, sf_dir))


@register("t8_grounding_check", sql_ctes("""SELECT conv_id, turn * 10 AS turn, CASE WHEN secret THEN 'secret' WHEN NOT grounded THEN 'ungrounded_price' END AS reason,
  CASE WHEN secret THEN 'replaced' WHEN NOT grounded THEN CASE WHEN kind = 'price' AND NOT tools THEN 'replaced' ELSE 'annotated' END END AS action
FROM (SELECT c.conv_id, c.turn, c.kind, regexp_matches(c.text, 'eyJ[\\w-]+\\.[\\w-]+\\.[\\w-]+|Bearer\\s+|\\bsk-[\\w-]+|\\blsv2_[\\w-]+') AS secret,
    c.kind IS NULL OR EXISTS (SELECT 1 FROM proof p WHERE p.conv_id = c.conv_id AND p.kind = c.kind AND p.value = c.value AND p.turn < c.turn * 10) AS grounded,
    c.conv_id % 3 <> 0 AND EXISTS (SELECT 1 FROM v_turns h WHERE h.conv_id = c.conv_id AND h.type = 'human' AND h.turn < c.turn) AS tools
  FROM claims c)""", ["v_turns"], [_PROOF, _CLAIMS]))
def t8(spark, sf_dir):
    """Redactions of personal data need look-around, which the oracle has not: they are left
    out of the compared columns (tests hold the texts)."""
    out = grounding.grounding_check(_talk(spark, sf_dir), "Eres un asistente de compras que responde solo con datos del catálogo de la tienda")
    other = F.col("reason") != "pii"
    return out.select("conv_id", "turn", F.when(other, F.col("reason")).alias("reason"), F.when(other, F.col("action")).alias("action"))


@register("v7_no_invented_price", sql_ctes("""SELECT c.conv_id * 1000 + c.turn AS case_id, CASE WHEN c.turn % 4 <> 3 THEN
    CASE WHEN c.kind = 'price' AND NOT (c.conv_id % 3 <> 0 AND EXISTS (SELECT 1 FROM shown p WHERE p.conv_id = c.conv_id AND p.value = c.value)) THEN 0.0
      ELSE 1.0 END END::DOUBLE AS score
FROM claims c""", ["v_turns"], [_CLAIMS, ("shown", f"""SELECT DISTINCT conv_id, CAST(value AS DECIMAL(38,6)) AS value FROM (
    SELECT conv_id, q * ({_P} + 0.5) AS value FROM v_turns, range(1, 21) r(q) UNION ALL SELECT conv_id, q * 2 * {_P} FROM v_turns, range(1, 21) r(q)
    UNION ALL SELECT conv_id, 1100 + {_P} FROM v_turns)""")]))
def v7(spark, sf_dir):
    talk = _talk(spark, sf_dir)
    shown = talk.where("type = 'tool'").groupBy("conv_id").agg(F.collect_set("payload").alias("tool_context"))
    turn = (F.col("turn") / 10).cast("long")
    cases = (talk.where("type = 'ai'").join(shown, "conv_id", "left").select(
        (F.col("conv_id") * 1000 + turn).alias("case_id"), F.element_at(F.array(*map(F.lit, ("tools", "proposal", "guardrail", "domain"))),
                                                                        (turn % 4 + 1).cast("int")).alias("kind"),
        F.col("text").alias("answer"), F.coalesce("tool_context", F.array().cast("array<string>")).alias("tool_context")))
    return grounding.no_invented_price(cases)


@register("w4_trim_history", sql_ctes("""SELECT t.* FROM v_turns t JOIN (
  SELECT conv_id, max(CASE WHEN place = n AND type = 'system' THEN turn END) AS sys, max(CASE WHEN type = 'human' THEN turn END) AS last_human,
    min(CASE WHEN type = 'human' AND place <= 3 - CAST(lead = 'system' AS INTEGER) THEN turn END) AS first FROM (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place, count(*) OVER (PARTITION BY conv_id) AS n,
        first_value(type) OVER (PARTITION BY conv_id ORDER BY turn) AS lead FROM v_turns) GROUP BY conv_id) c ON c.conv_id = t.conv_id
WHERE t.turn = c.sys OR t.turn >= coalesce(c.first, c.last_human)""", ["v_turns"]))
def w4(spark, sf_dir):
    return messages.trim_history(Views(spark, sf_dir).v_turns, 3)


@register("j9_pending_tool_calls", sql_ctes("""SELECT a.conv_id, a.turn * 10 AS turn, CASE WHEN s.i < 2 THEN a.conv_id || '-' || a.turn || '-' || s.i END AS call_id,
  CASE s.i WHEN 0 THEN 'list_my_orders' WHEN 1 THEN 'search_products' ELSE 'remember' END AS name
FROM (SELECT conv_id, max(turn) AS turn FROM v_turns WHERE type = 'ai' GROUP BY conv_id) a, range(3) s(i)
WHERE NOT (s.i < 2 AND (a.conv_id + s.i) % 3 = 0)""", ["v_turns"]))
def j9(spark, sf_dir):
    t = Views(spark, sf_dir).v_turns
    ident = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.lit(""))
    calls = F.array(*[F.struct((F.concat(ident, F.lit(str(i))) if i < 2 else F.lit(None).cast("string")).alias("id"), F.lit(n).alias("name"))
                      for i, n in enumerate(("list_my_orders", "search_products", "remember"))])
    said = t.select("conv_id", (F.col("turn") * 10).alias("turn"), "type", F.when(F.col("type") == "ai", calls).alias("tool_calls"),
                    F.lit(None).cast("string").alias("tool_call_id"))
    answers = t.where("type = 'ai'").select("conv_id", (F.col("turn") * 10 + 5).alias("turn"), F.lit("tool").alias("type"),
                                            F.lit(None).cast("array<struct<id:string,name:string>>").alias("tool_calls"), F.explode(F.array(
        *[F.when((F.col("conv_id") + i) % 3 == 0, F.concat(ident, F.lit(str(i)))) for i in range(2)])).alias("tool_call_id"))
    return messages.pending_tool_calls(said.unionByName(answers.where("tool_call_id IS NOT NULL")))


@register("t11_keep_human_input", sql_ctes("""SELECT conv_id, turn, type, CASE WHEN type = 'human' THEN length(text) END AS original_length,
  CASE WHEN type <> 'human' THEN 'not_human' END AS error FROM v_turns""", ["v_turns"]))
def t11(spark, sf_dir):
    kept, rejected = messages.keep_human_input(Views(spark, sf_dir).v_turns.withColumnRenamed("text", "content"))
    return kept.drop("text").withColumn("error", F.lit(None).cast("string")).unionByName(rejected.withColumn("original_length", F.lit(None).cast("int")))


# ------------------------------------------------------------------------------ keyed folds
# Events as changes of carts: the user is the owner, k the quantity, the id names the product.
_CHANGES = """SELECT user_id AS owner, ts AS occurred_at, event_id, 'act-' || (event_id // 2) AS action_id, event_id % 60 AS product_id,
  (CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) % 24) - 1 AS quantity FROM events"""


def _changes(spark, sf_dir):
    e = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return Views(spark, sf_dir).events.select(
        F.col("user_id").alias("owner"), F.col("ts").alias("occurred_at"), "event_id", F.concat(F.lit("act-"), F.floor(e / 2).cast("string")).alias("action_id"),
        (e % 60).alias("product_id"), (k % 24 - 1).alias("quantity"))


def _cart_facts(spark, sf_dir):
    v = Views(spark, sf_dir)
    carts = spark.createDataFrame([], "owner long, line int, product_id long, quantity long, unit_amount long")
    changes = _changes(spark, sf_dir)
    locked = changes.select("owner").where("owner % 10 = 3").distinct()
    return carts, locked, changes, v.v_products.where("product_id <> 49")


_A11_RESULT = """CASE WHEN owner % 10 = 3 THEN 'checkout_locked' WHEN stock IS NULL THEN 'not_found' WHEN quantity IS NULL OR quantity NOT BETWEEN 1 AND 20 THEN 'invalid'
  WHEN coalesce(cart[product_id], 0) + quantity > stock THEN 'stock' WHEN cart[product_id] IS NULL AND cardinality(cart) >= 20 THEN 'cart_full' END"""


@register("a11_apply_cart_proposals", f"""WITH RECURSIVE v_products AS ({SQL_VIEWS['v_products']}),
d AS (SELECT c.*, p.stock, row_number() OVER (PARTITION BY owner ORDER BY occurred_at, event_id) AS n FROM ({_CHANGES}) c
  LEFT JOIN v_products p ON p.product_id = c.product_id AND p.product_id <> 49),
w AS (SELECT owner, 0::BIGINT AS n, MAP([]::BIGINT[], []::BIGINT[]) AS cart, MAP([]::VARCHAR[], []::STRUCT(total BIGINT, reason VARCHAR)[]) AS done,
    NULL::BIGINT AS event_id, NULL::VARCHAR AS action_id, NULL::BIGINT AS product_id, NULL::TIMESTAMP AS occurred_at, NULL::STRUCT(total BIGINT, reason VARCHAR) AS r
  FROM (SELECT DISTINCT owner FROM d)
  UNION ALL
  SELECT owner, n, CASE WHEN fresh AND r.reason IS NULL THEN map_concat(cart, MAP([product_id], [r.total])) ELSE cart END,
    CASE WHEN fresh THEN map_concat(done, MAP([action_id], [r])) ELSE done END, event_id, action_id, product_id, occurred_at, r
  FROM (SELECT *, done[action_id] IS NULL AS fresh, coalesce(done[action_id],
      {{'total': CASE WHEN reason IS NULL THEN coalesce(cart[product_id], 0) + quantity END, 'reason': reason}}) AS r
    FROM (SELECT *, {_A11_RESULT} AS reason FROM (SELECT d.owner, d.n, d.event_id, d.action_id, d.product_id, d.occurred_at, d.quantity, d.stock, w.cart, w.done
      FROM w JOIN d ON d.owner = w.owner AND d.n = w.n + 1))))
SELECT owner, occurred_at, event_id, action_id, product_id, r.reason IS NULL AS applied, r.total AS quantity_in_cart, r.reason AS reason FROM w WHERE n > 0""")
def a11(spark, sf_dir):
    return proposals.apply_cart_proposals(*_cart_facts(spark, sf_dir))


@register("a14_set_quantities", f"""WITH RECURSIVE v_products AS ({SQL_VIEWS['v_products']}),
d AS (SELECT c.*, p.stock, row_number() OVER (PARTITION BY owner ORDER BY occurred_at, event_id) AS n FROM ({_CHANGES}) c
  LEFT JOIN v_products p ON p.product_id = c.product_id AND p.product_id <> 49),
w AS (SELECT owner, 0::BIGINT AS n, MAP([]::BIGINT[], []::BIGINT[]) AS cart, NULL::BIGINT AS event_id, NULL::BIGINT AS product_id,
    NULL::TIMESTAMP AS occurred_at, NULL::VARCHAR AS reason FROM (SELECT DISTINCT owner FROM d)
  UNION ALL
  SELECT owner, n, CASE WHEN reason IS NOT NULL THEN cart ELSE map_from_entries([e FOR e IN map_entries(cart) IF e.key <> product_id]
      || CASE WHEN quantity > 0 THEN [{{'key': product_id, 'value': quantity}}] ELSE [] END) END, event_id, product_id, occurred_at, reason
  FROM (SELECT *, CASE WHEN owner % 10 = 3 THEN 'checkout_locked' WHEN stock IS NULL THEN 'not_found' WHEN quantity < 0 THEN 'invalid'
      WHEN quantity > stock AND quantity >= coalesce(cart[product_id], 0) THEN 'stock'
      WHEN quantity > 0 AND cart[product_id] IS NULL AND cardinality(cart) >= 20 THEN 'cart_full' END AS reason
    FROM (SELECT d.owner, d.n, d.event_id, d.product_id, d.occurred_at, d.quantity, d.stock, w.cart FROM w JOIN d ON d.owner = w.owner AND d.n = w.n + 1)))
SELECT owner, occurred_at, event_id, product_id, reason IS NULL AS applied, reason FROM w WHERE n > 0""")
def a14(spark, sf_dir):
    return proposals.set_quantities(*_cart_facts(spark, sf_dir))


_WISHES = """SELECT user_id AS owner, ts AS occurred_at, event_id, CASE event_id % 12 WHEN 0 THEN 'forget' WHEN 1 THEN CASE WHEN event_id % 7 = 0 THEN 'forget_all' ELSE 'forget' END
    ELSE 'remember' END AS action, event_id % 25 AS slot, CASE event_id % 5 WHEN 0 THEN 'talla' WHEN 1 THEN 'marca' WHEN 2 THEN 'presupuesto' WHEN 3 THEN 'color'
    ELSE 'otro' END AS kind, CASE WHEN event_id % 11 = 0 THEN repeat('x', 81) ELSE CAST(event_id % 40 AS VARCHAR) END AS value FROM events"""


def _wishes(spark, sf_dir):
    e = F.col("event_id")
    action = F.when(e % 12 == 0, "forget").when(e % 12 == 1, F.when(e % 7 == 0, "forget_all").otherwise("forget")).otherwise("remember")
    kinds = F.array(*map(F.lit, ("talla", "marca", "presupuesto", "color", "otro")))
    return Views(spark, sf_dir).events.select(
        F.col("user_id").alias("owner"), F.col("ts").alias("occurred_at"), "event_id", action.alias("action"),
        F.format_string("preference-%02d", e % 25).alias("slot_key"), F.element_at(kinds, (e % 5 + 1).cast("int")).alias("kind"),
        F.when(e % 11 == 0, F.repeat(F.lit("x"), F.lit(81))).otherwise(F.concat(F.lit(" "), (e % 40).cast("string"))).alias("value"))


@register("t12_preference_state", f"""WITH RECURSIVE
d AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY occurred_at, event_id) AS n, kind || '|' || value AS wish,
    CASE WHEN action = 'remember' AND (kind = 'color' OR length(value) > 80) THEN 'invalid' END AS refusal FROM ({_WISHES})),
w AS (SELECT owner, 0::BIGINT AS n, [NULL FOR i IN range(20)]::VARCHAR[] AS slots, NULL::BIGINT AS event_id, NULL::VARCHAR AS action, NULL::TIMESTAMP AS occurred_at,
    NULL::VARCHAR AS result, NULL::BIGINT AS slot FROM (SELECT DISTINCT owner FROM d)
  UNION ALL
  SELECT owner, n, CASE result WHEN 'forgotten_all' THEN [NULL FOR i IN range(20)] WHEN 'forgotten' THEN [CASE WHEN i + 1 <> at_slot THEN slots[i + 1] END FOR i IN range(20)]
      WHEN 'saved' THEN [CASE WHEN i + 1 = at_slot THEN wish ELSE slots[i + 1] END FOR i IN range(20)] ELSE slots END, event_id, action, occurred_at, result,
    CASE WHEN result IN ('forgotten', 'known', 'saved') THEN at_slot END
  FROM (SELECT *, CASE action WHEN 'forget_all' THEN 'forgotten_all' WHEN 'forget' THEN CASE WHEN slots[slot] IS NULL OR slot = 0 THEN 'not_found' ELSE 'forgotten' END
      ELSE coalesce(refusal, CASE WHEN list_position(slots, wish) > 0 THEN 'known' WHEN free IS NULL THEN 'full' ELSE 'saved' END) END AS result,
      CASE WHEN action = 'forget' THEN slot WHEN list_position(slots, wish) > 0 THEN list_position(slots, wish) ELSE free END AS at_slot
    FROM (SELECT d.*, w.slots, [i + 1 FOR i IN range(20) IF w.slots[i + 1] IS NULL][1] AS free FROM w JOIN d ON d.owner = w.owner AND d.n = w.n + 1)))
SELECT owner, occurred_at, event_id, action, result, CASE WHEN slot IS NOT NULL THEN 'preference-' || lpad(CAST(slot AS VARCHAR), 2, '0') END AS slot FROM w WHERE n > 0""")
def t12(spark, sf_dir):
    return proposals.preference_state(_wishes(spark, sf_dir))
