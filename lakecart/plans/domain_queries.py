"""Registered topic and routing queries, with oracles.

The conversations have no shop words of their own, so the fixture puts a shop phrase in
front of some turns; both sides do the same.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import domain
from ..registry import register
from .views import Views, sql_ctes

PHRASES = ("Busco zapatillas. ", "¿Y el otro? ", "mi pedido no llega, ", "Agrega al carrito ", "pago con Yápe ", "la capital de ", "", "Hola")


ALONE = (1, 7)


def _talk(spark, sf_dir):
    """Every turn with its phrase in front, and short phrases also as a message of their own."""
    v = Views(spark, sf_dir).v_turns
    k = (F.col("conv_id") + F.col("turn")) % len(PHRASES)
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (k + 1).cast("int"))
    whole = v.select("conv_id", (F.col("turn") * 2).alias("turn"), "type", F.concat(phrase, F.col("text")).alias("text"))
    return whole.unionByName(v.where(k.isin(*ALONE)).select("conv_id", (F.col("turn") * 2 + 1).alias("turn"), "type", phrase.alias("text")))


# The oracle's own shape of the rules: each message is split into what matters (its folded text,
# which of the word lists it holds) before any decision, and the last assistant message comes by
# a join instead of a window.
def _plain(pattern):
    return pattern.replace("(?U)", "")


_LIST = "[" + ", ".join(f"'{p}'" for p in PHRASES) + "]"
_K = f"(conv_id + turn) % {len(PHRASES)}"
_TALK = ("talk", f"""SELECT conv_id, turn * 2 AS turn, type, ({_LIST})[{_K} + 1] || text AS text FROM v_turns WHERE type IN ('human', 'ai')
  UNION ALL SELECT conv_id, turn * 2 + 1, type, ({_LIST})[{_K} + 1] FROM v_turns WHERE type IN ('human', 'ai') AND {_K} IN {ALONE}""")
_HELD = ("held", "SELECT *, regexp_matches(t, '" + _plain(domain.FOREIGN_RE) + "') AS foreign_words, regexp_matches(t, '" + _plain(domain.WARES_RE)
         + "') AS wares, regexp_matches(t, '" + _plain(domain.GREETING_RE) + "') AS greets, regexp_matches(t, '" + _plain(domain.FOLLOW_UP_RE) + "') AS points, "
         + "[" + ", ".join(f"CASE WHEN regexp_matches(t, '{_plain(p)}') THEN '{n}' END" for n, p in domain.TOPIC_RES.items()) + "] AS topics "
         "FROM (SELECT *, trim(replace(strip_accents(lower(text)), 'ß', 'ss'), ' ¿¡') AS t FROM talk)")
_TOPIC = ("topics_of", f"""SELECT *, CASE WHEN foreign_words > wares THEN '{domain.OUTSIDE}' WHEN greets THEN '{domain.CHAT}'
  ELSE coalesce([x FOR x IN topics IF x IS NOT NULL][1], '{domain.OUTSIDE}') END AS own FROM held""")
_FOLLOW = ("categories", f"""SELECT h.conv_id, h.turn, CASE WHEN h.own = '{domain.OUTSIDE}' AND NOT h.foreign_words AND h.points
    AND len(regexp_extract_all(h.t, '[^\\s]+')) <= 6 AND a.own <> '{domain.OUTSIDE}' AND NOT contains(a.text, '[mensaje bloqueado]')
    AND NOT starts_with(a.text, '{domain.REFUSAL}') THEN '{domain.CHAT}' ELSE h.own END AS category
  FROM topics_of h ASOF LEFT JOIN (SELECT * FROM topics_of WHERE type = 'ai') a ON a.conv_id = h.conv_id AND h.turn > a.turn WHERE h.type = 'human'""")


@register("t5_classify_domain", sql_ctes(f"SELECT conv_id, turn, category, category <> '{domain.OUTSIDE}' AS in_domain FROM categories",
                                         ["v_turns"], [_TALK, _HELD, _TOPIC, _FOLLOW]))
def t5(spark, sf_dir):
    return domain.classify_domain(_talk(spark, sf_dir))


@register("w3_sticky_route", sql_ctes("""SELECT c.conv_id, c.turn, CASE WHEN d.category IS NULL THEN 'shopping' WHEN d.category IN ('pedidos', 'pagos_envios') THEN 'post_sale'
    ELSE 'shopping' END AS agent, CASE WHEN d.turn = c.turn THEN c.category ELSE 'sticky' END AS route_reason
FROM categories c ASOF LEFT JOIN (SELECT * FROM categories WHERE category IN ('productos', 'carrito', 'pedidos', 'pagos_envios')) d
  ON d.conv_id = c.conv_id AND c.turn >= d.turn""", ["v_turns"], [_TALK, _HELD, _TOPIC, _FOLLOW]))
def w3(spark, sf_dir):
    return domain.sticky_route(domain.classify_domain(_talk(spark, sf_dir)))
