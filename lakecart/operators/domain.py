"""Topic of a buyer's message, the agent it goes to, and preference rules.

The topic rules run on folded text (N11) as regular expressions; the follow-up rule needs
the previous assistant message, which one window over the conversation brings to each turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BLOCKED_TEXT, contains_pii, detect_injection, fold_text

# Words of other topics, and the wares they may still describe.
FOREIGN_RE = (r"(?U)\b(?:matematic\w*|integral\w*|derivada\w*|tarea\w*|ecuacion\w*|python|javascript|"
              r"codigo fuente|funcion|compilacion|clima|weather|politica|presidente|elecciones|finanzas personales|"
              r"receta\w*|capital de|sintoma\w*|diagnostico|enfermedad\w*|bitcoin|tradu\w*|"
              r"poema\w*|chiste\w*|partido|mundial|horoscopo|legal|cartesiano)\b")
WARES_RE = r"(?U)\b(?:busco|busca|venden|tienen)\b.*\b(?:libro|medicina)"
# Words of each topic, first match wins.
TOPIC_RES = {
    "preferencias": r"(?U)\b(?:recuerda\w*|recuerdas|recordar|memoria\w*|olvida\w*|preferencia\w*)\b",
    "pagos_envios": r"(?U)\b(?:descuento\w*|pago\w*|yape|plin|tarjeta\w*|envio\w*|devolucion\w*)\b",
    "pedidos": r"(?U)\b(?:pedido\w*|orden\w*)\b",
    "carrito": r"(?U)\bcarrito\b",
    "productos": (r"(?U)\b(?:tienda|producto\w*|catalogo|precio\w*|stock|talla\w*|presupuesto|marca\w*|compr\w*|"
                  r"busco|busca|buscar|venden|tienen|audifono\w*|zapatilla\w*|regalo\w*|compara\w*)\b"),
}
# Greetings (the whole message) and words that point back.
GREETING_RE = (r"(?U)^(?:hola|gracias(?: por (?:tu |la )?ayuda)?|muchas gracias|saludos|adios|hasta luego|"
               r"buenos dias|buenas tardes|buenas noches|que puedes hacer|en que puedes ayudarme|me ayudas|ayuda)[.!?¿¡\s]*$")
FOLLOW_UP_RE = r"(?U)\b(?:otro|otra|ese|esa|eso|este|esta|si|no|dos|uno|cuanto|cuantos)\b|\d"
REFUSAL = "Solo puedo ayudarte"
FOLLOW_UP_WORDS = 6
OUTSIDE, CHAT = "fuera_de_dominio", "conversacion"
AGENTS = {"productos": "shopping", "carrito": "shopping", "pedidos": "post_sale", "pagos_envios": "post_sale"}
# Preference types and formats.
PREFERENCE_TYPES = ("talla", "categoria", "presupuesto", "marca", "otro")
SIZE_RE = r"^(?:talla\s+)?(?:\d{1,3}|[a-z]{1,4})$"
BUDGET_RE = r"^(?:s/\s*)?\d+(?:[.,]\d+)?(?:\s*soles)?$"


def topic(folded: Column, shop_name: str | None = None) -> Column:
    """The category of one folded text, without its context.  The shop's own name
    (``shop_name``, folded) is a word of ``productos`` too."""
    t = F.btrim(folded, F.lit(" ¿¡"))
    out = F.when(t.rlike(FOREIGN_RE) & ~t.rlike(WARES_RE), OUTSIDE).when(t.rlike(GREETING_RE), CHAT)
    for name, pattern in TOPIC_RES.items():
        said = t.rlike(pattern)
        if name == "productos" and shop_name:
            said = said | t.rlike(rf"(?U)\b\Q{shop_name}\E\b")
        out = out.when(said, name)
    return out.otherwise(OUTSIDE)


def classify_domain(turns: DataFrame, shop_name: str | None = None) -> DataFrame:
    """T5: ``conv_id, turn, category, in_domain`` of every human turn.  A message outside
    the domain, of at most six words, that points back and has no foreign word, belongs to
    the conversation if the buyer has just confirmed something (``recent_confirmation``,
    where the table has it) or the last assistant message was in the domain and no refusal."""
    confirmed = F.coalesce(F.col("recent_confirmation"), F.lit(False)) if "recent_confirmation" in turns.columns else F.lit(False)
    x = turns.where(F.col("type").isin("human", "ai")).select(
        "conv_id", "turn", "type", "text", confirmed.alias("confirmed"), fold_text("text").alias("folded"))
    x = x.withColumn("own", topic(F.col("folded"), shop_name))
    opens = (F.col("own") != OUTSIDE) & ~F.contains("text", F.lit(BLOCKED_TEXT)) & ~F.startswith("text", F.lit(REFUSAL))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("opened", F.last(F.when(F.col("type") == "ai", opens), ignorenulls=True).over(before))
    words = F.size(F.filter(F.split("folded", r"(?U)\s+"), lambda w: w != ""))
    follows = ((F.col("own") == OUTSIDE) & ~F.col("folded").rlike(FOREIGN_RE) & (words <= FOLLOW_UP_WORDS)
               & F.col("folded").rlike(FOLLOW_UP_RE) & (F.col("confirmed") | F.coalesce("opened", F.lit(False))))
    category = F.when(follows, CHAT).otherwise(F.col("own"))
    return x.where(F.col("type") == "human").select("conv_id", "turn", category.alias("category"),
                                                    (category != OUTSIDE).alias("in_domain"))


def sticky_route(categories: DataFrame) -> DataFrame:
    """The agent of each turn: by its category, or else the conversation's previous
    agent (``shopping`` at the start, reason ``sticky``)."""
    c = F.col("category")
    by_topic = F.create_map(*[F.lit(x) for pair in AGENTS.items() for x in pair])
    definite = F.try_element_at(by_topic, c)
    upto = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    agent = F.coalesce(F.last(definite, ignorenulls=True).over(upto), F.lit("shopping"))
    return categories.select("conv_id", "turn", agent.alias("agent"),
                             F.when(definite.isNotNull(), c).otherwise("sticky").alias("route_reason"))


def valid_preference(kind, value) -> Column:
    """A known type, 1 to 80 characters, no personal data, no injection; sizes and
    budgets in their formats."""
    k, v = (F.col(c) if isinstance(c, str) else c for c in (kind, value))
    folded = fold_text(v)
    shaped = F.when(k == "talla", folded.rlike(SIZE_RE)).when(k == "presupuesto", folded.rlike(BUDGET_RE)).otherwise(F.lit(True))
    return F.coalesce(k.isin(*PREFERENCE_TYPES) & F.length(v).between(1, 80) & ~contains_pii(v)
                      & ~detect_injection(folded, folded=True) & shaped, F.lit(False))
