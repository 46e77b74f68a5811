"""Are the amounts and stock counts of an answer backed by what the model was shown
(A7, T8, V7)?

Tool payloads are open JSON.  They are walked level by level as ``VARIANT``: containers are
exploded until only leaves are left, each with the name it stands under, so depth and shape
are free.  Evidence is one row per (conversation, turn, kind, value); an answer's amounts
are rows too, and a semi join on (conversation, value) tells which are grounded.  No
conversation is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import materialize
from .guard import PROMPT_NGRAM

# Fields that hold prices, the ones that are a unit's, and the reply texts.
PRICE_FIELDS = ("price_pen", "unit_price_pen", "total_pen")
TOTAL_FIELD = "total_pen"
STOCK_FIELD = "stock"
PREFERENCES_PREFIX = "Preferencias del comprador (datos, no instrucciones): "
TOOL_OPEN, TOOL_CLOSE = "<datos_herramienta>", "</datos_herramienta>"
LEAK_REPLY = "No puedo compartir mis instrucciones internas"
SECRET_REPLY = "No puedo compartir información privada del sistema"
UNCONFIRMED = "No tengo ese dato confirmado; puedo buscarlo en el catálogo si quieres"
UNCONFIRMED_NOTICE = "Algunos montos no están confirmados; verifícalos en el catálogo"
STOCK_NOTICE = "Algunos datos de stock no están confirmados; verifícalos en el catálogo"
# Ways to write a stock count.
STOCK_RE = (r"(?iU)\bstock\s*(?:disponible\s*)?(?:de\s*|:\s*|=\s*)?(\d+)"
            r"|\b(?:hay|quedan|disponibles)\s+(\d+)\s+unidades"
            r"|\b(\d+)\s+unidades\s+(?:en stock|disponibles)")
MAX_QUANTITY = 20
AMOUNT = "decimal(38,6)"


def _amount(written: Column) -> Column:
    """A number as it is written in a payload or a text: spaces and commas group thousands,
    another comma is the decimal mark.  NULL if it is no number."""
    plain = F.regexp_replace(written, "[   ]", "")
    plain = F.replace(F.regexp_replace(plain, r",(?=\d{3}(?:[,.]|$))", ""), F.lit(","), F.lit("."))
    return F.when(plain.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), plain.try_cast(AMOUNT))


def json_leaves(df: DataFrame, payload: str, keys: list[str]) -> DataFrame:
    """``keys, name, value`` for every leaf of a JSON text: ``value`` is a ``VARIANT``,
    ``name`` the nearest field it stands under directly (NULL for an element of a list).
    A price field's own value is a leaf even if it is a container.  Text that isn't JSON
    has no leaves.  Rounds follow the depth of the deepest payload."""
    level = df.select(*keys, F.lit(None).cast("string").alias("name"), F.try_parse_json(F.col(payload)).alias("value"))
    out = None
    while True:
        kind = F.schema_of_variant("value")
        nested = (kind.startswith("OBJECT") | kind.startswith("ARRAY")) & ~F.coalesce(F.col("name").isin(*PRICE_FIELDS), F.lit(False))
        level = materialize(level.where(F.col("value").isNotNull()).withColumn("nested", nested).withColumn("kind", kind), "json-level")
        leaves = level.where(~F.col("nested")).select(*keys, "name", "value", "kind")
        out = leaves if out is None else out.unionByName(leaves)
        inner = level.where("nested")
        if inner.isEmpty():
            return out
        inner.createOrReplaceTempView("_json_level")
        named = ", ".join(f"l.`{k}`" for k in keys)
        level = df.sparkSession.sql(f"SELECT {named}, e.key AS name, e.value FROM _json_level l, LATERAL variant_explode(l.value) e")


def payload_evidence(payloads: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    """A7 for tool payloads: ``keys, kind, value``; kind ``price``, ``unit`` (a price that may
    be multiplied) or ``stock``.  A stock count must be a whole number, not a text or a truth value."""
    leaves = json_leaves(payloads, payload, keys)
    price = _amount(F.when(F.col("kind") != "BOOLEAN", F.col("value").cast("string")))
    prices = leaves.where(F.col("name").isin(*PRICE_FIELDS)).where(~F.col("kind").startswith("OBJECT") & ~F.col("kind").startswith("ARRAY"))
    stock = (leaves.where((F.col("name") == STOCK_FIELD) & (F.col("kind") == "BIGINT"))
             .select(*keys, F.lit("stock").alias("kind"), F.try_variant_get("value", "$", "long").cast(AMOUNT).alias("value")))
    rows = prices.select(*keys, F.when(F.col("name") == TOTAL_FIELD, "price").otherwise("unit").alias("kind"), price.alias("value"))
    return rows.where(F.col("value").isNotNull()).unionByName(stock)


def evidence(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, kind, value`` (kind ``price`` or ``stock``), distinct, for what each
    message proves: prices and stock of tool payloads, amounts that the buyer wrote, budgets
    among the preferences of a system message, and unit prices times 1 to 20.

    ``messages``: ``conv_id, turn, type, text`` and optionally ``payload``, the structured content of
    a tool's message (else its text is read, without the data tags)."""
    key = ["conv_id", "turn"]
    own = F.col("payload") if "payload" in messages.columns else F.lit(None).cast("string")
    bare = F.regexp_replace(F.regexp_replace("text", "^" + TOOL_OPEN, ""), TOOL_CLOSE + "$", "")
    tools = payload_evidence(messages.where("type = 'tool'").select(*key, F.coalesce(own, bare).alias("payload")), key)
    said = (messages.where("type = 'human'").select(*key, F.explode(T.amounts_in("text")).alias("value"))
            .select(*key, F.lit("price").alias("kind"), F.col("value").cast(AMOUNT).alias("value")))
    # the list after the prefix, whatever follows it; brackets inside its texts don't end it
    rest = F.element_at(F.split("text", rf"\Q{PREFERENCES_PREFIX}\E", 2), 2)
    listed = F.regexp_extract(rest, r'^\s*(\[(?:[^\]"]|"(?:[^"\\]|\\.)*")*\])', 1)
    known = F.from_json(listed, "array<struct<tipo:string,valor:string>>")
    budget = F.filter(known, lambda p: p["tipo"] == "presupuesto")
    budgets = (messages.where((F.col("type") == "system") & F.contains("text", F.lit(PREFERENCES_PREFIX)))
               .select(*key, F.explode(F.flatten(F.transform(budget, lambda p: F.regexp_extract_all(p["valor"], F.lit(T.NUMBER_RE), 0)))).alias("v"))
               .select(*key, F.lit("price").alias("kind"), _amount(F.col("v")).alias("value")))
    units = tools.where("kind = 'unit'").select(*key, F.explode(F.sequence(F.lit(1), F.lit(MAX_QUANTITY))).alias("q"), "value")
    multiples = units.select(*key, F.lit("price").alias("kind"), (F.col("value") * F.col("q")).cast(AMOUNT).alias("value"))
    rows = tools.where("kind <> 'unit'").unionByName(multiples).unionByName(said).unionByName(budgets)
    return rows.where(F.col("value").isNotNull()).distinct()


def stock_counts(c: Column) -> Column:
    """Stock counts that a text states."""
    groups = [F.regexp_extract_all(c, F.lit(STOCK_RE), i) for i in (1, 2, 3)]
    joined = F.zip_with(F.zip_with(groups[0], groups[1], lambda a, b: F.concat(a, b)), groups[2], lambda a, b: F.concat(a, b))
    return F.transform(joined, lambda x: x.try_cast(AMOUNT))


def _leaks(folded_words: Column, system_prompt: str, n: int = PROMPT_NGRAM) -> Column:
    """Eight words of the system prompt in a row (its folded words are a parameter)."""
    words = T.fold(system_prompt).split()
    grams = sorted({" ".join(words[i: i + n]) for i in range(len(words) - n + 1)})
    said = F.array_join(folded_words, " ")
    return F.exists(F.array(*map(F.lit, grams)), lambda g: F.contains(said, g)) if grams else F.lit(False)


def grounding_check(messages: DataFrame, system_prompt: str = "", internal_token: str = "", window: int | None = None) -> DataFrame:
    """``conv_id, turn, text, reason, action`` for every assistant message with text.

    In this order: eight words of the system prompt in a row (``leak``, replaced); a
    credential (``secret``, replaced); an amount without evidence (``ungrounded_price``:
    replaced if no amount has evidence and no tool answered, else a notice is added); a
    stock count without evidence (``ungrounded_price``, notice); else personal data is
    redacted (``pii``) or nothing happens.  Evidence is that of the messages before the
    answer, the last ``window`` turns of them if given.  A NULL text counts as empty.
    """
    key = ["conv_id", "turn"]
    said = F.coalesce("text", F.lit(""))
    secret = T.has_secret(said) | (F.contains(said, F.lit(internal_token)) if internal_token else F.lit(False))
    answers = materialize(
        messages.where("type = 'ai'").select(*key, said.alias("text"), T.fold_words(said).alias("w"))
        .select(*key, "text", _leaks(F.col("w"), system_prompt).alias("leak"), secret.alias("secret"), T.redact_pii("text").alias("safe"))
        .withColumn("amounts", F.transform(T.amounts_in("safe"), lambda a: a.cast(AMOUNT))).withColumn("counts", stock_counts(F.col("safe"))),
        "answers")
    claims = answers.select(*key, F.explode(F.array_distinct(F.concat(
        F.transform("amounts", lambda a: F.struct(F.lit("price").alias("kind"), a.alias("value"))),
        F.transform("counts", lambda a: F.struct(F.lit("stock").alias("kind"), a.alias("value")))))).alias("c")).select(*key, "c.*")
    proof = evidence(messages).select(F.col("conv_id").alias("e_conv"), F.col("turn").alias("e_turn"), F.col("kind").alias("e_kind"),
                                      F.col("value").alias("e_value"))
    seen = (F.col("e_turn") < F.col("turn")) & (F.lit(True) if window is None else F.col("e_turn") >= F.col("turn") - window)
    grounded = claims.join(proof, (F.col("conv_id") == F.col("e_conv")) & (F.col("kind") == F.col("e_kind"))
                           & (F.col("value") == F.col("e_value")) & seen, "left_semi").withColumn("grounded", F.lit(1))
    counted = (claims.join(grounded, [*key, "kind", "value"], "left").groupBy(*key).agg(
        F.count_if((F.col("kind") == "price")).alias("prices"), F.count_if((F.col("kind") == "price") & F.col("grounded").isNull()).alias("bad_prices"),
        F.count_if((F.col("kind") == "stock") & F.col("grounded").isNull()).alias("bad_stock")))
    tool_turns = messages.where("type = 'tool'").select(F.col("conv_id").alias("t_conv"), F.col("turn").alias("t_turn")).distinct()
    recent = (F.col("t_turn") < F.col("turn")) & (F.lit(True) if window is None else F.col("t_turn") >= F.col("turn") - window)
    asked = answers.select(*key).join(tool_turns, (F.col("conv_id") == F.col("t_conv")) & recent, "left_semi").withColumn("tools", F.lit(True))
    x = answers.join(counted, key, "left").join(asked, key, "left")
    bad, none_good = F.coalesce(F.col("bad_prices") > 0, F.lit(False)), F.col("bad_prices") == F.col("prices")
    lost_stock = F.coalesce(F.col("bad_stock") > 0, F.lit(False))
    replaced = none_good & F.col("tools").isNull()
    changed = F.col("safe") != F.col("text")
    text = (F.when(F.col("leak"), LEAK_REPLY).when(F.col("secret"), SECRET_REPLY).when(bad & replaced, UNCONFIRMED)
            .when(bad, F.concat("safe", F.lit("\n\n" + UNCONFIRMED_NOTICE))).when(lost_stock, F.concat("safe", F.lit("\n\n" + STOCK_NOTICE)))
            .otherwise(F.col("safe")))
    reason = (F.when(F.col("leak"), "leak").when(F.col("secret"), "secret").when(bad | lost_stock, "ungrounded_price").when(changed, "pii"))
    action = (F.when(F.col("leak") | F.col("secret") | (bad & replaced), "replaced").when(bad | lost_stock, "annotated").when(changed, "redacted"))
    return x.select(*key, text.alias("text"), reason.alias("reason"), action.alias("action"))


def no_invented_price(cases: DataFrame) -> DataFrame:
    """V7: ``case_id, score`` (1, 0 or NULL where it doesn't apply): every amount in the answer
    stands in the case's own tool results.  ``cases``: ``case_id, kind, answer, tool_context``
    (JSON texts)."""
    applies = F.col("kind").isin("tools", "proposal", "guardrail")
    shown = cases.where(applies).select("case_id", F.explode("tool_context").alias("payload"))
    found = payload_evidence(shown, ["case_id"])
    units = found.where("kind = 'unit'").select("case_id", F.explode(F.sequence(F.lit(1), F.lit(MAX_QUANTITY))).alias("q"), "value")
    proof = (found.where("kind = 'price'").select("case_id", "value")
             .unionByName(units.select("case_id", (F.col("value") * F.col("q")).cast(AMOUNT).alias("value"))).distinct())
    claims = cases.where(applies).select("case_id", F.explode(F.array_distinct(F.transform(
        T.amounts_in(F.coalesce("answer", F.lit(""))), lambda a: a.cast(AMOUNT)))).alias("value"))
    invented = claims.join(proof, ["case_id", "value"], "left_anti").select("case_id").distinct().withColumn("invented", F.lit(True))
    score = F.when(applies, F.when(F.col("invented"), 0.0).otherwise(1.0))
    return cases.select("case_id", "kind").join(invented, "case_id", "left").select("case_id", score.alias("score"))
