"""Open JSON documents: a classifier's answer (A12) and cleaning by field name.

A document is taken apart into one row per leaf, with the path that leads to it; leaves are
changed by column functions; and the document is put together again bottom-up, a level at a
time.  No document is a Python object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import materialize
from .domain import CHAT, OUTSIDE, TOPIC_RES

CHOICES = (*TOPIC_RES, CHAT, OUTSIDE)
# Fields by what may happen to them, and the marks left.
FREE_TEXT = ("title", "description", "titulo", "descripcion")
ID_FIELDS = ("id", "key", "product_id", "order_id", "action_id", "creado")
PRIVATE_FIELDS = ("token", "authorization", "x-mcp-internal-token", "api_key", "cloudflare_api_token", "cloudflare_account_id",
                  "account_id", "accountid")
PRIVATE_PREFIX = "cf-aig-"
OMITTED = "[texto omitido]"


# -------------------------------------------------------------------------------------- A12
def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _probability(v: Column) -> Column:
    """A finite number from 0 to 1; truth values and texts are none."""
    number = _kind(v).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")
    x = F.when(number, F.try_variant_get(v, "$", "double"))
    return F.when(x.between(0, 1), x)


def parse_classifier(answers: DataFrame, minimum: float = 0.5, body: str = "body") -> DataFrame:
    """``answers`` with ``valid``, ``category``, ``confidence``, ``in_domain_probability``,
    ``allowed`` and ``error`` (``invalid_response`` or NULL).

    ``body`` is JSON; its fields may stand in ``result``.  It is valid if ``success`` is absent or
    true, the choice is known, confidence and every probability are numbers from 0 to 1, all
    probabilities are of known choices, the choice among them, and so is the second answer, which
    is a number or an object with ``noul`` or ``probability``.  Allowed: not outside the
    domain, and a second answer of at least ``minimum``.
    """
    x = answers.withColumn("_v", F.try_parse_json(F.col(body)))

    def at(path: str) -> Column:
        return F.try_variant_get("_v", path, "variant")

    whole = F.startswith(F.coalesce(F.schema_of_variant("_v"), F.lit("")), F.lit("OBJECT"))
    wrapped = at("$.result").isNotNull()
    success = at("$.success").isNull() | ((_kind(at("$.success")) == "BOOLEAN") & F.try_variant_get("_v", "$.success", "boolean"))
    x = x.withColumn("_a", F.when(wrapped, at("$.result.answers")).otherwise(at("$.answers")))

    def of(path: str) -> Column:
        return F.try_variant_get("_a", path, "variant")

    choice = F.when(_kind(of("$.categoria.choice")) == "STRING", F.try_variant_get("_a", "$.categoria.choice", "string"))
    options = F.try_variant_get("_a", "$.categoria.probabilities", "map<string,variant>")
    second = of("$.en_dominio")
    inner = F.when(_kind(second) != "OBJECT", second).otherwise(F.coalesce(of("$.en_dominio.noul"), of("$.en_dominio.probability")))
    x = x.select("*", choice.alias("_c"), options.alias("_o"), _probability(of("$.categoria.confidence")).alias("_p"), _probability(inner).alias("_d"))
    entries = F.map_entries("_o")
    fine = (whole & success & F.col("_c").isin(*CHOICES) & F.col("_p").isNotNull() & F.col("_d").isNotNull()
            & F.array_contains(F.map_keys("_o"), F.col("_c"))
            & F.forall(entries, lambda e: e["key"].isin(*CHOICES) & e["value"].isNotNull() & _probability(e["value"]).isNotNull()))
    x = x.withColumn("valid", F.coalesce(fine, F.lit(False)))
    ok = F.col("valid")
    return x.select(*answers.columns, "valid", F.when(ok, F.col("_c")).alias("category"), F.when(ok, F.col("_p")).alias("confidence"),
                    F.when(ok, F.col("_d")).alias("in_domain_probability"),
                    F.when(ok, (F.col("_c") != OUTSIDE) & (F.col("_d") >= minimum)).alias("allowed"), F.when(~ok, "invalid_response").alias("error"))


# --------------------------------------------------------------------------------------- A8
def _tool_text(field: Column, value: Column) -> Column:
    free = F.coalesce(field.isin(*FREE_TEXT), F.lit(False)) & T.detect_injection(value)
    return F.when(free, OMITTED).when(F.coalesce(field.isin(*ID_FIELDS), F.lit(False)), value).otherwise(T.redact_pii(value))


def _trace_text(field: Column, value: Column) -> Column:
    return T.redact_secrets(T.redact_pii(value))


def _private(field: Column) -> Column:
    name = F.lower(F.coalesce(field, F.lit("")))
    return name.isin(*PRIVATE_FIELDS) | name.startswith(PRIVATE_PREFIX)


def sanitize_payload(docs: DataFrame, key: str, payload: str = "payload", trace: bool = False) -> DataFrame:
    """``key, payload`` with every JSON document cleaned by field name.

    For tools: titles and descriptions that hold an injection become ``[texto omitido]``, id
    fields stay as they are, personal data is redacted in all other texts.  With ``trace``:
    private fields become ``[secreto]`` whatever they hold, personal data and credentials
    are redacted in all texts.  An element of a list counts as its list's field.  Numbers and
    truth values stay.  Text that isn't JSON is cleaned as one text.  ``key`` is unique; a NULL
    payload stays NULL.  The result's objects have their fields in alphabetical order.
    """
    spark = docs.sparkSession
    start = docs.select(F.col(key).alias("_k"), F.col(payload).alias("_t"), F.try_parse_json(F.col(payload)).alias("v"))
    plain = _trace_text(F.lit(None), F.col("_t")) if trace else F.when(T.detect_injection("_t"), OMITTED).otherwise(T.redact_pii("_t"))
    loose = start.where(F.col("v").isNull()).select(F.col("_k").alias(key), plain.alias(payload))

    # down: one table per depth, each node with the place of its parent among its siblings' parents
    levels = []
    level = start.where(F.col("v").isNotNull()).select("_k", F.lit("").alias("path"), F.lit("").alias("up"), F.lit(None).cast("string").alias("name"),
                                                       F.lit(0).alias("pos"), F.lit(None).cast("string").alias("field"), "v")
    while True:
        kind = _kind(F.col("v"))
        hidden = _private(F.col("field")) & F.col("name").isNotNull() if trace else F.lit(False)
        level = materialize(level.withColumn("kind", F.when(hidden, "HIDDEN").otherwise(F.coalesce(kind, F.lit("VOID")))), "json-nodes")
        levels.append(level)
        inner = level.where(F.col("kind").isin("OBJECT", "ARRAY"))
        if inner.isEmpty():
            break
        inner.createOrReplaceTempView("_nodes")
        level = spark.sql("""SELECT n._k, concat(n.path, '/', e.pos) AS path, n.path AS up, e.key AS name, e.pos,
          coalesce(e.key, n.field) AS field, e.value AS v FROM _nodes n, LATERAL variant_explode(n.v) e""")
    # up: leaves as JSON text, then each level's texts inside those of the level above; merged,
    # for beside the width the planner gives a variant the texts look small enough to broadcast
    below = None
    for level in reversed(levels):
        raw = F.try_variant_get("v", "$", "string")
        safe = _trace_text(F.col("field"), raw) if trace else _tool_text(F.col("field"), raw)
        leaf = F.when(F.col("kind") == "HIDDEN", F.lit(f'"{T.SECRET_MARK}"')).when(F.col("kind") == "STRING", _quoted(safe)) \
            .otherwise(F.to_json("v"))
        if below is None:
            whole = level.withColumn("json", F.when(F.col("kind") == "OBJECT", "{}").when(F.col("kind") == "ARRAY", "[]").otherwise(leaf))
        else:
            parts = below.groupBy("_k", F.col("up").alias("path")).agg(
                F.array_sort(F.collect_list(F.struct("pos", F.concat(F.when(F.col("name").isNotNull(), F.concat(_quoted(F.col("name")), F.lit(":")))
                                                                     .otherwise(""), F.col("json")).alias("j")))).alias("parts"))
            body = F.coalesce(F.array_join(F.transform("parts", lambda x: x["j"]), ","), F.lit(""))
            whole = level.join(parts.hint("merge"), ["_k", "path"], "left").withColumn("json", F.when(F.col("kind") == "OBJECT", F.concat(F.lit("{"), body, F.lit("}")))
                                                                         .when(F.col("kind") == "ARRAY", F.concat(F.lit("["), body, F.lit("]"))).otherwise(leaf))
        below = whole.select("_k", "path", "up", "name", "pos", "json")
    return below.select(F.col("_k").alias(key), F.col("json").alias(payload)).unionByName(loose)


def _quoted(text: Column) -> Column:
    """A text as a JSON text."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)
