"""Registered text-guard and conversation-window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import guard
from ..registry import register
from .views import Views, sql_ctes


@register("t1_redaction_summary")
def t1(spark, sf_dir):
    """No SQL oracle: the rules need look-around regexes and a Luhn check.  Tests hold the
    redacted texts against a brute-force version."""
    return guard.redaction_summary(guard.redact_corpus(Views(spark, sf_dir).documents))


@register("t1_redacted_texts")
def t1_texts(spark, sf_dir):
    """Every document's redacted text and whether it held personal data."""
    return guard.redact_corpus(Views(spark, sf_dir).documents).select("doc_id", "redacted", "has_pii")


_FOLD = "replace(strip_accents(lower({c})), 'ß', 'ss')"


def _grams_sql(table, key, n=8):
    inner = n - 2
    return f"""SELECT DISTINCT k, array_to_string(w[i + 1:i + {inner}], ' ') AS mid, w[i] AS f, w[i + {n - 1}] AS l
  FROM (SELECT k, w, unnest(generate_series(1, len(w) - {n - 1})) AS i
        FROM (SELECT {key} AS k, list_filter(regexp_split_to_array({_FOLD.format(c='text')}, '\\s+'), lambda x: x <> '') AS w
              FROM {table}) WHERE len(w) >= {n})"""


@register("t9_prompt_overlap", sql_ctes("""SELECT DISTINCT d.k AS doc_id, b.k AS item_id
FROM dg d JOIN bg b ON d.mid = b.mid
WHERE ends_with(d.f, b.f) AND starts_with(d.l, b.l)""", (), [("dg", _grams_sql("documents", "doc_id")),
                                                            ("bg", _grams_sql("benchmark", "item_id"))]))
def t9(spark, sf_dir):
    v = Views(spark, sf_dir)
    return guard.prompt_overlap(v.documents, v.benchmark)


_CHAT = ("chat", "SELECT * FROM v_turns WHERE type IN ('human', 'ai')")


@register("w1_history_window", sql_ctes("""SELECT conv_id, turn, type,
  CAST(coalesce(len(list(type) OVER w), 0) AS INTEGER) AS history_size,
  coalesce(array_to_string(list(type || ': ' || CASE WHEN type = 'ai' THEN substr(text, 1, 300) ELSE text END) OVER w,
    chr(10)), '') AS history_text
FROM chat WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)""",
                                        ["v_turns"], [_CHAT]))
def w1(spark, sf_dir):
    return guard.history_window(Views(spark, sf_dir).v_turns)


@register("w2_previous_assistant", sql_ctes("""SELECT conv_id, turn, type,
  last_value(CASE WHEN type = 'ai' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_ai_text
FROM v_turns""", ["v_turns"]))
def w2(spark, sf_dir):
    return guard.previous_assistant(Views(spark, sf_dir).v_turns)


@register("w5_exchange_index", sql_ctes("""SELECT conv_id, turn, type, text, exchange,
  CAST(sum(CASE WHEN type = 'ai' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, exchange ORDER BY turn
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS ai_since_human
FROM (SELECT *, CAST(sum(CASE WHEN type = 'human' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS exchange FROM v_turns)""", ["v_turns"]))
def w5_index(spark, sf_dir):
    return guard.human_turn_index(Views(spark, sf_dir).v_turns)


_CALLS = ("calls", "SELECT *, length(text) % 3 = 0 AS tool_calls FROM v_turns")


@register("w5_tool_iterations", sql_ctes("""SELECT conv_id, turn, type, exchange,
  CAST(sum(CASE WHEN type = 'ai' AND tool_calls THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, exchange ORDER BY turn
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS tool_iterations
FROM (SELECT *, CAST(sum(CASE WHEN type = 'human' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS exchange FROM calls)""", ["v_turns"], [_CALLS]))
def w5(spark, sf_dir):
    t = Views(spark, sf_dir).v_turns.withColumn("tool_calls", F.length("text") % 3 == 0)
    return guard.tool_iterations(t).select("conv_id", "turn", "type", "exchange", "tool_iterations")


@register("t13_transcript", sql_ctes("""SELECT conv_id, turn, type, position,
  CASE WHEN turn % 5 = 2 THEN 'own-' || CAST(turn AS VARCHAR)
    ELSE 'agent-message:' || type || ':' || CAST(position AS VARCHAR) END AS id
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id, type ORDER BY turn) - 1 AS INTEGER) AS position
  FROM chat) WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 0""", ["v_turns"], [_CHAT]))
def t13(spark, sf_dir):
    own = F.when(F.col("turn") % 5 == 2, F.concat(F.lit("own-"), F.col("turn").cast("string")))
    return guard.transcript(Views(spark, sf_dir).v_turns.withColumn("id", own))
