"""Text-guard jobs over corpora.

Each job annotates the corpus row by row with JVM expressions (no shuffle) and, where a
report is wanted, aggregates per language/source/role with partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import materialize

PROMPT_NGRAM = 8


def redact_corpus(df: DataFrame, text: str = "text") -> DataFrame:
    """The corpus with its redacted text and per-kind finding counts."""
    t = F.col(text)
    redacted = T.redact_secrets(T.redact_pii(t))
    marks = {
        "emails": T.EMAIL_MARK, "cards": T.CARD_MARK, "phones": T.PHONE_MARK, "dnis": T.DNI_MARK,
        "secrets": T.SECRET_MARK,
    }
    out = df.withColumn("redacted", redacted)
    changed = F.col("redacted") != F.col(text)
    counts = [F.when(changed, T.count_literal("redacted", m) - T.count_literal(text, m)).when(~changed, 0).alias(name)
              for name, m in marks.items()]
    return out.select("*", *counts, (changed | F.col(text).rlike(T.MARKERS_RE)).alias("has_pii"))


def redaction_summary(annotated: DataFrame, keys=("lang", "source")) -> DataFrame:
    """Per-group report of a redacted corpus."""
    return annotated.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("docs"),
        F.count_if("has_pii").alias("docs_with_pii"),
        *[F.sum(c).cast("bigint").alias(c) for c in ("emails", "cards", "phones", "dnis", "secrets")])


# ------------------------------------------------------------------------------------ T9
def _words(text_col) -> F.Column:
    return T.fold_words(text_col)


def prompt_overlap(texts: DataFrame, references: DataFrame, n: int = PROMPT_NGRAM,
                   text_key: str = "doc_id", ref_key: str = "item_id") -> DataFrame:
    """T9 set form (n-gram contamination): pairs (text, reference) where some ``n``
    consecutive normalised words of the reference occur in the normalised text.

    Occurrence is substring containment in whitespace-normalised text, so the first
    reference word may end a longer text word and the last may begin one; the middle
    ``n - 2`` words must be whole text words.  Each position is one 64-bit hash of its middle
    words; those that a reference has too are kept (an equi-join on the hash, broadcast when the
    references are measured small, split by AQE where a hash is hot), and only their texts
    are folded again to compare the words themselves."""
    if n < 3:
        raise ValueError("n must be >= 3")
    inner = n - 2

    def hashes(df, key, *more):
        return df.select(F.col(key), *more, F.posexplode(T.gram_hashes("text", inner, 1, 1)).alias("at", "h"))

    r = hashes(references.select(ref_key, "text", _words(F.col("text")).alias("w")), ref_key, "w")
    r = r.select(ref_key, "h", F.slice("w", F.col("at") + 1, n).alias("r")).distinct()
    t = hashes(texts, text_key)
    hits = materialize(t.join(r, "h").select(text_key, "at", ref_key, "r"), "gram-hits")
    near = texts.join(hits.select(text_key).distinct(), text_key, "left_semi")
    words = near.select(F.col(text_key), _words(F.col("text")).alias("w"))
    found = hits.join(words, text_key).withColumn("t", F.slice("w", F.col("at") + 1, n))
    same = ((F.slice("t", 2, inner) == F.slice("r", 2, inner)) & F.endswith(F.get("t", F.lit(0)), F.get("r", F.lit(0)))
            & F.startswith(F.get("t", F.lit(n - 1)), F.get("r", F.lit(n - 1))))
    # under coalesce no "is not null" can be derived, which would fold every text below the semi join
    return found.where(F.coalesce(same, F.lit(False))).select(text_key, ref_key).distinct()


# ------------------------------------------------------------------------------ windows
def _conv_order(conv: str = "conv_id", turn: str = "turn") -> Window:
    return Window.partitionBy(conv).orderBy(turn)


def history_window(turns: DataFrame, n: int = 6, ai_chars: int = 300) -> DataFrame:
    """For each human/ai turn, the previous ``n`` human/ai turns (other types skipped),
    assistant text cut to ``ai_chars``; as an ordered array and as ``type: text`` lines.
    The frame is bounded (``n`` rows), so the window keeps a fixed-size buffer."""
    chat = turns.where(F.col("type").isin("human", "ai"))
    item = F.struct("type", F.when(F.col("type") == "ai", F.substring("text", 1, ai_chars))
                    .otherwise(F.col("text")).alias("text"))
    w = _conv_order().rowsBetween(-n, -1)
    hist = chat.withColumn("history", F.collect_list(item).over(w))
    return hist.select(
        "conv_id", "turn", "type",
        F.size("history").alias("history_size"),
        F.array_join(F.transform("history", lambda h: F.concat(h["type"], F.lit(": "), h["text"])), "\n")
        .alias("history_text"))


def previous_assistant(turns: DataFrame) -> DataFrame:
    """The last ai turn's text before each turn (NULL at the start)."""
    w = _conv_order().rowsBetween(Window.unboundedPreceding, -1)
    ai = F.when(F.col("type") == "ai", F.col("text"))
    return turns.select("conv_id", "turn", "type", F.last(ai, ignorenulls=True).over(w).alias("previous_ai_text"))


def human_turn_index(turns: DataFrame) -> DataFrame:
    """Running count of human turns (the exchange a message belongs to) and of the ai
    messages in it so far."""
    w = _conv_order().rowsBetween(Window.unboundedPreceding, 0)
    x = turns.withColumn("exchange", F.count_if(F.col("type") == "human").over(w))
    w2 = Window.partitionBy("conv_id", "exchange").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("ai_since_human", F.count_if(F.col("type") == "ai").over(w2))


def tool_iterations(turns: DataFrame) -> DataFrame:
    """For each turn, its exchange (running count of human turns) and how many ai
    messages with tool calls (``tool_calls`` true) the exchange has had so far."""
    w = _conv_order().rowsBetween(Window.unboundedPreceding, 0)
    x = turns.withColumn("exchange", F.count_if(F.col("type") == "human").over(w))
    w2 = Window.partitionBy("conv_id", "exchange").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    calls = (F.col("type") == "ai") & F.coalesce(F.col("tool_calls"), F.lit(False))
    return x.withColumn("tool_iterations", F.count_if(calls).over(w2))


def transcript(turns: DataFrame) -> DataFrame:
    """human/ai rows with non-empty text; the position is counted per type before
    empty rows are dropped; id: the message's own ``id``, if there is one, else
    ``agent-message:{type}:{position}``."""
    own = F.col("id") if "id" in turns.columns else F.lit(None).cast("string")
    chat = turns.where(F.col("type").isin("human", "ai"))
    pos = F.row_number().over(Window.partitionBy("conv_id", "type").orderBy("turn")) - 1
    x = chat.withColumn("position", pos)
    return x.where(F.length(F.regexp_replace("text", r"^\s+|\s+$", "")) > 0).select(
        "conv_id", "turn", "type", "position",
        F.coalesce(F.nullif(own, F.lit("")), F.concat(F.lit("agent-message:"), F.col("type"), F.lit(":"),
                                                      F.col("position").cast("string"))).alias("id"))
