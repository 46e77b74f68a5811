"""Conversations as tables of messages: what still fits the model's window (W4), which tool
calls are open (J9), and what may be stored of a buyer's message (T11).

Everything is an aggregate per conversation joined back to its messages, or a top-n by
position; a conversation of any length is never one row or one Python group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Tools by the label shown while they run.
ORDER_TOOLS, ORDER_LABEL = ("list_my_orders", "get_my_order"), "Consultando tus pedidos…"
CATALOG_TOOLS, CATALOG_LABEL = ("search_products", "get_product", "check_stock"), "Consultando catálogo…"


def trim_history(messages: DataFrame, max_messages: int = 40) -> DataFrame:
    """The messages of each conversation that go to the model.

    The last ``max_messages`` (a leading system message is one of them and always stays),
    from the first human message among them on: so a tool's result never stands without its
    call.  If there is no human message among them, all from the last human one on; without
    any human message only the leading system message.  ``turn`` is unique in a conversation.
    """
    if max_messages < 1:
        raise ValueError("max_messages must be positive")
    facts = messages.groupBy("conv_id").agg(
        F.min_by(F.struct("turn", "type"), "turn").alias("head"), F.max(F.when(F.col("type") == "human", F.col("turn"))).alias("last_human"))
    facts = facts.select("conv_id", "last_human", F.when(F.col("head.type") == "system", F.col("head.turn")).alias("system_turn"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    tail = messages.select("conv_id", "turn", "type").withColumn("place", place).where(F.col("place") <= max_messages)
    fits = F.col("place") <= max_messages - F.col("system_turn").isNotNull().cast("int")
    first = (tail.where("type = 'human'").join(facts, "conv_id").where(fits).groupBy("conv_id").agg(F.min("turn").alias("first")))
    cut = facts.join(first, "conv_id", "left").select("conv_id", "system_turn", F.coalesce("first", "last_human").alias("cut"))
    stays = F.coalesce(F.col("turn") >= F.col("cut"), F.lit(False)) | F.coalesce(F.col("turn") == F.col("system_turn"), F.lit(False))
    return messages.join(cut, "conv_id").where(stays).select(*messages.columns)


def pending_tool_calls(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, call_id, name`` for the calls of each conversation's last
    assistant message that no later tool message answers.  A call without an id can't be
    answered.  ``messages``: ``conv_id, turn, type, tool_calls`` (``id, name``),
    ``tool_call_id``."""
    last = (messages.where("type = 'ai'").groupBy("conv_id").agg(F.max("turn").alias("turn")))
    calls = (messages.where("type = 'ai'").join(last, ["conv_id", "turn"], "left_semi")
             .select("conv_id", "turn", F.explode("tool_calls").alias("c")).select("conv_id", "turn", F.col("c.id").alias("call_id"), "c.name"))
    done = messages.where("type = 'tool' AND tool_call_id <> ''").select(
        F.col("conv_id").alias("d_conv"), F.col("turn").alias("d_turn"), F.col("tool_call_id").alias("d_id"))
    return calls.join(done, (F.col("conv_id") == F.col("d_conv")) & (F.col("call_id") == F.col("d_id")) & (F.col("d_turn") > F.col("turn")),
                      "left_anti")


def pending_label(pending: DataFrame) -> DataFrame:
    """``conv_id, label``: what a conversation with open calls shows; orders come first, other
    tools show nothing (NULL)."""
    has_orders, has_catalog = (F.max(F.col("name").isin(*names)) for names in (ORDER_TOOLS, CATALOG_TOOLS))
    return pending.groupBy("conv_id").agg(F.when(has_orders, ORDER_LABEL).when(has_catalog, CATALOG_LABEL).alias("label"))


def keep_human_input(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected).  Only messages that the buyer may send (type ``human`` or role
    ``user``) are kept, with nothing but their id, redacted text and original length; other
    types are rejected.  ``messages``: ``conv_id, turn, type, role, content`` (a text) or
    ``blocks`` (content as blocks, N13)."""
    blocks = F.col("blocks") if "blocks" in messages.columns else F.lit(None).cast("array<struct<type:string,text:string>>")
    role = F.col("role") if "role" in messages.columns else F.lit(None).cast("string")
    text = F.coalesce(F.when(blocks.isNotNull(), T.text_of_blocks(blocks)), F.col("content"), F.lit(""))
    ours = F.coalesce(F.col("type") == "human", F.lit(False)) | F.coalesce(role == "user", F.lit(False))
    kept = messages.where(ours).select("conv_id", "turn", text.alias("_t")).select(
        "conv_id", "turn", F.lit("human").alias("type"), T.redact_pii("_t").alias("text"), F.length("_t").alias("original_length"))
    return kept, messages.where(~ours).select("conv_id", "turn", "type", F.lit("not_human").alias("error"))
