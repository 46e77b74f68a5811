"""The preference rules (T12) as a stream: the same steps, with each owner's slots as
state.  Rows of a micro-batch are taken in log order; a log whose files come in order ends
as the batch job does, and emits the same results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators import proposals

_SLOTS = T.StructType([T.StructField("slots", T.ArrayType(T.StructType([
    T.StructField("n", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())])))])


def _step(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    slots = {n: (k, v) for n, k, v in state.get[0]} if state.exists else proposals.start_preferences()
    rows = pd.concat(list(pdfs)).sort_values(["occurred_at", "event_id"])
    out = []
    for row in rows.astype(object).where(rows.notna(), None).to_dict("records"):
        out.append({"owner": key[0], "event_id": row["event_id"]} | proposals.step_preferences(slots, row))
    state.update(([(n, k, v) for n, (k, v) in slots.items()],))
    yield pd.DataFrame(out)


def stream_preferences(events: DataFrame) -> DataFrame:
    """``owner, event_id, result, slot`` of every event (``operators.proposals.preference_state``)."""
    owner = events.schema["owner"].dataType.simpleString()
    event = events.schema["event_id"].dataType.simpleString()
    return proposals.checked_preferences(events).groupBy("owner").applyInPandasWithState(
        _step, f"owner {owner}, event_id {event}, result string, slot string", _SLOTS, "append", GroupStateTimeout.NoTimeout)
