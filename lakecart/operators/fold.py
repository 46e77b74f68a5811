"""Sequential rules with a small state per key.

Rows are hash-partitioned by key, sorted by key and log order, and walked in Arrow batches;
what is in memory is one key's state, whose size the rules bound (20 cart lines, 20
preferences, 50 results), never a key's rows.  The rules are plain functions
``step(state, row) -> result``, so a stream can hold the same states (``streaming.folds``).
A key's rows are one task's: what a row does depends on all rows of the key before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold_rows(df: DataFrame, key: str, order: list[str], start: Callable[[dict], dict], step: Callable[[dict, dict], dict],
              columns: list[str], results: str, final: Callable[[dict], list[dict]] | None = None) -> DataFrame:
    """``key`` and ``columns`` of every row with what ``step`` returns for it.

    ``start(row)`` makes a key's state from its first row.  ``results``: DDL of the fields that
    ``step`` returns.  With ``final`` the rows are those it makes of each key's last state.
    """
    kept = [key, *([] if final else columns)]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), results])
    names = [part.split()[0] for part in _fields(results)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, out = None, None, []

        def frame(rows):
            return pd.DataFrame(rows, columns=[*kept, *names], dtype=object)

        for pdf in batches:
            for row in pdf.astype(object).where(pdf.notna(), None).to_dict("records"):
                if state is None or row[key] != now:
                    if final and state is not None:
                        out += [{key: now} | r for r in final(state)]
                    now, state = row[key], start(row)
                result = step(state, row)
                if not final:
                    out.append({c: row[c] for c in kept} | result)
            yield frame(out)
            out = []
        if final and state is not None:
            yield frame([{key: now} | r for r in final(state)])

    return df.repartition(F.col(key)).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def _fields(ddl: str) -> list[str]:
    """Top-level fields of a DDL text."""
    out, depth, word = [], 0, ""
    for ch in ddl:
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and not depth:
            out.append(word.strip())
            word = ""
        else:
            word += ch
    return [*out, word.strip()]
