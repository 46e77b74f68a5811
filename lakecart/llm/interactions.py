"""Filter interaction audit by min-plus removal ranks (operator 12).

Five filters are applied in every one of their 120 orders; which filter removes a document
depends only on the set of filters it fails.  So the texts are read once, each becoming a
failure mask, and documents are counted by part and mask.  On those counts (32 masks a part)
the removal step of every mask in every order is the min-plus product of the mask matrix
(0 where the filter fails, infinity where it passes) and the inverse permutations (the
place of each filter in each order): the least place of a filter that the mask fails.
Weighted counts are scattered to these steps; what fails a filter but is removed
earlier is redundant there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
_N = len(FILTERS)
_NEVER = 99

ORDERS = np.array(list(permutations(range(_N))))
#: place of each filter in each order
PLACES = np.argsort(ORDERS, axis=1)
#: 0 where a mask fails a filter, else never
FAILS = (np.arange(1 << _N)[:, None] >> np.arange(_N) & 1).astype(bool)

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def removal_steps() -> np.ndarray:
    """Min-plus product: for each mask and order the step that removes, or ``_NEVER``."""
    mask = np.where(FAILS, 0, _NEVER)
    return np.minimum((mask[:, None, :] + PLACES[None, :, :]).min(axis=2), _NEVER)


def audit_counts(n: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """Order by step counts from the documents (all, good, toxic) of each of the 32 masks."""
    step = removal_steps()
    mask, order = np.nonzero(step < _N)
    at = (order, step[mask, order])
    out = {}
    for name, weight in (("removed", n), ("good_lost", good), ("toxic_lost", toxic)):
        out[name] = np.zeros(ORDERS.shape, np.int64)
        np.add.at(out[name], at, weight[mask])
    out["kept"] = n.sum() - np.cumsum(out["removed"], axis=1)
    out["redundant"] = (n @ FAILS)[ORDERS] - out["removed"]
    out["unique_fails"] = n[1 << np.arange(_N)][ORDERS]
    by_filter = np.zeros(_N, np.int64)
    np.add.at(by_filter, ORDERS, out["removed"])
    out["shapley"] = by_filter[ORDERS]
    return out


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["".join(FILTERS[f] for f in order) for order in ORDERS]
    for batch in batches:
        for row in batch.to_pylist():
            weights = np.zeros((3, 1 << _N), np.int64)
            for m in row["masks"]:
                weights[:, m["mask"]] += (m["n"], m["good"], m["toxic"])
            found = audit_counts(*weights)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["part"]] * ORDERS.size), pa.array(np.repeat(names, _N)),
                 pa.array(np.tile(np.arange(1, _N + 1, dtype=np.int32), len(ORDERS)))]
                + [pa.array(found[c].ravel()) for c in COUNTS],
                ["part", "filter_order", "step", *COUNTS])


def text_mask(text: Column) -> Column:
    """Bits of filters A to D that ``text`` (never null) fails."""
    words = F.array_remove(F.split(text, r"[ \t\n\x0B\f\r]+"), "")
    n = F.size(words)
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = (n < 100, F.size(F.array_distinct(words)) * 100 < n * 80, capitals * 100 > F.length(text) * 10,
             text.rlike("[#$%&*|]"))
    bits = [f.cast("int") * (1 << i) for i, f in enumerate(fails)]
    return sum(bits[1:], bits[0])


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents of each part (lang) by the filters they fail.

    Filter E, a text equal to that of a smaller ``doc_id`` anywhere in the table, compares
    128-bit digests.  Rows of an equal digest are counted by id first, and only the smallest
    id of each digest is looked up again, by digest and id: the copies of one text never
    meet in one task.  A row without an id equals no smaller id; rows that share the
    smallest id of a text all pass E.  A label row counts if any of its id's rows has it.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.md5(text)).alias("digest"),
                       text_mask(text).alias("mask"))
    marks = (labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id")
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"),
                  F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    joined = rows.join(marks, "doc_id", "left").select(
        "doc_id", "part", "digest", "mask", F.coalesce("good", F.lit(0)).alias("good"),
        F.coalesce("toxic", F.lit(0)).alias("toxic"))
    first = (rows.where(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
             .withColumn("first", F.lit(True)))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return (joined.join(first, ["digest", "doc_id"], "left")
            .select("part", (F.col("mask") + copy.cast("int") * 16).alias("mask"), "good", "toxic")
            .groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"),
                                         F.sum("toxic").alias("toxic")))


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, zeros included.

    ``docs``: ``doc_id, text, lang``; ``labels``: ``doc_id, quality, toxic``.  A null text is
    empty (it fails A alone, and E if a smaller id's text is empty too), a null lang is the
    part of the empty string, a null label is no label.  Every row of a repeated ``doc_id``
    counts.  An empty table has no parts and gives no rows.  Other columns are not read.
    """
    masks = mask_counts(docs, labels)
    return (masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
            .mapInArrow(_audit, SCHEMA))


SQL = """
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         [x FOR x IN string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+') IF x <> ''] AS words
  FROM documents),
f AS (
  SELECT w.part, len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS d, w.doc_id > min(w.doc_id) OVER (PARTITION BY t) AS e,
         coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS bad
  FROM w LEFT JOIN labels l ON l.doc_id = w.doc_id),
g AS (
  SELECT part, a, b, c, d, e, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (bad) AS n_bad
  FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
o AS (
  SELECT p.l || q.l || r.l || s.l || u.l AS filter_order FROM x p, x q, x r, x s, x u
  WHERE len(list_distinct([p.l, q.l, r.l, s.l, u.l])) = 5),
k AS (
  SELECT o.filter_order, i.step, substr(o.filter_order, i.step, 1) AS letter
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) i),
m AS (
  SELECT k.*, g.*, least(CASE WHEN a THEN strpos(filter_order, 'A') END, CASE WHEN b THEN strpos(filter_order, 'B') END,
                   CASE WHEN c THEN strpos(filter_order, 'C') END, CASE WHEN d THEN strpos(filter_order, 'D') END,
                   CASE WHEN e THEN strpos(filter_order, 'E') END) AS gone,
         CASE letter WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS fails,
         a::INT + b::INT + c::INT + d::INT + e::INT AS n_fails
  FROM k, g),
r AS (
  SELECT part, filter_order, step, letter,
         sum(CASE WHEN gone IS NULL OR gone > step THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN gone = step THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN fails AND gone < step THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN fails AND n_fails = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN gone = step THEN n_good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN gone = step THEN n_bad ELSE 0 END)::BIGINT AS toxic_lost
  FROM m GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM r
"""
