"""Toxicity classification by FTRL-proximal logistic regression (operator 7).

Features of a text are its distinct words, word pairs and skip-grams (words with one word
between them), hashed to 32 bits.  FTRL-proximal with per-coordinate rates and L1 keeps
few weights above zero; only those are broadcast, as sorted slots and values.

The fit is bounded by ``max_rows`` labelled rows, chosen by a hash of their id, so one task
can walk them in order, which fits better than averaging over ``shards`` of them (with more,
a coordinate's state after each epoch is the mean over the shards that touched it).  A
feature must occur in ``min_docs`` rows of a shard.  Scoring
covers all texts, whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_fraction, materialize
from .textvec import ALNUM_WORDS, Words, groups, list_array, ngram_hash, release, text_buffer

#: (words, words skipped after the first) of each kind of feature.
KINDS = ((1, 0), (2, 0), (2, 1))
SIEVE_BITS = 20


@dataclass
class Model:
    """``slots``: sorted feature hashes with a weight that is not zero."""

    slots: np.ndarray
    weights: np.ndarray
    bias: float


@dataclass
class Rates:
    alpha: float = 4.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.0

    def weight(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The closed-form proximal step of each coordinate."""
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0.0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)


def features(texts: pa.Array):
    """Yield ``(first text, number of texts, owner, slot)`` for groups of texts: an entry
    for every feature of a text, with repeats."""
    data, offsets = text_buffer(texts)
    for a, b in groups(offsets):
        words = Words(data, offsets[a: b + 1], ALNUM_WORDS)
        owner = words.owner()
        owners, slots = [], []
        for n, skip in KINDS:
            h = ngram_hash(words.hash, n, skip)
            span = n + skip
            same = owner[: len(h)] == owner[span - 1: span - 1 + len(h)]
            owners.append(owner[: len(h)][same])
            slots.append((h[same] >> np.uint64(32)).astype(np.uint32))
        yield a, b - a, np.concatenate(owners), np.concatenate(slots)


def feature_sets(text: Column) -> Column:
    """``array<int>``: a text's distinct feature slots."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def run(texts: pa.Array) -> pa.Array:
        slots, lengths = [], []
        for _, n, owner, slot in features(texts):
            key = np.unique(owner.astype(np.uint64) << np.uint64(32) | slot)
            slots.append((key & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            lengths.append(np.bincount((key >> np.uint64(32)).astype(np.int64), minlength=n))
        flat = np.concatenate(slots) if slots else np.empty(0, np.uint32)
        return list_array(flat.view(np.int32), np.concatenate(lengths) if lengths else np.empty(0, np.int64), pa.int32())

    return run(text)


def _epoch(table: pa.Table, state: tuple | None, rates: Rates, min_docs: int) -> pa.Table:
    """One pass of a shard over its rows in the order of their hash."""
    order = pc.sort_indices(table, [("u", "ascending"), ("doc_id", "ascending")]).to_numpy()
    y = table.column("label").to_numpy()[order]
    lists = table.column("slots").combine_chunks()
    del table
    flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint32)
    offsets = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
    frequent = []
    for high in range(16):  # a sixteenth of the slots at a time
        ranked = np.sort(flat[flat >> np.uint32(28) == high])
        ahead = ranked[min_docs - 1:]  # a slot occurs min_docs times if the place that far on holds it too
        frequent.append(np.unique(ahead[ahead == ranked[: len(ahead)]]))
    slots = np.concatenate(frequent)
    del ranked, ahead, frequent
    ends = np.append(slots, np.uint32(0))  # a place past the last slot holds no feature
    z, n = np.zeros(len(slots) + 1), np.zeros(len(slots) + 1)  # the last coordinate is the bias
    if state is not None:
        old, old_z, old_n, bias = state
        at = np.searchsorted(old, slots)
        hit = (at < len(old)) & (old[np.minimum(at, len(old) - 1)] == slots) if len(old) else np.zeros(len(slots), bool)
        z[:-1][hit], n[:-1][hit] = old_z[at[hit]], old_n[at[hit]]
        z[-1], n[-1] = bias
    for row, label in zip(order, y, strict=True):
        ids = flat[offsets[row]: offsets[row + 1]]
        at = np.searchsorted(slots, ids)
        x = np.append(at[(at < len(slots)) & (ends[at] == ids)], len(slots))
        weight = rates.weight(z[x], n[x])
        if x[-1] == len(slots):  # the bias has no L1
            weight[-1] = -z[-1] / ((rates.beta + np.sqrt(n[-1])) / rates.alpha)
        g = 1.0 / (1.0 + np.exp(-np.clip(weight.sum(), -30, 30))) - label
        rate = (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / rates.alpha
        z[x] += g - rate * weight
        n[x] += g * g
    release()
    out = [slots.astype(np.int64), z[:-1], n[:-1]]
    return pa.table({"slot": pa.array(np.append(out[0], -1)), "z": pa.array(np.append(out[1], z[-1])),
                     "n": pa.array(np.append(out[2], n[-1]))})


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 10_000, shards: int = 1, epochs: int = 5,
        min_docs: int = 4, rates: Rates | None = None) -> Model:
    """Weights from ``labels`` (``doc_id, label``) and the texts of ``docs``.  Rows with a
    null label or id are no examples; of several labels of an id the largest counts;
    without examples all weights are zero."""
    rates = rates or Rates()
    spark = docs.sparkSession
    named = (labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.max("label").cast("int").alias("label")))
    total = named.count()
    if total == 0:
        return Model(np.empty(0, np.uint32), np.empty(0), 0.0)
    u = hash_fraction("doc_id", F.lit("fit"))
    chosen = (named.withColumn("u", u).where(F.col("u") * total <= 1.05 * max_rows)
              .orderBy("u", "doc_id").limit(max_rows))
    rows = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # max_rows bounds it
            .select("doc_id", "label", "u", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"),
                    feature_sets(F.col("text")).alias("slots")))
    rows = materialize(rows, "toxicity-sample")
    state = None
    for _ in range(epochs):
        shared = spark.sparkContext.broadcast(state)

        def run(table: pa.Table) -> pa.Table:
            return _epoch(table, shared.value, rates, min_docs)  # noqa: B023  used before the next epoch

        met = (rows.groupBy("shard").applyInArrow(run, "slot long, z double, n double")
               .groupBy("slot").agg(F.avg("z").alias("z"), F.avg("n").alias("n")).toArrow().sort_by("slot"))
        slot, z, n = (met.column(c).to_numpy() for c in ("slot", "z", "n"))
        if len(slot) == 0:
            return Model(np.empty(0, np.uint32), np.empty(0), 0.0)
        state = (slot[1:].astype(np.uint32), z[1:], n[1:], (z[0], n[0]))
        shared.unpersist()
    slots, z, n, (bias_z, bias_n) = state
    weights = rates.weight(z, n)
    return Model(slots[weights != 0], weights[weights != 0],
                 float(-bias_z / ((rates.beta + np.sqrt(bias_n)) / rates.alpha)))


def score(spark: SparkSession, text: Column, model: Model) -> Column:
    """Probability that a text is labelled 1; a null or empty text has the bias alone."""
    shared = spark.sparkContext.broadcast(model)  # weights of a bounded sample, thinned by L1

    @F.arrow_udf(T.DoubleType())
    def run(texts: pa.Array) -> pa.Array:
        m = shared.value
        sieve = np.zeros(1 << SIEVE_BITS, bool)
        sieve[m.slots >> np.uint32(32 - SIEVE_BITS)] = True
        total = np.full(len(texts), m.bias)
        for a, n, owner, slot in features(texts) if len(m.slots) else ():
            near = sieve[slot >> np.uint32(32 - SIEVE_BITS)]
            owner, slot = owner[near], slot[near]
            at = np.minimum(np.searchsorted(m.slots, slot), len(m.slots) - 1)
            hit = m.slots[at] == slot
            key = np.unique(owner[hit].astype(np.int64) * len(m.slots) + at[hit])
            total[a: a + n] += np.bincount(key // len(m.slots), m.weights[key % len(m.slots)], minlength=n)
        release()
        return pa.array(1.0 / (1.0 + np.exp(-np.clip(total, -30, 30))))

    return run(text)


def classify(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """``docs`` with ``toxic_score`` (0 to 1) and ``toxic_predicted`` (1 from
    ``threshold`` on).  One row per input row; columns of these names are replaced."""
    model = fit(train_docs, labels, **options)
    base = docs.drop("toxic_score", "toxic_predicted")
    out = base.withColumn("toxic_score", score(docs.sparkSession, F.col("text"), model))
    return out.withColumn("toxic_predicted", (F.col("toxic_score") >= threshold).cast("int"))
