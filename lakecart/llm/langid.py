"""Language identification by string kernels (operator 3).

Two texts are as similar as their sets of character n-grams overlap: the blended-spectrum
presence kernel ``k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|)`` over all n-grams of 1 to
3 characters (hashed to a fixed space).  Nyström landmarks turn it into ``m`` features,
one-versus-rest kernel ridge regression is solved on them, and texts are scored in
batches: presence matrix times landmark matrix, then times class weights.

Only the fit is bounded: ``per_language`` labelled texts and ``landmarks`` of them for
each language, chosen by a hash of their id, at most ``max_rows`` in all.  Their packed
n-gram bits (4 KB a text) are what reaches the driver.  Scoring covers all texts, whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .common import hash_fraction
from .textvec import groups, release, text_buffer

BITS = 15
DIM = 1 << BITS
ORDERS = (1, 2, 3)
UNDETERMINED = "und"
SHARPNESS = 4.0
BATCH = 16

PREDICTION = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
_letter = regex.compile(r"\p{L}").search


def gram_slots(text: str) -> list[np.ndarray]:
    """Slots of a text's character n-grams, an array for each order (with repeats)."""
    chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out = []
    for n in ORDERS:
        m = len(chars) - n + 1
        if m <= 0:
            break
        h = chars[:m] + np.uint64(n << 40)
        for j in range(1, n):
            h = h * np.uint64(0x100000001B3) + chars[j: j + m]
        out.append(((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64))
    return out


def presence(texts: list[str]) -> np.ndarray:
    """0/1 matrix (float32) of texts by n-gram slots."""
    out = np.zeros((len(texts), DIM), np.float32)
    for row, text in zip(out, texts, strict=True):
        for slots in gram_slots(text):
            row[slots] = 1.0
    return out


@dataclass
class Model:
    """``packed``: landmarks' n-gram bits; ``weights``: landmarks by languages."""

    languages: list[str]
    packed: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def scorer(self):
        marks = np.unpackbits(self.packed, axis=1)[:, :DIM].astype(np.float32)
        columns, sizes = np.ascontiguousarray(marks.T), np.maximum(marks.sum(1), 1.0)

        def score(texts: list[str]) -> np.ndarray:
            bits = presence(texts)
            kernel = (bits @ columns) / np.sqrt(np.maximum(bits.sum(1), 1.0)[:, None] * sizes[None, :])
            return kernel.astype(np.float64) @ self.weights + self.bias

        return score


def solve(bits: np.ndarray, langs: list[str], n_marks: int, ridge: float) -> Model:
    """Nyström features of the sample and ridge regression, one language against the rest."""
    names = sorted(set(langs))
    y = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    x = np.unpackbits(bits, axis=1)[:, :DIM].astype(np.float32)
    sizes = np.maximum(x.sum(1), 1.0)
    taken = np.zeros(len(names), int)
    marks = []
    for i, lang in enumerate(langs):  # the sample's order is the order of the hash
        k = names.index(lang)
        if taken[k] < n_marks:
            taken[k] += 1
            marks.append(i)
    k_nm = ((x @ x[marks].T) / np.sqrt(sizes[:, None] * sizes[marks][None, :])).astype(np.float64)
    values, vectors = np.linalg.eigh(k_nm[marks])
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = k_nm @ root
    center, level = phi.mean(0), y.mean(0)
    gram = (phi - center).T @ (phi - center) + ridge * len(phi) * np.eye(phi.shape[1])
    w = np.linalg.solve(gram, (phi - center).T @ (y - level))
    return Model(names, bits[marks], root @ w, level - center @ w)


def fit(train: DataFrame, per_language: int = 400, landmarks: int = 24, max_rows: int = 4000,
        max_languages: int = 500, ridge: float = 1e-4) -> Model | None:
    """Model from ``doc_id, text, lang`` rows; rows without a language or a letter are no
    examples, nor are languages beyond the ``max_languages`` most frequent.  None if no
    example is left."""
    named = train.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")
    sizes = (train.where(F.col("lang").isNotNull()).groupBy(F.col("lang").alias("its_lang")).agg(F.count("*").alias("n"))
             .orderBy(F.desc("n"), "its_lang").limit(max_languages))
    quota = max(1, min(per_language, max_rows // max(1, sizes.count())))
    order = hash_fraction("doc_id", "lang")
    near = (named.withColumn("u", order)
            .join(F.broadcast(sizes), F.col("lang") == F.col("its_lang"))  # max_languages bounds it
            .where(F.col("u") * F.col("n") <= 2.0 * quota + 20))
    ranked = near.withColumn("r", F.row_number().over(W.Window.partitionBy("lang").orderBy("u", F.xxhash64("text"))))

    @F.arrow_udf(T.BinaryType())
    def pack(texts: pa.Array) -> pa.Array:
        return pa.array([np.packbits(presence([t])[0] > 0).tobytes() for t in texts.to_pylist()], pa.binary())

    rows = (ranked.where(F.col("r") <= quota).select("lang", "u", pack("text").alias("bits"))
            .orderBy("u", "lang", F.xxhash64("bits")).collect())
    if not rows:
        return None
    bits = np.stack([np.frombuffer(bytes(r["bits"]), np.uint8) for r in rows])
    return solve(bits, [r["lang"] for r in rows], landmarks, ridge)


def predict(spark: SparkSession, text: Column, model: Model | None) -> Column:
    """Struct ``lang_pred, score``: ``und`` and 0 where a text is null or has no letter
    (or where nothing could be learnt)."""
    shared = spark.sparkContext.broadcast(model)  # landmarks by 4 KB: bounded by fit's parameters

    @F.arrow_udf(PREDICTION)
    def run(texts: pa.Array) -> pa.Array:
        m = shared.value
        langs, scores = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
        score = m.scorer() if m else None
        _, offsets = text_buffer(texts)
        for a, b in groups(offsets) if m else ():
            part = texts.slice(a, b - a).to_pylist()
            known = [i for i, t in enumerate(part) if t and _letter(t)]
            for k in range(0, len(known), BATCH):
                some = known[k: k + BATCH]
                f = score([part[i] for i in some])
                p = np.exp(SHARPNESS * (f - f.max(1, keepdims=True)))
                best = p.argmax(1)
                scores[np.array(some) + a] = p.max(1) / p.sum(1)
                langs[np.array(some) + a] = [m.languages[j] for j in best]
        release()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores)], ["lang_pred", "score"])

    return run(text)


def identify(docs: DataFrame, train: DataFrame, **options) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` from a model fitted on ``train``.

    One row per input row.  Columns of these names in ``docs`` are replaced; repeated
    rows and null ids change nothing; ties between languages go to the first by name.
    """
    model = fit(train, **options)
    base = docs.drop("lang_pred", "score")
    out = base.withColumn("_p", predict(docs.sparkSession, F.col("text"), model))
    return out.select(*[F.col(f"`{c}`") for c in base.columns], "_p.lang_pred", "_p.score")
