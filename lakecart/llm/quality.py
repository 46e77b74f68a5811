"""Quality rules with robust multivariate outliers (operator 4), in DataFrame functions.

Every text gets counts, and from them a vector of transformed statistics: log words, mean
word length, and square roots of the shares of symbols, repeated lines and repeated words.
For each language and source a minimum-covariance-determinant estimate is found by
concentration steps: from medians and MADs on, the ``coverage`` share of rows that lie
nearest gives the next mean and covariance.  The covariance is scaled so that the median
squared distance is that of a chi-square, and no variance is below its floor (most rows
have no symbols or repeats at all).  Rows beyond ``cutoff`` are rejected.

Groups of fewer than ``min_group`` rows share one estimate.  Quantiles are
``percentile_approx``, sums are combined before they are shuffled, and the estimates are a
small table with a row for each group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SPACE = " \t\n\x0b\x0c\r"
FEATURES = ("f1", "f2", "f3", "f4", "f5")
#: Smallest standard deviation of each statistic.
FLOORS = (0.5, 0.5, 0.1, 0.15, 0.15)
#: Median of chi-square with five degrees of freedom.
CHI2_MEDIAN = 4.351
ACCURACY = 10_000


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once (a lambda variable, not an expression
    that every use would compute again)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(windows: Column, width: int) -> Column:
    """How many words lie in windows whose hash occurs twice or more."""

    def marked(rows: Column) -> Column:
        last = F.size(rows) - 1

        def twin(k: Column) -> Column:
            h = F.get(rows, k)["h"]
            return (((k > 0) & (F.get(rows, k - 1)["h"] == h)) | ((k < last) & (F.get(rows, k + 1)["h"] == h)))

        return F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), last), twin), lambda k: F.get(rows, k)["i"]))

    def fold(state: Column, i: Column) -> Column:
        end = i + (width - 1)
        return F.struct((state["n"] + end - F.greatest(state["end"], i - 1)).alias("n"), end.alias("end"))

    rows = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    start = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end"))
    return F.aggregate(_bind(rows, marked), start, fold, lambda s: s["n"])


def repeated_words(words: Column, width: int = 5) -> Column:
    """Number of words in windows of ``width`` words found twice or more, the first
    occurrence included."""

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - width),
                           lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))

    def count(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_covered(w, width))

    def guarded(h: Column) -> Column:
        return F.when(F.size(h) < width, F.lit(0)).otherwise(_bind(windows(h), count))

    return _bind(F.transform(words, lambda w: F.xxhash64(w)), guarded)


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` and the counts of every text (null: no words)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    counted = docs.select(
        "doc_id", "lang", "source",
        F.char_length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        _bind(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))).alias("lines"),
        _bind(words, lambda x: F.struct(F.size(x).alias("n"), repeated_words(x).alias("r"))).alias("words"))
    return counted.select(
        "doc_id", "lang", "source", F.col("words.n").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.col("lines.n") - F.col("lines.d")).cast("long").alias("n_dup_lines"),
        F.col("words.r").cast("long").alias("n_repeat_words"), F.col("lines.n").cast("long").alias("n_lines"))


def vectors(counts: DataFrame) -> DataFrame:
    """``counts`` with ``base_failed`` and the transformed statistics."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return (counts.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
            .withColumn("f1", F.log1p(F.col("n_words").cast("double")))
            .withColumn("f2", F.col("word_chars") / n)
            .withColumn("f3", F.sqrt(F.col("n_symbols") / n))
            .withColumn("f4", F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double")))
            .withColumn("f5", F.sqrt(F.col("n_repeat_words") / n)))


def _distance(rows: DataFrame) -> Column:
    """Squared Mahalanobis distance by forward substitution with the Cholesky factor."""
    z: list[Column] = []
    for i, f in enumerate(FEATURES):
        rest = F.col(f) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * z[j]
        z.append(rest / F.col(f"l{i}{i}"))
    return sum((x * x for x in z[1:]), z[0] * z[0])


def _factor(moments: DataFrame) -> DataFrame:
    """Cholesky factor of each group's covariance, variances raised to their floors."""
    out = moments
    for i in range(len(FEATURES)):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") + (F.lit(FLOORS[i] ** 2) if i == j else F.lit(0.0))
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    return out.select("g", *[f"m{i}" for i in range(len(FEATURES))],
                      *[f"l{i}{j}" for i in range(len(FEATURES)) for j in range(i + 1)])


def _first_estimate(rows: DataFrame) -> DataFrame:
    """Medians, and MADs as a diagonal covariance."""
    p = len(FEATURES)
    medians = rows.groupBy("g").agg(*[F.percentile_approx(f, 0.5, ACCURACY).alias(f"m{i}") for i, f in enumerate(FEATURES)])
    medians = materialize(medians, "medians")
    mads = rows.join(medians, "g").groupBy("g").agg(
        *[F.first(f"m{i}").alias(f"m{i}") for i in range(p)],
        *[F.percentile_approx(F.abs(F.col(f) - F.col(f"m{i}")), 0.5, ACCURACY).alias(f"s{i}") for i, f in enumerate(FEATURES)])
    return _factor(mads.select("g", *[f"m{i}" for i in range(p)],
                               *[(F.pow(1.4826 * F.col(f"s{i}"), 2) if i == j else F.lit(0.0)).alias(f"c{i}{j}")
                                 for i in range(p) for j in range(i + 1)]))


def estimates(rows: DataFrame, coverage: float = 0.75, steps: int = 3) -> DataFrame:
    """One row for each group ``g``: center ``m*``, factor ``l*`` and ``scale``."""
    p = len(FEATURES)
    now = materialize(_first_estimate(rows), "estimate-0")
    for step in range(1, steps + 1):
        far = rows.join(now, "g").withColumn("d2", _distance(rows)).select("g", "d2", *FEATURES)
        cut = materialize(far.groupBy("g").agg(F.percentile_approx("d2", coverage, ACCURACY).alias("cut")), f"cut-{step}")
        near = far.join(cut, "g").where(F.col("d2") <= F.col("cut"))
        moments = near.groupBy("g").agg(
            *[F.avg(f).alias(f"m{i}") for i, f in enumerate(FEATURES)],
            *[F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"c{i}{j}") for i in range(p) for j in range(i + 1)])
        now = materialize(_factor(moments), f"estimate-{step}")
    last = rows.join(now, "g").withColumn("d2", _distance(rows))
    scale = last.groupBy("g").agg(F.greatest(F.percentile_approx("d2", 0.5, ACCURACY) / CHI2_MEDIAN, F.lit(1.0)).alias("scale"))
    return materialize(now.join(scale, "g"), "estimates")


def assess(docs: DataFrame, cutoff: float = 35.0, min_group: int = 200, **options) -> DataFrame:
    """Counts, ``base_failed``, ``distance`` and ``kept`` for every row of ``docs``
    (``doc_id, text, lang, source``).

    A null or empty text has no words and fails the base rule; null languages and sources
    are groups like any other; rows that fail the base rule take no part in estimates and
    have a null distance; equal rows get equal results.
    """
    counts = materialize(vectors(statistics(docs)), "statistics")
    sizes = (counts.where(~F.col("base_failed")).groupBy("lang", "source").agg(F.count("*").alias("n"))
             .select(F.col("lang").alias("_l"), F.col("source").alias("_s"),
                     F.when(F.col("n") >= min_group, F.to_json(F.struct("lang", "source"))).otherwise(F.lit("small")).alias("g")))
    sizes = materialize(sizes, "groups")
    same = counts["lang"].eqNullSafe(sizes["_l"]) & counts["source"].eqNullSafe(sizes["_s"])
    grouped = counts.join(sizes, same, "left")
    found = estimates(grouped.where(~F.col("base_failed")).select("g", *FEATURES), **options)
    scored = grouped.join(found, "g", "left").withColumn("distance", F.when(~F.col("base_failed"),
                                                                            _distance(grouped) / F.col("scale")))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         "distance", (~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cutoff)).alias("kept"))
