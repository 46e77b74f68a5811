"""Secret scan with a random forest that removes false positives (operator 2).

A wide pattern finds candidates: runs of 12 or more token characters with a digit, and
whole values, of any characters, assigned to a credential's name.  Each candidate has
features of its length, character transitions, dictionary coverage, path and neighbouring
words.  A forest trained on labelled findings decides.  Where no findings are labelled by
hand, :func:`provisional_label` labels them by rules of public key formats and assignments.
The neighbouring words see those assignments, so a forest with such labels repeats the rule
(on sf0.1 for every candidate); false positives of a rule only go with labels from elsewhere.

The fit is bounded by ``max_findings`` labelled findings (chosen by a hash, half of them for
either label while it has so many); candidates are
sought in all texts, whole, and every candidate is scored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_fraction, materialize

MASK = "[SECRET]"
CONTEXT = 48
_run = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9+/_\-]{11,}={0,2}")
_digit = re.compile("[0-9]")
_word = re.compile(r"[A-Za-z]+")

# Words that name a credential.
CREDENTIAL_WORDS = frozenset("password passwd pwd pass secret token key apikey api auth bearer credential credentials "
                             "access private".split())
#: A value after an assignment to such a word: what the quotes hold, or all up to white space
#: but closing marks.  It reads the text before it as provisional_label does.
_assigned = re.compile(r"(?<![A-Za-z])(?i:" + "|".join(sorted(CREDENTIAL_WORDS, key=len, reverse=True))
                       + r")\s*[=:]\s*(?:\"([^\"\n]+)\"|'([^'\n]+)'|([^\s\"'=:]\S*))")

# Public key formats.
KEY_FORMATS = re.compile(r"(AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_live_[0-9a-zA-Z]{24}|xox[abp]-[0-9A-Za-z-]{10,}"
                         r"|AIza[0-9A-Za-z_\-]{35}")

FINDING = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                                    T.StructField("value", T.StringType()), T.StructField("before", T.StringType()),
                                    T.StructField("after", T.StringType())]))
FEATURES = ("length", "digit_share", "upper_share", "class_changes", "entropy", "hex_only", "transition_score",
            "dictionary_coverage", "path_marks", "path_before", "quoted", "assigned", "credential_word", "gap_to_word")


def candidates(text: str) -> list[tuple[int, int, str, str, str]]:
    """``start, end, value, before, after`` of every candidate (positions in code points).
    What lies in an assigned value is part of it."""
    spans = []
    for m in _assigned.finditer(text):
        value = m.group(m.lastindex)
        kept = value.rstrip(",;)]}") or value if m.lastindex == 3 else value
        spans.append((m.start(m.lastindex), m.start(m.lastindex) + len(kept)))
    starts = [a for a, _ in spans]
    for m in _run.finditer(text):  # the run first, then its digit: one pass, however long a run is
        if _digit.search(text, *m.span()):
            k = bisect_right(starts, m.start()) - 1
            if k < 0 or spans[k][1] <= m.start():
                spans.append(m.span())
    return [(a, b, text[a:b], text[max(0, a - CONTEXT): a], text[b: b + CONTEXT]) for a, b in sorted(spans)]


def provisional_label(value: str, before: str) -> int:
    """1 for a public key format, or a value assigned to a credential's name."""
    if KEY_FORMATS.fullmatch(value):
        return 1
    assigned = re.search(r"([A-Za-z]+)\s*[=:]\s*[\"']?$", before)
    return int(bool(assigned) and assigned.group(1).lower() in CREDENTIAL_WORDS)


def _char(c: str) -> int:
    return ord(c) - 97 if "a" <= c <= "z" else 26


@dataclass
class Lexicon:
    """Words and letter transitions of the text around labelled findings."""

    words: frozenset
    transitions: np.ndarray

    @classmethod
    def learn(cls, contexts: list[str], size: int = 3000) -> Lexicon:
        count: Counter = Counter()
        table = np.ones((27, 27))
        for text in contexts:
            for w in _word.findall(text.lower()):
                count[w] += 1
                for a, b in zip(w, w[1:], strict=False):
                    table[_char(a), _char(b)] += 1
        words = frozenset(w for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:size] if len(w) >= 3)
        return cls(words, np.log(table / table.sum(1, keepdims=True)))

    def coverage(self, value: str) -> float:
        """Share of a value's characters inside dictionary words."""
        text, at, covered = value.lower(), 0, 0
        while at < len(text):
            step = next((n for n in range(min(12, len(text) - at), 2, -1) if text[at: at + n] in self.words), 0)
            covered += step
            at += step or 1
        return covered / max(1, len(text))


def feature_row(value: str, before: str, after: str, lexicon: Lexicon) -> list[float]:
    n = len(value)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in value]
    lower = value.lower()
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    steps = [lexicon.transitions[_char(a), _char(b)] for a, b in zip(lower, lower[1:], strict=False)]
    near = re.search(r"([A-Za-z]+)[^A-Za-z]*$", before)
    return [n, kinds.count("d") / n, kinds.count("u") / n,
            sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1), entropy,
            float(all(c in "0123456789abcdef" for c in lower)), float(np.mean(steps)) if steps else 0.0,
            lexicon.coverage(value), sum(value.count(c) for c in "/-_"), float(before[-1:] in ("/", ".", "@", "\\")),
            float(before[-1:] in "\"'" and before != "" and after[:1] in ("\"", "'")),
            float(bool(re.search(r"[=:]\s*[\"']?$", before))),
            float(near is not None and near.group(1).lower() in CREDENTIAL_WORDS),
            float(len(before) - near.end(1)) if near else float(CONTEXT)]


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int):
    """A tree as nested tuples: (feature, threshold, low, high), or the share of ones."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return float(y.mean())
    best = (np.inf, 0, 0.0)
    for f in rng.choice(x.shape[1], max(2, round(math.sqrt(x.shape[1]))), replace=False):
        values = np.unique(x[:, f])
        if len(values) < 2:
            continue
        cuts = (values[1:] + values[:-1]) / 2
        for c in cuts if len(cuts) <= 16 else np.quantile(cuts, np.linspace(0, 1, 16)):
            low = x[:, f] <= c
            k = low.sum()
            if k < least or len(y) - k < least:
                continue
            p, q = y[low].mean(), y[~low].mean()
            impurity = k * p * (1 - p) + (len(y) - k) * q * (1 - q)
            if impurity < best[0]:
                best = (impurity, f, float(c))
    if best[0] == np.inf:
        return float(y.mean())
    low = x[:, best[1]] <= best[2]
    return (int(best[1]), best[2], _grow(x[low], y[low], rng, depth - 1, least), _grow(x[~low], y[~low], rng, depth - 1, least))


@dataclass
class Forest:
    lexicon: Lexicon
    trees: list

    @classmethod
    def fit(cls, findings: list[tuple[str, str, str, int]], n_trees: int = 40, depth: int = 8, least: int = 2,
            seed: int = 7) -> Forest:
        """From ``value, before, after, label`` rows.  Without rows every score is 0."""
        lexicon = Lexicon.learn([b + " " + a for _, b, a, _ in findings])
        if not findings:
            return cls(lexicon, [0.0])
        x = np.array([feature_row(v, b, a, lexicon) for v, b, a, _ in findings])
        y = np.array([label for *_, label in findings], float)
        rng = np.random.default_rng(seed)
        draws = [rng.integers(0, len(y), len(y)) for _ in range(n_trees)]
        return cls(lexicon, [_grow(x[d], y[d], rng, depth, least) for d in draws])

    def score(self, value: str, before: str, after: str) -> float:
        row = feature_row(value, before, after, self.lexicon)
        total = 0.0
        for tree in self.trees:
            while isinstance(tree, tuple):
                tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
            total += tree
        return total / len(self.trees)


def find(text: Column) -> Column:
    """Array of candidates of a text; null and empty texts have none."""

    @F.arrow_udf(FINDING)
    def run(texts: pa.Array) -> pa.Array:
        names = ("start", "end", "value", "before", "after")
        rows = [[dict(zip(names, c, strict=True)) for c in candidates(t or "")] for t in texts.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()),
                                                  ("before", pa.string()), ("after", pa.string())])))

    return run(text)


def findings(docs: DataFrame) -> DataFrame:
    """``doc_id, start, end, value, before, after``: a row for every candidate."""
    return docs.select("doc_id", F.explode(find(F.col("text"))).alias("f")).select("doc_id", "f.*")


def labelled(found: DataFrame) -> DataFrame:
    """Findings with a provisional ``label``."""

    @F.arrow_udf(T.IntegerType())
    def rule(value: pa.Array, before: pa.Array) -> pa.Array:
        return pa.array([provisional_label(v, b) for v, b in zip(value.to_pylist(), before.to_pylist(), strict=True)],
                        pa.int32())

    return found.withColumn("label", rule("value", "before"))


def fit(found: DataFrame, max_findings: int = 4000, **options) -> Forest:
    """Forest from labelled findings (``value, before, after, label``; rows with a null
    label are no examples); equal findings count once."""
    rows = found.where(F.col("label").isNotNull()).select("value", "before", "after", "label").distinct()
    rows = rows.withColumn("u", hash_fraction("value", "before", "after"))
    order = ("u", "value", "before", "after", "label")
    ones, others = (rows.where(which).orderBy(*order).limit(max_findings).collect()
                    for which in (F.col("label") == 1, F.col("label") != 1))
    n = min(len(ones), max(max_findings // 2, max_findings - len(others)))
    taken = sorted(ones[:n] + others[: max_findings - n], key=lambda r: [r[c] for c in order])
    return Forest.fit([(r["value"], r["before"], r["after"], r["label"]) for r in taken], **options)


def scan(docs: DataFrame, threshold: float = 0.5, labels: DataFrame | None = None, **options) -> DataFrame:
    """``doc_id, start, end, value, score, is_secret`` of every candidate in ``docs``; a score
    equal to ``threshold`` is a secret.

    ``labels``: labelled findings; by default the documents' own, labelled by rule.
    Null or empty texts and texts without candidates give no rows; repeated documents
    repeat their rows; positions are code points of the whole text.
    """
    found = materialize(findings(docs), "findings")
    forest = docs.sparkSession.sparkContext.broadcast(fit(labels or labelled(found), **options))  # bounded by max_findings

    @F.arrow_udf(T.DoubleType())
    def run(value: pa.Array, before: pa.Array, after: pa.Array) -> pa.Array:
        rows = zip(value.to_pylist(), before.to_pylist(), after.to_pylist(), strict=True)
        return pa.array([forest.value.score(*r) for r in rows], pa.float64())

    return (found.withColumn("score", run("value", "before", "after"))
            .select("doc_id", "start", "end", "value", "score", (F.col("score") >= threshold).alias("is_secret")))


def redact(spark: SparkSession, text: Column, forest: Forest, threshold: float = 0.5) -> Column:
    """A text with its secrets masked; a null text stays null."""
    shared = spark.sparkContext.broadcast(forest)

    def clean(text: str) -> str:
        out, at = [], 0
        for start, end, value, before, after in candidates(text):
            if shared.value.score(value, before, after) >= threshold:
                out += [text[at:start], MASK]
                at = end
        return "".join([*out, text[at:]]) if out else text

    @F.arrow_udf(T.StringType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else clean(t) for t in texts.to_pylist()], pa.string())

    return run(text)


def redact_documents(docs: DataFrame, threshold: float = 0.5, labels: DataFrame | None = None, **options) -> DataFrame:
    """``docs`` with every secret in ``text`` masked; ``n_chars``, if there, follows."""
    forest = fit(labels or labelled(materialize(findings(docs), "findings")), **options)
    out = docs.withColumn("text", redact(docs.sparkSession, F.col("text"), forest, threshold))
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out
