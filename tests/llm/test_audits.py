"""Operators 12 and 13 against plain Python, with the edge cases of their docstrings."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakecart.llm import divergence, interactions

from .conftest import DOCS, EDGE_ROWS, prose

LABELS = "doc_id long, quality int, toxic int"


def plain_mask(text):
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w]
    fails = (len(words) < 100, 100 * len(set(words)) < 80 * len(words),
             100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), bool(re.search(r"[#$%&*|]", text)))
    return fails


def plain_interactions(docs, labels):
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    least = {}
    for d, text, *_ in docs:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    rows = []
    for d, text, lang, *_ in docs:
        fails = dict(zip("ABCD", plain_mask(text or ""), strict=True))
        fails["E"] = d is not None and least[text or ""] < d
        rows.append((lang or "", fails, d in good, d in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = list(range(len(mine)))
            for step, letter in enumerate(order, 1):
                gone = [i for i in left if mine[i][1][letter]]
                failing = [r for r in mine if r[1][letter]]
                left = [i for i in left if not mine[i][1][letter]]
                shapley[letter] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), len(failing) - len(gone), sum(sum(r[1].values()) == 1 for r in failing),
                    sum(mine[i][2] for i in gone), sum(mine[i][3] for i in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def some_docs(seed, n=120):
    rng = random.Random(seed)
    texts = [prose(rng.randrange(0, 160), rng.randrange(9)) for _ in range(20)] + ["LOUD WORDS " * 60, "a # b", "", None,
                                                                                    " ".join(f"w{i}" for i in range(200)),
                                                                                    " é " * 120, "A\x0bB\x1cC"]
    return [(rng.choice([None, *range(80)]), rng.choice(texts), rng.choice([None, "", "en", "de"]), "s", 1)
            for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_interactions_match_plain_python(spark, seed):
    rng = random.Random(seed)
    docs = some_docs(seed)
    labels = [(rng.choice([None, *range(80)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)]
    found = interactions.interactions(spark.createDataFrame(docs, DOCS).repartition(7),
                                      spark.createDataFrame(labels, LABELS)).collect()
    assert {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in found} == plain_interactions(docs, labels)
    assert len(found) == 600 * len({d[2] or "" for d in docs})


def test_interactions_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(5, 1, 1), (None, 1, 1)], LABELS).withColumn("part", F.lit("clash"))
    found = interactions.interactions(edge_docs, labels).collect()
    expected = plain_interactions([r[:3] for r in EDGE_ROWS], [(5, 1, 1)])
    assert {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in found} == expected
    assert interactions.interactions(no_docs, labels).count() == 0
    some = interactions.interactions(edge_docs, labels.where("false"))
    assert some.count() == len(found) and some.agg(F.sum("good_lost")).first()[0] == 0


def test_removal_steps_are_the_first_failing_place():
    steps = interactions.removal_steps()
    for m in range(32):
        for o, order in enumerate(permutations(range(5))):
            first = [s for s, f in enumerate(order) if m >> f & 1]
            assert steps[m, o] == (first[0] if first else 99)


def plain_terms(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)


def plain_divergence(docs, least=10, k=10):
    held, n, lang_n, groups = defaultdict(int), Counter(), Counter(), defaultdict(set)
    for _, text, lang, source, *_ in docs:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = plain_terms(text)
        for t in set(terms):
            held[lang, t] += 1
        for t in terms:
            n[lang, source, t] += 1
            lang_n[lang, t] += 1
    out = set()
    for lang, sources in groups.items():
        kept = sorted((t for la, t in held if la == lang and held[la, t] >= least), key=lambda t: t.encode())
        v = len(kept)
        total = {s: sum(n[lang, s, t] for t in kept) for s in sources}

        def share(c, whole, v=v):
            return 1 + 1_000_000_000 * (c + 2) // (whole + 2 * v)

        p = {s: {t: share(n[lang, s, t], total[s]) for t in kept} for s in sources}
        whole = {t: share(lang_n[lang, t], sum(total.values())) for t in kept}

        def value(a, b):
            return (a - b) ** 2 // (a + b)

        for s in sources:
            pairs = sorted(((-sum(value(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s))
            out |= {(lang, s, "pair", o, -f, r) for r, (f, _, o) in enumerate(pairs, 1)}
            terms = sorted((-value(p[s][t], whole[t]), t.encode(), t) for t in kept if n[lang, s, t] and p[s][t] > whole[t])
            out |= {(lang, s, "term", t, -f, r) for r, (f, _, t) in enumerate(terms[:k], 1)}
    return out


def term_docs(seed, n=300):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "abcdeÉé日" for b in "xyzXYZß"] + ["it's", "A1b", "\U0001f600"]
    return [(i, None if rng.random() < 0.05 else " ".join(
        vocabulary[min(int(rng.expovariate(0.08)), len(vocabulary) - 1)] for _ in range(rng.randrange(0, 30))),
             rng.choice([None, "en", "en", "en", "de", "zz"]), rng.choice([None, "a", "b", "c", "é", "hot", "hot"]), 1)
            for i in range(n)]


@pytest.mark.parametrize("least,k", [(10, 10), (1, 3), (500, 10)])
def test_divergence_matches_plain_python(spark, monkeypatch, least, k):
    docs = term_docs(least)
    monkeypatch.setattr(divergence, "BUCKET_ROWS", 60)
    monkeypatch.setattr(divergence, "SOURCE_BLOCK", 2)
    found = divergence.source_divergence(spark.createDataFrame(docs, DOCS).repartition(6), least, k)
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == plain_divergence(docs, least, k)


def test_divergence_edges(spark, edge_docs, no_docs):
    found = divergence.source_divergence(edge_docs, least_docs=1)
    assert {tuple(r) for r in found.collect()} == plain_divergence(EDGE_ROWS, least=1)
    assert {tuple(r) for r in divergence.source_divergence(edge_docs).collect()} == plain_divergence(EDGE_ROWS)
    assert divergence.source_divergence(no_docs).count() == 0


@pytest.mark.parametrize("k", [1, 3, 10])
def test_skyband_is_that_of_the_definition(k):
    rng = np.random.default_rng(k)
    for size, top in ((0, 3), (1, 3), (40, 4), (1500, 60), (1500, 3)):
        n, lang_n = rng.integers(1, top, size), rng.integers(1, top, size)
        terms = [f"t{i}" for i in rng.permutation(size)]
        stay = set(divergence.skyband(n, lang_n, pa.array(terms, pa.string()), k).tolist())
        at = np.argsort(np.argsort(np.array(terms))) if size else np.empty(0)
        beaten = ((n[None, :] >= n[:, None]) & (lang_n[None, :] <= lang_n[:, None]) & (at[None, :] < at[:, None])).sum(1)
        assert stay == set(np.flatnonzero(beaten < k).tolist())


def test_shares_and_divergence_stay_exact():
    huge = np.array([0, 9_223_372_034, 9_300_000_000, 4_000_000_000_000_000])
    assert divergence.shares(huge, int(huge.sum()), 4).tolist() == [
        1 + 1_000_000_000 * (int(c) + 2) // (int(huge.sum()) + 8) for c in huge]
    assert divergence.divergence(np.array([1_000_000_001]), np.array([1])).tolist() == [10 ** 18 // 1_000_000_002]
