"""Tokenising, language, toxicity, licences, language model: brute force, round trips and
held-out accuracy; edge rows of every kind."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakecart.llm import bpe, langid, licenses, lm, queries, textvec, toxicity

from .conftest import EDGE_ROWS

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference_encoder():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet=" \n\tab'sé日.  ", max_size=40))
def test_words_are_the_pattern(text):
    text = text.encode("utf-8", "ignore").decode()
    for kind, pattern in ((textvec.SPACE_WORDS, r"[^\x20\x09-\x0D]+"), (textvec.ALNUM_WORDS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        data, offsets = textvec.text_buffer(pa.array(["aé z", text, "b"]))
        words = textvec.Words(data, offsets, kind)
        lowered = text.translate(LOWER) if kind is textvec.ALNUM_WORDS else text
        expected = re.findall(pattern, lowered)
        got = [bytes(data[a:b]).decode().translate(LOWER) for a, b in zip(words.start, words.end, strict=True)][words.first[1]: words.first[2]]
        assert got == [w.translate(LOWER) for w in expected]
        assert [int(h) for h in words.hash[words.first[1]: words.first[2]]] == [textvec.word_hash(w.encode()) for w in expected]


def test_bpe_edges(spark, edge_docs, no_docs, reference_encoder):
    out = bpe.byte_bpe_round_trip(edge_docs, RANKS, P.PATTERN, True)
    got = collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out.collect())
    expected = collections.Counter()
    for doc_id, text, *_ in EDGE_ROWS:
        ids = reference_encoder.encode_ordinary(text or "")
        expected[doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                 hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert got == expected
    assert bpe.byte_bpe_round_trip(no_docs, RANKS, P.PATTERN).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet=" \n\tab'sé1.  ", max_size=60))
def test_bpe_any_text(text):
    import tiktoken

    text = text.encode("utf-8", "ignore").decode()
    if not hasattr(test_bpe_any_text, "encoder"):
        test_bpe_any_text.encoder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    for space_leads in (True, False):
        ids = bpe.codec(RANKS, P.PATTERN, space_leads).encode(text).tolist()
        assert ids == test_bpe_any_text.encoder.encode_ordinary(text)
        assert bpe.codec(RANKS, P.PATTERN, space_leads).decode(ids) == text.encode()


def test_bpe_id_columns(spark):
    df = spark.createDataFrame([("a b c",), (None,)], "text string")
    ids = df.withColumn("ids", bpe.encode_ids(F.col("text"), RANKS, P.PATTERN))
    rows = ids.select("text", "ids", bpe.decode_ids(F.col("ids"), RANKS, P.PATTERN).alias("raw")).collect()
    assert [bytes(r["raw"]).decode() for r in rows] == ["a b c", ""]


def test_language_held_out(spark, sf):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in queries.op3_language_id(spark, sf).collect() if r["held_out"]]
    assert len(rows) == sum(zlib.crc32(str(d).encode()) % 4 == 2 for d in truth)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in rows]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark, edge_docs, no_docs):
    rows = langid.identify(edge_docs, edge_docs).collect()
    assert len(rows) == len(EDGE_ROWS)
    for r in rows:
        assert (r["lang_pred"] == "und") == (r["text"] is None or not any(c.isalpha() for c in r["text"]))
        assert r["node"] == "clash"
    assert langid.identify(no_docs, no_docs).count() == 0
    assert {r["lang_pred"] for r in langid.identify(edge_docs, no_docs).collect()} == {"und"}


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    words = re.compile(r"\b(trash|pathetic|idiot|worthless|disgusting|stupid|clown|loser|scum|moron)\b")
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    clean = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 0").collect()}
    rows = queries.op7_toxicity(spark, sf).collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r["held_out"]]
    toxic = [r["score"] for r in held if words.search(docs[r["doc_id"]].lower())]
    other = [r["score"] for r in held if r["doc_id"] in clean]
    assert np.mean([t > o for t in toxic for o in other]) > 0.8
    assert np.mean([o >= 0.7 for o in other]) < 0.03


def test_toxicity_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, 1), (None, 1), (6, None), (9, 0)], "doc_id long, label int")
    rows = toxicity.classify(edge_docs, edge_docs, labels, min_docs=1).collect()
    assert len(rows) == len(EDGE_ROWS) and all(0 <= r["toxic_score"] <= 1 for r in rows)
    empty = {r["toxic_score"] for r in rows if not (r["text"] or "").strip()}
    assert len(empty) == 1  # the bias alone
    assert toxicity.classify(no_docs, edge_docs, labels).count() == 0
    assert {r["toxic_score"] for r in toxicity.classify(edge_docs, edge_docs, labels.where("false")).collect()} == {0.5}


def brute_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        parts = phrase.split()
        hits = [i for i in range(len(words)) if words[i: i + len(parts)] == parts]
        places += hits
        labels |= {label} if hits else set()
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))


def brute_blocks(text, threshold):
    split = lambda t: set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER)))
    return sorted((label, line) for line, block in enumerate((text or "").split("\n")) for label, t in licenses.TEMPLATES.items()
                  if len(split(t) & split(block)) >= math.ceil(threshold * len(split(t)) - 1e-9))


def test_licenses_brute_force(spark, sf, edge_docs, no_docs):
    extra = [(100, "CC BY\ncc by-sa 4.0 licensed under", "en", "a", 1),
             (101, "é MIT License\nLicensed under the Apache License Version 2 0 thing\n\nApache", "en", "a", 1)]
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(edge_docs.select("doc_id", "text", "lang", "source", "n_chars"))
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    texts = collections.Counter((r["doc_id"], r["text"]) for r in docs.collect())
    expected = collections.Counter()
    for (doc_id, text), n in texts.items():
        expected[(doc_id, *brute_licenses(text), tuple(brute_blocks(text, 0.8)))] += n
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"],
                               tuple(sorted((m["label"], m["line"]) for m in r["matches"])))
                              for r in licenses.scan(docs).collect())
    assert got == expected
    assert licenses.scan(no_docs).count() == 0


def test_licenses_name_every_notice_wrapped_or_not(spark):
    t = licenses.TEMPLATES
    wrapped = {k: "\n".join(" * " + " ".join(v.split()[i: i + 5]) for i in range(0, len(v.split()), 5)) for k, v in t.items()}
    rows = [(i, f"intro words {wrapped[k]} \n more words", {k}) for i, k in enumerate(t)]
    rows += [(100 + i, f"intro words {v} more words", {k}) for i, (k, v) in enumerate(t.items())]
    rows += [(200, f"{t['mit']} some {t['apache-2.0']} and {t['bsd-3-clause']}", {"mit", "apache-2.0", "bsd-3-clause"}),
             (201, f"{t['cc-by-sa-4.0']}. {t['cc-by-4.0']}", {"cc-by-sa-4.0", "cc-by-4.0"})]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    for doc_id, _, expected in rows:
        assert set(filter(None, got[doc_id]["labels"].split(","))) - set(licenses.PHRASES.values()) - {"mit"} == expected - {"mit"}, doc_id
        assert got[doc_id]["score"] == 1
        if "mit" in expected:
            assert "mit" in got[doc_id]["labels"].split(",")


def test_elias_fano_finds_what_is_there():
    rng = np.random.default_rng(5)
    for n, bits in ((0, 40), (1, 40), (7, 3), (1000, 40), (5000, 14), (20_000, 63)):
        values = np.sort(rng.integers(0, 1 << bits, n, dtype=np.uint64))
        values = np.unique(values)
        ef = lm.EliasFano.build(values, bits)
        if n:
            assert (ef.access(np.arange(len(values))) == values).all()
        probe = np.concatenate([values, rng.integers(0, 1 << bits, 200, dtype=np.uint64)])
        where = {int(v): i for i, v in enumerate(values)}
        assert ef.find(probe).tolist() == [where.get(int(x), -1) for x in probe]


def brute_lm(rows, mu):
    tokens = [(d, h, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [None]) for d, t, h in rows]
    one, two = collections.Counter(), collections.Counter()
    for _, h, w in tokens:
        if not h:
            one.update(w)
            two.update(zip([None, *w], w, strict=False))
    n, v = sum(one.values()), len(one)
    uni = lambda w: (one[w] + 1) / (n + v + 1)
    out = []
    for d, h, w in tokens:
        base = sum(math.log10(uni(x)) for x in w)
        score = sum(math.log10((two[a, b] + mu * uni(b)) / (one[a] + mu)) for a, b in zip([None, *w], w, strict=False))
        out.append((d, h, len(w), sum(one[x] > 0 for x in w), n, base, score))
    return out


def test_lm_brute_force(spark, edge_docs, no_docs):
    rows = edge_docs.select("doc_id", "text", F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False)).alias("h")).collect()
    expected = sorted(brute_lm([tuple(r) for r in rows], 50.0), key=repr)
    got = sorted((tuple(r) for r in lm.score_texts(edge_docs, F.col("doc_id") % 3 == 0).collect()), key=repr)
    assert len(got) == len(expected)
    for a, b in zip(sorted(got, key=lambda x: (x[0] or 0, x[2])), sorted(expected, key=lambda x: (x[0] or 0, x[2])), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5])
        assert a[6] == pytest.approx(b[6], rel=0.05, abs=0.3)  # codes above EXACT are rounded
    assert lm.score_texts(no_docs, F.lit(False)).count() == 0
