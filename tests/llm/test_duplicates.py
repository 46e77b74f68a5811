"""Joins, clusters, packing, quality and secrets against brute force, and edge rows."""

import collections
import re

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import zlib
from pyspark.sql import functions as F

from lakecart.llm import graph, neardup, packing, quality, queries, secrets, sigtree

from .conftest import EDGE_ROWS, PROSE, prose

WORDS = P.path("word_bpe_49k.json")


def closure(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7, 7), (2000, 2001)]
    got = {r["node"]: r["component"] for r in
           graph.connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    assert got == closure(edges, {n for e in edges for n in e})
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_jaccard(rows):
    sets = []
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append((doc_id, {tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    n = len(sets)
    pairs = []
    for i in range(n):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)):
                common = len(a & b)
                if 100 * common >= 75 * (len(a) + len(b) - common):
                    pairs.append((i, j))
    group = closure(pairs, range(n))
    smallest = collections.defaultdict(list)
    for i in range(n):
        smallest[group[i]].append(sets[i][0])
    first = {g: min((x for x in ids if x is not None), default=None) for g, ids in smallest.items()}
    return sorted(((d, len(s), first[group[i]] if s else d) for i, (d, s) in enumerate(sets)), key=repr)


def near_copies(n, words, edits, start=500):
    rng = np.random.default_rng(n)
    base = [PROSE[i] + str(k) for k, i in enumerate(rng.integers(0, len(PROSE), words))]
    rows = []
    for k in range(n):
        w = list(base)
        for p in rng.integers(0, words, rng.integers(0, edits + 1)):
            w[p] = f"edit{k}x{p}"
        rows.append((start + k, " ".join(w)))
    return rows


@pytest.mark.parametrize("leaf_block", [400, 16])
def test_jaccard_brute_force(spark, leaf_block):
    rows = near_copies(60, 120, 6) + near_copies(25, 40, 3, 600) + near_copies(30, 9, 2, 700)
    rows += [(800 + i, prose(60, i)) for i in range(20)] + [(900, "A b  C d"), (901, "a B\nc D"), (902, "a b c"), (903, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in sigtree.jaccard_components(df, leaf_block=leaf_block).collect()), key=repr)
    assert got == brute_jaccard(rows)


@pytest.mark.parametrize("shards", [8, 9, 21])
def test_jaccard_sends_every_key(spark, monkeypatch, shards):
    rows = near_copies(40, 90, 6) + near_copies(20, 9, 2, 700) + [(800 + i, prose(60, i)) for i in range(20)]
    texts = pa.array([t for _, t in rows])
    nodes, keys = {}, 0
    for _, node, sets in sigtree._sets(texts, 5, sigtree.BLOCK_BYTES):
        nodes |= {int(x): len(np.unique(sigtree.shard_keys(s, shards))) for x, s in zip(node, sets, strict=True)}
    for batch in sigtree._send(5, shards)([pa.RecordBatch.from_arrays([texts], ["text"])]):
        assert set(batch.column("shard").to_pylist()) <= set(range(shards))
        keys += sum(len(x) for x in batch.column("low").to_pylist())
    assert keys == sum(nodes.values())
    size = sum(len(t.encode()) for _, t in rows)
    monkeypatch.setattr(sigtree, "SHARD_BYTES", size // shards)
    assert max(8, -(-size // sigtree.SHARD_BYTES)) in (shards, shards + 1)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in sigtree.jaccard_components(df).collect()), key=repr) == brute_jaccard(rows)


def test_jaccard_edges(spark, edge_docs, no_docs):
    got = sorted((tuple(r) for r in sigtree.jaccard_components(edge_docs).collect()), key=repr)
    expected = brute_jaccard([(r[0], r[1]) for r in EDGE_ROWS])
    assert got == expected
    assert sigtree.jaccard_components(no_docs).count() == 0


def test_jaccard_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted((tuple(r) for r in queries.op6_ngram_jaccard(spark, "/root/testdata/sf0.001").collect()), key=repr)
    assert got == brute_jaccard([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_dual_traversal_drops_no_pair():
    rng = np.random.default_rng(3)
    keys = []
    for _ in range(12):
        base = rng.integers(1, 1 << 62, 80)
        keys += [np.unique(np.where(rng.random(80) < 0.06, rng.integers(1, 1 << 62, 80), base)) for _ in range(6)]
    sizes = np.array([len(k) for k in keys])
    tree = sigtree.SignatureTree(sizes, keys)
    i, j, _ = sigtree.dual_traversal(tree, tree, True, 75, 100)
    found = set(zip(i.tolist(), j.tolist(), strict=True))
    for a in range(len(keys)):
        for b in range(a + 1, len(keys)):
            common = len(np.intersect1d(keys[a], keys[b]))
            if 100 * common >= 75 * (sizes[a] + sizes[b] - common):
                assert (a, b) in found
    assert len(found) < len(keys) * (len(keys) - 1) / 4  # the bounds do prune


def test_vectors_brute_force_and_edges(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(150)]
    for k in range(12):  # groups of near copies, one larger than the window
        base = rng.standard_normal(16)
        rows += [(1000 + 100 * k + i, (base + 0.08 * rng.standard_normal(16)).tolist()) for i in range(60 if k == 0 else 4)]
    rows += [(5000 + i, [1.0] * 16) for i in range(40)]  # equal vectors
    rows += [(6000, None), (6001, [0.0] * 16), (6002, [1.0, None] * 8), (6003, [float("nan")] * 16), (6004, [float("inf")] * 16),
             (6005, []), (6006, [2.0, 1.0]), (6007, [4.0, 2.0]), (None, [3.0] * 16), (1, rows[1][1]), (6008, [-0.0, 1.0]), (6009, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit(1)).withColumn("key", F.lit("x"))
    got = collections.Counter(tuple(r) for r in neardup.near_duplicates(df, block=32).collect())
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    units = {i: (x := np.array(rows[i][1], np.float32).astype(np.float64)) / np.linalg.norm(x) for i in ok}
    pairs = [(i, j) for i in ok for j in ok if j < i and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.9 - 1e-12]
    group = closure(pairs, range(len(rows)))
    links = collections.Counter(x for p in pairs for x in p)
    expected = collections.Counter()
    for i, (vec_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        first = min(ids) if ids else vec_id
        expected[vec_id, links[i], first, vec_id == first] += 1
    found = sum(k[1] * n for k, n in (got & expected).items())
    assert found >= 0.97 * sum(k[1] * n for k, n in expected.items())
    assert sum(got.values()) == len(rows)
    assert neardup.near_duplicates(df.where("false")).count() == 0


@pytest.mark.parametrize("n", [1000, 4000])
def test_lone_pairs_at_the_threshold_are_found_at_any_size(spark, n):
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pairs = n // 4
    off = rng.standard_normal((pairs, 32))
    off -= (off * x[:pairs]).sum(1, keepdims=True) * x[:pairs]
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    x[n - pairs:] = 0.905 * x[:pairs] + np.sqrt(1 - 0.905**2) * off
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    # a window of one: as many bits to share as 24 times the vectors have with the usual one
    got = {r["vec_id"]: r["component_id"] for r in neardup.near_duplicates(df, window=1).collect()}
    assert np.mean([got[n - pairs + i] == got[i] for i in range(pairs)]) >= 0.97


@pytest.mark.parametrize("mean", [0.5, 0.7])
def test_lone_pairs_in_a_cone_are_found(spark, mean):
    rng = np.random.default_rng(7)
    n, dim, pairs = 4000, 64, 500

    def unit(v):
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    x = unit(np.sqrt(mean) * np.eye(dim)[0] + np.sqrt(1 - mean) * unit(rng.standard_normal((n, dim))))
    off = rng.standard_normal((pairs, dim))
    off = unit(off - (off * x[:pairs]).sum(1, keepdims=True) * x[:pairs])
    x[n - pairs:] = 0.905 * x[:pairs] + np.sqrt(1 - 0.905**2) * off
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["component_id"], r["n_links"]) for r in neardup.near_duplicates(df).collect()}
    assert np.mean([got[n - pairs + i][0] == got[i][0] for i in range(pairs)]) >= 0.98
    close = (x @ x.T >= 0.9).sum(1) - 1
    assert sum(links for _, links in got.values()) >= 0.98 * close.sum()


def test_passes_follow_from_the_sample():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    few, more = (neardup.measured_passes(x, n, 256, 0.9, 0.99) for n in (2000, 200_000))
    assert neardup.measured_passes(x, 100, 256, 0.9, 0.99) == 1 < few < more
    cone = x + 1.2 * np.eye(64)[0]
    assert neardup.measured_passes(cone / np.linalg.norm(cone, axis=1, keepdims=True), 2000, 256, 0.9, 0.99) > few
    copies = np.concatenate([x[:250], x[0] + 0.02 * rng.standard_normal((250, 64))])  # a dense group needs no more of them
    copies /= np.linalg.norm(copies, axis=1, keepdims=True)
    assert neardup.measured_passes(copies, 2000, 256, 0.9, 0.99) <= few + 2
    assert neardup.measured_passes(x[:0], 0, 256, 0.9, 0.99) == 1


def test_special_tokens_have_their_own_ids():
    from tokenizers import Tokenizer

    model, words = Tokenizer.from_file(WORDS), packing.WordTokenizer(WORDS)
    for text in ("a <|endoftext|> b", "x<|endoftext|>y,z", "é<|endoftext|>日本", "<|endoftext|><|startoftext|>", "<|EndOfText|>"):
        assert np.frombuffer(words.encode_all([text])[0], np.uint32).tolist() == model.encode(text, add_special_tokens=False).ids


def test_candidates_of_one_long_run_take_one_pass():
    assert secrets.candidates("a-" * 300_000) == []
    text = "a-" * 300_000 + "7"
    assert [(a, b) for a, b, *_ in secrets.candidates(text)] == [(0, len(text))]


def test_packing_is_whole_and_gapless(spark, edge_docs, no_docs):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(WORDS)
    rows = packing.pack(edge_docs, WORDS, capacity=256, with_ids=True).collect()
    got = collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in rows)
    expected = collections.Counter()
    for doc_id, text, *_ in EDGE_ROWS:
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 0], np.uint32)
        for k in range(0, len(ids), 256):
            part = ids[k: k + 256].tobytes()
            expected[doc_id, k // 256, k, len(part) // 4, zlib.crc32(part), part] += 1
    assert got == expected
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(no_docs, WORDS).count() == 0


def test_packing_needs_few_sequences():
    rng = np.random.default_rng(2)
    counts = collections.Counter(np.minimum(2048, rng.lognormal(6, 1.2, 40_000).astype(int) + 1).tolist())
    made = packing.plan(counts, 2048)
    used = collections.Counter()
    for content, times in made:
        assert sum(content) <= 2048
        for x in content:
            used[x] += times
    assert used == counts
    least = -(-sum(x * n for x, n in counts.items()) // 2048)
    assert sum(t for _, t in made) <= 1.005 * least + 1


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i: i + 5]) for i in range(len(words) - 4)]
    often = collections.Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            len(words) < 10 or 100 * len(covered) > 20 * len(words))


def test_quality_counts_and_verdicts(spark, edge_docs, no_docs):
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = collections.Counter((r["doc_id"], *[r[c] for c in columns]) for r in quality.assess(edge_docs).collect())
    assert got == collections.Counter((r[0], *brute_counts(r[1])) for r in EDGE_ROWS)
    assert quality.assess(no_docs).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    rows = queries.op4_quality_rules(spark, "/root/testdata/sf0.01").collect()
    for r in rows:
        assert tuple(r[c] for c in columns) == brute_counts(texts[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])
    good = {r["doc_id"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1").collect()}
    judged = [r["kept"] for r in rows if r["doc_id"] in good and not r["base_failed"]]
    assert np.mean(judged) >= 0.99
    noisy = [r["kept"] for r in rows if not r["base_failed"] and r["n_symbols"] > 0.5 * r["n_words"]]
    assert noisy and np.mean(noisy) <= 0.3


def test_secrets_found_and_masked(spark, edge_docs, no_docs):
    rows = [(i, f"{prose(8, i)} token = \"{i:040x}\" {prose(6)} 4{i:015d} and 192.168.0.{i} {prose(4)}") for i in range(60)]
    rows += [(100 + i, f"{prose(5, i)} password={i * 7919:018x} {prose(9)} order20240{i:07d} x") for i in range(60)]
    rows += [(200, None), (201, ""), (202, "plain words only")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.lit(0))
    found = secrets.scan(docs).collect()
    texts = dict(rows)
    for r in found:
        assert texts[r["doc_id"]][r["start"]: r["end"]] == r["value"]
        true = texts[r["doc_id"]][: r["start"]].endswith(('token = "', "password="))
        assert r["is_secret"] == true, r
    clean = {r["doc_id"]: r for r in secrets.redact_documents(docs).collect()}
    assert clean[200]["text"] is None and clean[202]["text"] == "plain words only"
    assert all(secrets.MASK in clean[i]["text"] and f"{i:040x}" not in clean[i]["text"] for i in range(60))
    assert clean[3]["n_chars"] == len(clean[3]["text"])
    assert secrets.scan(no_docs).count() == 0
    assert secrets.redact_documents(edge_docs).count() == len(EDGE_ROWS)


def test_assigned_values_are_whole_candidates():
    text = "user=bob password = \"S3cr3t!pw#24\" then pwd: hunter!, token='a b$c)' and password=0123456789abcdef01; key=abcDEF123456$x.y end"
    got = secrets.candidates(text)
    assert [c[2] for c in got] == ["S3cr3t!pw#24", "hunter!", "a b$c)", "0123456789abcdef01", "abcDEF123456$x.y"]
    assert all(text[a:b] == value and secrets.provisional_label(value, before) == 1 for a, b, value, before, _ in got)


def test_fit_has_rare_secrets(spark):
    rows = [(f"order2024{i:09d}", f"see {i} ", " x", 0) for i in range(300)] + [(f"{i * 7919:018x}", "password=", " x", 1) for i in range(3)]
    forest = secrets.fit(spark.createDataFrame(rows, "value string, before string, after string, label int"), max_findings=20)
    assert any(isinstance(t, tuple) or t > 0 for t in forest.trees)
    assert forest.score(f"{5 * 7919:018x}", "password=", " x") > forest.score("order2024000000007", "see 7 ", " x")
