"""The pipeline against a plain version of its stages' rules."""

import collections
import re

import corpus_pipeline
from lakecart.llm.common import materialize

from .conftest import EDGE_ROWS
from .test_duplicates import brute_jaccard

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_keep_columns_and_their_rules(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.STAGES[-1][0]] == [5, "best-fit packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialize(stage(spark, docs, sf), "test-stage")
        assert out.columns == COLUMNS, name
        before, after = ({r["doc_id"]: r["text"] for r in x.collect()} for x in (docs, out))
        assert out.count() == len(after) and set(after) <= set(before)
        if name == "language ID":
            assert set(after) == {d for d, t in before.items() if t and any(c.isalpha() for c in t)}
        if name == "n-gram Jaccard join":
            assert set(after) == {d for d, _, c in brute_jaccard(list(before.items())) if d == c}
        if name == "secret scans":
            assert set(after) == set(before)
            assert not any(re.search(r'token = "[0-9a-f]{40}"|AKIA[0-9A-Z]{16}', t) for t in after.values())
        else:
            assert all(after[d] == before[d] for d in after)
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}
    room = collections.Counter()
    for r in packed:
        room[r["sequence_id"]] += r["length"]
    assert max(room.values()) <= 2048


def test_edge_rows(spark, sf, edge_docs, no_docs):
    for docs, n in ((edge_docs.select(*COLUMNS), len(EDGE_ROWS)), (no_docs, 0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, sf), "test-edges")
        assert (docs.count() > 0) == (n > 0)
