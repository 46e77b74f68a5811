"""Licence scan by exact set-similarity join with licence templates (operator 8).

Every line of a text is a block, a set of words, and so is every window of as many words as
a template has, wherever its lines break.  A template is found in a block when the
block holds at least ``threshold`` of the template's distinct words.  Template words are
ordered by their count over the whole corpus, rarest first.  A block that reaches the
needed overlap ``o = ceil(threshold * |T|)`` holds one of the first ``|T| - o + 1`` words
(prefix filter), has ``o`` words itself (length filter), and leaves enough words behind
that first common word on both sides (positional filter); what passes is counted exactly.
The templates are a fixed table, so documents are never shuffled: one pass counts the
words, one pass probes.  Every template found gives its label, unless a better one (more of its
words, or longer) of the same line, or of an overlapping window, holds all words it found.
Phrases of known licences are reported besides.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textvec import ALNUM_WORDS, Words, groups, text_buffer, word_hash

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices that the licences themselves ask for, one block each.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "lgpl-3.0": "This library is licensed under the GNU Lesser General Public License, version 3",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
           "associated documentation files (the Software), to deal in the Software without restriction",
    "mit-notice": "Released under the MIT License",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                    "provided that the following conditions are met",
    "cc-by-4.0": "Licensed under CC BY 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}

MATCH = T.StructType([T.StructField("label", T.StringType()), T.StructField("line", T.IntegerType()),
                      T.StructField("containment", T.DoubleType())])
RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()), T.StructField("matches", T.ArrayType(MATCH))])
_MATCHES = pa.list_(pa.struct([("label", pa.string()), ("line", pa.int32()), ("containment", pa.float64())]))


def words_of(text: str) -> np.ndarray:
    """Word hashes of a text, by the operator's word rule."""
    data = np.frombuffer(text.encode(), np.uint8)
    return Words(data, np.array([0, len(data)]), ALNUM_WORDS).hash


@dataclass
class Index:
    """Templates over the ordered vocabulary: ranks are positions in the global order."""

    vocabulary: np.ndarray  # sorted hashes
    rank: np.ndarray  # of each vocabulary entry
    templates: list[tuple[str, np.ndarray, int]]  # label, sorted ranks, needed overlap
    prefix: dict[int, list[tuple[int, int]]]  # rank -> (template, position in it)
    texts: list[list[int]]  # ranks of each template's words as they follow each other

    @classmethod
    def build(cls, counts: dict[int, int], templates: dict[str, str], threshold: float) -> Index:
        sets = {label: np.unique(words_of(t)) for label, t in templates.items()}
        vocabulary = np.unique(np.concatenate(list(sets.values()))) if sets else np.empty(0, np.uint64)
        order = sorted(range(len(vocabulary)), key=lambda i: (counts.get(int(vocabulary[i]), 0), int(vocabulary[i])))
        rank = np.empty(len(vocabulary), np.int64)
        rank[order] = np.arange(len(vocabulary))
        rows, prefix = [], {}
        for k, (label, words) in enumerate(sorted(sets.items())):
            ranks = np.sort(rank[np.searchsorted(vocabulary, words)])
            need = math.ceil(threshold * len(ranks) - 1e-9)
            rows.append((label, ranks, need))
            for at, r in enumerate(ranks[: len(ranks) - need + 1]):
                prefix.setdefault(int(r), []).append((k, at))
        texts = [rank[np.searchsorted(vocabulary, words_of(templates[label]))].tolist() for label, _, _ in rows]
        return cls(vocabulary, rank, rows, prefix, texts)

    def probe(self, block: np.ndarray, size: int) -> list[tuple[str, float]]:
        """Labels and containments for a block's sorted distinct ranks (its words outside
        the vocabulary only count for ``size``)."""
        out, seen = [], set()
        for at, r in enumerate(block.tolist()):
            for k, position in self.prefix.get(r, ()):
                if k in seen:
                    continue
                seen.add(k)  # the first common word decides the positional bound
                label, ranks, need = self.templates[k]
                if size < need or min(len(ranks) - position, len(block) - at) < need:
                    continue
                common = len(np.intersect1d(ranks, block, assume_unique=True))
                if common >= need:
                    out.append((label, common / len(ranks)))
        return out


    def windows(self, ranks: np.ndarray) -> list[tuple[str, float, int, int, frozenset]]:
        """Label, containment, first and last place and words found of the best windows of a
        text, given the rank of each of its words (-1 outside the vocabulary)."""
        starts: dict[int, list[int]] = {}
        for at in np.flatnonzero(np.isin(ranks, list(self.prefix))).tolist():
            for k, _ in self.prefix[int(ranks[at])]:
                starts.setdefault(k, []).append(at)
        out = []
        for k, ats in starts.items():
            label, own, need = self.templates[k]
            places = np.flatnonzero(np.isin(ranks, own))
            best, size, pairs = [], len(self.texts[k]), set(zip(self.texts[k], self.texts[k][1:], strict=False))
            around = np.zeros(len(ranks) + 1, np.int64)  # windows that hold a prefix word
            np.add.at(around, np.maximum(np.array(ats) - size + 1, 0), 1)
            np.add.at(around, np.array(ats) + 1, -1)
            for first in places[np.cumsum(around)[places] > 0].tolist():
                i, j = np.searchsorted(places, (first, first + size))
                if j - i < need:
                    continue
                words, new = np.unique(ranks[places[i:j]], return_index=True)
                if len(words) >= need:
                    last = int(places[i + new.max()])
                    inside = ranks[first: last + 1].tolist()
                    in_order = sum(pair in pairs for pair in zip(inside, inside[1:], strict=False))
                    best.append((-len(words), -in_order, last - first, first, frozenset(words.tolist())))
            taken = np.zeros(len(ranks), bool)
            for n, _, length, first, words in sorted(best, key=lambda x: x[:4]):
                if not taken[first: first + length + 1].any():
                    taken[first: first + length + 1] = True
                    out.append((label, -n / len(own), first, first + length, words))
        return out


def uncovered(hits: list[tuple[str, float, int, int, frozenset]], lengths: dict[str, int]) -> set[str]:
    """Labels of matches whose words no better match that overlaps them holds."""
    kept: list = []
    for hit in sorted(hits, key=lambda x: (x[1], lengths[x[0]], x[0]), reverse=True):
        if not any(hit[2] <= k[3] and k[2] <= hit[3] and hit[4] <= k[4] and hit[0] != k[0] for k in kept):
            kept.append(hit)
    return {k[0] for k in kept}


def count_words(docs: DataFrame, templates: dict[str, str]) -> dict[int, int]:
    """How often each template word occurs in all texts (a row for each template word)."""
    vocabulary = np.unique(np.concatenate([words_of(t) for t in templates.values()]))

    def run(batches):
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            for a, b in groups(offsets):
                h = Words(data, offsets[a: b + 1], ALNUM_WORDS).hash
                at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                total += np.bincount(at[vocabulary[at] == h], minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(vocabulary.view(np.int64)), pa.array(total)], ["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r["word"] & (1 << 64) - 1: r["n"] for r in rows}


def scan(docs: DataFrame, threshold: float = 0.8, templates: dict[str, str] | None = None) -> DataFrame:
    """``doc_id``, counts and places of the phrases, labels, score and ``matches`` (every
    line and template that meet the threshold) of every text.

    One row per input row; a null or empty text has no words and empty labels; places are
    word numbers from 0 of the whole text, null without a phrase; score is the largest
    containment found, 1 with a phrase, else 0.
    """
    templates = TEMPLATES if templates is None else templates
    index = docs.sparkSession.sparkContext.broadcast(Index.build(count_words(docs, templates), templates, threshold))
    phrases = [([np.uint64(word_hash(w.encode())) for w in p.split()], label) for p, label in PHRASES.items()]

    @F.arrow_udf(RESULT)
    def run(texts: pa.Array) -> pa.Array:
        ix = index.value
        lengths = {label: len(ranks) for label, ranks, _ in ix.templates}
        sets = {label: frozenset(ranks.tolist()) for label, ranks, _ in ix.templates}
        starters = np.array([v for v, r in zip(ix.vocabulary, ix.rank, strict=True) if int(r) in ix.prefix], np.uint64)
        out = {f.name: [] for f in RESULT.fields}
        data, offsets = text_buffer(texts)
        for a, b in groups(offsets):
            words = Words(data, offsets[a: b + 1], ALNUM_WORDS)
            h, owner, n = words.hash, words.owner(), b - a
            base: list[list] = [[] for _ in range(n)]
            for parts, label in phrases:
                at = np.flatnonzero(h == parts[0])
                at = at[at + len(parts) <= len(h)]
                for j, p in enumerate(parts[1:], 1):
                    at = at[h[at + j] == p]
                for i in at[owner[at] == owner[at + len(parts) - 1]].tolist():
                    base[owner[i]].append((i - int(words.first[owner[i]]), label))
            found: list[list] = [[] for _ in range(n)]
            named: list[set] = [set() for _ in range(n)]
            spot = np.searchsorted(starters, h)
            near = np.flatnonzero(starters[np.minimum(spot, len(starters) - 1)] == h) if len(starters) else spot[:0]
            lines = offsets[a] + np.flatnonzero(data[offsets[a]: offsets[b]] == 10)
            line_of = np.searchsorted(lines, words.start[near])
            done = set()
            for i, line in zip(near.tolist(), line_of.tolist(), strict=True):
                doc = int(owner[i])
                if (doc, line) in done:
                    continue
                done.add((doc, line))
                low = max(int(offsets[a + doc]), int(lines[line - 1]) + 1 if line else 0)
                high = min(int(offsets[a + doc + 1]), int(lines[line]) if line < len(lines) else int(offsets[b]))
                first, last = np.searchsorted(words.start, (low, high))
                block = np.unique(h[first:last])
                at = np.minimum(np.searchsorted(ix.vocabulary, block), len(ix.vocabulary) - 1)
                ranks = np.sort(ix.rank[at[ix.vocabulary[at] == block]])
                number = line - int(np.searchsorted(lines, offsets[a + doc]))
                hits = ix.probe(ranks, len(block))
                found[doc] += [{"label": label, "line": number, "containment": c} for label, c in hits]
                inside = frozenset(ranks.tolist())
                named[doc] |= uncovered([(label, c, 0, 0, inside & sets[label]) for label, c in hits], lengths)
            spot = np.minimum(np.searchsorted(ix.vocabulary, h), len(ix.vocabulary) - 1)
            ranks = np.where(ix.vocabulary[spot] == h, ix.rank[spot], -1) if len(ix.vocabulary) else np.full(len(h), -1)
            widest = np.zeros(n)
            for doc in {int(owner[i]) for i in near.tolist()}:
                hits = ix.windows(ranks[words.first[doc]: words.first[doc + 1]])
                named[doc] |= uncovered(hits, lengths)
                widest[doc] = max((x[1] for x in hits), default=0.0)
            for k in range(n):
                places, own = [p for p, _ in base[k]], {label for _, label in base[k]}
                labels = own | named[k]
                row = (int(words.counts[k]), len(places), min(places, default=None), max(places, default=None),
                       ",".join(sorted(own)), ",".join(sorted(labels)),
                       max([float(bool(places)), float(widest[k]), *(m["containment"] for m in found[k])]), found[k])
                for name, value in zip(out, row, strict=True):
                    out[name].append(value)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), _MATCHES]
        return pa.StructArray.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    return docs.select("doc_id", run(F.col("text")).alias("r")).select("doc_id", "r.*")
