"""Source divergence audit with dominance skybands (operator 13).

A lang keeps the terms found in enough of its documents.  Most terms are rare, so a first
pass counts documents by the hash of a term and marks the hashes that may be kept in a
bitmap of fixed size; a second pass counts the marked terms by (lang, source), occurrences
and documents, and the exact document counts decide.  Shares ``p`` are integers (parts of a
billion, smoothed), and two shares diverge by ``floor((p-q)^2/(p+q))``.

* Pairs of sources: kept terms are dealt to buckets; a task has the counts of one bucket's
  terms for a block of sources and all sources of a lang, sums the divergence of every pair
  over its terms, and the sums are added up.
* Terms of a group against its lang: for a share above the lang's, the divergence rises with
  the group's count and falls with the lang's, and ties go to the earlier term.  So a term
  that k others beat or equal in group count, lang count and UTF-8 order cannot be among
  the first k.  Each partition keeps its skyband, the terms dominated by fewer than k
  others; skybands are merged, and only what is left is ranked by the exact values.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import materialize
from .textvec import Words, groups, release, signed, text_buffer

#: Terms are runs of letters a-z (after lower-casing) and non-ASCII characters.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

SCALE = 1_000_000_000
CHUNK_BYTES = 1 << 20
#: Bits of a term's hash that the bitmap knows (2^26 bits: 8 MB).
BITMAP_BITS = 26
#: (term, source) counts that a task of the pair sums should hold, sources of its left
#: block, and cells of its dense work array.
BUCKET_ROWS, SOURCE_BLOCK, CELLS = 200_000, 256, 1 << 20
#: Terms kept by a task between two writes of its skybands.
HELD_TERMS = 500_000


def _substrings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The lower-cased words at these byte ranges."""
    length = end - start
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(length, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], length)
    raw = _LOWER[data[at]]
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets.tobytes()),
                                            pa.py_buffer(raw.tobytes())).cast(pa.string())


def _term_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold a term, by lang and the term's hash."""
    for batch in batches:
        release()
        data, offsets = text_buffer(batch.column(0))
        code = batch.column(1).dictionary_encode()
        lang = code.indices.to_numpy()
        held = []
        for n, (a, b) in enumerate(groups(offsets, CHUNK_BYTES), 1):
            words = Words(data, offsets[a: b + 1], LETTERS)
            key, term = np.unique(words.hash, return_inverse=True)
            pair = np.unique(words.owner() * len(key) + term) if len(key) else np.empty(0, np.int64)
            of = lang[a + pair // max(1, len(key))].astype(np.int64) * len(key) + pair % max(1, len(key))
            of, docs = np.unique(of, return_counts=True)
            held.append((of // max(1, len(key)), key[of % max(1, len(key))] if len(key) else key, docs))
            if n % 8 == 0:
                held = [_added(held)]
        if not held:
            continue
        at, key, docs = _added(held)
        yield pa.RecordBatch.from_arrays([code.dictionary.take(pa.array(at)), pa.array(signed(key)), pa.array(docs)],
                                         ["lang", "key", "docs"])


def _added(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of equal (lang, key) added up."""
    lang, key, docs = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((key, lang))
    lang, key, docs = lang[order], key[order], docs[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (lang[1:] != lang[:-1])
    at = np.flatnonzero(new)
    return lang[at], key[at], np.add.reduceat(docs, at) if len(at) else docs


def frequent_hashes(rows: DataFrame, least_docs: int) -> np.ndarray:
    """Bitmap of the hashes (their first ``BITMAP_BITS`` bits) of terms that a lang may keep.
    It has one size whatever the vocabulary: with more terms it lets more others through."""
    held = (rows.select("text", "lang").mapInArrow(_term_documents, "lang string, key long, docs long")
            .groupBy("lang", "key").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs))
    bit = F.shiftrightunsigned("key", 64 - BITMAP_BITS) + 1  # these functions count from 1
    chunks = (held.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket"))
              .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")))
    out = np.zeros((1 << BITMAP_BITS) // 8, np.uint8)
    for r in chunks.toLocalIterator():  # 4 KB each
        start = (r["bucket"] - 1) * 4096
        out[start: start + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _marked(bitmap: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which hashes are marked."""
    bit = (key >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
    return (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)


def _count(shared):
    """Occurrences and documents of the marked terms of a batch by (lang, source)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in batches:
            release()
            data, offsets = text_buffer(batch.column(0))
            codes = [batch.column(i).dictionary_encode() for i in (1, 2)]
            lang, source = (c.indices.to_numpy().astype(np.int64) for c in codes)
            n_sources = len(codes[1].dictionary)
            group = lang * n_sources + source
            for a, b in groups(offsets, CHUNK_BYTES):
                words = Words(data, offsets[a: b + 1], LETTERS)
                at = np.flatnonzero(_marked(bitmap, words.hash))
                if not len(at):
                    continue
                _, first, term = np.unique(words.hash[at], return_index=True, return_inverse=True)
                n_terms, first = len(first), at[first]
                held, n = np.unique(words.owner()[at] * n_terms + term, return_counts=True)
                key, place = np.unique(group[a + held // n_terms] * n_terms + held % n_terms, return_inverse=True)
                total = np.bincount(place, weights=n, minlength=len(key)).astype(np.int64)
                text = _substrings(data, words.start[first], words.end[first])
                lang_at, source_at = np.divmod(key // n_terms, n_sources)
                yield pa.RecordBatch.from_arrays(
                    [codes[0].dictionary.take(pa.array(lang_at)), codes[1].dictionary.take(pa.array(source_at)),
                     text.take(pa.array(key % n_terms)), pa.array(total), pa.array(np.bincount(place, minlength=len(key)))],
                    ["lang", "source", "term", "n", "docs"])

    return run


def kept_terms(rows: DataFrame, least_docs: int) -> DataFrame:
    """``lang, source, term, n, lang_n, first``: counts of the terms that a lang keeps;
    ``first`` marks one row of each term.  ``rows``: ``text, lang, source`` without nulls."""
    shared = rows.sparkSession.sparkContext.broadcast(frequent_hashes(rows, least_docs))  # of fixed size
    counts = (rows.select("text", "lang", "source")
              .mapInArrow(_count(shared), "lang string, source string, term string, n long, docs long")
              .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    term = W.Window.partitionBy("lang", "term")
    return (counts.withColumn("lang_n", F.sum("n").over(term)).withColumn("held", F.sum("docs").over(term))
            .withColumn("first", F.col("source") == F.min("source").over(term)).where(F.col("held") >= least_docs)
            .select("lang", "source", "term", "n", "lang_n", "first"))


def shares(n: np.ndarray, total: int, terms: int) -> np.ndarray:
    """``1 + floor(SCALE (n + 2) / (total + 2 terms))``, exact for any count."""
    if n.size == 0 or int(n.max()) < (1 << 63) // SCALE - 2:
        return 1 + SCALE * (n + 2) // (total + 2 * terms)
    return np.array([1 + SCALE * (int(x) + 2) // (total + 2 * terms) for x in n.ravel()], np.int64).reshape(n.shape)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    gap = p - q
    return gap * gap // (p + q)


def _pairs(left: pa.Table, right: pa.Table) -> pa.Table:
    """Sums over a bucket's terms for the pairs (source of the block, other source)."""
    release()
    lang = left.column("lang")[0].as_py()
    sources = left.column("source").to_pylist()
    total, terms = left.column("total").to_pylist(), left.column("terms")[0].as_py()
    mine = np.flatnonzero(left.column("mine").to_numpy())
    sums = np.zeros((len(mine), len(sources)), np.int64)
    if right.num_rows:
        place = {s: i for i, s in enumerate(sources)}
        row = np.array([place[s] for s in right.column("source").to_pylist()])
        code = right.column("term").combine_chunks().dictionary_encode()
        column, n = code.indices.to_numpy(), right.column("n").to_numpy()
        order = np.argsort(column, kind="stable")
        row, column, n = row[order], column[order], n[order]
        width = max(1, CELLS // len(sources))
        for c in range(0, len(code.dictionary), width):
            a, b = np.searchsorted(column, (c, c + width))
            cells = np.zeros((len(sources), min(width, len(code.dictionary) - c)), np.int64)
            cells[row[a:b], column[a:b] - c] = n[a:b]
            p = np.stack([shares(x, t, terms) for x, t in zip(cells, total, strict=True)])
            for k, i in enumerate(mine):
                sums[k] += divergence(p[i], p).sum(axis=1)
    other = np.arange(len(sources))[None, :] != mine[:, None]
    i, j = np.nonzero(other)
    names = pa.array(sources, pa.string())
    return pa.table({"lang": pa.array([lang] * len(i), pa.string()), "source": names.take(pa.array(mine[i])),
                     "item": names.take(pa.array(j)), "value": pa.array(sums[i, j])})


def skyband(n: np.ndarray, lang_n: np.ndarray, terms: pa.Array, k: int) -> np.ndarray:
    """Places of the terms that fewer than k others dominate: a count at least as high, a
    lang count at most as high, and an earlier term."""
    by_term = pc.sort_indices(terms).to_numpy()
    at = np.empty(len(by_term), np.int64)
    at[by_term] = np.arange(len(by_term))
    order = np.lexsort((at, lang_n, -n))  # whoever dominates a term comes before it
    # equal counts: only the first k terms can stay, whatever else there is
    new = np.ones(len(order), bool)
    new[1:] = (n[order][1:] != n[order][:-1]) | (lang_n[order][1:] != lang_n[order][:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    order = order[np.arange(len(order)) - start < k]
    kept = np.empty(0, np.int64)
    for s in range(0, len(order), 512):
        some = order[s: s + 512]
        for rivals, inside in ((kept, False), (some, True)):
            if inside:
                rivals = some  # those that are left
            over = ((n[rivals] >= n[some][:, None]) & (lang_n[rivals] <= lang_n[some][:, None])
                    & (at[rivals] < at[some][:, None])).sum(axis=1)
            if inside:
                some = some[over + before < k]
            else:
                stay = over < k
                some, before = some[stay], over[stay]
        kept = np.concatenate([kept, some])
    return kept


def _local(k: int):
    """Skybands of the groups of a partition: ``lang, source, term, n, lang_n``."""

    def emit(held):
        for (lang, source), t in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * t.num_rows, pa.string()), pa.array([source] * t.num_rows, pa.string()),
                 *(t.column(c).combine_chunks() for c in ("term", "n", "lang_n"))],
                ["lang", "source", "term", "n", "lang_n"])

    def run(batches):
        held: dict[tuple[str, str], pa.Table] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            code = [table.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source")]
            group = code[0].indices.to_numpy().astype(np.int64) * len(code[1].dictionary) + code[1].indices.to_numpy()
            order = np.argsort(group, kind="stable")
            cut = np.flatnonzero(np.diff(group[order])) + 1
            for rows in np.split(order, cut) if len(order) else ():
                some = table.take(pa.array(rows))
                key = (some.column("lang")[0].as_py(), some.column("source")[0].as_py())
                some = some.select(["term", "n", "lang_n"])
                if key in held:
                    some = pa.concat_tables([held[key], some])
                stay = skyband(some.column("n").to_numpy(), some.column("lang_n").to_numpy(),
                               some.column("term").combine_chunks(), k)
                held[key] = some.take(pa.array(stay)).combine_chunks()
            if sum(t.num_rows for t in held.values()) > HELD_TERMS:
                yield from emit(held)
                held = {}
        yield from emit(held)

    return run


def _merged(k: int):
    def run(table: pa.Table) -> pa.Table:
        stay = skyband(table.column("n").to_numpy(), table.column("lang_n").to_numpy(),
                       table.column("term").combine_chunks(), k)
        return table.take(pa.array(stay))

    return run


def _ranked(k: int):
    """The first k terms of a group by exact divergence."""

    def run(table: pa.Table) -> pa.Table:
        one = {c: table.column(c)[0].as_py() for c in ("lang", "source", "total", "lang_total", "terms")}
        p = shares(table.column("n").to_numpy(), one["total"], one["terms"])
        q = shares(table.column("lang_n").to_numpy(), one["lang_total"], one["terms"])
        at = np.flatnonzero(p > q)
        value, term = divergence(p, q)[at], table.column("term").combine_chunks().take(pa.array(at))
        place = np.empty(len(at), np.int64)
        place[pc.sort_indices(term).to_numpy()] = np.arange(len(at))
        order = np.lexsort((place, -value))[:k]
        return pa.table({"lang": pa.array([one["lang"]] * len(order), pa.string()),
                         "source": pa.array([one["source"]] * len(order), pa.string()),
                         "item": term.take(pa.array(order)), "value": pa.array(value[order]),
                         "rank": pa.array(np.arange(1, len(order) + 1, dtype=np.int32))})

    return run


def source_divergence(docs: DataFrame, least_docs: int = 10, k: int = 10) -> DataFrame:
    """``lang, source, part, item, value, rank``: how each (lang, source) group differs from
    the lang's other sources (part ``pair``, all of them) and from the lang as a whole
    (part ``term``, the first k terms that it has more often than the lang).

    ``docs``: ``text, lang, source``; nulls are empty strings (a null lang or source is the
    lang or source of the empty string).  Every row is a document.  A group without terms
    is a group all the same; in a lang that keeps no term all pairs have value 0.  Equal
    values are ranked by the item's UTF-8 bytes.  An empty table gives no rows.
    """
    rows = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")))
    kept = materialize(kept_terms(rows, least_docs), "kept-terms")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("first").cast("long")).alias("terms"))
    stats = (rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left")
             .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms")))
    by_lang = W.Window.partitionBy("lang")
    stats = materialize(stats.withColumn("lang_total", F.sum("total").over(by_lang))
                        .withColumn("terms", F.sum("terms").over(by_lang))
                        .withColumn("place", F.row_number().over(by_lang.orderBy("source")) - 1), "groups")

    most = kept.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    buckets = max(1, math.ceil(most / BUCKET_ROWS))
    block = F.floor(F.col("place") / SOURCE_BLOCK)
    blocks = stats.groupBy("lang").agg(F.max(block).alias("last"))
    sides = (stats.join(blocks, "lang").withColumn("block", F.explode(F.sequence(F.lit(0), "last")))
             .withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
             .select("lang", "bucket", F.col("block").cast("long").alias("block"), "source", "total", "terms",
                     (block == F.col("block")).alias("mine")))
    counts = (kept.join(blocks, "lang").withColumn("block", F.explode(F.sequence(F.lit(0), "last")))
              .select("lang", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket"),
                      F.col("block").cast("long").alias("block"), "source", "term", "n"))
    key = ("lang", "bucket", "block")
    pairs = (sides.groupBy(*key).cogroup(counts.groupBy(*key))
             .applyInArrow(_pairs, "lang string, source string, item string, value long")
             .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    by_group = W.Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value",
                         F.row_number().over(by_group).alias("rank"))

    shape = "lang string, source string, term string, n long, lang_n long"
    local = kept.select("lang", "source", "term", "n", "lang_n").mapInArrow(_local(k), shape)
    salts = max(1, math.isqrt(len(kept.inputFiles())))  # neither merge meets more than a root of the files
    band = (local.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(salts))).groupBy("lang", "source", "salt")
            .applyInArrow(_merged(k), shape + ", salt long").drop("salt"))
    terms = (band.join(stats, ["lang", "source"]).groupBy("lang", "source")
             .applyInArrow(_ranked(k), "lang string, source string, item string, value long, rank int"))
    return pairs.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


SQL = """
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source
  FROM documents),
w AS (
  SELECT id, lang, source, unnest(regexp_extract_all(
    translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM d),
l AS (
  SELECT lang, term, count(*) AS n, count(DISTINCT id) AS docs FROM w GROUP BY lang, term
  HAVING count(DISTINCT id) >= 10),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w SEMI JOIN l ON w.lang = l.lang AND w.term = l.term GROUP BY ALL),
lang_total AS (SELECT lang, sum(n) AS total, count(*) AS v FROM l GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
group_total AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source
  GROUP BY g.lang, g.source),
p AS (
  SELECT t.lang, t.source, l.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (t.total + 2 * x.v) AS p,
         1 + (1000000000::HUGEINT * (l.n + 2)) // (x.total + 2 * x.v) AS q
  FROM group_total t JOIN l ON l.lang = t.lang JOIN lang_total x ON x.lang = t.lang
  LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = l.term),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value
  FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
