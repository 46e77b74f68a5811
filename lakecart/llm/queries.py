"""Thin registered queries over the operators of this folder, with DuckDB SQL where SQL
can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import load
from . import divergence, interactions, topk
from .common import crc_mod, documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {"op11_top_k_search": topk.SQL, "op12_filter_interactions": interactions.SQL,
                          "op13_source_divergence": divergence.SQL}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every text, as digests."""
    import public_tokenizers

    from . import bpe

    return bpe.byte_bpe_round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                                   public_tokenizers.PATTERN, space_leads=True)


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learnt from the documents outside fold 2 of 4."""
    from . import langid

    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    fold = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    out = langid.identify(docs.select("doc_id", "text"), docs.where(~fold))
    return out.select("doc_id", fold.alias("held_out"), "lang_pred", "score")


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learnt from labels outside fold 1 of 3."""
    from . import toxicity

    docs = documents(spark, sf_dir, "doc_id", "text")
    fold = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    labels = load(spark, sf_dir, "labels").where(~fold).select("doc_id", F.col("toxic").alias("label"))
    out = toxicity.classify(docs, docs, labels)
    return out.select("doc_id", fold.alias("held_out"), F.col("toxic_score").alias("score"),
                      F.col("toxic_predicted").alias("predicted"))


@query
def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by 5-word shingles at Jaccard 0.75 or more."""
    from . import sigtree

    return sigtree.jaccard_components(documents(spark, sf_dir, "doc_id", "text"))


@query
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as token pieces in sequences of at most 2048."""
    import public_tokenizers

    from . import packing

    return packing.pack(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate secret of every text, with the forest's score and verdict."""
    from . import secrets

    return secrets.scan(documents(spark, sf_dir, "doc_id", "text"))


@query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and templates in every text."""
    from . import licenses

    return licenses.scan(documents(spark, sf_dir, "doc_id", "text")).drop("matches")




@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every text and the verdict of base rules and robust distance."""
    from . import quality

    return quality.assess(documents(spark, sf_dir, "doc_id", "text", "lang", "source"))


@query
def op5_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of embeddings at cosine 0.9 or more."""
    from . import neardup

    return neardup.near_duplicates(load(spark, sf_dir, "embeddings"))


@query
def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every text, learnt from the documents outside fold 2 of 7."""
    from . import lm

    return lm.score_texts(documents(spark, sf_dir, "doc_id", "text"), crc_mod("doc_id", 7) == 2)


@query
def op11_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest inner products of every fiftieth embedding."""
    return topk.top_inner_products(load(spark, sf_dir, "embeddings"))


@query
def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in each of their 120 orders, by language."""
    return interactions.interactions(documents(spark, sf_dir), load(spark, sf_dir, "labels"))


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each source differs from the other sources and from all of its language."""
    return divergence.source_divergence(documents(spark, sf_dir))
