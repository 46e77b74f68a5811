"""A training-data pipeline over ``documents``: five stages of the operators in
``lakecart.llm``.  Each stage is written as a table and read again by the next.

Rejected documents go at stages 1 to 3 (no identifiable language or surely another than
stated, toxic, not the first of its near-duplicate group); stage 4 masks secrets in place; stage 5 packs what is left
into sequences.  Documents keep all columns of ``documents`` up to stage 4.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lakecart.llm import langid, packing, secrets, sigtree, toxicity
from lakecart.llm.common import materialize
from lakecart.sources.tables import load

ORACLE_SQL = None


#: Score from which a prediction that differs from the stated language rejects a document.
SURE = 0.9


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose text is null or has no letter in it (they have no
    identifiable language), and those that are surely in another language than the source
    states.  ``lang`` stays the source's; documents without one are not compared."""
    scored = langid.identify(docs, docs)
    wrong = F.coalesce((scored["lang"] != F.col("lang_pred")) & (F.col("score") >= SURE), F.lit(False))
    return scored.where((F.col("lang_pred") != langid.UNDETERMINED) & ~wrong).select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with a toxicity score of 0.7 or more."""
    labels = load(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return toxicity.classify(docs, docs, labels).where(F.col("toxic_predicted") == 0).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group; of rows with an equal id one
    stays, the same on every run.  Rows without an id belong to no group; equal texts
    among them stay once."""
    known = docs.where(F.col("doc_id").isNotNull())
    groups = sigtree.jaccard_components(known)
    first = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    by_id = W.Window.partitionBy("doc_id").orderBy(F.xxhash64(*[c for c in docs.columns if c != "doc_id"]))
    kept = known.join(first, "doc_id", "left_semi").withColumn("_r", F.row_number().over(by_id)).where("_r = 1")
    return kept.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()).dropDuplicates(["text"]))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets; no document goes."""
    return secrets.redact_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of at most 2048."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language ID", language), ("toxicity", toxic), ("n-gram Jaccard join", near_duplicates),
          ("secret scans", secret_scan), ("best-fit packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; rows: pieces with ids and places."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
