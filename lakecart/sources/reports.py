"""Semi-structured inputs: evaluation cases (S8) and scanner findings reports (Q14)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CASE_KINDS = ("domain", "routing", "tools", "proposal", "guardrail")
FINDING_KINDS = ("Vulnerabilities", "Secrets", "Misconfigurations")

_TURN = T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType())])
CASES = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("split", T.StringType()),
    T.StructField("metadata", T.StructType([T.StructField("kind", T.StringType()),
                                            T.StructField("source", T.StringType())])),
    T.StructField("history", T.ArrayType(_TURN)), T.StructField("recent_confirmation", T.BooleanType()),
    T.StructField("input", T.StringType()),
    # the expected block varies by kind; it is kept as JSON text and parsed per kind
    T.StructField("expected", T.StringType()),
])

_FINDING = T.StructType([
    T.StructField("Severity", T.StringType()), T.StructField("VulnerabilityID", T.StringType()),
    T.StructField("ID", T.StringType()), T.StructField("RuleID", T.StringType()),
    T.StructField("StartLine", T.LongType()),
    T.StructField("CauseMetadata", T.StructType([T.StructField("StartLine", T.LongType())])),
])
FINDINGS = T.StructType([T.StructField("Results", T.ArrayType(T.StructType(
    [T.StructField("Target", T.StringType())] + [T.StructField(k, T.ArrayType(_FINDING)) for k in FINDING_KINDS])))])


class CaseError(ValueError):
    pass


def read_cases(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """JSONL cases with an explicit nested schema.  Duplicate ids, an unknown
    ``metadata.kind`` or an empty selected split are errors (each checked with a
    limit-1 probe, nothing is collected)."""
    cases = spark.read.schema(CASES).json(path)
    if not cases.groupBy("id").count().where(F.col("count") > 1).isEmpty():
        raise CaseError("duplicate case ids")
    if not cases.where(~F.coalesce(F.col("metadata.kind").isin(*CASE_KINDS), F.lit(False))).isEmpty():
        raise CaseError("unknown case kind")
    selected = cases if split is None else cases.where(F.col("split") == split)
    if selected.isEmpty():
        raise CaseError("the split has no cases")
    return selected.select("*", F.col("metadata.kind").alias("kind"))


def flatten_findings(spark: SparkSession, path: str) -> DataFrame:
    """Q14: one row per finding — severity, the first present of the three ids, target,
    line (own or from the cause metadata)."""
    results = spark.read.schema(FINDINGS).option("multiLine", True).json(path).select(
        F.explode_outer("Results").alias("r"))
    parts = [results.select(F.col("r.Target").alias("target"), F.lit(k).alias("kind"),
                            F.explode(F.col(f"r.{k}")).alias("f")) for k in FINDING_KINDS]
    flat = reduce(lambda a, b: a.unionByName(b), parts)
    return flat.select(
        F.col("f.Severity").alias("severity"),
        F.coalesce("f.VulnerabilityID", "f.ID", "f.RuleID").alias("identifier"),
        "target", "kind",
        F.coalesce("f.StartLine", "f.CauseMetadata.StartLine").alias("line"))
