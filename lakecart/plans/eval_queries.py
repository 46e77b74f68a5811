"""Registered evaluation and latency-report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import half_up_sql
from ..functions.text import input_decision
from ..operators import evals
from ..registry import register
from .views import Views, sql_ctes

# Gate parameters of the latency report (ms) and calibration rule.
DEFAULT_LIMIT_MS = 30.0
CALIBRATION_FACTOR, CALIBRATION_STEP = 1.5, 10


def labelled_cases(spark, sf_dir):
    """Evaluation cases from the labelled corpus: every labelled document is a user input
    run through the input guard.  Spanish documents are ``domain`` cases (expected in
    domain = quality label), the others ``guardrail`` cases (expected blocked = toxic).  The
    answer is the document itself, whole: V6 says which texts hold personal data."""
    v = Views(spark, sf_dir)
    docs = v.documents.select("doc_id", "text", "lang")
    d = v.labels.join(docs, "doc_id").withColumn("decision", input_decision("text"))
    return d.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("case_id"),
        F.when(F.col("lang") == "es", "domain").otherwise("guardrail").alias("kind"),
        (F.col("quality") == 1).alias("expected_in_domain"),
        F.col("decision.reason").isNull().alias("in_domain"),
        (F.col("toxic") == 1).alias("expected_blocked"),
        F.col("decision.reason").isNotNull().alias("blocked"),
        F.col("text").alias("answer"),
        F.lit(None).cast("string").alias("error"))


@register("v9_scores")
def v9(spark, sf_dir):
    return evals.score_cases(labelled_cases(spark, sf_dir))


@register("v10_summary")
def v10(spark, sf_dir):
    return evals.summarize(v9(spark, sf_dir))


@register("d11_threshold_gate")
def d11(spark, sf_dir):
    return evals.threshold_gate(v10(spark, sf_dir), "offline")


@register("v11_confusion")
def v11(spark, sf_dir):
    c = labelled_cases(spark, sf_dir)
    domain, guardrail = (
        evals.confusion(c.where(F.col("kind") == kind), expected, actual, [False, True]).select(F.lit(kind).alias("kind"), "*")
        for kind, expected, actual in (("domain", "expected_in_domain", "in_domain"), ("guardrail", "expected_blocked", "blocked")))
    return domain.unionByName(guardrail)


_RANKED = ("ranked", """SELECT event_type, v, n, rn FROM (
    SELECT event_type, CAST(value AS DECIMAL(18,2)) AS v, count(*) OVER (PARTITION BY event_type) AS n,
      row_number() OVER (PARTITION BY event_type ORDER BY CAST(value AS DECIMAL(18,2))) AS rn FROM events)""")


@register("q15_latency_report", sql_ctes(f"""SELECT event_type, count(*) AS n,
  {half_up_sql("CAST(sum(v) * 100 AS BIGINT)", "count(v)")} AS avg, min(v) AS min, max(v) AS max,
  {half_up_sql("CAST((max(v) FILTER (WHERE rn = (n + 1) // 2) + max(v) FILTER (WHERE rn = n // 2 + 1)) * 100 AS BIGINT)", "2")} AS median,
  max(v) FILTER (WHERE rn = CAST(ceil(n * 0.95) AS BIGINT)) AS p95,
  CAST({DEFAULT_LIMIT_MS} AS DECIMAL(18,2)) AS "limit",
  max(v) FILTER (WHERE rn = CAST(ceil(n * 0.95) AS BIGINT)) < CAST({DEFAULT_LIMIT_MS} AS DECIMAL(18,2)) AS passed
FROM ranked GROUP BY event_type""", (), [_RANKED]))
def q15(spark, sf_dir):
    return evals.latency_report(Views(spark, sf_dir).events, ["event_type"], "value", default_limit=DEFAULT_LIMIT_MS)


@register("q15_calibrate_threshold", f"""SELECT event_type, max(p95) AS max_p95,
  CAST(ceil(max(p95) * 1.5 / {CALIBRATION_STEP}) * {CALIBRATION_STEP} AS BIGINT) AS "limit"
FROM (SELECT event_type, day, max(v) FILTER (WHERE rn = CAST(ceil(n * 0.95) AS BIGINT)) AS p95 FROM (
    SELECT event_type, CAST(ts AS DATE) AS day, CAST(value AS DECIMAL(18,2)) AS v,
      count(*) OVER (PARTITION BY event_type, CAST(ts AS DATE)) AS n,
      row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY CAST(value AS DECIMAL(18,2))) AS rn
    FROM events) GROUP BY event_type, day)
GROUP BY event_type""")
def q15c(spark, sf_dir):
    ev = Views(spark, sf_dir).events.select(
        "event_type", F.to_date("ts").alias("day"), F.col("value").cast("decimal(18,2)").alias("v"))
    runs = evals.order_stats(ev, ["event_type", "day"], "v")
    return evals.calibrate_threshold(runs, ["event_type"], CALIBRATION_FACTOR, CALIBRATION_STEP)
