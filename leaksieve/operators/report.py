"""Roll-ups and listings of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaksieve.functions.severity import severity_rank

DEFAULT_SEVERITY = "medium"


def _graded(findings: DataFrame) -> DataFrame:
    return findings.withColumn("severity", F.coalesce("severity", F.lit(DEFAULT_SEVERITY)))


def severity_type_counts(findings: DataFrame) -> DataFrame:
    return _graded(findings).groupBy("severity", "type").agg(F.count(F.lit(1)).alias("found"))


def by_severity(findings: DataFrame) -> DataFrame:
    """Findings with the display rank of their severity, worst first."""
    ranked = _graded(findings).withColumn("severity_rank", severity_rank(F.col("severity")))
    return ranked.orderBy("severity_rank", "type", "file", "line", "snippet")


def findings_report(findings: DataFrame) -> DataFrame:
    """File, line and snippet under severity and type, with the size of each heading.

    How the headings are joined is left to Spark, which sends them only where it has measured them to be small.
    """
    headings = severity_type_counts(findings)
    rows = _graded(findings).select("severity", "type", "file", "line", "snippet")
    return by_severity(rows.join(headings, ["severity", "type"])).select(
        "severity_rank", "severity", "type", "found", "file", "line", "snippet"
    )


def run_stats(corpus: DataFrame, raw: DataFrame, clean: DataFrame) -> DataFrame:
    """One row: texts processed, findings before and after the clean-up, removed."""
    sources = {"files_processed": corpus, "findings_raw": raw, "findings_clean": clean}
    counted = None
    for name, source in sources.items():
        one = source.select(*(F.lit(int(other == name)).cast("long").alias(other) for other in sources))
        counted = one if counted is None else counted.unionByName(one)
    totals = counted.agg(*(F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in sources))
    return totals.withColumn("duplicates_removed", F.col("findings_raw") - F.col("findings_clean"))
