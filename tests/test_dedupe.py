from __future__ import annotations

import re
from difflib import SequenceMatcher

from leaksieve.operators.dedupe import clean_duplicates, duplicate_pairs, duplicate_report
from leaksieve.operators.report import by_severity, findings_report, run_stats, severity_type_counts
from leaksieve.operators.skew import join_hot, number_within
from pyspark.sql import functions as F

SCHEMA = "type string, file string, line int, snippet string, severity string"
FINDINGS = [
    ("A", "src/a.py", 3, "Token: abc", "medium"),
    ("A", "a.py", 9, "token abc", "medium"),
    ("A", "b.py", 1, "TOKEN  abc", "medium"),
    ("B", "a.py", 9, "token abc", "high"),
    ("B", "z.py", 1, "other", None),
    ("C", "q.py", 1, "!a!b!c!", "info"),
    ("C", "r.py", 1, "abc", "info"),
]


def _normal(text):
    return re.sub(r"[^\w\s]", "", re.sub(r"\s+", " ", text.lower().strip()))


def test_shortest_path_wins(spark):
    clean = clean_duplicates(spark.createDataFrame(FINDINGS, SCHEMA))
    assert clean.columns == ["type", "file", "line", "snippet", "severity"]
    best = {}
    for row in sorted(FINDINGS, key=lambda r: (len(r[1]), *r[1:4])):
        best.setdefault((row[0], _normal(row[3])), row)
    assert sorted(map(tuple, clean.collect()), key=str) == sorted(best.values(), key=str)
    assert ("A", "a.py", 9, "token abc", "medium") in best.values()


def test_clean_up_folds_before_the_shuffle(spark):
    plan = clean_duplicates(spark.createDataFrame(FINDINGS, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and plan.count("Exchange") == 1


def _pairs_by_hand(threshold, order):
    firsts, pairs = {}, set()
    for row in sorted(FINDINGS, key=lambda r: (order.index(r[0]) if r[0] in order else len(order), *r[:4])):
        first = firsts.setdefault(_normal(row[3]), row)
        if row != first:
            ratio = SequenceMatcher(None, row[3], first[3]).ratio()
            if ratio >= threshold:
                pairs.add((row, first, ratio))
    return pairs


def test_pairs_with_the_first_of_their_kind(spark):
    findings = spark.createDataFrame(FINDINGS, SCHEMA)
    for threshold in (0.0, 0.85, 1.0):
        for order in (["A", "B", "C"], ["B", "A"]):
            for rows_per_task in (1, 1_000_000):
                pairs = duplicate_pairs(
                    findings, type_order=order, threshold=threshold, rows_per_task=rows_per_task
                )
                got = {(tuple(r.current), tuple(r.first), r.similarity) for r in pairs.collect()}
                assert got == _pairs_by_hand(threshold, order)
    report = duplicate_report(duplicate_pairs(findings, type_order=["A", "B"], threshold=0.9))
    assert ("B", "a.py", 9, "a.py", 9, "100.00%") in {tuple(r) for r in report.collect()}
    assert all(r.similarity.endswith("%") for r in report.collect())


def test_identical_records_are_no_pair(spark):
    twice = spark.createDataFrame([FINDINGS[0], FINDINGS[0]], SCHEMA)
    assert duplicate_pairs(twice).count() == 0


def test_hot_key_is_spread_and_complete(spark):
    many = spark.range(10_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    few = many.select("k").distinct().withColumn("v", F.concat("k", F.lit("!")))
    sizes = many.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    joined = join_hot(many, few, "k", sizes, rows_per_task=100)
    assert joined.count() == 10_000
    assert joined.where("v = concat(k, '!')").select("id").distinct().count() == 10_000


def test_comparisons_with_one_first_are_dealt_out(spark):
    n = F.col("id").cast("int")
    snippet = F.when(n == 0, "a very usual token").otherwise("a very usual token!")
    found = spark.range(110_000).select(F.lit("A").alias("type"), F.format_string("f%07d", n).alias("file"), n.alias("line"), snippet.alias("snippet"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        pairs = duplicate_pairs(found).select(F.spark_partition_id().alias("task")).groupBy("task").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(r["count"] for r in pairs) == 109_999 and len(pairs) > 1


def test_numbers_within_groups(spark):
    rows = spark.range(5_000).select((F.col("id") % 2 == 0).alias("g"), F.col("id").cast("string").alias("u"))
    numbered = number_within(rows, ["g"], F.col("u"), "n")
    per_group = numbered.groupBy("g").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.countDistinct("n").alias("c"))
    assert sorted(map(tuple, per_group.collect())) == [(False, 0, 2499, 2500), (True, 0, 2499, 2500)]


def test_reports(spark):
    findings = spark.createDataFrame(FINDINGS, SCHEMA)
    counts = {(r.severity, r.type): r.found for r in severity_type_counts(findings).collect()}
    assert counts == {("medium", "A"): 3, ("high", "B"): 1, ("medium", "B"): 1, ("info", "C"): 2}
    ranks = [r.severity_rank for r in by_severity(findings).collect()]
    assert ranks == sorted(ranks) == [1, 2, 2, 2, 2, 99, 99]
    report = findings_report(findings).collect()
    assert [(r.severity, r.type, r.found) for r in report][:2] == [("high", "B", 1), ("medium", "A", 3)]
    assert len(report) == len(FINDINGS)
    empty = findings.limit(0)
    assert run_stats(empty, empty, empty).first().asDict() == dict.fromkeys(
        ("files_processed", "findings_raw", "findings_clean", "duplicates_removed"), 0
    )
