from __future__ import annotations

from leaksieve.operators.incremental import incremental_scan, ruleset_key, scan_contents
from leaksieve.operators.scan import scan
from leaksieve.rules.catalogue import standard_rules
from leaksieve.rules.model import user_rules
from checks.registry import extended
from tests.conftest import as_tuples, corpus

RULES = standard_rules()


def test_only_new_contents_are_scanned_and_names_are_current(spark):
    first = corpus(spark, "AB123CD77", "nothing here", "")
    stored = scan_contents(first, RULES)
    # A mark for each of the two texts that hold something, and one finding.
    assert stored.where("type is null").count() == 2 and stored.count() == 3
    second = spark.createDataFrame(
        [("moved", "AB123CD77"), ("copy", "AB123CD77"), ("new", "XY123CD77"), ("same", "nothing here"), ("e", "")],
        "file string, text string",
    )
    for rows_per_task in (1, 1_000_000):
        findings, fresh = incremental_scan(second, RULES, stored, rows_per_task=rows_per_task)
        assert sorted(as_tuples(findings)) == sorted(as_tuples(scan(second, RULES)))
        assert [r.snippet for r in fresh.where("type is not null").collect()] == ["XY123CD77"]
        assert fresh.count() == 2


def test_stored_findings_are_used_as_they_are(spark):
    first = corpus(spark, "AB123CD77")
    stored = scan_contents(first, RULES).selectExpr(
        "content_md5", "ruleset", "replace(type, 'Car', 'Edited') AS type", "line", "snippet", "severity"
    )  # an older store without the later columns
    findings, fresh = incremental_scan(first, RULES, stored)
    assert [r.type for r in findings.collect()] == ["Edited Plate Number"] and fresh.count() == 0


def test_other_rules_or_options_do_not_use_the_store(spark):
    texts = corpus(spark, "AB123CD77 http://x.org")
    stored = scan_contents(texts, RULES)
    for rules, options in ((extended(), {}), (RULES, {"domains": ["x.org"]}), (RULES, {"options": "unescaped"})):
        _, fresh = incremental_scan(texts, rules, stored, **options)
        assert fresh.select("content_md5").distinct().count() == 1
    keys = {
        ruleset_key(RULES),
        ruleset_key(RULES, ["x.org"]),
        ruleset_key(RULES, options="u"),
        ruleset_key(extended()),
        ruleset_key(user_rules({"a": "b"})),
        ruleset_key(user_rules({"a": "c"})),
    }
    assert len(keys) == 6


def test_texts_never_move(spark, tmp_path):
    corpus(spark, "AB123CD77", "XY123CD77 and", "nothing", "AB123CD77").write.parquet(str(tmp_path / "texts"))
    texts = spark.read.parquet(str(tmp_path / "texts"))
    stored = scan_contents(texts.where("file = '2'"), RULES)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = scan_contents(texts, RULES, known=stored)
        plan = fresh._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        moved = [block for block in plan.split("\n\n") if "Exchange" in block.strip().split("\n")[0] and "Input" in block]
        assert moved and not any("text#" in block or "_text#" in block for block in moved)
        assert {r.snippet for r in fresh.where("type is not null").collect()} == {"AB123CD77", "XY123CD77"}
        assert fresh.where("type is null").count() == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
