"""Findings at rest: runs that replace themselves, arrays read in parts, malformed records; pairs by whole matches."""

from __future__ import annotations

import json
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from leaksieve.functions.text import bag_ratio, similarity
from leaksieve.operators.dedupe import duplicate_pairs
from leaksieve.operators.scan import scan
from leaksieve.rules.catalogue import standard_rules
from leaksieve.sources.findings import read_findings, read_runs, write_run
from tests.conftest import corpus


def findings(spark, *rows):
    schema = "type string, file string, line int, snippet string, severity string, match_md5 string"
    return spark.createDataFrame([("T", file, 1, "s", severity, "m") for file, severity in rows], schema)


def saved(spark, path):
    return sorted((r.run, r.file, r.severity) for r in read_runs(spark, path).collect())


def test_a_run_saved_again_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "runs")
    write_run(findings(spark, ("a", "high"), ("b", "critical"), ("c", "high")), path, "r1")
    write_run(findings(spark, ("x", "medium")), path, "r2")
    first = [("r1", "a", "high"), ("r1", "b", "critical"), ("r1", "c", "high")]
    assert saved(spark, path) == [*first, ("r2", "x", "medium")]
    write_run(findings(spark, ("a", "high"), ("b", "critical"), ("c", "high")), path, "r1")
    assert saved(spark, path) == [*first, ("r2", "x", "medium")]
    write_run(findings(spark, ("d", "high")), path, "r1")  # a severity less than before
    assert saved(spark, path) == [("r1", "d", "high"), ("r2", "x", "medium")]
    write_run(findings(spark), path, "r2")
    assert saved(spark, path) == [("r1", "d", "high")]
    plan = read_runs(spark, path).where("run = 'r1' AND severity = 'high'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan
    with pytest.raises(ValueError, match="run"):
        write_run(findings(spark), path, "a/b")


def test_an_array_is_read_in_parts(spark, tmp_path):
    rows = [
        {"type": "T", "file": f"f{n}", "line": n, "snippet": 'a},\n  {"x": "}\n  }", [ü] \\' * (n % 3), "severity": "low"} for n in range(500)
    ]
    path = tmp_path / "array.json"
    path.write_text(json.dumps(rows, indent=2, ensure_ascii=False), encoding="utf-8")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4_096)
    try:
        found = read_findings(spark, str(path), one_array=True, indent=2)
        assert found.rdd.getNumPartitions() > 10
        assert sorted((r.file, r.line, r.snippet) for r in found.collect()) == sorted((r["file"], r["line"], r["snippet"]) for r in rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    for text, count in (("[]", 0), ("[\n]", 0), (json.dumps(rows[:1], indent=2), 1)):
        path.write_text(text, encoding="utf-8")
        assert read_findings(spark, str(path), one_array=True, indent=2).count() == count


def test_malformed_records_have_their_own_column(spark, tmp_path):
    good = {"type": "T", "file": "f", "line": 1, "snippet": "s", "severity": "low"}
    lines = tmp_path / "lines.json"
    lines.write_text(json.dumps(good) + '\n{"type": "T", "file"\n\n' + json.dumps({**good, "line": "x"}) + "\n")
    array = tmp_path / "array.json"
    array.write_text(json.dumps([good, good, good], indent=2).replace('"line": 1', '"line": x', 1))
    for read, kept, lost in (
        (lambda **o: read_findings(spark, str(lines), **o), 1, 2),
        (lambda **o: read_findings(spark, str(array), one_array=True, indent=2, **o), 2, 1),
    ):
        assert read().count() == kept and "malformed" not in read().columns
        everything = read(malformed=True).collect()
        assert len(everything) == kept + lost and sum(r.malformed is not None for r in everything) == lost


def test_pairs_go_by_the_whole_match(spark):
    head = "eyJ" + "hbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9" * 4 + "."
    texts = corpus(spark, f"{head}abcd.ef", f"{head}ab--cd.ef", f"{head}ab{'-' * 90}cd.ef", f"{head}other.ef")
    found = scan(texts, standard_rules(), whole=True).where("type = 'JWT Token'").cache()
    assert found.where("length(match) > 110 AND length(snippet) = 100").count() == 4
    pairs = duplicate_pairs(found)
    got = {(r.current.file, r.first.file): r.similarity for r in pairs.collect()}
    want = {}
    text = {r.file: r.match for r in found.collect()}
    for other in ("1", "2"):
        ratio = SequenceMatcher(None, text[other], text["0"]).ratio()
        if ratio >= 0.85:
            want[other, "0"] = ratio
    assert got == want and ("1", "0") in want and want["1", "0"] < 1


def test_the_bound_rejects_no_pair(spark):
    rng = random.Random(5)
    rows = [("", ""), ("a", ""), ("aab", "aba"), ("ü😀x", "x😀ü")]
    for _ in range(400):
        a = "".join(rng.choices("abcdé ", k=rng.randint(0, 60)))
        b = "".join(c for c in a if rng.random() < 0.8) + "".join(rng.choices("abx", k=rng.randint(0, 9)))
        rows.append((a, b))
    pairs = spark.createDataFrame(rows, "a string, b string").select(
        "*", bag_ratio(F.col("a"), F.col("b")).alias("bound"), similarity(F.col("a"), F.col("b")).alias("ratio")
    )
    for r in pairs.collect():
        assert r.bound >= r.ratio - 1e-12
        assert r.ratio == pytest.approx(SequenceMatcher(None, r.a, r.b).ratio())
