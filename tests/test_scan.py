from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from leaksieve.operators.dedupe import clean_duplicates
from leaksieve.operators.scan import distinct_findings, scan, search, union_findings
from leaksieve.rules.catalogue import standard_rules
from leaksieve.rules.model import custom_domain_rule, user_rules
from checks.registry import extended
from tests.conftest import SF, as_tuples, by_hand, corpus

RULES = {r.name: r for r in standard_rules()}


def found(spark, text, *names, **options):
    rules = [RULES[n] for n in names] or standard_rules()
    return [f[1:4] for f in as_tuples(scan(corpus(spark, text), rules, **options))]


def test_match_may_cross_lines(spark):
    assert found(spark, "a\nBearer\nabc def", "Bearer/OAuth Token") == [("Bearer/OAuth Token", 2, "Bearer\nabc")]


def test_password_needs_one_more_character(spark):
    assert found(spark, "passwords", "Password") == [("Password", 1, "passwords")]
    assert found(spark, "foo password", "Password") == []


def test_access_key_has_nineteen_characters(spark):
    assert found(spark, "AKIA" + "Q" * 16, "AWS Access Key") == []
    assert len(found(spark, "AKI" + "Q" * 16, "AWS Access Key")) == 1


def test_same_finding_once_a_line(spark):
    assert found(spark, "x AB123CD77 AB123CD77\nAB123CD77", "Car Plate Number") == [
        ("Car Plate Number", 1, "AB123CD77"),
        ("Car Plate Number", 2, "AB123CD77"),
    ]


def test_snippet_is_cut_at_100_characters(spark):
    (hit,) = found(spark, "é\nAAAA" + "x" * 150, "Firebase Secret")
    assert hit[1:] == (2, "AAAA" + "x" * 96)


def test_the_whole_match_is_what_counts(spark):
    issued = "eyJ" + "h" * 120 + "."
    text = f"é {issued}a.s {issued}b.s {issued}a.s"
    findings = scan(corpus(spark, text, text), [RULES["JWT Token"]])
    places = sorted((r.match_offset, r.match_md5, r.snippet) for r in findings.where("file = '0'").collect())
    matches = [f"{issued}a.s", f"{issued}b.s"]
    assert places == [(text.index(m), hashlib.md5(m.encode()).hexdigest(), m[:100]) for m in matches]
    assert clean_duplicates(findings).count() == 2 and distinct_findings(findings.union(findings)).count() == 4


def test_places_agree_with_a_walk_by_hand(spark):
    text = "пароль\n \tkey x\u00a0secret_key=1;api_key=2!\n\nAB123CD77 AB123CD77 é AB123CD78\nend https://a.example.com/x" * 3
    findings = scan(corpus(spark, text), extended(), domains=["example.com"])
    for row in findings.collect():
        assert text[row.match_offset :].startswith(row.snippet)
        assert text.count("\n", 0, row.match_offset) + 1 == row.line
    assert {"Car Plate Number", "Custom Domain URL"} <= {r.type for r in findings.collect()}


def test_escaped_literals_are_refused(spark):
    spark.conf.set("spark.sql.parser.escapedStringLiterals", "true")
    try:
        with pytest.raises(ValueError):
            scan(corpus(spark, "x"), standard_rules())
    finally:
        spark.conf.unset("spark.sql.parser.escapedStringLiterals")


def test_custom_domains(spark):
    def hits(text):
        return found(spark, text, "Azure Storage Key", domains=["example.com", " "])

    name = "Custom Domain URL"
    assert hits("see https://a.example.com:8080/x?y z") == [(name, 1, "https://a.example.com:8080/x?y")]
    assert hits("https://example.community") == [(name, 1, "https://example.com")]
    assert hits("https://notexample.com/") == []
    assert hits("HTTP://A.EXAMPLE.COM") == [(name, 1, "HTTP://A.EXAMPLE.COM")]
    assert custom_domain_rule([" ", ""]) is None


def test_literal_search(spark):
    texts = corpus(spark, "foo foo \nxFoo foo", "none", "a.c abc")
    rows = search(texts, "foo ").collect()
    assert [(r.file, r.line, r.snippet, r.severity) for r in rows] == [("0", 1, "foo", "info")] * 2
    assert {r.hash for r in rows} == {hashlib.md5(b"foo ").hexdigest()}
    assert clean_duplicates(search(texts, "foo ")).count() == 1
    assert [r.file for r in search(texts, "a.c").collect()] == ["2"]
    assert [r.line for r in search(texts, "\nx").collect()] == [1]


def test_iban_takes_whole_groups(spark):
    assert found(spark, "GB82WEST12345698765432", "IBAN") == []
    assert len(found(spark, "GB82WEST123456987654", "IBAN")) == 1


def test_letters_outside_ascii(spark):
    texts = ["ВУ 12 34 567890", "логин: вася", "ПАРОЛЬ=тайна", "Договор № 5", "ſession_id=1", "Key: 0123456789abcdef01", "dİvision", "ap\u0131=0123456789abcdef01", "to\u212aen:0123456789abcdef01", "x٣٤٥٦٧٨ y"]
    rows = as_tuples(scan(corpus(spark, *texts), standard_rules()))
    assert sorted(rows) == sorted(by_hand([(str(n), t) for n, t in enumerate(texts)], standard_rules()))
    assert {"Driver License (RU)", "Username/Login", "Password", "Contract Number"} <= {r[1] for r in rows}


def test_line_ends_are_lf_only(spark):
    text = "a\r\nAB123CD77\x0b\x85 AB123CD77 \rAB123CD77"
    assert found(spark, text, "Car Plate Number") == [("Car Plate Number", 2, "AB123CD77")]
    rule = user_rules({"start": "^b.*$"})
    one = corpus(spark, "a\rb\nb c\rd\n")
    assert [f[2:4] for f in as_tuples(scan(one, rule))] == [(2, "b c\rd")]


def test_markers_in_the_text_do_not_matter(spark):
    opening, closing = chr(0xFDD0), chr(0xFDD1)
    text = f"{opening}AB123CD77{closing}\n{closing}$0{opening}<AB123CD77 {chr(0xE000)}\nAB123CD77"
    assert [h[1] for h in found(spark, text, "Car Plate Number")] == [1, 2, 3]
    assert search(corpus(spark, text), opening).count() == 2


def test_empty_and_null_texts(spark):
    texts = spark.createDataFrame([("a", ""), ("b", None), ("c", "AB123CD77")], "file string, text string")
    assert [f[0] for f in as_tuples(scan(texts, standard_rules()))] == ["c"]


def test_many_matches_of_one_rule_in_one_text(spark):
    text = "\n".join(f"code {n:06d}" for n in range(40_000))
    rows = scan(corpus(spark, text), [RULES["One-Time Code"]])
    assert rows.count() == 40_000
    assert rows.where("line = cast(snippet as int) + 1").count() == 40_000


def test_scan_needs_no_shuffle(spark):
    plan = scan(corpus(spark, "x"), extended())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_stored_tables_agree_with_python(spark):
    for table, name, text in (("documents", "doc_id", "text"), ("pages", "url", "html")):
        source = spark.read.parquet(f"{SF}/{table}.parquet").select(
            F.col(name).cast("string").alias("file"), F.col(text).alias("text")
        )
        texts = [tuple(r) for r in source.collect()]
        for rules in (standard_rules(), extended()):
            rows = as_tuples(scan(source.repartition(4), rules))
            assert len(rows) == len(set(rows))
            assert set(rows) == by_hand(texts, rules)


def test_distinct_and_union(spark):
    one = corpus(spark, "AB123CD77 foo")
    rows = scan(one.unionAll(one), [RULES["Car Plate Number"]], domains=["x.org"])
    assert rows.count() == 2 and distinct_findings(rows).count() == 1
    both = union_findings(rows, search(one, "foo"))
    assert sorted((r.type, r.hash is None) for r in both.collect()) == [
        ("Car Plate Number", True),
        ("Car Plate Number", True),
        ("User Search", False),
    ]
