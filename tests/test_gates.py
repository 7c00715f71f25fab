import pytest
from pyspark.sql import functions as F

from checks.registry import LONG_LINES, _scan_exact, _scan_family, _written_tree, all_lines, extended
from leaksieve.operators.exact import scan_exact
from leaksieve.operators.scan import _candidates, _keyword_findings, scan
from leaksieve.rules.catalogue import family_rules, standard_rules
from leaksieve.rules.model import Rule, first_letters, literal, user_rules
from leaksieve.sources import files
from tests.conftest import corpus

SF = "/root/testdata/sf0.001"
ODD = (
    "éid=5 id==6 a.id=7;x", "call ٤١٥-555-26-71 or (415) 555-26-71 or 4155552671", "x\U0001d7cf\U0001d7cf\U0001d7cf",
    " \U0001d7d1\U0001d7d2\U0001d7d3\U0001d7d4\U0001d7d5\U0001d7d6 ", "at 1.5, -2.5 or 55.75, 37.61", "é/admin a/admin /admin a/logs é.env x.env.local",
    "http://a.internal.b https://q\n.internal.c ttp://x.internal.y 10.1.2.3 10.1.2 hocalhost localhost 192.168.1.2", "0" * 20, "1" * 32, "a" * 64 + "b",
    "1BoatSLRHtKNngkdXEeobR76b53LETtpyT 3c1 bc1 xbc1", "eyJa.b.c xeyJa.b.c eyJa.b.", "01.02.1990 1/2/90 a1/2/90", "Kernel.log UNIT unıt ſtaff",
)


def test_what_is_searched_matches_what_the_rule_does(spark):
    samples = [line.replace("{n}", "7").replace("{n4}", "0007").replace("{n6}", "000007").replace("{n8}", "00000007") for line in all_lines()]
    texts = corpus(spark, *ODD, *samples, " ".join(ODD), "\n".join(samples))
    rules = [r for r in (*standard_rules(), *extended()) if r.searched != r.java]
    assert len(rules) > 60
    every = [f"regexp_extract_all(text, {literal(r.java)}, 0) = regexp_extract_all(text, {literal(r.searched)}, 0)" for r in rules]
    differ = [F.count_if(~F.expr(same)).alias(str(n)) for n, same in enumerate(every)]
    assert [rules[int(n)].name for n, found in texts.agg(*differ).first().asDict().items() if found] == []


def test_no_gate_drops_a_match(spark):
    texts = corpus(spark, *ODD, " ".join(ODD))
    rules = [r for r in extended() if r.needs_number or r.needs_hash_run or r.fast_pattern]
    ungated = [Rule(r.name, r.pattern, r.ignore_case, r.multiline, jvm_pattern=r.jvm_pattern, severity=r.severity) for r in rules]
    assert sorted(scan(texts, rules).collect()) == sorted(scan(texts, ungated).collect())
    assert sorted(scan_exact(texts, rules).collect()) == sorted(scan_exact(texts, ungated).collect())


def test_first_letters():
    assert first_letters(r"\b(?:foo|b\w)=x") == "bf"
    for none in (r"\b(?:foo|\w)x", r"\b(foo)?x", r"\bfo|x", r"\bf?x", r"foo", r"\b(?:foo|(b))x", r"\b(?!foo)x"):
        assert first_letters(none) == ""
    (rule,) = user_rules({"k": r"\bkelvin\b"})
    assert rule.searched == "(?diumU)(?=[k])\\bkelvin\\b"


def test_f1_each_text_is_folded_once_for_python(spark):
    plan = _scan_exact(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    # Once for the JVM's texts and once for Python's, and not in a filter for every rule.
    assert plan.count("upper(") < 10


def test_f2_rules_of_a_keyword_are_looked_up_by_hash():
    found = _keyword_findings(extended(), False)
    assert "map_from_arrays" not in found and "array_intersect" not in found


def test_f3_a_long_token_is_not_searched_for_hashes_and_numbers(spark):
    rules = standard_rules()
    text = "\n".join(LONG_LINES).format(n=7)
    texts = spark.createDataFrame([(1, text)], "file int, _text string")
    (row,) = _candidates(texts, rules, ["file"]).collect()
    assert {rules[n - 1].name for n in row["_rules"]} == {"JWT Token", "Bitcoin Address"}


@pytest.mark.parametrize("rule", family_rules("service_paths"), ids=lambda rule: rule.name)
def test_f4_no_path_is_searched_by_a_word_edge_or_a_choice(rule):
    assert not rule.searched.removeprefix("(?dU)").startswith(("\\b", "(?:"))


def test_f4_lines_are_counted_without_cutting_the_text_again(spark):
    plan = _scan_family(spark, SF, "service_paths")._jdf.queryExecution().optimizedPlan().toString()
    assert "array_repeat" not in plan


def test_f5_no_content_is_kept_of_files_that_are_only_checked(spark):
    tree = _written_tree(spark, SF)
    plan = files.unread_files(spark, tree, max_bytes=4000)._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan
