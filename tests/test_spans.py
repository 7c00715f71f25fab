import random

import pytest

from checks.registry import all_lines, extended
from leaksieve.operators.scan import _reaches, scan
from leaksieve.rules.catalogue import standard_rules
from leaksieve.rules.model import Rule, custom_domain_rule, user_rules
from leaksieve.rules.spans import crossings, sought, tokens_regex
from tests.conftest import corpus

RULES = {rule.name: rule for rule in standard_rules()}
# What stands between words: blanks of every kind, ends of lines, and lines of blanks, colons and equals signs only.
BETWEEN = ("\n", "\n\n", " \n:\n", "\t\n=", "\r\n", " ", "\n \n= \n", "\u2028", "\n:=\n\n", ":\n", "")


@pytest.mark.parametrize(
    ("pattern", "most"),
    [
        (r"a[\s:=]*b\s+c", 2), (r"a(?:\s?b)?[^\s]+\b", 1), (r"a|b\s\s|c\s", 2), (r"[\w.-](?<!\.\.)\d{3,}", 0), (r"a[^/]+", None),
        (r"a(?:\s?b){2,}", None), (r"[\s.]*", None), (r"a\s*+b", None), (r"a(?!\s)", None), (r"^a", None), (r"a$", None), (r"\Wa", None),
        (r"a\nb", None), (r"(a)\1", None), ("a\nb", None), (r"[\x00-z]", None),
    ],
)
def test_line_ends_that_a_match_can_hold(pattern, most):
    assert crossings(Rule("r", pattern, family="other")) == most


def test_rules_of_users_are_tried_on_whole_texts():
    assert [crossings(rule) for rule in user_rules({"a": "abc", "b": r"x\d"})] == [None, None]
    assert crossings(custom_domain_rule(["example.com"])) == 0


def test_f3_few_rules_are_tried_on_whole_texts():
    rules = [rule for rule in extended() if not rule.keywords]
    beyond = _reaches(rules)
    assert [rule.name for n, rule in enumerate(rules, 1) if n not in beyond] == ["IBAN", "Phone Number"]
    assert max(beyond.values()) == 5


def test_longest_literal_at_every_place(spark):
    regex = tokens_regex(["API", "API_SPEC", "PI_", "KEY", "БИК", "№", "@"])
    text = "xAPI_SPECKEY@\n\n:\nБИК№\nAPI"
    found = spark.createDataFrame([(text, regex)], "t string, r string").selectExpr("regexp_extract_all(t, r, 1)").first()[0]
    assert found == ["API_SPEC", "PI_", "KEY", "@", "\n", "БИК", "№", "\n", "API"]


@pytest.mark.parametrize("dense", [0, 20])
def test_f3_matches_across_lines_are_those_of_whole_texts(spark, monkeypatch, dense):
    monkeypatch.setattr("leaksieve.operators.scan._DENSE", dense)
    rng = random.Random(11)
    samples = [line.replace("{n}", "7").replace("{n4}", "0007").replace("{n6}", "000007").replace("{n8}", "00000007") for line in all_lines()]
    samples = samples[: len(standard_rules()) + 30]
    texts = ["\n", "password\n\n\n:\n=\n x", "Bearer\n\n \n\nabc\nOAuth", "\n\nCVV\n=:\n123\nCVV 1"]
    for _ in range(150):
        lines = rng.choices(samples, k=rng.randrange(1, 15))
        lines = ["".join(rng.choice(BETWEEN) if c in " :=" and rng.random() < 0.5 else c for c in line) for line in lines]
        texts.append("".join(line + rng.choice(BETWEEN) for line in lines))
    rules = standard_rules()
    whole = [Rule(r.name, r.pattern, r.ignore_case, r.multiline, jvm_pattern=r.jvm_pattern, severity=r.severity) for r in rules]
    got, want = (sorted(map(tuple, scan(corpus(spark, *texts), some).collect())) for some in (rules, whole))
    assert got == want and any("\n" in row[3] for row in got)


def test_literals_that_tell_a_rule():
    assert sought(RULES["JWT Cookie"]) == ("JWT=", "AUTH_TOKEN=")
    assert sought(RULES["Social Security Number (SSN)"]) == () and sought(RULES["Email Address"]) == ("@",)
