from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from checks.registry import KEYWORD_LISTING, all_lines, extended, filled
from checks.samples import EXTENDED_SAMPLES, FAMILY_SAMPLES
from leaksieve.operators.scan import scan
from leaksieve.rules.catalogue import extended_rules, family_rules, keyword_rule, standard_rules
from leaksieve.rules.model import Rule, custom_domain_rule, extend, user_rules
from pyspark.sql import functions as F
from tests.conftest import as_tuples, by_hand, corpus


def test_rule_counts_and_severities():
    assert len(standard_rules()) == 71
    assert len(extended()) == len({r.name for r in extended()}) == 402
    assert Counter(r.severity for r in standard_rules()) == {"critical": 5, "high": 3, "medium": 63}
    assert Counter(r.severity for r in extended()) == {"critical": 13, "high": 5, "medium": 384}
    assert [len(family_rules(f)) for f in ("credentials", "service_paths", "sessions", "financial")] == [11, 5, 10, 11]
    assert [len(family_rules(f)) for f in ("pii", "contact", "legal", "other")] == [9, 7, 6, 12]


def test_extended_set_keeps_the_place_of_replaced_rules():
    names = [r.name for r in extended()]
    assert names[:71] == [r.name for r in standard_rules()]
    changed = {a.name for a, b in zip(standard_rules(), extended()) if a.pattern != b.pattern}
    assert changed == {"Hardcoded API Key", "Internal URL/IP", "Job Title"}


def test_keyword_listing_is_a_parameter():
    own = extended_rules(["- My Token @7 {my_token, my_key} x2 **high**", "unrelated", "- Other {other}"])
    assert [r.pattern for r in own[-2:]] == [r"\b(?:my_token|my_key)=\S+\b", r"\b(?:other)=\S+\b"]
    assert len(own) == 71 + 30 + 2
    assert KEYWORD_LISTING.exists()
    with pytest.raises(ValueError):
        keyword_rule("bad", ["a-b"])


def test_severity_by_name():
    rules = user_rules({n: n for n in ("JWT Token", "JWT Cookie", "AWS Secret Key", "Hardcoded API Key")})
    assert [r.severity for r in rules] == ["high", "medium", "medium", "critical"]


def test_user_rules():
    text, compiled = user_rules({"a": "^b", "c": re.compile("d")})
    assert (text.ignore_case, text.multiline) == (True, True)
    assert (compiled.ignore_case, compiled.multiline) == (False, False)
    with pytest.raises(ValueError):
        user_rules({"empty": "a*"})
    assert [r.pattern for r in extend([text], user_rules({"a": "z", "n": "y"}))] == ["z", "y"]


def test_every_sample_fires_its_rule_and_spark_agrees_with_python(spark):
    lines = [line for family in FAMILY_SAMPLES.values() for line in family.values()]
    by_name = {r.name: r for r in extended()} | {r.name: r for r in standard_rules()}
    named = {k: v for family in FAMILY_SAMPLES.values() for k, v in family.items()} | EXTENDED_SAMPLES
    for name, line in named.items():
        filled_line = re.sub(r"\{n(\d*)\}", lambda m: "7".zfill(int(m[1] or 1)), line)
        assert by_name[name].compile().search(filled_line), name
    ids = spark.range(7, 9).select(F.col("id").cast("string").alias("file"), filled(all_lines(), F.col("id")).alias("text"))
    texts = [tuple(row) for row in ids.collect()]
    for rules in (standard_rules(), extended()):
        assert sorted(as_tuples(scan(ids, rules))) == sorted(by_hand(texts, rules))
    covered = {row[1] for row in by_hand(texts, extended())}
    # Its sample is Cyrillic and has a test of its own.
    assert {r.name for r in extended()} - covered == {"Driver License (RU)"}
    assert len(lines) == 70


def test_near_misses_stay_out(spark):
    rules = [keyword_rule("Serial", ["serial", "device_id"])]
    texts = ["serial = 1", "serials=1", "xserial=1", "serial=", "Serial=1", "my.serial=1", "a_device_id=2 device_id=3"]
    found = as_tuples(scan(corpus(spark, *texts), rules))
    assert sorted(found) == sorted(by_hand([(str(n), t) for n, t in enumerate(texts)], rules))
    assert sorted(f[3] for f in found) == ["device_id=3", "serial=1"]


def _random_text(rng: random.Random, alphabet: list[str]) -> str:
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 14)))


@pytest.mark.parametrize(
    ("rule", "alphabet"),
    [
        ("IBAN", ["GB82", "WEST", "1234", "5", " ", "\n", "A", "é", "-", "GB82WEST12345678", "_"]),
        ("domain", ["http://", "https://", "a.", "a", "..", ".", "ex.com", "x-y.", ":80", "/p q", " ", "é", "ex.com."]),
    ],
)
def test_stack_safe_forms_match_the_same(rule, alphabet):
    rule = custom_domain_rule(["ex.com", "a.ex.com"]) if rule == "domain" else next(
        r for r in standard_rules() if r.name == rule
    )
    rng, flags, hits = random.Random(5), rule.compile().flags, 0
    for _ in range(60_000):
        text = _random_text(rng, alphabet)
        plain = [m.span() for m in rule.compile().finditer(text)]
        assert plain == [m.span() for m in re.finditer(rule.jvm_pattern, text, flags)], text
        hits += len(plain)
    assert hits > 2_000


def test_long_runs_do_not_exhaust_the_stack(spark):
    runs = ["GB82 WEST" + " AB12" * 60_000 + ".", "GB82WEST" + "AB12" * 60_000 + "X", "http://" + "a." * 90_000 + "example.com/x"]
    domain = custom_domain_rule(["example.com"])
    found = as_tuples(scan(corpus(spark, *runs), [*standard_rules(), domain]))
    assert ("2", domain.name, 1, runs[2][:100], "medium") in found
    assert not any(f[1] == "IBAN" and f[0] == "1" for f in found)
    long_iban = corpus(spark, "GB82WEST" + " AB12" * 60_000 + ".")
    assert [f[1] for f in as_tuples(scan(long_iban, [r for r in standard_rules() if r.name == "IBAN"]))] == ["IBAN"]


def test_keyword_rules_agree_with_python_on_random_runs(spark):
    rules = [
        keyword_rule("Serial", ["serial", "device_id"]),
        keyword_rule("Device", ["device_id", "ssid"]),
        keyword_rule("Long", ["a_rather_long_keyword"]),
    ]
    parts = ["serial", "device_id", "ssid", "a_rather_long_keyword", "=", "=", " ", "\n", "\t", " ", " ", "\r\n", "x", "é", "-", ";", "((", "_", "9", "x" * 60, ":"]
    rng = random.Random(9)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(3, 30))) for _ in range(3_000)]
    found = as_tuples(scan(corpus(spark, *texts), rules))
    expected = by_hand([(str(n), t) for n, t in enumerate(texts)], rules)
    assert len(found) == len(set(found)) and set(found) == expected
    assert len(expected) > 300


def test_user_rules_mean_what_they_mean_in_python(spark):
    verbose = re.compile(r"""
        (?P<the_key> k ) = [ #]?  (\d) \2   # a comment
        """, re.X)
    patterns = {
        "verbose": verbose,
        "ascii": re.compile(r"\w+z", re.A),
        "ascii, no case": re.compile(r"\bs\w*q", re.A | re.I),
        "named": r"(?P<my_key>[ab])=(?P=my_key)1?",
        "class": r"x[^[]y",
        "class end": r"x[]a]+y?",
        "and": r"[a-z&&b]+=",
        "upto": r"q{,2}w",
        "brace": r"a{x}|b{",
        "end": re.compile(r"z\Z"),
        "dot": re.compile(r"a.b", re.S),
        "octal": r"\075k",
        "tab": "k\\v|x(?#none)y",
        "inline": "(?s)a.q",
        "scoped": "(?i:K)=1",
    }
    rules = user_rules(patterns)
    rng = random.Random(11)
    parts = ["k", "K", "=", "11", "1", " ", "#", "é", "z", "x", "[", "]", "y", "a", "b", "&", "q", "w", "{", "}", "{x}", "\n", "\v", "s", "ſ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(3, 25))) for _ in range(2_000)]
    found = as_tuples(scan(corpus(spark, *texts), rules))
    expected = by_hand([(str(n), t) for n, t in enumerate(texts)], rules)
    assert set(found) == expected and {f[1] for f in found} == set(patterns)


@pytest.mark.parametrize("regex", [r"(a)?(?(1)b|c)", r"\101x", r"[\1]x", r"(?a:\w)x", rb"bytes", r"\N{DIGIT ONE}"])
def test_user_rules_without_an_equivalent_are_refused(regex):
    with pytest.raises(ValueError):
        user_rules({"r": re.compile(regex)})


def test_a_pattern_that_the_jvm_refuses_is_named_before_the_scan(spark):
    texts = corpus(spark, "aab")
    # Refused by both, so it has to come as a finished rule.
    bad = Rule("bad", "[b-a]")
    with pytest.raises(ValueError, match="'bad'"):
        scan(texts, [*user_rules({"good": "a+"}), bad])
    assert [r.snippet for r in scan(texts, user_rules({"good": "a+"})).collect()] == ["aa"]
