from __future__ import annotations

import re

import pytest

from checks.registry import UNLIKE, _scan_exact, extended, table
from leaksieve.operators.exact import scan_exact
from leaksieve.operators.scan import scan
from leaksieve.rules.catalogue import standard_rules
from leaksieve.rules.model import user_rules
from tests.conftest import SF, as_tuples, by_hand, corpus

TEXTS = [
    "password\x1f=\x1csecret12345 and AB123CD77",
    "code 12² x²y id́ a‍b AB123CD77",
    "١٢٣ ½ ① café été",
    "plain ascii AB123CD77\nAB123CD77 AB123CD77\r\npassport 4509 123456",
    "mail óscar@example.com\n\npassıon PAſſ Kelvin",
    "",
]
OWN = user_rules({"words": r"\w+", "digits": r"\d+", "blanks": r"\s+", "edge": r"\bx\w", "folded": "pass|kelvin", "not a word": r"\W+"})


@pytest.mark.parametrize("rules", [OWN, standard_rules(), list(extended())], ids=["own", "standard", "extended"])
def test_findings_are_those_of_python(spark, rules):
    found = scan_exact(corpus(spark, *TEXTS), rules)
    assert sorted(as_tuples(found)) == sorted(by_hand([(str(n), t) for n, t in enumerate(TEXTS)], rules))


def test_columns_are_those_of_the_scan(spark):
    texts = corpus(spark, "x AB123CD77 AB123CD77\nAB123CD77 xy", "é AB123CD77 AB123CD77\nAB123CD77 xy", None)
    kept = texts.selectExpr("file", "text", "named_struct('a', file) AS extra", "file AS type_of")
    options = {"keep": ["extra", "type_of"], "whole": True, "domains": ["example.com"]}
    ours, theirs = scan_exact(kept, standard_rules(), **options), scan(kept, standard_rules(), **options)
    assert ours.schema.simpleString() == theirs.schema.simpleString()
    assert sorted(map(str, ours.collect())) == sorted(map(str, theirs.collect())) and ours.count() == 4
    assert scan_exact(texts.limit(0), standard_rules()).isEmpty()


def test_more_findings_than_a_batch_holds(spark):
    text = "é " + " ".join(f"w{n}" for n in range(25_000))
    found = scan_exact(corpus(spark, text), user_rules({"words": r"w\d+"})).select("match_offset", "snippet").collect()
    assert len(found) == 25_000
    assert all(text[row.match_offset :].startswith(row.snippet) for row in found)


def test_the_query_reads_as_python(spark):
    from zlib import crc32

    texts = []
    for row in table(spark, SF, "documents").select("doc_id", "text").collect():
        old, new = UNLIKE[crc32(str(row.doc_id).encode()) % len(UNLIKE)]
        texts.append((str(row.doc_id), (row.text or "").replace(old, new) if old else row.text or ""))
    assert any(re.search("[\x1c\x1f²́‍]", text) for _, text in texts)
    ours = as_tuples(_scan_exact(spark, SF))
    assert sorted(ours) == sorted(by_hand(texts, extended())) and ours
