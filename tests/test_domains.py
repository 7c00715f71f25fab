"""Domain tables against the rule that holds its domains in one regex."""

from __future__ import annotations

import random

from leaksieve.operators.domains import scan_domain_table
from leaksieve.operators.scan import FOUND, scan
from leaksieve.rules.model import custom_domain_rule
from tests.conftest import corpus

DOMAINS = ["example.com", "b.example.com", "Example.org", "localhost", "a.io", "example.co", "münchen.de", " ", "x-y.net"]
TEXTS = [
    "http://example.com https://sub.example.com:80/p?q http://example.community/x\nHTTPS://A.B.EXAMPLE.ORG/y http://example.org.",
    "see http://evil-example.com and http://.example.com http://a..example.com http://b.example.com.example.com/z",
    "http://other.net/?u=http://example.com/1,http://localhost:8080 http://example.com/http://a.io/2 http://a.io,http://a.io:9",
    "http://a.io http://a.io\nhttp://a.io https://münchen.de/ü http://MÜNCHEN.de (http://x-y.net/)[http://w.x-y.net:1/]",
    "http://" + "s." * 300 + "a.io/deep http://" + "a" * 3_000, "", "no url", "http:// https://", "xhttp://a.iohttp://a.io",
]


def rows(found):
    return sorted(tuple(r) for r in found.select("file", *FOUND).collect())


def table(spark, names):
    return spark.createDataFrame([(d, n) for n, d in enumerate(names)], "domain string, place int")


def test_same_as_the_rule(spark):
    texts = corpus(spark, *TEXTS)
    want = rows(scan(texts, [custom_domain_rule(DOMAINS)]))
    assert rows(scan_domain_table(texts, table(spark, DOMAINS), order="place")) == want and len(want) > 15


def test_random_texts(spark):
    rng = random.Random(2)
    parts = ["http://", "https://", "a.io", "example.", "com", "co", ".", "/", ":80", " ", "\n", "x", "-", "sub.", "http://a.io/"]
    texts = corpus(spark, *("".join(rng.choices(parts, k=rng.randint(1, 60))) for _ in range(400)))
    names = ["a.io", "example.com", "example.co", "com", "x"]
    want = rows(scan(texts, [custom_domain_rule(names)]))
    assert rows(scan_domain_table(texts, table(spark, names), order="place")) == want and len(want) > 300


def test_many_domains(spark):
    names = spark.range(100_000).selectExpr("concat('host', id, '.example') AS domain")
    texts = corpus(spark, "http://host77.example/a https://w.host99999.example http://host100000.example http://host5.examples")
    found = scan_domain_table(texts, names)
    assert sorted(r.snippet for r in found.collect()) == ["http://host5.example", "http://host77.example/a", "https://w.host99999.example"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan


def test_empty_tables(spark):
    assert scan_domain_table(corpus(spark, *TEXTS), table(spark, [" ", ""])).collect() == []
    assert scan_domain_table(corpus(spark, "").limit(0), table(spark, DOMAINS)).collect() == []
