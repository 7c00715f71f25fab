from __future__ import annotations

import hashlib
import random
import time
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from leaksieve.functions.severity import severity_column, severity_of, severity_rank
from leaksieve.functions.text import (
    POPULAR_FROM,
    bag_ratio,
    decode_utf8_lossy,
    matching_ratio,
    normalized,
    normalized_hash,
    similarity,
    strip,
    unescape,
)
from checks.registry import extended


def one(spark, value, function, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(function(F.col("v"))).first()[0]


def test_lossy_decoding(spark):
    for raw in (b"a\xffb", "й".encode()[:1] + b"x", "ok � й".encode(), b"\xff" + "�".encode(), b"", b"\xed\xa0\x80z"):
        assert one(spark, bytearray(raw), decode_utf8_lossy, "binary") == raw.decode("utf-8", errors="ignore")


def test_normalised_hash(spark):
    text = "  HTTP://www.X.com  -  Й "
    assert one(spark, text, normalized) == "httpwwwxcom  й"
    assert one(spark, text, normalized_hash) == "16417226e6d188e274c01112cb057dfb"
    assert one(spark, " \t a  b\n", strip) == "a  b"
    assert one(spark, "A-b", normalized_hash) == hashlib.md5(b"ab").hexdigest()


def test_unescape(spark):
    cases = {
        r"\u0041": "A",
        "é" + r"\u0041": "Ã©A",
        r"\x4": r"\x4",
        "l1\r\nl2" + r"\x4": "l1\nl2" + r"\x4",
        r"lone \ud83d": r"lone \ud83d",
        r"\101\x42\n\N{BULLET}": "AB\n•",
        "plain": "plain",
        "a\rb": "a\nb",
        r"\U0001F600": "😀",
    }
    source = spark.createDataFrame([(k,) for k in [*cases, None]], "v string")
    got = {r.v: r.u for r in source.select("v", unescape(F.col("v")).alias("u")).collect()}
    assert got == {**cases, None: None}


def test_similarity_is_that_of_matching_blocks(spark):
    pairs = [("abcd", "bcde"), ("tide", "diet"), ("diet", "tide"), ("", ""), ("same", "same"), ("a-b c", "A b-c")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similarity(F.col("a"), F.col("b")).alias("s"))
    assert [(r.a, r.b, r.s) for r in rows.collect()] == [(a, b, SequenceMatcher(None, a, b).ratio()) for a, b in pairs]


def test_ratio_by_substrings_is_that_of_matching_blocks():
    rng = random.Random(7)
    for letters in ("ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyz0123456789é😀"):
        for size in (0, 1, 5, 30, POPULAR_FROM - 3, POPULAR_FROM + 3):
            for _ in range(40):
                a = "".join(rng.choices(letters, k=size))
                b = list(a)
                for _ in range(rng.randrange(4)):
                    at = rng.randrange(len(b) + 1)
                    b[at : at + rng.randrange(4)] = rng.choices(letters, k=rng.randrange(6))
                assert matching_ratio(a, "".join(b)) == SequenceMatcher(None, a, "".join(b)).ratio()


def test_long_tokens_are_compared_by_substrings(monkeypatch):
    token = "eyJ" + "hbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9" * 3 + ".a12345.sig"
    marked = token[:105] + "!!!" + token[105:]
    want = SequenceMatcher(None, marked, token).ratio()
    monkeypatch.setattr("difflib.SequenceMatcher", None)
    assert matching_ratio(marked, token) == want


def test_the_bound_is_linear_in_the_text(spark):
    long = spark.range(1).select(F.repeat(F.lit("abcd"), 15_000).alias("a"), F.repeat(F.lit("bcde"), 15_000).alias("b"))
    began = time.monotonic()
    assert long.select(bag_ratio(F.col("a"), F.col("b"))).first()[0] == 0.75
    assert time.monotonic() - began < 5


def test_severity_column_agrees_with_the_function(spark):
    names = spark.createDataFrame([(r.name,) for r in extended()], "n string")
    for row in names.select("n", severity_column(F.col("n")).alias("s")).collect():
        assert row.s == severity_of(row.n)
    ranks = spark.createDataFrame([(s,) for s in ("low", "info", "high", "critical", "medium")], "s string")
    assert [r[0] for r in ranks.select(severity_rank(F.col("s"))).collect()] == [3, 99, 1, 0, 2]
