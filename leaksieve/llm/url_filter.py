"""URL filter: rules by longest match, and else naive Bayes over the words of host and path.

Host labels are split at all but letters and digits, then segmented by Viterbi search under word frequencies (unigrams) counted over the
words of all pages. Tokens are these words and the path's own. Multinomial naive Bayes learns from the pages
themselves: a URL whose host words hold a seed word is labelled block, any other allow; its counts cover all rows.

A null URL or one without ``://`` has empty host and path, no rule and no token, and gets the
more frequent class, as does any URL in which no token was seen. If two rules are equally long, the first by name wins. Equal
URLs are judged once and handed to each of their rows, whatever their ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leaksieve.llm.common import saved, table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules of the query.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
#: Words that label a host for training.
SEEDS = (
    "ads adserver adult banner bets betting bet casino cams clickbait dating escort gambling hacked keygen loans lottery "
    "malware nude phishing pills poker porn sex slots spam torrent track tracker tracking viagra warez xxx"
).split()
#: Each seed counts as a word seen so often.
SEED_COUNT = 100
LONGEST_WORD = 24


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Iterable[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null where none does."""
    name = verdict = None
    for rule, says in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        domain, _, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{rest}")
        name = F.when(fits, rule) if name is None else name.when(fits, rule)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    nothing = F.lit(None).cast("string")
    return (nothing, nothing) if name is None else (name, verdict)


def word_counts(texts: DataFrame, text_col: str) -> DataFrame:
    """(word, n) over the words in ``a-z`` of all rows, markup left out, and the seeds."""
    plain = F.lower(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "<[^>]*>", " "))
    words = texts.select(F.explode_outer(F.regexp_extract_all(plain, F.lit("([a-z]+)"), F.lit(1))).alias("word"))
    counted = words.where(F.length("word").between(1, LONGEST_WORD)).groupBy("word").agg(F.count("*").alias("n"))
    seeds = F.array(*[F.lit(seed) for seed in SEEDS])
    # The seeds come from a frame of one row; the sum makes one row a word again.
    one = texts.sparkSession.range(1).select(F.explode(seeds).alias("word"), F.lit(SEED_COUNT).cast("long").alias("n"))
    return counted.unionByName(one).groupBy("word").agg(F.sum("n").alias("n"))


def viterbi(label: str, known: dict[tuple[int, int], float], unknown: float) -> list[str]:
    """The likeliest words of a label. known: log-probability by (start, end).

    A stretch that is no word costs ``unknown`` and more for each of its letters.
    """
    best, back = [0.0] + [-math.inf] * len(label), [0] * (len(label) + 1)
    for end in range(1, len(label) + 1):
        for start in range(max(0, end - LONGEST_WORD), end):
            cost = known.get((start, end), unknown - 2.3 * (end - start))
            if best[start] + cost > best[end]:
                best[end], back[end] = best[start] + cost, start
    words, end = [], len(label)
    while end:
        words.append(label[back[end] : end])
        end = back[end]
    return words[::-1]


def _segment(batches: Iterator[pa.RecordBatch], total: int) -> Iterator[pa.RecordBatch]:
    unknown = math.log(10 / total)
    for batch in batches:
        out = []
        for label, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            known = {(f["at"], f["at"] + f["size"]): math.log(f["n"] / total) for f in found or []}
            out.append(viterbi(label, known, unknown))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], ["label", "words"])


def segmented(labels: DataFrame, words: DataFrame) -> DataFrame:
    """(label, words) of distinct labels. The look-up of their parts among the words is a join."""
    total = words.agg(F.sum("n")).first()[0] or 1
    length = F.length("label")
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(0), length - 1),
            lambda at: F.transform(
                F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), length - at)),
                lambda size: F.struct(at.alias("at"), size.alias("size")),
            ),
        )
    )
    parts = labels.select("label", F.explode_outer(spans).alias("s"))
    parts = parts.select("label", "s.*", F.expr("substring(label, s.at + 1, s.size)").alias("word"))
    found = parts.join(words, "word").groupBy("label").agg(F.collect_list(F.struct("at", "size", "n")).alias("found"))
    return labels.join(found, "label", "left").mapInArrow(
        lambda batches: _segment(batches, total), "label string, words array<string>"
    )


def judge(
    pages: DataFrame,
    rules: Iterable[tuple[str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    seeds: Iterable[str] = SEEDS,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, words, log_odds) of every row; log_odds above 0 mean block."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    url = F.coalesce("url", F.lit(""))
    urls = rows.select(url.alias("url")).groupBy("url").agg(F.count("*").alias("n"))
    urls = saved(urls.select("url", "n", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), "urls")

    pieces = F.filter(F.split("host", "[^a-z0-9]+"), lambda p: p != "")
    hosts = urls.select("host").distinct().select("host", F.posexplode_outer(pieces).alias("at", "label"))
    hosts = saved(hosts.where("label IS NOT NULL"), "hosts")
    words = saved(word_counts(pages, html_col), "words")
    cut = segmented(hosts.select("label").distinct(), words)
    ordered = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda s: s["words"]))
    by_host = hosts.join(cut, "label").groupBy("host").agg(ordered.alias("words"))

    none = F.array().cast("array<string>")
    tokens = F.transform(
        F.filter(F.split(F.lower("path"), r"[^\p{L}\p{N}]+"), lambda p: p != ""),
        lambda p: F.concat(F.lit("/"), F.regexp_replace(p, r"\p{N}+", "0")),
    )
    urls = urls.join(by_host, "host", "left").withColumn("words", F.coalesce("words", none))
    bad = F.arrays_overlap("words", F.array(*[F.lit(seed) for seed in seeds])).alias("bad")
    urls = saved(urls.select("url", "n", "host", "path", "words", F.concat("words", tokens).alias("tokens"), bad), "url-words")

    each = urls.select("n", "bad", F.explode_outer("tokens").alias("token")).where("token IS NOT NULL")
    blocked, allowed = F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n")))
    counts = saved(each.groupBy("token").agg(blocked.alias("block"), allowed.alias("allow")), "tokens")
    sums = counts.agg(F.sum("block").alias("b"), F.sum("allow").alias("a"), F.count("*").alias("v")).first()
    docs = urls.agg(blocked.alias("b"), allowed.alias("a")).first()
    b, a, v = sums.b or 0, sums.a or 0, sums.v or 0
    prior = math.log((docs.b or 0) + 1) - math.log((docs.a or 0) + 1)
    odds = F.log((F.col("block") + 1) / F.lit(float(b + v + 1))) - F.log((F.col("allow") + 1) / F.lit(float(a + v + 1)))
    weighed = urls.select("url", F.explode_outer("tokens").alias("token")).where("token IS NOT NULL")
    scores = weighed.join(counts.select("token", odds.alias("odds")), "token").groupBy("url").agg(F.sum("odds").alias("odds"))

    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    log_odds = F.coalesce("odds", F.lit(0.0)) + prior
    judged = urls.join(scores, "url", "left").select(
        "url",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, F.when(log_odds > 0, "block").otherwise("allow")).alias("verdict"),
        "words",
        log_odds.alias("log_odds"),
    )
    return rows.withColumn("url", url).join(saved(judged, "judged"), "url").drop("url")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "pages"), RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", F.array_join("words", " ").alias("host_words"))
