"""Findings of URLs on the domains of a table, of any length.

``custom_domain_rule`` puts its domains into one regex, which a job's settings can hold. Here the domains are rows. The
scan finds every run that begins like a URL, once for all domains; each place in a host where a label begins gives one key for
each length that a domain has, and a join with the table says which keys are domains. As with the rule, sub-domains
count, the last label that begins a domain decides, and a domain has to begin there, not to end: ``http://example.community`` is on
``example.com``. Texts do not move; of URLs only those with a key in the table do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leaksieve.functions.text import normalized_hash, strip
from leaksieve.operators.scan import FOUND, SNIPPET_LENGTH, scan
from leaksieve.rules.model import CUSTOM_DOMAIN_TYPE, Rule

_FLAGS = "(?diuU)"
_URL_RUN = Rule("url run", r"https?://\S+", ignore_case=True, severity="medium", needs=(("http",),))
# What sub-domains look like, as one run that ends in a dot and has no empty label.
_LABELS = r"(?:(?!\.)(?:[\w.-](?<!\.\.))*(?<=\.))?"
_RUN = ("file", "line", "run_offset")
_URL = (*_RUN, "k")


def scan_domain_table(
    corpus: DataFrame, domains: DataFrame, column: str = "domain", *, order: str | None = None, text: str = "text", file: str = "file"
) -> DataFrame:
    """The columns of ``scan``: URLs of ``corpus`` on a domain of the table, or below one.

    Of several domains that begin at one label the first by ``order`` is taken, the longest if no order is named.
    Blank and null domains match nothing; letter case does not count, nor how often a domain is repeated. An empty table finds nothing.
    """
    named = domains.select(F.lower(strip(F.col(column))).alias("key"), (F.col(order) if order else F.lit(0)).alias("place"))
    named = named.where(F.length("key") > 0).groupBy("key").agg(F.min("place").alias("place"))
    lengths = named.select(F.length("key").alias("n")).distinct().agg(F.sort_array(F.collect_list("n")).alias("lengths"))

    runs = scan(corpus, [_URL_RUN], text=text, file=file, whole=True)
    runs = runs.select("file", "line", F.col("match_offset").alias("run_offset"), "match")
    # Every URL of a run, one inside another's path too.
    pieces = runs.select("*", F.split("match", _FLAGS + "(?=https?://)", -1).alias("pieces"))
    starts = F.expr("transform(pieces, (p, i) -> aggregate(slice(pieces, 1, i), 0, (n, x) -> n + length(x)))")
    cut = F.filter(F.arrays_zip(starts.alias("at"), F.col("pieces").alias("piece")), lambda p: p["piece"] != "")
    urls = pieces.select(*_RUN, "match", F.posexplode(cut).alias("k", "cut"))
    urls = urls.select(*_URL, F.col("cut.at").alias("at"), F.expr("substring(match, cut.at + 1)").alias("url"))
    # The scheme, then sub-domains as far as they go; a label begins after each of their dots.
    head = F.regexp_extract("url", _FLAGS + "^https?://", 0)
    chain = F.regexp_extract("url", _FLAGS + "^https?://(" + _LABELS + ")", 1)
    urls = urls.select("*", F.length(head).alias("head"), F.split(chain, r"\.", -1).alias("labels"))
    begins = F.expr("transform(labels, (l, i) -> head + aggregate(slice(labels, 1, i), 0, (n, x) -> n + length(x) + 1))")
    sent = F.broadcast(lengths)  # one row of at most as many numbers as a host has characters
    tries = urls.select(*_URL, "at", "url", F.explode(begins).alias("begin")).join(sent)
    tries = tries.select(*_URL, "at", "url", "begin", F.explode("lengths").alias("n"))
    keyed = tries.where(F.expr("begin + n <= length(url)")).withColumn("key", F.lower(F.expr("substring(url, begin + 1, n)")))
    hits = keyed.join(named, "key")

    best = F.max_by(F.struct("at", "url", "begin", "n"), F.struct("begin", -F.col("place"), "n")).alias("best")
    matched = hits.groupBy(*_URL).agg(best).select(*_URL, "best.*")
    tail = F.regexp_extract(F.expr("substring(url, begin + n + 1)"), r"(?dU)^(?::\d+)?(?:/\S*)?", 0)
    matched = matched.select(*_URL, "at", F.concat(F.expr("left(url, begin + n)"), tail).alias("match"))
    # What lies inside an earlier match is none.
    before = Window.partitionBy(*_RUN).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.max(F.col("at") + F.length("match")).over(before)
    matched = matched.withColumn("before", F.coalesce(ends, F.lit(0))).where("at >= before")
    found = matched.select(
        "file",
        F.lit(CUSTOM_DOMAIN_TYPE).alias("type"),
        "line",
        F.left("match", F.lit(SNIPPET_LENGTH)).alias("snippet"),
        F.lit("medium").alias("severity"),
        (F.col("run_offset") + F.col("at")).cast("int").alias("match_offset"),
        F.md5(F.col("match").cast("binary")).alias("match_md5"),
        normalized_hash(F.col("match")).alias("match_key"),
    )
    same = [c for c in ("file", *FOUND) if c != "match_offset"]
    return found.groupBy(*same).agg(F.min("match_offset").alias("match_offset")).select("file", *FOUND)
