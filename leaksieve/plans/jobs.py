"""Whole runs: scan, keep the raw findings, clean them up, count."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaksieve.functions.severity import severity_rank
from leaksieve.operators.crawl import reach
from leaksieve.operators.dedupe import clean_duplicates
from leaksieve.operators.links import page_edges
from leaksieve.operators.report import run_stats, severity_type_counts
from leaksieve.operators.scan import scan, search
from leaksieve.operators.skew import maybe_in
from leaksieve.rules.model import Rule
from leaksieve.sources.findings import read_findings, write_findings
from leaksieve.sources.tables import pages_corpus


@dataclass(frozen=True)
class Run:
    raw: DataFrame
    clean: DataFrame
    stats: DataFrame


def scan_run(
    corpus: DataFrame,
    out: str,
    rules: Sequence[Rule] = (),
    *,
    domains: Iterable[str] = (),
    term: str | None = None,
) -> Run:
    """Scan ``(file, text)`` rows, or search for ``term`` instead, and save the results.

    The raw findings are written once and read back, so the clean-up and the
    counts do not scan again.
    """
    return _saved(_found(corpus, rules, domains, term), corpus, out)


def _found(corpus: DataFrame, rules: Sequence[Rule], domains: Iterable[str], term: str | None) -> DataFrame:
    return search(corpus, term) if term else scan(corpus, rules, domains=domains)


def _saved(found: DataFrame, processed: DataFrame, out: str) -> Run:
    spark = found.sparkSession
    write_findings(found, f"{out}/raw_scan_results")
    clean_up_run(spark, f"{out}/raw_scan_results", f"{out}/scan_results")
    raw, clean = (read_findings(spark, f"{out}/{name}") for name in ("raw_scan_results", "scan_results"))
    return Run(raw, clean, run_stats(processed, raw, clean))


def clean_up_run(
    spark: SparkSession, raw_path: str, clean_path: str, *, one_array: bool = False, indent: int | None = None
) -> None:
    """Clean up saved findings by themselves."""
    write_findings(clean_duplicates(read_findings(spark, raw_path, one_array=one_array, indent=indent)), clean_path)


def web_run(
    pages: DataFrame,
    seeds: DataFrame,
    out: str,
    rules: Sequence[Rule] = (),
    *,
    max_depth: int,
    domains: Iterable[str] = (),
    term: str | None = None,
) -> Run:
    """Scan the stored pages ``(url, html)`` that a crawl from ``seeds (url)`` reaches.

    The pages are scanned where they lie; only their URLs and findings are joined
    with what was reached.
    """
    reached = reach(seeds, page_edges(pages), max_depth=max_depth).select("url")
    wanted = reached.select(F.xxhash64("url").alias("_id"))  # of checkpointed levels, so it is cheap to read twice
    near = maybe_in(pages.withColumn("_id", F.xxhash64("url")), wanted, "_id")
    found = _found(pages_corpus(near), rules, domains, term)
    named = reached.withColumnRenamed("url", "file")
    processed = pages.select("url").join(reached, "url", "left_semi")
    # Not a semi-join: Spark would push that below the scan, and shuffle the pages for it.
    return _saved(found.join(named, "file").select(*found.columns), processed, out)


def worst_first(clean: DataFrame) -> DataFrame:
    """How many distinct findings of each severity and type."""
    counts = severity_type_counts(clean)
    return counts.withColumn("severity_rank", severity_rank(F.col("severity"))).orderBy("severity_rank", "type")
