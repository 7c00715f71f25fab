"""Scan only contents not scanned before."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaksieve.functions.text import content_hash
from leaksieve.operators.scan import FOUND, scan
from leaksieve.operators.skew import FILTER_BYTES, ROWS_PER_TASK, join_hot, maybe_in
from leaksieve.rules.model import Rule, custom_domain_rule
from leaksieve.session import ensure_checkpoint_dir


def ruleset_key(rules: Sequence[Rule], domains: Iterable[str] = (), options: str = "") -> str:
    """Names a rule set and its options; stored findings of another key are not used."""
    domain_rule = custom_domain_rule(domains)
    parts = [f"{r.name}\0{r.java}\0{r.severity}" for r in (*rules, *([domain_rule] if domain_rule else []))]
    return hashlib.md5("\1".join([options, *parts]).encode()).hexdigest()


def scan_contents(
    corpus: DataFrame,
    rules: Sequence[Rule],
    *,
    file: str = "file",
    text: str = "text",
    domains: Sequence[str] = (),
    known: DataFrame | None = None,
    options: str = "",
    filter_bytes: int = FILTER_BYTES,
) -> DataFrame:
    """Findings by content: ``content_md5``, ``ruleset`` and the columns of ``scan.FOUND``.

    Every distinct non-empty text gives a row of nulls, which marks it as scanned,
    and a row per finding.  Contents in ``known`` are left out.  ``file`` has to
    identify a row of ``corpus``.
    """
    return _scan_new(corpus, _hashed(corpus, file, text), rules, file, text, domains, known, options, None, filter_bytes)


def incremental_scan(
    corpus: DataFrame,
    rules: Sequence[Rule],
    stored: DataFrame,
    *,
    file: str = "file",
    text: str = "text",
    domains: Sequence[str] = (),
    options: str = "",
    rows_per_task: int = ROWS_PER_TASK,
    buckets: int | None = None,
    filter_bytes: int = FILTER_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """``(findings of the whole corpus, rows to add to the store)``.

    ``stored`` has the columns of ``scan_contents``.  Stored findings are used
    for every text with the same md5 and rule set, under the current file name.
    The hashes and the new findings are checkpointed: both results use them, and
    neither holds any text.  Where ``stored`` lies in ``buckets`` by ``content_md5``,
    as ``store.stored`` reads it, hashes are dealt out the same way and stored rows
    stay where they are, but for those of contents with over ``rows_per_task`` files.
    """
    ensure_checkpoint_dir(corpus.sparkSession)
    key = ruleset_key(rules, domains, options)
    hashed = _hashed(corpus, file, text).checkpoint()
    fresh = _scan_new(corpus, hashed, rules, file, text, domains, stored, options, buckets, filter_bytes).checkpoint()
    copies = hashed.groupBy("content_md5").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows_per_task).checkpoint()
    # N files hold at most N / rows_per_task such contents.
    hot = None if copies.isEmpty() else F.broadcast(copies.select("content_md5"))
    parts = []
    for rows in (stored.where(F.col("ruleset") == key), fresh):
        missing = [F.lit(None).cast(fresh.schema[c].dataType).alias(c) for c in FOUND if c not in rows.columns]
        present = [c for c in FOUND if c in rows.columns]
        found = rows.where(F.col("type").isNotNull()).select("content_md5", *present, *missing)
        if hot is None:
            parts.append(_dealt(hashed, buckets).join(found, "content_md5"))
        else:
            rest = _dealt(hashed.join(hot, "content_md5", "left_anti"), buckets)
            parts.append(rest.join(found, "content_md5"))
            many, few = (side.join(hot, "content_md5", "left_semi") for side in (hashed, found))
            parts.append(join_hot(many, few, "content_md5", copies, rows_per_task))
    named = [part.select("file", *FOUND) for part in parts]
    return functools.reduce(DataFrame.unionAll, named), fresh


def _dealt(hashes: DataFrame, buckets: int | None) -> DataFrame:
    return hashes if buckets is None else hashes.repartition(buckets, "content_md5")


def _hashed(corpus: DataFrame, file: str, text: str) -> DataFrame:
    name = F.col(file).cast("string").alias("file")
    return corpus.where(F.length(text) > 0).select(name, content_hash(F.col(text)).alias("content_md5"))


def _scan_new(corpus, hashed, rules, file, text, domains, known, options, buckets, filter_bytes) -> DataFrame:
    """Scan one file of each content that ``known`` does not have, where it lies.

    Only hashes are shuffled: copies are folded on them, one file stands for all,
    and known contents are taken away.  A filter of the chosen files, sized by their
    count, goes to every task of the corpus.  It lets some other files through; their
    findings are taken out afterwards, exactly.  Texts never move.
    """
    key = ruleset_key(rules, domains, options)
    new = hashed.groupBy("content_md5").agg(F.min(F.xxhash64("file")).alias("_id"))
    if known is not None:
        # Every scanned content has a row of nulls, but stores of other makes may hold findings alone.
        done = known.where(F.col("ruleset") == key).select("content_md5")
        new = _dealt(new, buckets).join(done, "content_md5", "left_anti")
    ensure_checkpoint_dir(corpus.sparkSession)
    new = new.checkpoint()  # used twice, and holds hashes only
    named = corpus.select(F.col(file).cast("string").alias("file"), F.col(text).alias("text"))
    texts = maybe_in(named.withColumn("_id", F.xxhash64("file")), new, "_id", filter_bytes).withColumn(
        "content_md5", content_hash(F.col("text"))
    )
    found = scan(texts, rules, file="content_md5", keep=["_id"], domains=domains, mark_scanned=True)
    # Not a semi-join: Spark would push that below the scan, and shuffle the texts for it.
    rows = found.withColumnRenamed("file", "content_md5").join(new, ["content_md5", "_id"])
    # Two files of one content might share an id.
    return rows.select("content_md5", F.lit(key).alias("ruleset"), *FOUND).distinct()
