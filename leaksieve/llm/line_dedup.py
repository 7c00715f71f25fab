"""Lines that too many documents share, found with levelled sorted runs of line hashes.

Every row is one document. A null or empty text is one empty line. Repeated rows are documents of
their own; rows without an id keep it null. Equal texts lose the same lines, so what is dropped
is handed back by the hash of the text and needs no unique id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leaksieve.llm.common import BLANKS, saved, scratch, table, wide_hash

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """A line without blanks at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), _UPPER, _LOWER)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """In how many documents each line occurs, kept as levels of sorted runs.

    ``add`` anti-joins a batch with the keys that have already reached the threshold, which need no
    more counting, and writes the rest as a sorted run of level 0. ``fan`` runs of a level
    are compacted into one of the next, so N batches leave about ``fan * log(N)`` runs.
    """

    def __init__(self, spark: SparkSession, min_docs: int, fan: int = 2, root: str | None = None):
        self.spark, self.min_docs, self.fan = spark, min_docs, fan
        self.root = root or scratch(spark, "line-runs")
        self.levels: list[list[DataFrame]] = [[]]
        self._written = 0

    def _run(self, counts: DataFrame, level: int) -> DataFrame:
        self._written += 1
        return saved(counts.sortWithinPartitions(*KEY), "", f"{self.root}/level-{level}-{self._written}")

    def totals(self) -> DataFrame | None:
        runs = [run for level in self.levels for run in level]
        if not runs:
            return None
        merged = runs[0]
        for run in runs[1:]:
            merged = merged.unionByName(run)
        return merged if len(runs) == 1 else merged.groupBy(*KEY).agg(F.sum("docs").alias("docs"))

    def frequent(self) -> DataFrame:
        return self.totals().where(F.col("docs") >= self.min_docs).select(*KEY)

    def add(self, counts: DataFrame) -> None:
        if self.totals() is not None:
            counts = counts.join(self.frequent(), KEY, "left_anti")
        self.levels[0].append(self._run(counts, 0))
        for level, runs in enumerate(self.levels):
            if len(runs) >= self.fan:
                merged = runs[0]
                for run in runs[1:]:
                    merged = merged.unionByName(run)
                merged = merged.groupBy(*KEY).agg(F.sum("docs").alias("docs"))
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(self._run(merged, level + 1))
                runs.clear()


def line_counts(texts: DataFrame, min_chars: int) -> DataFrame:
    """Key hashes and in how many rows of ``text`` they occur, folded before the shuffle."""
    keys = F.array_distinct(F.transform(lines_of(F.col("text")), line_key))
    each = texts.select(F.explode_outer(keys).alias("key")).where(F.length("key") >= min_chars)
    return each.select(*wide_hash(F.col("key"))).groupBy(*KEY).agg(F.count("*").alias("docs"))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
    batches: int = 4,
) -> DataFrame:
    """One row per document: id, text without the frequent lines, lines before, lines dropped.

    The documents enter the runs in ``batches`` parts, as they would arrive over time; the decision
    falls on the totals of all. Keys shorter than ``min_chars`` are never dropped.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    runs = LineRuns(spark, min_docs)
    for number in range(batches):
        part = base.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == number)
        runs.add(line_counts(part, min_chars))
    frequent = saved(runs.frequent(), "frequent-lines")

    text_hash = [c.alias(n) for c, n in zip(wide_hash(F.col("text")), ("t1", "t2"), strict=True)]
    lines = base.select(*text_hash, F.posexplode_outer(lines_of(F.col("text"))).alias("at", "line"))
    keyed = lines.select("t1", "t2", "at", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    hit = keyed.select("t1", "t2", "at", *wide_hash(F.col("key"))).join(frequent, KEY, "left_semi")
    dropped = hit.groupBy("t1", "t2").agg(F.collect_set("at").alias("dropped"))

    whole = base.select("*", *text_hash).join(dropped, ["t1", "t2"], "left")
    whole = whole.select("doc_id", lines_of(F.col("text")).alias("lines"), "dropped")
    n_lines, places = F.size("lines"), F.coalesce("dropped", F.array().cast("array<int>"))
    kept = F.array_except(F.sequence(F.lit(0), n_lines - 1), places)
    return whole.select(
        "doc_id",
        F.array_join(F.transform(kept, lambda at: F.get("lines", at)), "\n").alias("text"),
        n_lines.cast("long").alias("n_lines"),
        F.size(places).cast("long").alias("n_dropped"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = dedup_lines(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    return result.select("doc_id", "n_lines", "n_dropped", digest)


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
frequent AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines,
  CAST(count(*) FILTER (WHERE key IN (SELECT key FROM frequent)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos)
    FILTER (WHERE key NOT IN (SELECT key FROM frequent)), '')) AS kept_sha256
FROM keyed GROUP BY doc_id
"""
