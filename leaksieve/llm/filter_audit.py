"""Which of five filters removes what, in every order that they could stand in.

A document's failures are five bits, its cell. Documents are counted by (part, cell) before anything is shuffled, so a
part that holds most rows is 32 numbers a task. Each cell is then folded across the array of all orders, which
is a constant of the plan: ``aggregate`` walks an order's steps and carries whether a document of this cell is still there,
``transform`` does so for every order. The 600 structs are weighted by the cell's counts, and the at most 32 arrays of a part
are merged by elementwise sums.

A null text is empty, a null part the empty string. A text repeats if a smaller id holds the same one (SHA-256); rows
without an id repeat nothing and are repeated by nothing, rows that repeat id and text are the first of their text as often as they occur.
Of several label rows of one id the largest values count; documents without labels are neither good nor toxic. An empty
table has no parts and gives no row. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leaksieve.llm.common import table
from leaksieve.llm.decontamination import bound

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITAL_PERCENT = 2
MARKS = "[#$%&*|]"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failures(text: Column) -> Column:
    """The cell of a text: bit k is set if filter ``FILTERS[k]`` would remove it. Whether it repeats is not seen here."""
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))

    def cell(words: Column) -> Column:
        n, distinct = F.size(words), F.size(F.array_distinct(words))
        tests = [
            n < MIN_WORDS,
            distinct.cast("long") * 100 < n.cast("long") * MIN_DISTINCT_PERCENT,
            capitals.cast("long") * 100 > F.length(text).cast("long") * MAX_CAPITAL_PERCENT,
            text.rlike(MARKS),
        ]
        return reduce(Column.__add__, (F.when(test, 1 << k).otherwise(0) for k, test in enumerate(tests)))

    return bound(F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(0)), cell)


def cells(
    docs: DataFrame,
    labels: DataFrame,
    part: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id_col: str = "doc_id",
) -> DataFrame:
    """Per (part, cell): how many documents, how many of them good and how many toxic."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text")
    )
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")
    # One id stands for each text. It is looked up by id, which no two texts' rows share in numbers: no key is hot.
    first = named.where("doc_id IS NOT NULL").select("doc_id", digest)
    first = first.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "digest", F.lit(True).alias("first"))
    own = named.select("doc_id", "part", failures(F.col("text")).alias("cell"), digest)
    marked = own.join(first, ["doc_id", "digest"], "left")
    repeats = F.col("doc_id").isNotNull() & F.col("first").isNull()
    marked = marked.select("doc_id", "part", (F.col("cell") + F.when(repeats, 1 << FILTERS.index("E")).otherwise(0)).alias("cell"))
    known = labels.where(F.col(label_id_col).isNotNull()).groupBy(F.col(label_id_col).alias("doc_id"))
    known = known.agg(F.max(F.expr("quality = 1")).alias("good"), F.max(F.expr("toxic = 1")).alias("toxic"))
    judged = marked.join(known, "doc_id", "left")

    def number(test: str) -> Column:
        return F.sum(F.when(F.col(test), 1).otherwise(0))

    return judged.groupBy("part", "cell").agg(
        F.count(F.lit(1)).alias("n"), number("good").alias("good"), number("toxic").alias("toxic")
    )


def _folded(orders: Sequence[Sequence[int]]) -> str:
    """SQL: the cell folded across all orders, one struct of weighted counts a step."""
    listed = "array(" + ", ".join(f"array({', '.join(map(str, order))})" for order in orders) + ")"
    gone = "(acc.left = 0)"
    fails = "(getbit(cell, k) = 1)"
    step = f"""named_struct(
        'kept', CASE WHEN {gone} OR {fails} THEN 0L ELSE n END,
        'removed', CASE WHEN {fails} AND NOT {gone} THEN n ELSE 0L END,
        'redundant', CASE WHEN {fails} AND {gone} THEN n ELSE 0L END,
        'unique_fails', CASE WHEN cell = shiftleft(1, k) THEN n ELSE 0L END,
        'good_lost', CASE WHEN {fails} AND NOT {gone} THEN good ELSE 0L END,
        'toxic_lost', CASE WHEN {fails} AND NOT {gone} THEN toxic ELSE 0L END)"""
    none = f"CAST(array() AS ARRAY<STRUCT<{', '.join(f'{name}: BIGINT' for name in COUNTS)}>>)"
    return f"""flatten(transform({listed}, o -> aggregate(
        o,
        named_struct('left', 1, 'steps', {none}),
        (acc, k) -> named_struct(
            'left', CASE WHEN {gone} OR {fails} THEN 0 ELSE 1 END,
            'steps', concat(acc.steps, array({step}))),
        acc -> acc.steps)))"""


def audit(judged: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Per part, order and step: the counts of ``COUNTS``, and what the step's filter removes over all orders."""
    orders = list(permutations(range(len(filters))))
    steps = len(filters)
    folded = judged.select("part", F.expr(_folded(orders)).alias("steps"))
    sums = ", ".join(f"'{name}', a.{name} + b.{name}" for name in COUNTS)
    zeros = ", ".join(f"'{name}', 0L" for name in COUNTS)
    merged = folded.groupBy("part").agg(F.collect_list("steps").alias("cells"))  # a part has 32 cells at most
    merged = merged.selectExpr(
        "part",
        f"aggregate(cells, array_repeat(named_struct({zeros}), {len(orders) * steps}), "
        f"(x, y) -> zip_with(x, y, (a, b) -> named_struct({sums}))) AS steps",
    )
    places = "array(" + ", ".join(str(k) for order in orders for k in order) + ")"
    share = f"aggregate(filter(zip_with(steps, {places}, (s, p) -> CASE WHEN p = f THEN s.removed END), x -> x IS NOT NULL), 0L, (a, x) -> a + x)"
    merged = merged.selectExpr("part", "steps", f"transform(sequence(0, {steps - 1}), f -> {share}) AS shapley")
    names = "array(" + ", ".join("'" + "".join(filters[k] for k in order) + "'" for order in orders) + ")"
    rows = merged.select("part", "shapley", F.posexplode("steps").alias("at", "s"))
    return rows.selectExpr(
        "part",
        f"get({names}, at div {steps}) AS filter_order",
        f"CAST(at % {steps} + 1 AS INT) AS step",
        *(f"s.{name} AS {name}" for name in COUNTS),
        f"get(shapley, get({places}, at)) AS shapley",
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
  FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT d.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
     100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text),
     regexp_matches(text, '[#$%&*|]'), coalesce(least < d.doc_id, false)] AS fails
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
k AS (SELECT unnest(range(1, 6)) AS k),
orders AS (
  SELECT [a.k, b.k, c.k, e.k, g.k] AS o FROM k a, k b, k c, k e, k g
  WHERE len(list_distinct([a.k, b.k, c.k, e.k, g.k])) = 5),
steps AS (
  SELECT o, unnest(range(1, 6)) AS step FROM orders),
laid AS (
  SELECT array_to_string([substr('ABCDE', x, 1) FOR x IN o], '') AS filter_order, step, o[step] AS filter, o[1 : step - 1] AS earlier
  FROM steps),
masks AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
judged AS (
  SELECT part, filter_order, step, filter, n, good, toxic, fails[filter] AS own,
    len([x FOR x IN earlier IF fails[x]]) > 0 AS before, len([x FOR x IN fails IF x]) AS all_fails
  FROM masks, laid),
counted AS (
  SELECT part, filter_order, step, filter,
    sum(CASE WHEN own OR before THEN 0 ELSE n END) AS kept,
    sum(CASE WHEN own AND NOT before THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN own AND before THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN own AND all_fails = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN own AND NOT before THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN own AND NOT before THEN toxic ELSE 0 END) AS toxic_lost
  FROM judged GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM counted
"""
