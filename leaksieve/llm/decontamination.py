"""Benchmark decontamination with SimHash over item-sized windows.

Words are runs of letters and digits in lower case, shingles five of them (fewer for an item of fewer words). A
document is contaminated by an item if one of its windows of as many words as the item has is at least 0.8 similar:
shared shingles over all shingles, each counted as often as it occurs. Every start is tried, so the parts of an
item may stand in another order. A window at 0.8 holds at least 0.8 / 1.8 of its and the item's shingles in common: a
running count over the places of shared shingles leaves out the windows that hold fewer, and no other.

Each window that is left gets a 64-bit SimHash of its shingles. The fingerprints of items and windows are cut into one block
more than the radius, so two that differ in no more bits agree in one block at least: a join on
(words, block, value) finds all pairs within the radius, and the exact similarity decides on them. At similarity 0.8
fingerprints differ in 9.6 bits on average; the radius of 21 lies four deviations above: one such window in 10^4 is missed.

All of it is DataFrame functions. Null or empty texts hold no window; items without words match nothing; a document
shorter than an item is one window. Equal texts are found by hash and reported for each of their
documents, whatever their ids; repeated items count by their item id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leaksieve.llm.common import saved, table, wide_hash

WIDTH = 5
SIMILARITY = 0.8
RADIUS = 21
#: Tables of at most so many rows, of five numbers each (so 20 MB), are sent to every executor; longer ones are shuffled.
SENT_ROWS = 500_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(0))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` and its loops read it."""
    return F.get(F.transform(F.array(value), use), 0)


def shingles_of(words: Column, width: int) -> Column:
    """Hashes of the runs of ``width`` words; none if there are fewer words."""

    def runs(held: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(held) - width)
        hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(held, i + k) for k in range(width)]))
        return F.when(F.size(held) < width, F.array().cast("array<bigint>")).otherwise(hashes)

    return bound(words, runs)


def _simhash(shingles: Column) -> Column:
    """Bit b is set if it is in over half the hashes."""

    def bits(held: Column) -> Column:
        def bit(acc: Column, b: Column) -> Column:
            one = F.call_function("shiftleft", F.lit(1).cast("long"), b)
            votes = F.aggregate(held, F.lit(0), lambda n, h: n + F.when(h.bitwiseAND(one) != 0, 1).otherwise(0))
            return F.when(2 * votes > F.size(held), acc.bitwiseOR(one)).otherwise(acc)

        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), bit)

    return bound(shingles, bits)


def _counted(shingles: Column) -> Column:
    """Shingles told apart by how often they have occurred, so that sets of them intersect as bags do."""
    return bound(
        F.array_sort(shingles),
        lambda s: F.transform(s, lambda h, i: F.xxhash64(h, i + 1 - F.array_position(s, h))),
    )


def _blocks(fp: str, radius: int) -> Column:
    """(block, value) of each of the radius + 1 blocks."""
    cuts = [round(64 * k / (radius + 1)) for k in range(radius + 2)]
    parts = [
        F.struct(
            F.lit(number).alias("block"),
            F.shiftrightunsigned(F.col(fp), a).bitwiseAND(F.lit((1 << b - a) - 1)).cast("long").alias("value"),
        )
        for number, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))
    ]
    return F.array(*parts)


def _starts(places: Column, size: Column, n_words: Column, width: int, similarity: float) -> Column:
    """Starts of all windows of ``n_words`` words that hold enough of the sorted ``places`` to be similar to an item.

    A start s belongs to the first place i at or after it; its window holds ``need`` places if place i + need - 1 lies in it.
    """
    own, last = F.least(size, n_words) - (width - 1), F.greatest(F.lit(0), size - n_words)
    share = similarity / (1 + similarity)
    need = F.greatest(F.lit(1), F.ceil(F.lit(share) * (own + n_words - (width - 1)) - 1e-9).cast("int"))
    none = F.array().cast("array<int>")

    def run(low: Column, high: Column) -> Column:
        return F.when(low > high, none).otherwise(F.sequence(low, F.greatest(low, high)))

    def starts(held: Column) -> Column:
        at, least, own, last = (held[name] for name in ("at", "need", "own", "last"))

        def of_place(place: Column, i: Column) -> Column:
            before = F.coalesce(F.get(at, i - 1), F.lit(-1))
            # Past the last place, no window holds enough.
            far = F.coalesce(F.get(at, i + least - 1), F.lit(2**31 - 1)) - own
            ends = F.struct(F.greatest(F.lit(0), before + 1, far + 1).alias("low"), F.least(last, place).alias("high"))
            return bound(ends, lambda e: run(e["low"], e["high"]))

        return F.flatten(F.transform(at, of_place))

    return bound(F.struct(places.alias("at"), need.alias("need"), own.alias("own"), last.alias("last")), starts)


def _sent(items: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(items) if rows <= SENT_ROWS else items


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = SIMILARITY,
    radius: int = RADIUS,
) -> DataFrame:
    """A row per (document, item): the most similar window, its first word, its words, how many windows match."""
    items = benchmark.select(F.col(item_col).alias("item_id"), words_of(F.col(item_text_col)).alias("words"))
    items = items.where(F.size("words") > 0).withColumn("n_words", F.size("words"))
    items = items.withColumn("width", F.least("n_words", F.lit(WIDTH)))
    widths = sorted(row.width for row in items.select("width").distinct().collect())
    found = None
    for width in widths:
        part = _of_width(docs, items.where(F.col("width") == width), width, id_col, text_col, similarity, radius)
        found = part if found is None else found.unionByName(part)
    if found is None:
        empty = "cast(null as long) item_id, 0D similarity, 0 start, 0 n_words, 0L windows"
        return docs.select(F.col(id_col).alias("doc_id")).where(F.lit(False)).selectExpr("doc_id", *empty.split(", "))
    best = F.max_by(F.struct("similarity", "start", "n_words"), F.struct("similarity", -F.col("start"))).alias("best")
    found = found.groupBy("doc_id", "item_id").agg(best, F.count("*").alias("windows"))
    return found.select("doc_id", "item_id", "best.*", "windows")


def _of_width(
    docs: DataFrame, items: DataFrame, width: int, id_col: str, text_col: str, similarity: float, radius: int
) -> DataFrame:
    items = items.withColumn("shingles", shingles_of(F.col("words"), width))
    items = items.withColumn("fp", _simhash(F.col("shingles"))).withColumn("bag", _counted(F.col("shingles")))
    items = items.select("item_id", "n_words", "shingles", "fp", "bag").withColumn("row", F.monotonically_increasing_id())
    items = saved(items, "items")
    anchors = items.select("n_words", F.explode_outer("shingles").alias("h")).where("h IS NOT NULL").distinct()
    anchors = saved(anchors, "item-shingles")
    hashes = [c.alias(n) for c, n in zip(wide_hash(F.col("text")), ("t1", "t2"), strict=True)]
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    # Outer generators throughout: for others the optimizer tests the array first, which computes it anew.
    # Windows with enough shared shingles. Only positions move, never words.
    cut = base.select(*hashes, words_of(F.col("text")).alias("words"))
    cut = cut.select("t1", "t2", F.size("words").alias("size"), shingles_of(F.col("words"), width).alias("shingles"))
    at = cut.select("t1", "t2", "size", F.posexplode_outer("shingles").alias("p", "h"))
    shared_at = at.join(_sent(anchors, anchors.count()), "h").groupBy("t1", "t2", "size", "n_words")
    shared_at = shared_at.agg(F.array_sort(F.collect_set("p")).alias("at"))
    starts = _starts(F.col("at"), F.col("size"), F.col("n_words"), width, similarity)
    places = shared_at.select("t1", "t2", "n_words", starts.alias("starts")).where(F.size("starts") > 0)
    places = places.groupBy("t1", "t2").agg(F.collect_list(F.struct("n_words", "starts")).alias("places"))

    # The windows' own shingles, bags and fingerprints.
    held = base.select("*", *hashes).join(saved(places, "windows"), ["t1", "t2"])
    held = held.select("doc_id", words_of(F.col("text")).alias("words"), "places")
    held = held.select("doc_id", shingles_of(F.col("words"), width).alias("all"), F.explode_outer("places").alias("w"))
    held = held.select("doc_id", "all", "w.n_words", F.explode_outer("w.starts").alias("start"))
    window = F.slice("all", F.col("start") + 1, F.col("n_words") - (width - 1))
    windows = held.select("doc_id", "start", "n_words", window.alias("shingles"))
    windows = windows.select("doc_id", "start", "n_words", _simhash(F.col("shingles")).alias("fp"), _counted(F.col("shingles")).alias("bag"))
    windows = windows.withColumn("blocks", _blocks("fp", radius)).select("*", F.explode_outer("blocks").alias("b"))
    windows = windows.select("doc_id", "start", "n_words", "b.*", "fp", "bag", "blocks")

    kept = items.withColumn("blocks", _blocks("fp", radius)).select("*", F.explode_outer("blocks").alias("b"))
    kept = kept.select("row", "n_words", "b.*", F.col("fp").alias("item_fp"))
    xor = F.col("fp").bitwiseXOR(F.col("item_fp"))
    pairs = windows.join(_sent(kept, items.count() * (radius + 1)), ["n_words", "block", "value"])
    pairs = pairs.where(F.bit_count(xor) <= radius)
    cuts = [round(64 * k / (radius + 1)) for k in range(radius + 2)]
    # A pair that agrees in several blocks counts for the first of them.
    first = F.coalesce(
        *[
            F.when(F.shiftrightunsigned(xor, a).bitwiseAND(F.lit((1 << b - a) - 1)) == 0, number)
            for number, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))
        ]
    )
    pairs = pairs.where(F.col("block") == first).select("doc_id", "start", "n_words", "bag", "row")
    # The bags of items are fetched for the pairs within the radius only.
    pairs = pairs.join(items.select("row", "item_id", F.col("bag").alias("item_bag")), "row")
    shared = F.size(F.array_intersect("bag", "item_bag"))
    score = shared / (F.size("bag") + F.size("item_bag") - shared)
    return pairs.withColumn("similarity", score).where(F.col("similarity") >= similarity).select(
        "doc_id", "item_id", "similarity", "start", "n_words"
    )


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Items have five words at least here; shingles are compared as text and bags by counting.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
ds AS (SELECT doc_id, len(w) AS size, unnest(range(len(w) - 4)) AS p, w FROM d WHERE len(w) >= 5),
dsh AS (SELECT doc_id, size, p, array_to_string(w[p + 1 : p + 5], ' ') AS s FROM ds),
bs AS (SELECT item_id, len(w) AS n, unnest(range(len(w) - 4)) AS j, w FROM b WHERE len(w) >= 5),
bsh AS (SELECT item_id, n, j, array_to_string(w[j + 1 : j + 5], ' ') AS s FROM bs),
wins AS (
  SELECT DISTINCT doc_id, n, unnest(range(greatest(0, p - (n - 5)), least(p, greatest(0, size - n)) + 1)) AS start
  FROM (SELECT DISTINCT doc_id, size, p, n FROM dsh JOIN bsh USING (s))),
wsh AS (
  SELECT wins.doc_id, n, start, s, count(*) AS c FROM wins JOIN dsh
  ON wins.doc_id = dsh.doc_id AND p BETWEEN start AND start + n - 5 GROUP BY ALL),
wn AS (SELECT doc_id, n, start, sum(c) AS total FROM wsh GROUP BY ALL),
ish AS (SELECT item_id, n, s, count(*) AS c FROM bsh GROUP BY ALL),
shared AS (
  SELECT doc_id, n, start, item_id, sum(least(wsh.c, ish.c)) AS common FROM wsh JOIN ish USING (n, s) GROUP BY ALL),
scored AS (
  SELECT doc_id, item_id, n, start, CAST(common AS DOUBLE) / CAST(total + (n - 4) - common AS DOUBLE) AS similarity
  FROM shared JOIN wn USING (doc_id, n, start))
SELECT doc_id, item_id, max(similarity) AS similarity,
  CAST(arg_max(start, similarity * 1e9 - start) AS INTEGER) AS start, CAST(any_value(n) AS INTEGER) AS n_words,
  count(*) AS windows
FROM scored WHERE similarity >= 0.8 GROUP BY doc_id, item_id
"""
