"""Importance resampling towards a target: documents whose word runs are commoner in the target are drawn more often.

Features are runs of one to three words; a feature's bucket is the CRC-32 of its bytes modulo 10,000. Both tables are counted whole,
each task into one array of buckets, and the gain of a bucket is the logarithm of how much commoner it is in the target. A document's
weight is the sum of its features' gains; Gumbel noise from a hash of its id makes the highest scores a weighted draw.

Most words are few. The ``HEAD`` most frequent ones, counted over all documents, are sent to every task with the CRC of
the word and that of the word behind a blank: the CRC of a run follows from those of its parts, by tables that push a CRC over a
number of bytes. For the ``FREQUENT`` first of them the CRC and the bucket of every pair are sent too. Both are
bounded by these numbers and by ``HEAD_BYTES``, the longest word of the head: about 8 MB. A feature with a word of the tail takes the CRC of
its own bytes. Either way the bucket is exact, so the head decides nothing but speed.

A null text has no words; other columns are not read. A null id hashes as the empty string and comes last among equal scores. Repeated rows count as often as
they occur; of rows alike in score and id any may come first. With no target words or no documents the gains are still defined.
Texts are read in parts of ``PART`` bytes with the two words before them, so memory does not grow with their length.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leaksieve.llm.common import binary, saved, table

BUCKETS = 10_000
RUN = 3
HEAD, FREQUENT, HEAD_BYTES = 32_768, 1_024, 40
SEED = 42
MIN_WORDS = 20
PERCENT = 5
PART = 1 << 19

#: A-Z in lower case; all that is no word becomes a blank.
_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def _parts(text: bytes) -> Iterator[tuple[list[bytes], int]]:
    """Words of the text, a part at a time, with how many of them are of the part before."""
    before: list[bytes] = []
    low = 0
    while low < len(text) or not low:
        high = len(text)
        if high - low > PART:
            # A blank of the normalised text is the same byte for byte, so looking for one need not translate it all.
            high = low + PART
            while high < len(text) and _WORDS[text[high]] != 0x20:
                high += 1
        words = before + text[low:high].translate(_WORDS).split()
        yield words, len(before)
        before, low = words[-(RUN - 1) :], max(high, 1)


def _shifts(most: int) -> np.ndarray:
    """[n, k, b]: the CRC b << 8k pushed over n zero bytes, without the inversions at both ends."""
    step = np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)
    tables = np.zeros((most + 1, 4, 256), np.uint32)
    for k in range(4):
        tables[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(most):
        held = tables[n]
        tables[n + 1] = step[held & 255] ^ (held >> np.uint32(8))
    return tables


class Head(NamedTuple):
    """CRC states of the frequent words, by their place, and of the pairs of the most frequent ones."""

    words: list[bytes]
    alone: np.ndarray  # CRC of the word
    behind: np.ndarray  # CRC of a blank and the word
    length: np.ndarray  # of a blank and the word
    pairs: np.ndarray  # CRC of two words, [first * frequent + second]
    pair_bucket: np.ndarray


def head_of(words: list[bytes], frequent: int = FREQUENT, buckets: int = BUCKETS) -> Head:
    alone = np.array([zlib.crc32(word) for word in words], np.uint32)
    behind = np.array([zlib.crc32(b" " + word) for word in words], np.uint32)
    length = np.array([len(word) + 1 for word in words], np.int64)
    top, shifts = slice(0, frequent), _shifts(HEAD_BYTES + 1)
    pairs = _push(shifts, alone[top, None], length[None, top]) ^ behind[None, top]
    return Head(words, alone, behind, length, pairs.ravel(), (pairs.ravel() % np.uint32(buckets)).astype(np.int32))


def _push(shifts: np.ndarray, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The CRCs pushed over ``n`` bytes."""
    crc = crc.astype(np.int64)
    out = shifts[n, 0, crc & 255]
    for k in (1, 2, 3):
        out = out ^ shifts[n, k, crc >> 8 * k & 255]
    return out


class Bucketer:
    """Buckets of all features of texts."""

    def __init__(self, head: Head, buckets: int):
        self.head, self.buckets = head, np.uint32(buckets)
        self.place = {word: n for n, word in enumerate(head.words)}
        self.frequent = math.isqrt(len(head.pairs))
        self.shifts = _shifts(HEAD_BYTES + 1)

    def of(self, parts: list[tuple[list[bytes], int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(part, bucket) of the features that end in each part's own words, an array a run length."""
        words = [word for part, _ in parts for word in part]
        if not words:
            return
        sizes = np.array([len(part) for part, _ in parts])
        number = np.repeat(np.arange(len(parts)), sizes)
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        own = np.arange(len(words)) >= first + np.repeat([seen for _, seen in parts], sizes)
        joined = b" ".join(words)
        ends = np.cumsum([len(word) + 1 for word in words]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        place = self.place
        at = np.array([place.get(word, -1) for word in words], np.int64)
        head, known, crc = self.head, at >= 0, np.zeros(len(words), np.uint32)
        for run in range(1, RUN + 1):
            last = np.flatnonzero(own & (np.arange(len(words)) - (run - 1) >= first))
            bucket = np.empty(len(words), np.int32)
            # The features of head words: one word more than the run before, or a pair that is known whole.
            if run == 1:
                fast = at >= 0
                crc[fast] = head.alone[at[fast]]
                bucket[fast] = crc[fast] % self.buckets
            else:
                fast = np.zeros(len(words), bool)
                fast[1:] = known[:-1] & (at[1:] >= 0)
                grown = np.zeros(len(words), np.uint32)
                told = np.zeros(len(words), bool)
                if run == 2 and self.frequent:
                    told[1:] = fast[1:] & (at[:-1] < self.frequent) & (at[1:] < self.frequent)
                    cell = at[np.flatnonzero(told) - 1] * self.frequent + at[told]
                    grown[told], bucket[told] = head.pairs[cell], head.pair_bucket[cell]
                rest = np.flatnonzero(fast & ~told)
                grown[rest] = _push(self.shifts, crc[rest - 1], head.length[at[rest]]) ^ head.behind[at[rest]]
                bucket[rest] = grown[rest] % self.buckets
                crc, known = grown, fast
            slow = last[~fast[last]]
            bounds = zip(starts[slow - (run - 1)].tolist(), ends[slow].tolist(), strict=True)
            direct = np.array([zlib.crc32(joined[a:b]) for a, b in bounds], np.uint32)
            bucket[slow] = direct % self.buckets
            yield number[last], bucket[last]


def _grouped(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Parts of texts, some ``PART`` bytes at a time: (batch, [(row, words, how many of them are of the part before)])."""
    for batch in batches:
        held, size = [], 0
        for row, text in enumerate(binary(batch.column(column))):
            for part in _parts(text or b""):
                held.append((row, *part))
                size += sum(map(len, part[0])) + 16
                if size > PART:
                    yield batch, held
                    held, size = [], 0
        if held:
            yield batch, held


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(seen: Counter) -> pa.RecordBatch:
        columns = [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["word", "n"])

    seen: Counter = Counter()
    for _, held in _grouped(batches, "text"):
        for _, words, before in held:
            seen.update(words[before:])
        if len(seen) > 500_000:
            yield rows(seen)
            seen = Counter()
    yield rows(seen)


def frequent_words(texts: DataFrame, most: int = HEAD) -> list[bytes]:
    """The most frequent words of at most ``HEAD_BYTES`` bytes, counted over all of ``texts``; at most ``most`` of them.

    Counts are put into classes, 64 for each doubling, and as many whole classes are taken as fit: no more rows than that reach the driver.
    """
    if not most:
        return []
    counted = texts.mapInArrow(_count_words, "word binary, n long").where(F.length("word") <= HEAD_BYTES)
    counted = counted.groupBy("word").agg(F.sum("n").alias("n"))
    step = F.floor(64 * F.log2("n")).alias("class")
    counted = saved(counted.select("word", "n", step).where("n > 1"), "words")
    sizes = counted.groupBy("class").agg(F.count(F.lit(1)).alias("words")).collect()
    least, taken = None, 0
    for row in sorted(sizes, key=lambda row: -row["class"]):
        taken += row.words
        if taken > most:
            break
        least = row["class"]
    if least is None:
        return []
    found = counted.where(F.col("class") >= least).select("word", "n").collect()
    return [bytes(row.word) for row in sorted(found, key=lambda row: (-row.n, bytes(row.word)))]


def bucket_totals(texts: DataFrame, head: Broadcast, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all ``texts`` fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, total = Bucketer(head.value, buckets), np.zeros(buckets, np.int64)
        for _, held in _grouped(batches, "text"):
            for _, bucket in made.of([(words, before) for _, words, before in held]):
                total += np.bincount(bucket, minlength=buckets)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(...)) of each bucket, both tables smoothed by one feature a bucket."""
    buckets, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    ratio = (
        ((t + 1) * (s_all + buckets)) / ((s + 1) * (t_all + buckets)) for s, t in zip(source.tolist(), target.tolist(), strict=True)
    )
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def noise(seed: int, doc_id: int | None) -> int:
    """Gumbel noise in thousandths, from the id alone."""
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, head: Broadcast, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of the rows (doc_id, text)."""
    schema = pa.schema([(name, pa.int64()) for name in ("doc_id", "n_words", "n_features", "weight", "score")])

    def score_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Bucketer(head.value, len(gain))
        for batch in batches:
            if not batch.num_rows:
                continue
            words, features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for _, held in _grouped([batch], "text"):
                row = np.array([row for row, _, _ in held])
                np.add.at(words, row, [len(part) - before for _, part, before in held])
                for number, bucket in made.of([(part, before) for _, part, before in held]):
                    np.add.at(features, row, np.bincount(number, minlength=len(held)))
                    # Sums of thousandths are whole numbers far below 2^53, so adding them as doubles is exact.
                    np.add.at(weight, row, np.bincount(number, gain[bucket], len(held)).astype(np.int64))
            ids = batch.column("doc_id")
            score = weight + np.array([noise(seed, doc_id) for doc_id in ids.to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (words, features, weight, score))], schema=schema)

    return docs.mapInArrow(score_rows, "doc_id long, n_words long, n_features long, weight long, score long")


def ranked(rows: DataFrame, drawn: int, *order: Column) -> DataFrame:
    """``rows`` with their place in ``order`` as ``rank``, null beyond ``drawn``.

    Ranges of the order are sorted each by itself; a row's place is that in its range plus the rows of the ranges before.
    """
    numbered = saved(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # A row a range, of which there are no more than shuffle partitions: small enough for one task and to be sent.
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = numbered.withColumn("_part", part).join(F.broadcast(sizes), "_part")
    rank = F.col("_before") + place + 1
    return placed.withColumn("rank", F.when(rank <= drawn, rank)).drop("_at", "_part", "_before")


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    buckets: int = BUCKETS,
    seed: int = SEED,
    head: int = HEAD,
    frequent: int = FREQUENT,
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): the drawn documents have a rank."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    wanted = target.select(F.col(target_text_col).cast("string").alias("text"))
    texts = source.select("text")
    sent = spark.sparkContext.broadcast(head_of(frequent_words(texts, head), frequent, buckets))
    gain = gains(bucket_totals(texts, sent, buckets), bucket_totals(wanted, sent, buckets))
    scored = scores(source, sent, gain, seed).withColumn("_row", F.monotonically_increasing_id())
    scored = saved(scored, "scores")
    fit = scored.where(F.col("n_words") >= min_words)
    drawn = percent * fit.count() // 100
    placed = ranked(fit, drawn, F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_row"))
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(rest).drop("_row")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 is written out from its polynomial; a feature's bytes are folded one by one.
ORACLE = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS row, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
runs AS (
  SELECT 'd' AS side, row, w, len(w) AS size, unnest(range(1, len(w) + 1)) AS p FROM d
  UNION ALL SELECT 'b', row, w, len(w), unnest(range(1, len(w) + 1)) FROM b),
f AS (
  SELECT side, row, w[p] AS feature FROM runs
  UNION ALL SELECT side, row, w[p] || ' ' || w[p + 1] FROM runs WHERE p < size
  UNION ALL SELECT side, row, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] FROM runs WHERE p < size - 1),
hexed AS (SELECT feature, hex(encode(feature)) AS x FROM (SELECT DISTINCT feature FROM f)),
bytes AS (
  SELECT feature, list_transform(range(len(x) // 2), lambda i: 16 * (strpos('0123456789ABCDEF', x[2 * i + 1]) - 1)
    + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1) AS bytes FROM hexed),
bucketed AS (
  SELECT feature, xor(list_reduce(list_prepend(4294967295, bytes),
    lambda c, v: xor(c >> 8, t[1 + (xor(c, v) & 255)])), 4294967295) % 10000 AS bucket FROM bytes, crc),
counted AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM f JOIN bucketed USING (feature) GROUP BY bucket),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (sum(s) OVER () + 10000) AS DOUBLE)
    / CAST((s + 1) * (sum(t) OVER () + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM counted),
weighed AS (
  SELECT row, count(*) AS n_features, sum(gain) AS weight FROM f JOIN bucketed USING (feature) JOIN gain USING (bucket)
  WHERE side = 'd' GROUP BY row),
scored AS (
  SELECT doc_id, len(w) AS n, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || sha256('42:' || doc_id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT)
      AS score
  FROM d LEFT JOIN weighed USING (row)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id) AS place,
    5 * count(*) FILTER (n >= 20) OVER () // 100 AS drawn FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n >= 20 AND place <= drawn THEN place END AS rank FROM placed
"""
