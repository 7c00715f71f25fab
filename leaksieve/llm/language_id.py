"""Language identification by prediction by partial matching over bytes.

Per language a tree of byte contexts of orders 0 to ``order`` with the counts of the bytes that followed. A byte
that was seen after the longest context costs its share there; one that was not costs an
escape, and the next shorter context is asked, down to 256 equal chances (escape method C). The counts are
frozen, so a text has an exact code length in every language; the shortest wins.

A text that is null or has no letter is ``und`` with score 0. With no labelled row at all, every text is. Equal code
lengths go to the first language in order. Score: the share of the winner if code lengths
are taken as log-likelihoods. Repeated rows get the same answer; a null id is never held out of
an answer, but is not learnt from.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leaksieve.llm.common import binary, saved, table

ORDER = 4
#: Training takes so many distinct texts of each language, or all it has, and at most so many bytes of them together.
SAMPLE_ROWS = 400
SAMPLE_BYTES = 400_000
#: By language: the distinct grams of the full order, and how often each was seen.
Counts = dict[str, tuple[np.ndarray, np.ndarray]]
_LETTER = regex.compile(r"\p{L}")
_CHUNK = 1 << 22


def _grams(data: np.ndarray, order: int) -> np.ndarray:
    """For every byte, itself (lowest) and the ``order`` bytes before it; 0 before the beginning."""
    codes = np.zeros(len(data), np.int64)
    for back in range(order, -1, -1):
        codes <<= 8
        codes[back:] |= data[: max(0, len(data) - back)]
    return codes


class ContextTrees:
    """Costs in bits of a byte after its context, for every language."""

    def __init__(self, counts: Counts, order: int):
        self.order, self.languages = order, sorted(counts)
        self.levels = []
        for language in self.languages:
            grams, seen = counts[language]
            levels = []
            for k in range(order + 1):
                codes, place = np.unique(grams & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
                n = np.bincount(place, seen)
                contexts, of = np.unique(codes >> 8, return_inverse=True)
                total, distinct = np.bincount(of, n), np.bincount(of)
                hit = -np.log2(n / (total + distinct)[of])
                escape = -np.log2(distinct / (total + distinct))
                levels.append((codes, hit, contexts, escape))
            self.levels.append(levels)

    def cost(self, grams: np.ndarray) -> np.ndarray:
        """(language, gram): the code length of each gram's last byte after those before it."""
        out = np.zeros((len(self.languages), len(grams)))
        for row, levels in zip(out, self.levels, strict=True):
            open_ = np.arange(len(grams))
            for k in range(self.order, -1, -1):
                codes, hit, contexts, escape = levels[k]
                asked = grams[open_] & ((1 << 8 * (k + 1)) - 1)
                at = np.minimum(np.searchsorted(codes, asked), len(codes) - 1)
                known = codes[at] == asked
                row[open_[known]] += hit[at[known]]
                open_, asked = open_[~known], asked[~known] >> 8
                at = np.minimum(np.searchsorted(contexts, asked), len(contexts) - 1)
                known = contexts[at] == asked  # a context never seen has nothing to escape from
                row[open_[known]] += escape[at[known]]
            row[open_] += 8.0
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """(text, language): code lengths of whole texts. Each distinct gram is costed once."""
        total = np.zeros((len(texts), len(self.languages)))
        group: list[int] = []
        size = 0
        for number, text in enumerate(texts):
            if len(text) > _CHUNK:  # a very long text by itself, in parts that overlap by one context
                for low in range(0, len(text), _CHUNK):
                    head = max(0, low - self.order)
                    data = np.frombuffer(text[head : low + _CHUNK], np.uint8)
                    total[number] += self._sums(_grams(data, self.order)[low - head :], np.array([0]))[0]
                continue
            if size + len(text) > _CHUNK:
                self._score(texts, group, total)
                group, size = [], 0
            if text:
                group.append(number)
                size += len(text)
        self._score(texts, group, total)
        return total

    def _score(self, texts: list[bytes], group: list[int], total: np.ndarray) -> None:
        if group:
            pad = bytes(self.order)
            data = np.frombuffer(b"".join(pad + texts[number] for number in group), np.uint8)
            sizes = np.array([len(texts[number]) for number in group]) + self.order
            ends = np.cumsum(sizes)
            keep = np.ones(len(data), bool)
            for back in range(self.order):
                keep[ends - sizes + back] = False
            starts = ends - sizes - self.order * np.arange(len(group))
            total[group] = self._sums(_grams(data, self.order)[keep], starts)

    def _sums(self, grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
        place, distinct = pd.factorize(grams)
        costs = self.cost(distinct)
        return np.stack([np.add.reduceat(cost[place], starts) for cost in costs], axis=1)


def _any(tests: Iterable[Column]) -> Column:
    return reduce(Column.__or__, tests, F.lit(False))


def learn(labelled: DataFrame, order: int, rows: int, size: int) -> Counts:
    """The counts of the context trees, from a bounded sample of (lang, text): the ``rows`` distinct texts of a language
    with the lowest hashes, or all if it has fewer, and ``size`` bytes of them. How often a text is repeated changes
    nothing. What is collected is bounded by that, and by the number of languages."""

    def count(lang: tuple, group: pd.DataFrame) -> pd.DataFrame:
        seen: Counter = Counter()
        left = size
        # From the shortest on, each takes up to an equal share of what is left, so that a long one hides no other.
        texts = sorted((text.encode() for text in group["text"]), key=lambda data: (len(data), data))
        for number, data in enumerate(texts):
            data = data[: -(-left // (len(texts) - number))]
            left -= len(data)
            codes, n = np.unique(_grams(np.frombuffer(data, np.uint8), order), return_counts=True)
            seen.update(dict(zip(codes.tolist(), n.tolist(), strict=True)))
            if not left:
                break
        grams = sorted(seen)
        return pd.DataFrame(
            {
                "lang": [lang[0]],
                "grams": [np.array(grams, np.int64).tobytes()],
                "seen": [np.array([seen[g] for g in grams], np.int64).tobytes()],
            }
        )

    # Only hashes are told apart and counted; texts move once they are chosen, a copy of each.
    span = 1 << 31
    ranked = labelled.where("length(text) > 0").select("lang", "text", F.xxhash64("text").alias("rank"))
    known = saved(ranked.select("lang", "rank").distinct(), "labelled-texts")
    place = F.pmod("rank", F.lit(span))
    amount = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    last: dict[str, int] = {}
    asked = 2 * rows + 100
    while rest := amount.keys() - last.keys():
        below = _any((F.col("lang") == lang) & (place < min(span, span * asked // amount[lang])) for lang in sorted(rest))
        places: dict[str, list[int]] = {}
        for r in known.where(below).select("lang", place.alias("place")).collect():
            places.setdefault(r.lang, []).append(r.place)
        for lang, held in places.items():
            if len(held) >= min(rows, amount[lang]):
                last[lang] = sorted(held)[min(rows, amount[lang]) - 1]
        asked *= 2
    chosen = ranked.where(_any((F.col("lang") == lang) & (place <= high) for lang, high in sorted(last.items())))
    # A character is a byte at least.
    chosen = chosen.groupBy("lang", "rank").agg(F.min(F.substring("text", 1, size)).alias("text"))
    found = chosen.groupBy("lang").applyInPandas(count, "lang string, grams binary, seen binary").collect()
    return {r.lang: (np.frombuffer(r.grams, np.int64), np.frombuffer(r.seen, np.int64)) for r in found}


def _predict(batches: Iterator[pa.RecordBatch], counts: Broadcast, order: int) -> Iterator[pa.RecordBatch]:
    model = ContextTrees(counts.value, order) if counts.value else None
    for batch in batches:
        texts = binary(batch.column("text"))
        scored = [text if model and text and _LETTER.search(text.decode("utf-8", "replace")) else b"" for text in texts]
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        if model:
            lengths = model.lengths(scored)
            best = lengths.argmin(axis=1)
            gap = np.minimum(lengths - lengths.min(axis=1, keepdims=True), 1000)
            share = 1 / np.exp2(-gap).sum(axis=1)
            for at, text in enumerate(scored):
                if text:
                    names[at], scores[at] = model.languages[best[at]], share[at]
        columns = [batch.column(n) for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(names), pa.array(scores)],
            [*(n for n in batch.schema.names if n != "text"), "lang_pred", "score"],
        )


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def identify(
    docs: DataFrame,
    learnt_from: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    order: int = ORDER,
    rows: int = SAMPLE_ROWS,
    size: int = SAMPLE_BYTES,
    id_type: str = "long",
) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs``; the rows of ``learnt_from`` teach."""
    labelled = learnt_from.where(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    )
    counts = docs.sparkSession.sparkContext.broadcast(learn(labelled, order, rows, size))
    columns = docs.select(F.col(id_col).cast(id_type).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return columns.mapInArrow(lambda batches: _predict(batches, counts, order), f"doc_id {id_type}, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    teachers = docs.where(~F.coalesce(held_out(), F.lit(True)))
    found = identify(docs, teachers)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
