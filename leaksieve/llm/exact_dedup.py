"""Exact dedup against a minimal perfect hash over the distinct digests of a history.

Every row is a document; a null text counts as empty. Of equal texts the row with the largest id stays.
Null ids lose against any id, and rows that repeat the winning id as well as its text are all kept.
An empty history or an empty rest are allowed: all rows then meet in the grouping of nonmembers,
or in the slots. Equality is that of SHA-256 digests, compared byte by byte; texts never move.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leaksieve.llm.common import saved, table

DIGEST = 32


def _mix(words: np.ndarray, seed: int) -> np.ndarray:
    """64 hash bits of digests given as four words each, other ones for every seed."""
    with np.errstate(over="ignore"):
        x = words[:, seed % 4] ^ np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of n digests: levels of bits, a slot being the rank of its bit.

    On each level a digest that meets no other at its place sets a bit; those that meet go on to the next.
    """

    def __init__(self, words: np.ndarray, gamma: float = 2.0):
        self.levels: list[np.ndarray] = []
        left = words
        while len(left):
            size = max(64, int(len(left) * gamma))
            place = (_mix(left, len(self.levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            self.levels.append(alone)
            left = left[~alone[place]]
        before = np.cumsum([0, *(level.sum() for level in self.levels)])
        self.ranks = [np.cumsum(level) - 1 + start for level, start in zip(self.levels, before, strict=False)]

    def slots(self, words: np.ndarray) -> np.ndarray:
        """The slot of each digest; -1 where no level has a bit. A digest never seen may get any slot."""
        out = np.full(len(words), -1, np.int64)
        open_rows = np.arange(len(words))
        for seed, (level, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            place = (_mix(words[open_rows], seed) % np.uint64(len(level))).astype(np.int64)
            set_ = level[place]
            out[open_rows[set_]] = rank[place[set_]]
            open_rows = open_rows[~set_]
        return out


def _words(digests: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(digests.to_pylist()), np.uint64).reshape(-1, DIGEST // 8)


def _column(arrow: pa.Table, name: str) -> np.ndarray:
    return arrow[name].to_numpy()


def _match(history: pa.Table, new: pa.Table) -> pa.Table:
    """One bucket: slots for the history's digests, then a byte-checked look-up of the new ones.

    A row per distinct digest of either side, with the larger winner and the copies of both.
    """
    old_words, new_words = (_words(side["digest"].combine_chunks()) for side in (history, new))
    index = PerfectHash(old_words)
    slot = index.slots(old_words)
    n = len(old_words)
    digests, winner, copies = np.empty_like(old_words), np.empty(n, object), np.empty(n, np.int64)
    digests[slot], winner[slot], copies[slot] = old_words, history["keep_id"].to_pylist(), _column(history, "n")

    at = index.slots(new_words)
    member = at >= 0
    member[member] = (digests[at[member]] == new_words[member]).all(axis=1)
    keep, count = np.array(new["keep_id"].to_pylist() + [None], object)[:-1], _column(new, "n").copy()
    hit = at[member]
    count[member] += copies[hit]
    mine, theirs = keep[member], winner[hit]
    keep[member] = [b if a is None else a if b is None else max(a, b) for a, b in zip(mine, theirs, strict=True)]
    rest = np.ones(n, bool)
    rest[hit] = False
    all_digests = np.concatenate([new_words, digests[rest]])
    return pa.table(
        {
            "digest": pa.array([row.tobytes() for row in all_digests], pa.binary()),
            "keep_id": pa.array([*keep, *winner[rest]], pa.int64()),
            "n": pa.array(np.concatenate([count, copies[rest]]), pa.int64()),
            "member": pa.array(np.concatenate([member, np.zeros(int(rest.sum()), bool)])),
        }
    )


def exact_dedup(
    docs: DataFrame,
    history: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    keys_per_bucket: int = 500_000,
) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256, historical.

    ``history`` says which rows are the past. Both sides are folded by digest before the shuffle, then dealt
    out by the hash of the digest to as many buckets as hold ``keys_per_bucket`` digests each.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")
    past = F.coalesce(history, F.lit(False)).alias("past")
    rows = saved(docs.select(F.col(id_col).cast("long").alias("doc_id"), digest, past), "digests")

    def folded(side: DataFrame) -> DataFrame:
        return side.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))

    buckets = max(1, -(-rows.count() // keys_per_bucket))
    bucket = F.pmod(F.xxhash64("digest"), F.lit(buckets)).alias("bucket")
    past_side, new_side = (folded(rows.where(side)).select("*", bucket) for side in (F.col("past"), ~F.col("past")))
    groups = (
        past_side.groupBy("bucket")
        .cogroup(new_side.groupBy("bucket"))
        .applyInArrow(_match, "digest binary, keep_id long, n long, member boolean")
    )
    # A digest that many rows share makes one large side only, which adaptive execution splits.
    return rows.join(saved(groups, "digest-groups"), "digest").select(
        "doc_id",
        "keep_id",
        F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("past").alias("historical"),
    )


def half(id_col: str = "doc_id") -> Column:
    """The history of the query: one half of the documents, by the hash of their ids."""
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(2)) == 0


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return exact_dedup(docs, half()).drop("historical")


ORACLE = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
