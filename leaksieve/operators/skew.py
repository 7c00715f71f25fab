"""Joins and numbering that stay spread out when one key holds much of the data."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

ROWS_PER_TASK = 1_000_000

# A filter of ids is a number of bitmaps of 4 KB, as many as give each id 12 bits; an id sets four bits of one of them.
_BITS, _BITS_PER_ID, _PROBES = 32768, 12, 4

#: The largest filter that is sent to every task: 256 MB, which 1.7 * 10^8 ids fill.
FILTER_BYTES = 256 * 1024 * 1024


def join_hot(
    many: DataFrame, few: DataFrame, key: str, sizes: DataFrame, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Inner join of ``many`` rows a key with ``few`` rows a key.

    ``sizes (key, n)`` tells how many rows of ``many`` each key has.  A key above
    ``rows_per_task`` is dealt out over several tasks and its ``few`` rows are
    repeated for each.  Only those keys are broadcast: N input rows hold at most
    N / rows_per_task of them, however they are distributed.
    """
    shares = F.ceil(F.col("n") / F.lit(rows_per_task)).cast("int").alias("_shares")
    hot = F.broadcast(sizes.where(F.col("n") > rows_per_task).select(key, shares))
    split = F.coalesce("_shares", F.lit(1))
    dealt = many.join(hot, key, "left").withColumn(
        "_share", F.pmod(F.xxhash64(*(c for c in many.columns if c != key)), split).cast("int")
    )
    repeated = few.join(hot, key, "left").withColumn(
        "_share", F.explode(F.sequence(F.lit(0), split - F.lit(1)))
    )
    return dealt.drop("_shares").join(repeated.drop("_shares"), [key, "_share"]).drop("_share")


def number_within(rows: DataFrame, groups: Sequence[str], order: Column, name: str) -> DataFrame:
    """0-based position of each row in its group, by md5 of ``order``.

    A group is cut into 4,096 slices by the head of the hash.  Rows are numbered
    inside their slice and shifted by the size of the slices before it, so no
    task ever holds a whole group.
    """
    keyed = rows.withColumn("_hash", F.md5(order.cast("binary"))).withColumn(
        "_slice", F.substring("_hash", 1, 3)
    )
    before = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy(*groups, "_slice")
        .count()
        .select(*groups, "_slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*groups, "_slice").orderBy("_hash", order)
    return (
        keyed.withColumn("_place", F.row_number().over(inside))
        .join(offsets, [*groups, "_slice"])
        .withColumn(name, F.col("_offset") + F.col("_place") - F.lit(1))
        .drop("_hash", "_slice", "_place", "_offset")
    )


def filter_bitmaps(ids: int, most_bytes: int = FILTER_BYTES) -> int:
    """How many bitmaps a filter of so many ids has: it grows with them up to ``most_bytes``."""
    return max(1, min(math.ceil(ids * _BITS_PER_ID / _BITS), most_bytes * 8 // _BITS))


def filter_error(ids: int, bitmaps: int) -> float:
    """The share of other rows that a filter lets through, as expected."""
    return (1 - math.exp(-_PROBES * ids / (bitmaps * _BITS))) ** _PROBES


def maybe_in(rows: DataFrame, wanted: DataFrame, id: str, most_bytes: int = FILTER_BYTES) -> DataFrame:
    """The rows whose 64-bit ``id`` is in ``wanted``, and perhaps others; no row is shuffled.

    For rows too wide to move: work on what is left where it lies, and take the
    others out of the small results by an exact join.  ``wanted`` is read twice, once
    to count it.  Below ``most_bytes`` under 1 % of the other rows are let through; a
    filter of that size takes more ids than it has room for, and then lets more through.
    """
    bitmaps = filter_bitmaps(wanted.count(), most_bytes)
    bitmap = F.pmod(id, F.lit(bitmaps)).cast("int").alias("_bitmap")
    probes = F.xxhash64(id, F.lit(1)).alias("_probes")

    def bit(n: int) -> Column:
        return F.shiftrightunsigned("_probes", 15 * n).bitwiseAND(F.lit(_BITS - 1))

    # Dealt out by bitmap first, so that each is built by one task and no half-built one is moved.
    placed = wanted.select(bitmap, probes).repartition("_bitmap")
    bits = placed.select("_bitmap", F.explode(F.array(*map(bit, range(_PROBES)))).alias("_bit"))
    built = bits.groupBy("_bitmap").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    joined = rows.select("*", bitmap, probes).join(F.broadcast(built), "_bitmap")

    def is_set(n: int) -> Column:
        byte = F.conv(F.hex(F.substring("_bits", F.floor(bit(n) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, (bit(n) % 8).cast("int")) == 1

    return joined.where(functools.reduce(Column.__and__, map(is_set, range(_PROBES)))).select(*rows.columns)
