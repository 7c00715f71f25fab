"""Near-duplicates by SimHash, matched in a space of segment popcounts.

A fingerprint's 32 segments of two bits become their popcounts (0, 1, 2). The Manhattan distance of two such
vectors never exceeds the Hamming distance of the fingerprints, so pairs beyond the radius there are none within it here.
The grid: coordinates lie in six groups, and vectors within distance 3 agree wholly in three
groups at least. One join key per choice of three groups finds every pair; the Manhattan
bound and then the exact distance are part of the join condition, so only links leave the join.

Copies are folded first: the join sees each fingerprint once, and copies never become pairs. Texts that are
null or have no word get fingerprint 0 and link like any other. Null ids are never a component's
id unless all its ids are null. Keys are 20 a fingerprint whatever the input; the candidates of
random fingerprints grow with the square of their number at about 3 in 10^6 pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leaksieve.llm.common import binary, saved, table
from leaksieve.llm.graph import components

SEED = 42
RADIUS = 3
_CHUNK = 1 << 16


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    spans = zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - size + 1)


def simhash(text: bytes | None, size: int = 3) -> int:
    """Bit b is 1 if it is set in over half the hashes; 0 for a text without words."""
    hashes = shingle_hashes(text or b"", size)
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), _CHUNK):
        part = hashes[start : start + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([simhash(text, size) for text in binary(batch.column(1))], np.uint64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"]
        )


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, id_type: str = "long"
) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""
    columns = docs.select(F.col(id_col).cast(id_type).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return columns.mapInArrow(lambda batches: _fingerprints(batches, size), f"doc_id {id_type}, fp long")


_EVEN = 0x5555555555555555


def popcounts(fp: Column) -> Column:
    """The 32 segment popcounts in unary (00, 01, 11), so that a XOR counts the Manhattan distance."""
    high = F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(high).bitwiseAND(F.lit(_EVEN))
    full = fp.bitwiseAND(high).bitwiseAND(F.lit(_EVEN))
    return some.bitwiseOR(F.shiftleft(full, 1))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def grid(groups: int, radius: int) -> list[tuple[int, list[int]]]:
    """Masks of every choice of ``groups - radius`` groups, each with those of earlier groups left out.

    A pair is reported for the first choice that fits it: there, every group left out before the
    choice's last one differs.
    """
    bounds = [round(32 * k / groups) for k in range(groups + 1)]
    masks = [((1 << 2 * (b - a)) - 1) << 2 * a for a, b in zip(bounds, bounds[1:], strict=False)]
    cells = []
    for chosen in combinations(range(groups), groups - radius):
        before = [_signed(masks[k]) for k in range(chosen[-1]) if k not in chosen]
        cells.append((_signed(sum(masks[k] for k in chosen)), before))
    return cells


def near_links(prints: DataFrame, radius: int = RADIUS, groups: int = 6) -> DataFrame:
    """(u, v) with u < v: all pairs of distinct fingerprints ``fp`` within the radius, each once."""
    cells = F.array(
        *[
            F.struct(
                F.lit(number).alias("cell"),
                F.lit(mask).cast("long").alias("mask"),
                F.array(*[F.lit(m).cast("long") for m in before]).cast("array<long>").alias("before"),
            )
            for number, (mask, before) in enumerate(grid(groups, radius))
        ]
    )
    placed = prints.select("fp", popcounts(F.col("fp")).alias("pop")).select("fp", "pop", F.explode_outer(cells).alias("c"))
    keyed = placed.select("fp", "pop", "c.cell", F.col("pop").bitwiseAND(F.col("c.mask")).alias("key"), "c.before")
    left, right = keyed.alias("l"), keyed.drop("before").alias("r")
    apart = F.col("l.pop").bitwiseXOR(F.col("r.pop"))
    near = (
        (F.col("l.cell") == F.col("r.cell"))
        & (F.col("l.key") == F.col("r.key"))
        & (F.col("l.fp") < F.col("r.fp"))
        & (F.bit_count(apart) <= radius)
        & (F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= radius)
        & F.forall(F.col("l.before"), lambda mask: apart.bitwiseAND(mask) != 0)
    )
    return left.join(right, near).select(F.col("l.fp").alias("u"), F.col("r.fp").alias("v"))


def simhash_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 3,
    radius: int = RADIUS,
    id_type: str = "long",
) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest id that links lead to."""
    rows = saved(fingerprints(docs, id_col, text_col, size, id_type), "fingerprints")
    classes = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(near_links(classes.select("fp"), radius))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = rooted.select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = saved(rooted.join(named, "root").select("fp", "component_id"), "labels")
    return rows.join(labels, "fp").select("doc_id", "fp", "component_id")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    text = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return found.select("doc_id", text, "component_id")
