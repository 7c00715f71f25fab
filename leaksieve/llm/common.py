"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Hashable, Iterable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leaksieve.session import ensure_checkpoint_dir

#: White space of the contracts: what ``bytes.split()`` and ``bytes.strip()`` take as such.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(frame: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """The frame as a written table: lineage ends here, and a lost executor costs no recomputation."""
    spark = frame.sparkSession
    path = path or scratch(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def binary(column: pa.Array) -> list[bytes | None]:
    """The values of a string column as UTF-8 bytes, without decoding them."""
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def wide_hash(*columns: Column) -> list[Column]:
    """128 bits of hash, as two longs that hash aggregation keeps in fixed-width rows."""
    return [F.xxhash64(*columns).alias("h1"), F.xxhash64(F.lit(1), *columns).alias("h2")]


def rows_of(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def kept_by_worker(key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, made once by each Python worker and kept for its later tasks.

    Functions of this package arrive anew with every task, and their globals with them, hence a module of its own.
    """
    held = vars(sys.modules.setdefault("_leaksieve_worker", types.ModuleType("_leaksieve_worker"))).setdefault("held", {})
    if key not in held:
        held[key] = make()
    return held[key]
