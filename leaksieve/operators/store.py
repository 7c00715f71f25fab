"""Scanned contents kept between runs in bucketed tables, so that a rescan moves new hashes only.

A run is one table of the session's catalogue with the rows of ``scan_contents``, in
buckets by ``content_md5`` and sorted by it within each.  The rows that a batch adds are a run of
level 0; ``fan`` runs of one level are merged into one of the next, so a store of
n batches has some ``fan`` * log(n) runs and a row is rewritten log(n) times.  As all
runs lie in the same buckets, Spark reads them together, joins them and merges
them bucket by bucket without a shuffle.

A run counts once its table properties are set, in one step, and these name the runs
it stands for; what a lost driver leaves behind is therefore not read, and is removed by the next
batch.  A store has one writer at a time.  The number of buckets is fixed with the
first run.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Sequence
from typing import NamedTuple
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaksieve.operators.incremental import incremental_scan
from leaksieve.operators.scan import FOUND
from leaksieve.operators.skew import FILTER_BYTES, ROWS_PER_TASK
from leaksieve.rules.model import Rule
from leaksieve.session import ensure_checkpoint_dir

FAN = 8

_TYPES = {"line": "int", "match_offset": "int"}
SCHEMA = ", ".join(f"{c} {_TYPES.get(c, 'string')}" for c in ("content_md5", "ruleset", *FOUND))


class Run(NamedTuple):
    table: str
    level: int
    batch: str
    buckets: int
    stands_for: tuple[str, ...]


def runs(spark: SparkSession, store: str) -> list[Run]:
    """The runs that count, without those that another one stands for."""
    published = [run for run in map(functools.partial(_published, spark), _tables(spark, store)) if run]
    replaced = {old for run in published for old in run.stands_for}
    return [run for run in published if run.table not in replaced]


def stored(spark: SparkSession, store: str, without: str | None = None) -> DataFrame:
    """The rows of all runs; ``without`` leaves out what a batch added, where that is still a run of its own."""
    read = [run for run in runs(spark, store) if without is None or run.level > 0 or run.batch != without]
    return _rows(spark, read)


def scan_batch(
    corpus: DataFrame,
    rules: Sequence[Rule],
    store: str,
    batch: str,
    *,
    file: str = "file",
    text: str = "text",
    domains: Sequence[str] = (),
    options: str = "",
    buckets: int | None = None,
    fan: int = FAN,
    rows_per_task: int = ROWS_PER_TASK,
    filter_bytes: int = FILTER_BYTES,
) -> DataFrame:
    """Findings of a corpus, of which only contents that the store does not have are scanned and then kept.

    A batch that is run again under its name replaces what it added before, so a job
    that failed half-way is simply repeated.  The findings are checkpointed, as
    merging drops the tables that they are read from.  ``buckets`` counts for an empty store only, and
    is ``spark.sql.shuffle.partitions`` where not given.
    """
    spark = corpus.sparkSession
    _checked(store, batch)
    ensure_checkpoint_dir(spark)
    _drop_replaced(spark, store)
    live = runs(spark, store)
    laid_out = live[0].buckets if live else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = stored(spark, store, without=batch)
    found, fresh = incremental_scan(
        corpus,
        rules,
        known,
        file=file,
        text=text,
        domains=domains,
        options=options,
        rows_per_task=rows_per_task,
        buckets=laid_out,
        filter_bytes=filter_bytes,
    )
    found = found.checkpoint()
    before = [run.table for run in live if run.level == 0 and run.batch == batch]
    _write(fresh.repartition(laid_out, "content_md5"), store, Run("", 0, batch, laid_out, tuple(before)))
    compact(spark, store, fan)
    return found


def compact(spark: SparkSession, store: str, fan: int = FAN) -> None:
    """Merge levels that have ``fan`` runs, each bucket by the task that reads it, and drop what no longer counts."""
    if fan < 2:
        raise ValueError("fan has to be 2 or more")
    _drop_replaced(spark, store)
    level = 0
    while at_level := [run for run in runs(spark, store) if run.level >= level]:
        full = [run for run in at_level if run.level == level]
        if len(full) >= fan:
            merged = Run("", level + 1, "", full[0].buckets, tuple(run.table for run in full))
            # Rows of one run are distinct already; asking for it makes Spark keep to the buckets it reads.
            _write(_rows(spark, full).distinct(), store, merged)
            _drop_replaced(spark, store)
        level += 1


def drop(spark: SparkSession, store: str) -> None:
    for table in _tables(spark, store):
        spark.sql(f"DROP TABLE {table}")


def _drop_replaced(spark: SparkSession, store: str) -> None:
    """Done after each write, so that no run that counts ever stands for one that stood for others."""
    kept = {run.table for run in runs(spark, store)}
    for table in _tables(spark, store):
        if table not in kept:
            spark.sql(f"DROP TABLE {table}")


def _rows(spark: SparkSession, read: Sequence[Run]) -> DataFrame:
    if not read:
        return spark.createDataFrame([], SCHEMA)
    # Spark 4.1 puts tables read in batches of columns one after another, though it plans with their
    # buckets put together, and so would group and join wrongly.  Rows that pass a filter it puts together.
    tables = [spark.table(run.table).where(F.col("content_md5").isNotNull()) for run in read]
    return functools.reduce(DataFrame.unionByName, tables)


def _write(rows: DataFrame, store: str, run: Run) -> None:
    table = f"{store}__run_{uuid4().hex}"
    laid_out = rows.write.bucketBy(run.buckets, "content_md5").sortBy("content_md5")
    laid_out.format("parquet").saveAsTable(table)
    names = {"level": run.level, "batch": run.batch, "buckets": run.buckets, "stands_for": ",".join(run.stands_for)}
    properties = ", ".join(f"'run.{name}' = '{value}'" for name, value in names.items())
    rows.sparkSession.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ({properties})")


def _tables(spark: SparkSession, store: str) -> list[str]:
    _checked(store)
    listed = spark.sql(f"SHOW TABLES LIKE '{store}__run_*'").select("tableName").collect()
    return sorted(row.tableName for row in listed)


def _published(spark: SparkSession, table: str) -> Run | None:
    found = {row.key: row.value for row in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    if "run.level" not in found:
        return None
    older = tuple(name for name in found["run.stands_for"].split(",") if name)
    return Run(table, int(found["run.level"]), found["run.batch"], int(found["run.buckets"]), older)


def _checked(*names: str) -> None:
    for name in names:
        if not re.fullmatch(r"[a-z][a-z0-9_]*", name):
            raise ValueError(f"not a name of small letters, digits and underscores: {name!r}")
