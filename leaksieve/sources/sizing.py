"""Spread small inputs over the cores; leave large ones as they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Repartition an input too small to occupy every core by itself.

    A file of one row group is one task, whatever its size.  Where the estimated
    input is less than one read split per core, dealing the rows out costs little
    and a scan gains all cores.  A larger input already has a task per split and
    is not shuffled.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes")
    )
    estimate = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if estimate < cores * split else df
