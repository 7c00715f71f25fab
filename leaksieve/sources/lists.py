"""Lists of domains, URLs or search terms: one a line, or separated by commas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaksieve.functions.text import strip


def entries(values: DataFrame, column: str) -> DataFrame:
    """Stripped values without the blank ones."""
    stripped = values.select(strip(F.col(column)).alias("entry"))
    return stripped.where(F.length("entry") > 0)


def read_list(spark: SparkSession, path: str) -> DataFrame:
    return entries(spark.read.text(path), "value")


def split_list(values: DataFrame, column: str, separator: str = ",") -> DataFrame:
    parts = F.split(F.col(column), separator, -1)
    return entries(values.select(F.explode(parts).alias("entry")), "entry")


def domains_in(spark: SparkSession, source: str, *, most: int = 10_000) -> list[str]:
    """Domains of a comma-separated string, or of a list file if one has that name.

    A list of domains is part of the job's settings and is held on the driver; one of
    more than ``most`` is refused.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    is_file = "," not in source and path.getFileSystem(spark._jsc.hadoopConfiguration()).isFile(path)
    if is_file:
        found = [row.entry for row in read_list(spark, source).take(most + 1)]
    else:
        found = [d.strip() for d in source.split(",") if d.strip()]
    if len(found) > most:
        raise ValueError(f"more than {most} domains in {source[:100]!r}")
    return found

