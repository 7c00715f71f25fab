"""Findings at rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FINDING_SCHEMA = (
    "type string, file string, line int, snippet string, severity string, "
    "match_offset int, match_md5 string, match_key string, hash string"
)


#: A record that is no finding is kept as it stands here.
MALFORMED = "malformed"


def read_findings(
    spark: SparkSession, path: str, *, one_array: bool = False, indent: int | None = None, malformed: bool = False
) -> DataFrame:
    """Saved findings: JSON lines, or one JSON array a file with ``one_array``.

    An array is read whole by one task, or, if its records are written with ``indent`` blanks before their braces (as ``json.dump``
    does with that indent), a record at a time by as many tasks as its bytes ask for: a line end never
    stands inside a string, so a line of the indent and a brace ends a record wherever the file is split. Records that do not
    parse are left out, or kept in a column ``malformed`` of their own.
    """
    schema = f"{FINDING_SCHEMA}, {MALFORMED} string"
    if one_array and indent is None:
        reader = spark.read.option("multiLine", True).option("columnNameOfCorruptRecord", MALFORMED)
        if not malformed:
            return reader.schema(FINDING_SCHEMA).option("mode", "DROPMALFORMED").json(path)
        found = reader.schema(schema).json(path)
    else:
        records = _array_records(spark, path, indent) if one_array else spark.read.text(path).toDF("record")
        parsed = F.from_json("record", schema, {"columnNameOfCorruptRecord": MALFORMED})
        found = records.where("trim(record) <> ''").select(parsed.alias("f")).select("f.*")
    return found if malformed else found.where(F.col(MALFORMED).isNull()).drop(MALFORMED)


def _array_records(spark: SparkSession, path: str, indent: int) -> DataFrame:
    parts = spark.read.option("lineSep", "\n" + " " * indent + "}").text(path)
    body = F.regexp_replace("value", r"^[\s,]*\[?[\s,]*", "").alias("body")
    # What follows the last record is the end of the array.
    return parts.select(body).where(~F.col("body").rlike(r"^\s*\]?\s*$")).select(F.concat("body", F.lit("}")).alias("record"))


def write_findings(
    findings: DataFrame, path: str, *, format: str = "json", partition_by: Sequence[str] = ()
) -> None:
    """Save findings; text outside ASCII is written as it is."""
    writer = findings.write.format(format).mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_run(findings: DataFrame, path: str, run: str, *, format: str = "parquet") -> None:
    """Save the findings of a run in folders by run and severity; a run that is saved again replaces itself and no other.

    Folders of severities that the run no longer has are emptied first. A lost executor changes nothing: tasks commit by renaming.
    """
    spark = findings.sparkSession
    if not run or "/" in run:
        raise ValueError(f"no name for a run: {run!r}")
    kept = findings.withColumn("run", F.lit(run))
    now = {row.severity for row in kept.select("severity").distinct().collect()}
    before = _severities(spark, path, run)
    kept.write.format(format).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "severity").save(path)
    for folder in [folder for severity, folder in before.items() if severity not in now]:
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _severities(spark: SparkSession, path: str, run: str) -> dict:
    """The severity folders of a saved run, of which there are as many as severities."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path, f"run={run}")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return {}
    return {status.getPath().getName().removeprefix("severity="): status.getPath() for status in fs.listStatus(folder)}


def read_runs(spark: SparkSession, path: str, *, format: str = "parquet") -> DataFrame:
    """The findings of all saved runs with the name of their run; columns in the order of a finding."""
    schema = f"{FINDING_SCHEMA}, run string"
    found = spark.read.format(format).schema(schema).load(path)
    return found.select(*[field.split()[0] for field in schema.split(", ")])
