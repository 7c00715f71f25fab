"""From raw documents to packed token sequences, in five stages.

Each stage reads what its predecessor kept, written as Parquet, and all but the last
return the columns of ``documents``. Decisions are about rows: of two rows with one id and different texts
each stands for itself, and rows without an id are judged like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leaksieve.llm import decontamination, exact_dedup, language_id, packing, simhash_dedup
from leaksieve.llm.common import saved, table


#: A document's best language has to be at least so likely.
MIN_SCORE = 0.5


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with a key of id and text, so that a decision is about one text whatever its id and its copies."""
    text = F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit("null"))
    return docs.withColumn("_key", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The keyed documents whose keys are not in ``gone.doc_id``, without their keys."""
    return docs.join(gone.select(F.col("doc_id").alias("_key")), "_key", "left_anti").drop("_key")


def _one_of_each(docs: DataFrame, found: DataFrame, group: str, first: Column) -> DataFrame:
    """The keyed documents that are the greatest of their group by ``first``; equal ones go by key. ``found`` has (doc_id, group, id).

    Rows that repeat id and text have one key; where there are any, one of them is kept.
    """
    best = saved(found.groupBy(group).agg(F.max(F.struct(first, "doc_id")).getField("doc_id").alias("doc_id")), "best")
    gone = found.select("doc_id").distinct().join(best, "doc_id", "left_anti")
    repeats = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(best, "doc_id", "left_semi")
    repeats = saved(repeats.select("doc_id"), "repeats")
    if repeats.isEmpty():
        return _without(docs, gone)
    once = docs.join(repeats.select(F.col("doc_id").alias("_key")), "_key", "left_semi").dropDuplicates(["_key"])
    return _without(docs, gone.union(repeats)).unionByName(once.drop("_key"))


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language: null texts, those without a letter, and those whose best language is less likely
    than all others together."""
    rows = _keyed(docs)
    teachers = rows.where(~F.coalesce(language_id.held_out(), F.lit(True)))
    found = language_id.identify(rows, teachers, id_col="_key", id_type="string")
    return _without(rows, found.where((F.col("lang_pred") == "und") | (F.col("score") < MIN_SCORE)).distinct())


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts the document with the largest id, one without an id if none has any. Null equals empty."""
    rows = _keyed(docs.withColumn("text", F.coalesce("text", F.lit(""))))
    found = exact_dedup.exact_dedup(docs, exact_dedup.half()).where("group_size > 1")
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_sha256").alias("doc_id")
    found = saved(found.select(key, "text_sha256", F.col("doc_id").alias("id")), "copies")
    return _one_of_each(rows, found, "text_sha256", F.col("id")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each near-duplicate group the document with the smallest id, one without an id if none has any."""
    rows = _keyed(docs)
    found = simhash_dedup.simhash_components(rows, id_col="_key", id_type="string")
    number = F.expr("CAST(nullif(substring_index(doc_id, ':', 1), '') AS LONG)").alias("id")
    found = saved(found.select("doc_id", "component_id", number), "components")
    return _one_of_each(rows, found, "component_id", (-F.col("id")).alias("id"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, whole or nearly so."""
    rows = _keyed(docs)
    found = decontamination.contaminated(rows, table(spark, sf_dir, "benchmark"), id_col="_key")
    return _without(rows, found.select("doc_id").distinct())


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids."""
    return packing.pack(docs)


STAGES = [
    ("language_id", keep_known_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: SQL has no context trees, SimHash components or tokenizer; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
