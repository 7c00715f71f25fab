"""Captured web responses: which to keep, and under what name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaksieve.functions.urls import file_name_of, netloc_of
from leaksieve.operators.skew import number_within
from leaksieve.session import ensure_checkpoint_dir


# Ending by part of the content type, first hit counts.
TYPE_ENDINGS = (
    ("javascript", ".js"),
    ("json", ".json"),
    ("html", ".html"),
    ("css", ".css"),
    ("xml", ".xml"),
)
OTHER_ENDING = ".txt"

# Dots at the beginning belong to the stem.
_STEM_AND_ENDING = r"(?s)^(\.*[^.].*?|\.+)(\.[^.]*)?\z"


def _judged(responses: DataFrame, max_bytes: int | None) -> DataFrame:
    """The responses with ``kind`` and, for those that are not kept, the ``reason``."""
    is_page = F.lower(F.coalesce("content_type", F.lit(""))).contains("text/html")
    fits = F.lit(True) if max_bytes is None else F.coalesce("content_length", F.lit(0)) <= max_bytes
    answered = F.coalesce(F.col("status") == 200, F.lit(False))
    reason = F.when(~answered, "status").when(~is_page & ~fits, "size")
    return responses.withColumn("kind", F.when(is_page, "page").otherwise("file")).withColumn("reason", reason)


def route_responses(responses: DataFrame, *, max_bytes: int | None = None) -> DataFrame:
    """Keeps status 200 and adds ``kind``: ``page`` (links are followed) or ``file``.

    Nothing is dropped for its size unless ``max_bytes`` is given: then files above it by their content
    length go; an unknown length passes, and pages are not checked. ``skipped_responses`` gives the others.
    """
    return _judged(responses, max_bytes).where("reason IS NULL").drop("reason")


def skipped_responses(responses: DataFrame, *, max_bytes: int | None = None) -> DataFrame:
    """What ``route_responses`` leaves out, with its ``kind`` and the ``reason``: ``status`` (not 200, or none) or ``size``."""
    return _judged(responses, max_bytes).where("reason IS NOT NULL")


def ending_for(content_type: Column) -> Column:
    ending = F.lit(OTHER_ENDING)
    for part, value in reversed(TYPE_ENDINGS):
        ending = F.when(F.lower(content_type).contains(part), F.lit(value)).otherwise(ending)
    return ending


def name_files(routed: DataFrame) -> DataFrame:
    """``(url, kind, host, file_name)``, with no file name twice on a host.

    The name is the last path part; without a dot in it, ``file_`` and the
    response's number on its host.  Pages end in ``.html``.  Further responses
    with a name get ``_1``, ``_2``...; where another response has that name as its own,
    ``#1``, ``#2``..., which no path holds.  All numbers go by the md5 of the URL, which
    has to identify a response.  Bodies are not carried along.
    """
    ensure_checkpoint_dir(routed.sparkSession)
    hosted = routed.select("url", "kind", "content_type", netloc_of(F.col("url")).alias("host"))
    numbered = number_within(hosted, ["host"], F.col("url"), "_number")
    last = file_name_of(F.col("url"))
    made_up = F.format_string("file_%04d", F.col("_number"))
    name = F.when(last.contains("."), last).otherwise(
        F.concat(made_up, ending_for(F.coalesce("content_type", F.lit(""))))
    )
    as_page = F.when((F.col("kind") == "page") & ~name.endswith(".html"), F.concat(name, F.lit(".html")))
    # Numbering reads its input twice; the first numbers are kept for the second.
    named = numbered.select("url", "kind", "host", F.coalesce(as_page, name).alias("_name")).checkpoint()
    repeated = number_within(named, ["host", "_name"], F.col("url"), "_repeat")
    stem = F.regexp_extract("_name", _STEM_AND_ENDING, 1)
    ending = F.regexp_extract("_name", _STEM_AND_ENDING, 2)
    again = F.col("_repeat").cast("string")
    own = named.select("host", F.col("_name").alias("_like")).distinct().withColumn("_taken", F.lit(True))
    unlike = repeated.withColumn("_like", F.when(F.col("_repeat") == 0, F.col("_name")).otherwise(F.concat(stem, F.lit("_"), again, ending)))
    free = F.concat(stem, F.lit("#"), again, ending)
    file_name = F.when((F.col("_repeat") > 0) & F.col("_taken"), free).otherwise(F.col("_like"))
    return unlike.join(own, ["host", "_like"], "left").select("url", "kind", "host", file_name.alias("file_name"))
