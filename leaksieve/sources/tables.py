"""Any string column of any table, or a table of fetched pages, as a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def corpus_from(table: DataFrame, file: str | Column, text: str | Column, *keep: str) -> DataFrame:
    """``(file, text, *keep)``; only these columns are read."""
    file = F.col(file) if isinstance(file, str) else file
    text = F.col(text) if isinstance(text, str) else text
    return table.select(file.cast("string").alias("file"), text.alias("text"), *keep)


def pages_corpus(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Fetched pages under their URL; no suffix filter applies to them."""
    return corpus_from(pages, url, html)
