"""Directory trees and single files as a corpus ``(file, text, content_md5)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leaksieve.functions.text import content_hash, decode_utf8_lossy, unescape
from leaksieve.rules.model import quote
from leaksieve.sources import tree

# The suffixes that are scanned, and folder names that never are.
SUFFIXES = (
    ".py", ".js", ".ts", ".java", ".c", ".cpp", ".rb", ".php", ".cs",
    ".go", ".rs", ".json", ".yaml", ".yml", ".env", ".log", ".txt",
    ".html", ".xml", ".sql", ".md", ".conf", ".properties",
)
EXCLUDED_FOLDERS = (".git", "__pycache__", "venv", "node_modules", ".vscode")


def suffix_of(path: Column) -> Column:
    """Last suffix of the last path part; a dot that begins or ends the name is none."""
    return F.regexp_extract(F.substring_index(path, "/", -1), r"(?s)^.+(\.[^.]+)\z", 1)


def has_suffix(path: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """Case-sensitive."""
    return suffix_of(path).isin(*suffixes)


def in_excluded_folder(path: Column, excluded: Sequence[str] = EXCLUDED_FOLDERS) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, excluded)))


def within_size(length: Column, max_bytes: int | None) -> Column:
    """Nothing is too large unless ``max_bytes`` is given."""
    return F.lit(True) if max_bytes is None else length <= max_bytes


def relative_to(path: Column, base: str) -> Column:
    """Path below ``base``; the base itself is ``.``."""
    inside = F.regexp_replace(path, "^" + quote(base.rstrip("/")) + "/?", "")
    return F.when(inside == "", F.lit(".")).otherwise(inside)


def scan_files(
    spark: SparkSession,
    path: str,
    *,
    suffixes: Sequence[str] = SUFFIXES,
    excluded: Sequence[str] = EXCLUDED_FOLDERS,
    max_bytes: int | None = None,
    hidden: bool = True,
    decode_escapes: bool = False,
    opener: tree.Opener = tree.open_path,
) -> DataFrame:
    """Texts of a directory tree, or of one file (any suffix, named ``.``).

    The tree is listed and read in tasks, every name of it. ``unread_files`` gives what is missing here. ``hidden=False`` leaves the
    listing to Spark's reader, which passes over names that begin with ``_`` or ``.``; object stores that
    only Hadoop knows are read that way.
    """
    if hidden:
        listing = tree.list_tree(spark, path, suffixes=suffixes, excluded=excluded, opener=opener)
        return texts_of(tree.read_listed(listing, path, max_bytes=max_bytes, opener=opener), decode_escapes)
    return texts_of(_read_tree(spark, path, suffixes, excluded, max_bytes), decode_escapes)


def texts_of(files: DataFrame, decode_escapes: bool = False) -> DataFrame:
    """The corpus of ``(file, content)`` rows; files without content are no part of it."""
    text = decode_utf8_lossy(F.col("content"))
    corpus = files.where("content IS NOT NULL").select(
        "file",
        (unescape(text) if decode_escapes else text).alias("text"),
        content_hash(F.col("content")).alias("content_md5"),
    )
    return corpus.where(F.length("text") > 0)


def unread_files(
    spark: SparkSession,
    path: str,
    *,
    suffixes: Sequence[str] = SUFFIXES,
    excluded: Sequence[str] = EXCLUDED_FOLDERS,
    max_bytes: int | None = None,
    opener: tree.Opener = tree.open_path,
) -> DataFrame:
    """``(file, size, error)`` of what ``scan_files`` would have scanned but could not read, or was told not to."""
    listing = tree.list_tree(spark, path, suffixes=suffixes, excluded=excluded, opener=opener)
    return tree.unread_listed(listing, path, max_bytes=max_bytes, opener=opener)


def _read_tree(spark, path, suffixes, excluded, max_bytes) -> DataFrame:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    base = fs.makeQualified(hadoop_path).toString()
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    single = fs.getFileStatus(hadoop_path).isFile()
    if not single:
        reader = reader.option("pathGlobFilter", "*{" + ",".join(suffixes) + "}")
    files = reader.load(path).where(within_size(F.col("length"), max_bytes))
    below = relative_to(F.col("path"), base)
    kept = ~in_excluded_folder(F.col("path"), excluded)
    if not single:
        kept = kept & has_suffix(F.col("path"), suffixes)
    return files.where(kept).select(below.alias("file"), "content")
