"""String functions shared by the operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: From this length on ``SequenceMatcher`` passes over characters that are frequent.
POPULAR_FROM = 200

UNICODE_BLANK_ENDS = r"(?U)^\s+|\s+$"


def strip(text: Column) -> Column:
    """Drop white space of every kind at both ends (``trim`` drops spaces only)."""
    return F.regexp_replace(text, UNICODE_BLANK_ENDS, "")


def fold_case(text: Column) -> Column:
    """Upper case for literal tests that ignore case; never misses an equal letter.

    Upper case also reaches the few letters outside ASCII that equal a plain one
    when case is ignored, but for two that are upper case already.
    """
    ascii_only = F.octet_length(text) == F.length(text)
    plain = text
    for letter, equal in ((chr(0x130), "i"), (chr(0x212A), "k")):
        plain = F.replace(plain, F.lit(letter), F.lit(equal))
    return F.upper(F.when(ascii_only, text).otherwise(plain))


def normalized(text: Column) -> Column:
    """Lower case, no blanks at the ends, single spaces, no punctuation.

    Two spaces can come back where punctuation stood between them; that is kept.
    """
    single_spaced = F.regexp_replace(strip(F.lower(text)), r"(?U)\s+", " ")
    return F.regexp_replace(single_spaced, r"(?U)[^\w\s]", "")


def normalized_sql(text: str) -> str:
    """``normalized`` as SQL text, for use inside other SQL."""
    stripped = f"regexp_replace(lower({text}), '(?U)^\\\\s+|\\\\s+$', '')"
    return f"regexp_replace(regexp_replace({stripped}, '(?U)\\\\s+', ' '), '(?U)[^\\\\w\\\\s]', '')"


def normalized_hash(text: Column) -> Column:
    return F.md5(normalized(text).cast("binary"))


def content_hash(content: Column) -> Column:
    """md5 of the bytes, for binary and (as UTF-8) string columns alike."""
    return F.md5(content.cast("binary"))


def decode_utf8_lossy(content: Column) -> Column:
    """Bytes as UTF-8 text without the bytes that do not decode.

    Valid bytes are cast in the JVM; Python sees only the others.
    """
    as_text = content.cast("string")
    broken = F.when(~F.is_valid_utf8(as_text), content)
    return F.when(broken.isNull(), as_text).otherwise(_decode_ignoring_errors()(broken))


def _decode_ignoring_errors():
    @F.pandas_udf("string")
    def decode(content: pd.Series) -> pd.Series:
        return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", errors="ignore"))

    return decode.asNondeterministic()  # so that no filter runs it twice


def unescape(text: Column) -> Column:
    r"""Resolve ``\uXXXX``, ``\xNN``, ``\n`` and the other Python string escapes.

    UTF-8 bytes around escapes are read as Latin-1 and line ends become LF.  Text
    that does not decode keeps its escapes; text that would decode to lone
    surrogates stays as it is.  ASCII text without a backslash or CR cannot
    change and is not sent to Python.
    """
    unchanged = text.rlike(r"^\p{ASCII}*+$") & ~text.contains("\\") & ~text.contains("\r")
    return F.when(unchanged, text).otherwise(_unescape_udf()(F.when(~unchanged, text)))


def _unescape_udf():
    @F.pandas_udf("string")
    def resolve(text: pd.Series) -> pd.Series:
        import warnings

        def one(value):
            if value is None:
                return None
            lines = value.replace("\r\n", "\n").replace("\r", "\n")
            try:
                decoded = lines.encode("utf-8").decode("unicode-escape")
            except UnicodeDecodeError:
                return lines
            try:
                decoded.encode("utf-8")
            except UnicodeEncodeError:
                return value
            return decoded

        with warnings.catch_warnings():
            warnings.simplefilter("ignore", DeprecationWarning)
            return text.map(one)

    return resolve.asNondeterministic()  # so that no filter runs it twice


def length_ratio(current: Column, first: Column) -> Column:
    """An upper bound of ``bag_ratio``: what the lengths leave possible."""
    both = F.greatest(F.length(current) + F.length(first), F.lit(1))
    return F.when(current == first, F.lit(1.0)).otherwise(2 * F.least(F.length(current), F.length(first)) / both)


def bag_ratio(current: Column, first: Column) -> Column:
    """An upper bound of ``similarity``, without Python: what the characters have in common, wherever they stand.

    Matching blocks are made of common characters, each used once, so they hold no more of them than both strings do.
    """

    def held(text: Column, letter: Column) -> Column:
        return F.octet_length(text) - F.octet_length(F.replace(text, letter, F.lit("")))

    def add(common: Column, letter: Column) -> Column:
        return common + F.least(held(current, letter), held(first, letter)) / F.greatest(F.octet_length(letter), F.lit(1))

    both = F.greatest(F.length(current) + F.length(first), F.lit(1))
    quick = length_ratio(current, first)
    # Letter by letter, each counted by one search in bytes: linear in the text for every letter it has.
    common = 2 * F.aggregate(F.array_distinct(F.split(current, "")), F.lit(0.0), add) / both
    return F.when(current == first, F.lit(1.0)).otherwise(F.least(quick, common))


def similarity(current: Column, first: Column) -> Column:
    """Matching-block ratio of two strings; equal strings are 1.0 without Python."""
    differs = current != first
    ratio = _ratio_udf()(F.when(differs, current), F.when(differs, first))
    return F.when(current == first, F.lit(1.0)).otherwise(ratio)


def matching_ratio(current: str, first: str) -> float:
    """``SequenceMatcher(None, current, first).ratio()``.

    The longest block both hold, the earliest of equal ones, then the same in front of it and
    behind it.  Of texts short enough that no character counts as popular it is found by
    searches for substrings, which take a small part of the time.
    """
    from difflib import SequenceMatcher

    if max(len(current), len(first)) >= POPULAR_FROM:
        return SequenceMatcher(None, current, first).ratio()
    common, parts = 0, [(current, first)]
    while parts:
        a, b = parts.pop()
        at = size = 0
        for i in range(len(a) if b else 0):
            step = 1 if i + size < len(a) else 0
            while step:
                if i + size + step <= len(a) and a[i : i + size + step] in b:
                    at, size, step = i, size + step, 2 * step
                else:
                    step //= 2
        if size:
            place = b.index(a[at : at + size])
            common += size
            parts += [(a[:at], b[:place]), (a[at + size :], b[place + size :])]
    both = len(current) + len(first)
    return 2.0 * common / both if both else 1.0


def _ratio_udf():
    @F.pandas_udf("double")
    def ratio(current: pd.Series, first: pd.Series) -> pd.Series:
        known = {}  # A text that is everywhere is compared once a batch.

        def of(a, b):
            if (a, b) not in known:
                known[a, b] = None if a is None or b is None else matching_ratio(a, b)
            return known[a, b]

        return pd.Series([of(a, b) for a, b in zip(current, first, strict=True)], dtype="float64")

    return ratio.asNondeterministic()  # so that no filter runs it twice
