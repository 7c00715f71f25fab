"""DuckDB SQL for the same results, from the same rule list."""

from __future__ import annotations

from collections.abc import Sequence

from checks.samples import quoted
from leaksieve.rules.model import Rule

_MARK = "chr(57344)"
DOCUMENTS = "SELECT CAST(doc_id AS VARCHAR) AS file, text FROM documents"
PAGES = "SELECT url AS file, html AS text FROM pages"


def pattern(rule: Rule) -> str:
    flags = ("i" if rule.ignore_case else "") + ("m" if rule.multiline else "")
    return quoted((f"(?{flags})" if flags else "") + rule.pattern)


def _cut(regex: str) -> str:
    framed = f"regexp_replace(text, {regex}, {_MARK} || '\\0' || {_MARK}, 'g')"
    return f"string_split({framed}, {_MARK})"


def _rows(segments: str, columns: str) -> str:
    """One row per match; ``before`` is the text in front of it."""
    return f"""
        SELECT {columns}, seg[k] AS match, array_to_string(seg[1:k-1], '') AS before
        FROM (SELECT {columns}, seg, unnest(range(2, len(seg) + 1, 2)) AS k FROM ({segments}))
    """


def normalized(column: str) -> str:
    ends_off = f"regexp_replace(lower({column}), '^\\s+|\\s+$', '', 'g')"
    single = f"regexp_replace({ends_off}, '\\s+', ' ', 'g')"
    return f"regexp_replace({single}, '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')"


_OFFSET = "CAST(length(before) AS INTEGER)"
_HASHES = f"md5(match) AS match_md5, md5({normalized('match')}) AS match_key"
_LINE = "CAST(1 + length(before) - length(replace(before, chr(10), '')) AS INTEGER)"


def scan(corpus: str, rules: Sequence[Rule], whole: bool = False) -> str:
    """Findings of ``rules`` in the ``(file, text)`` rows of ``corpus``, with the uncut ``match`` if asked for."""
    per_rule = " UNION ALL ".join(
        f"SELECT file, {quoted(r.name)} AS type, {quoted(r.severity)} AS severity, {_cut(pattern(r))} AS seg "
        f"FROM corpus WHERE regexp_matches(text, {pattern(r)})"
        for r in rules
    )
    return f"""
        SELECT file, type, line, substr(match, 1, 100) AS snippet, severity,
               min(match_offset) AS match_offset, {_HASHES}{", match" if whole else ""}
        FROM (SELECT *, {_LINE} AS line, {_OFFSET} AS match_offset FROM (
            WITH corpus AS MATERIALIZED ({corpus}) {_rows(per_rule, "file, type, severity")}
        )) GROUP BY file, type, line, match, severity
    """


def search(corpus: str, term: str, stripped: str) -> str:
    regex = quoted(term)
    cut = f"SELECT file, {_cut(regex)} AS seg FROM ({corpus}) WHERE contains(text, {regex})"
    return f"""
        SELECT file, 'User Search' AS type, {_LINE} AS line, {quoted(stripped)} AS snippet,
               'info' AS severity, md5(match) AS hash, {_OFFSET} AS match_offset, {_HASHES}
        FROM ({_rows(cut, "file")})
    """


def clean(findings: str) -> str:
    return f"""
        SELECT * EXCLUDE (place) FROM (
            SELECT *, row_number() OVER (
                PARTITION BY type, match_key ORDER BY length(file), file, line, snippet, match_md5
            ) AS place FROM ({findings})
        ) WHERE place = 1
    """


RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 99 END"
