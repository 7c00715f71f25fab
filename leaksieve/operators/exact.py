"""The rule scan with Python's meaning of every character.

Java and Python class some characters differently: superscript digits, combining
marks, joiners, U+001C to U+001F, and what one of their Unicode versions does not
know yet.  Texts of plain ASCII without those separators mean the same to both and
are scanned in the JVM; only the others go to Python, in Arrow batches, each with
the rules whose literals it holds.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leaksieve.functions.text import content_hash, normalized_hash
from leaksieve.operators.scan import _KEYWORDS, _RULE, _RULES, _TEXT, FOUND, SNIPPET_LENGTH, _candidates, scan
from leaksieve.rules.gates import HASH_RUN, NUMBER, NUMBER_END
from leaksieve.rules.model import Rule, custom_domain_rule

# Every rule reads such a text alike in both engines.
_ALIKE = r"\A[\x00-\x1B\x20-\x7F]*+\z"

_ROWS_OUT = 10_000


def scan_exact(
    corpus: DataFrame,
    rules: Sequence[Rule],
    *,
    text: str = "text",
    file: str = "file",
    keep: Sequence[str] = (),
    domains: Iterable[str] = (),
    whole: bool = False,
) -> DataFrame:
    """``scan`` with findings as ``re`` has them: the same columns, and one row per rule, line and match.

    ``corpus`` is read twice, by each engine for its texts.  Null and empty texts
    have no findings.
    """
    domain_rule = custom_domain_rule(domains)
    rules = [*rules, domain_rule] if domain_rule else list(rules)
    alike = F.col(text).rlike(_ALIKE)
    by_jvm = scan(corpus.where(alike), rules, text=text, file=file, keep=keep, whole=whole)
    by_python = _scan_in_python(corpus.where(~alike), rules, text, file, keep)
    return by_jvm.unionByName(by_python.select(*by_jvm.columns))


def _scan_in_python(corpus: DataFrame, rules: Sequence[Rule], text: str, file: str, keep: Sequence[str]) -> DataFrame:
    ids = ["file", *keep]
    texts = corpus.select(F.col(file).cast("string").alias("file"), *keep, F.col(text).alias(_TEXT))
    # Regexes that spare work mean here what they mean to Python, so in the JVM only literals do.
    by_literals = [replace(rule, needs_regex=None, needs_number=None, needs_hash_run=False) for rule in rules]
    gated = _candidates(texts.where(F.length(_TEXT) > 0), by_literals, ids)
    # Not a filter: Spark would push that below the folding of case, to fold each text once for every rule.
    gated = gated.select(*ids, F.when(F.size(_RULES) > 0, F.col(_TEXT)).alias(_TEXT), _RULES)
    places = [(_RULE, T.IntegerType()), ("line", T.IntegerType()), ("match_offset", T.IntegerType()), ("match", T.StringType())]
    schema = T.StructType([gated.schema[name] for name in ids] + [T.StructField(name, kind) for name, kind in places])
    found = gated.mapInArrow(_matches(rules, ids), schema)
    names, severities = (F.array(*map(F.lit, values)) for values in ([r.name for r in rules], [r.severity for r in rules]))
    of_match = {
        "type": F.get(names, F.col(_RULE)),
        "severity": F.get(severities, F.col(_RULE)),
        "snippet": F.substring("match", 1, SNIPPET_LENGTH),
        "match_md5": content_hash(F.col("match")),
        "match_key": normalized_hash(F.col("match")),
    }
    return found.withColumns(of_match).select(*ids, *FOUND, "match")


def _matches(rules: Sequence[Rule], ids: Sequence[str]):
    """Of each text with its candidates: 0-based rule, line, place and match, the first of a kind on a line."""
    keyword_rules = [n for n, rule in enumerate(rules) if rule.keywords]
    all_keywords = len(rules) + _KEYWORDS

    def candidates(listed: list[int], text: str) -> Iterator[int]:
        for n in listed:
            if n == all_keywords:
                yield from (k for k in keyword_rules if any(f"{word}=" in text for word in rules[k].keywords))
            else:
                yield n - 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        regexes = [rule.compile() for rule in rules]
        number, hash_run = re.compile(NUMBER), re.compile(HASH_RUN)
        number_gates = {gate: re.compile(gate) for rule in rules if (gate := rule.needs_number)}

        def able(listed: list[int], text: str) -> Iterator[int]:
            """Those of the candidates whose shapes the text holds, each looked for once."""
            numbers, found = NUMBER_END.join(number.findall(text)), {}
            for n in candidates(listed, text):
                gate = rules[n].needs_number
                if gate and gate not in found:
                    found[gate] = number_gates[gate].search(numbers) is not None
                if rules[n].needs_hash_run and None not in found:
                    found[None] = hash_run.search(text) is not None
                if (not gate or found[gate]) and (not rules[n].needs_hash_run or found[None]):
                    yield n

        def rows(text: str, listed: list[int]) -> Iterator[tuple[int, int, int, str]]:
            ends = [at.start() for at in re.finditer("\n", text)]
            for n in able(listed, text):
                seen = set()
                for match in regexes[n].finditer(text):
                    found = bisect_left(ends, match.start()) + 1, match[0]
                    if found not in seen:
                        seen.add(found)
                        yield n, found[0], match.start(), found[1]

        def packed(batch: pa.RecordBatch, sources: list[int], out: list[tuple]) -> pa.RecordBatch:
            columns = [batch.column(name).take(pa.array(sources, pa.int32())) for name in ids]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string())
            columns += [pa.array(values, kind) for values, kind in zip(zip(*out), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=[*ids, _RULE, "line", "match_offset", "match"])

        for batch in batches:
            sources, out = [], []
            for source in range(batch.num_rows):
                text = batch.column(_TEXT)[source].as_py()
                for row in rows(text, batch.column(_RULES)[source].as_py()) if text is not None else ():
                    sources.append(source)
                    out.append(row)
                    if len(out) == _ROWS_OUT:
                        yield packed(batch, sources, out)
                        sources, out = [], []
            if out:
                yield packed(batch, sources, out)

    return run
