"""Run a rule set over whole texts: one row per finding.

The whole scan is one narrow stage.  A text is cut into units, each a line and the blank
ones that follow it; the literals and numbers of each tell the rules that can hit there.
Such a rule's regex runs over the few units that a match can reach, inside the text's row,
that of a rule without bounds over the whole text, and only the small findings leave the
row, so nothing is shuffled and no text is repeated.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaksieve.functions.text import fold_case, normalized_sql, strip
from leaksieve.rules.gates import HASH_RUN_JVM, NUMBER, NUMBER_END
from leaksieve.rules.model import Rule, custom_domain_rule, literal, quote
from leaksieve.rules.spans import UNIT_END, crossings, sought, tokens_regex, unit_number

SNIPPET_LENGTH = 100
SEARCH_TYPE = "User Search"
SEARCH_SEVERITY = "info"

# Noncharacters that frame matches; a text holding one is framed by a tag made
# from its own hash instead.
_OPEN, _CLOSE = chr(0xFDD0), chr(0xFDD1)

_WORD_BEFORE_EQUALS = r"(?<![A-Za-z0-9_])([A-Za-z0-9_]++)="
_KEYWORD_MATCH = r"(?dU)\b[A-Za-z0-9_]++=\S+\b"

_TEXT, _FOLDED, _NUMBERS, _RULE, _RULES = "_text", "_folded", "_numbers", "_rule", "_rules"

_UNITS, _STARTS, _LINES, _WINDOWS, _DENSE_TEXT = "_units", "_starts", "_lines", "_windows", "_dense"
# In a text that more rules can hit, they are looked for line by line.
_DENSE = 20
# The numbers of a line, none of which goes on in the next one.
_UNIT_NUMBER = r"\d[\d\-.()/,+]*+"
# A place where a rule can hit is the rule's number in the upper bits and its unit's in the lower.
_UNIT_BITS = 32

# A finding inside its row is one string, because distinct and sort are fast on strings:
# fields of fixed width, then the snippet.
_WIDTHS = {_RULE: 5, "line": 10, "match_md5": 32, "match_offset": 10, "match_key": 32}
_SAME = _WIDTHS[_RULE] + _WIDTHS["line"] + _WIDTHS["match_md5"]

#: What a finding says, beside where it was found.
FOUND = ("type", "line", "snippet", "severity", "match_offset", "match_md5", "match_key")

# Places behind the last rule: the mark of a scanned text, all keyword rules at once.
_MARK, _KEYWORDS = 1, 2


def scan(
    corpus: DataFrame,
    rules: Sequence[Rule],
    *,
    text: str = "text",
    file: str = "file",
    keep: Sequence[str] = (),
    domains: Iterable[str] = (),
    mark_scanned: bool = False,
    whole: bool = False,
) -> DataFrame:
    """Findings of every rule in every text: ``file`` and the columns of ``FOUND``.

    A finding is one text that a rule matches on one line: ``match_md5`` is the md5
    of the whole match, ``match_offset`` the 0-based character where it first
    starts, ``match_key`` the normalised hash of the whole match.  ``snippet`` is cut
    for display.

    ``file`` has to identify a row of ``corpus``; where it does not, pass the
    result through ``distinct_findings``.  ``keep`` names further corpus columns
    to carry.  ``domains`` adds the custom-domain rule.  ``mark_scanned`` adds one
    row of nulls per text, so that texts without findings are told from unseen ones.
    ``whole`` adds the uncut match as ``match``.
    """
    domain_rule = custom_domain_rule(domains)
    rules = [*rules, domain_rule] if domain_rule else list(rules)
    if not rules:
        raise ValueError("no rules to scan with")
    _check_literals(corpus)
    _check_user_rules(corpus, rules)
    ids = [F.col(file).cast("string").alias("file"), *keep]
    texts = corpus.select(*ids, F.col(text).alias(_TEXT)).where(F.length(_TEXT) > 0)
    by_unit = _reaches(rules)
    framed = _framed(_candidates(texts, rules, ["file", *keep], mark_scanned, _windows(rules, by_unit)))

    # A branch per rule, so that every regex is a literal and compiled once a task.
    plain = [(n, rule) for n, rule in enumerate(rules, 1) if not rule.keywords]
    none = "CAST(array() AS ARRAY<STRING>)"
    ways = [f"WHEN rule = {len(rules) + _MARK} THEN array(CAST(NULL AS STRING))"]
    if len(plain) < len(rules):
        ways.append(f"WHEN rule = {len(rules) + _KEYWORDS} THEN {_once(_keyword_findings(rules, whole))}")
    parts = [f"transform({_RULES}, rule -> CASE {' '.join(ways)} ELSE {none} END)"]
    if plain:
        regexes = _chosen("w.rule", [(n, _marked(rule.searched, "part")) for n, rule in plain])
        places = (f"coalesce(get({column}, w.first), 0)" for column in (_LINES, _STARTS))
        part = f"""CASE WHEN w.last < 0 THEN {_TEXT} WHEN w.first = w.last THEN get({_UNITS}, w.first)
            ELSE array_join(slice({_UNITS}, w.first + 1, w.last - w.first + 1), '\\n') END"""
        parts.append(f"""transform({_WINDOWS}, w -> element_at(transform(array({part}), part -> element_at(
            transform(array({regexes}), marked -> {_once(_located("marked", "w.rule", whole, *places))}), 1)), 1))""")
    found = f"explode(flatten({f'concat({chr(44).join(parts)})' if len(parts) > 1 else parts[0]})) AS _finding"

    def of_rule(values: Sequence[str]) -> Column:
        # The place is null in the mark of a scanned text.
        return F.expr(f"element_at(array({', '.join(map(literal, values))}, NULL), {_RULE})")

    rows = framed.selectExpr("file", *keep, found).select("file", *keep, *_unpacked("_finding", whole))
    return rows.select(
        "file",
        *keep,
        of_rule([r.name for r in rules]).alias("type"),
        "line",
        "snippet",
        of_rule([r.severity for r in rules]).alias("severity"),
        "match_offset",
        "match_md5",
        "match_key",
        *(["match"] if whole else []),
    )


def _reaches(rules: Sequence[Rule]) -> dict[int, int]:
    """How many units a match can go beyond the one that tells its rule, by the 1-based places of the rules of which that is known."""
    told = {n: rule for n, rule in enumerate(rules, 1) if not rule.keywords and (sought(rule) or unit_number(rule) or rule.needs_hash_run)}
    crossed = {n: crossings(rule) for n, rule in told.items()}
    # A hash is one word, but nothing tells it from a word of the same length.
    return {n: most for n, most in crossed.items() if most is not None}


def _windows(rules: Sequence[Rule], by_unit: dict[int, int]) -> list[tuple[str, str]]:
    """SQL columns for the units of a text, their places, and the runs of units that each rule is tried on.

    Looking for what tells the rules on every line pays off where many can hit: in other texts each candidate is tried on
    the whole, a run without a last unit, and so is always a rule of which no reach is known.  A match holds what tells its rule, so it lies in the run round that; no match begins in
    front of a run or between runs, so in its run each is found as in the whole text.
    """
    unit_end = literal(UNIT_END)
    sizes = f"transform({_UNITS}, unit -> length(unit) + 1)"
    breaks = f"transform({_UNITS}, unit -> 1 + octet_length(unit) - octet_length(replace(unit, '\\n', '')))"

    def before(numbers: str) -> str:
        return f"concat(array(0), {_running_sums(numbers, f'size({_UNITS})')})"

    by_token: dict[str, list[int]] = {}
    by_number, by_hash, gates, weak = [], [], [], []
    for n in by_unit:
        if texts := sought(rules[n - 1]):
            for text in texts:
                by_token.setdefault(text, []).append(n)
        elif gate := unit_number(rules[n - 1]):
            test = f"rlike(held, {literal('(?U)' + gate)})"
            if re.fullmatch(gate, "1"):
                # Nearly every number passes, so the rule itself says whether it is worth a run.
                test += f" AND rlike(get({_UNITS}, n), {literal(rules[n - 1].searched)})"
                weak.append(f"CASE WHEN {test} THEN {n << _UNIT_BITS}L END")
            else:
                gates.append(gate)
                by_number.append(f"CASE WHEN {test} THEN {n << _UNIT_BITS}L END")
        else:
            by_hash.append(f"{n << _UNIT_BITS}L")
    hits = []
    if by_token:
        # The longest of the literals at a place stands for those that it begins with.
        told = {text: sorted({n << _UNIT_BITS for short, listed in by_token.items() if text.startswith(short) for n in listed}) for text in by_token}
        words = f"filter(split(held, '[|]', -1), word -> word <> '')"
        rules_of = f"array_distinct(flatten(transform({words}, word -> {_rules_of(told, 'word', 'BIGINT')})))"
        hits.append(f"""flatten(transform({_by_unit(_FOLDED, tokens_regex(by_token), 1)}, (held, n) ->
            CASE WHEN held IN ('', '|') THEN CAST(array() AS ARRAY<BIGINT>) ELSE transform({rules_of}, place -> place + n) END))""")
    none = "CAST(array() AS ARRAY<BIGINT>)"
    if by_number or weak:
        # One search for all tells a line that none of them can hit, as most lines are.
        tests = [f"array_compact(array({', '.join(weak)}))"] if weak else []
        if by_number:
            any_gate = literal("(?U)" + "|".join(f"(?:{gate})" for gate in dict.fromkeys(gates)))
            tests.append(f"CASE WHEN rlike(held, {any_gate}) THEN array_compact(array({', '.join(by_number)})) ELSE {none} END")
        listed = f"concat({', '.join(tests)})" if len(tests) > 1 else tests[0]
        hits.append(f"""flatten(transform({_by_unit(_TEXT, f'(?U){_UNIT_NUMBER}|{UNIT_END}', 0)}, (held, n) ->
            CASE WHEN held IN ('', '|') THEN {none} ELSE transform({listed}, place -> place + n) END))""")
    if by_hash:
        holds_one = f"octet_length(unit) >= 32 AND rlike(unit, {literal(HASH_RUN_JVM)})"
        hits.append(f"""CASE WHEN rlike({_TEXT}, {literal(HASH_RUN_JVM)}) THEN flatten(transform({_UNITS}, (unit, n) ->
            CASE WHEN {holds_one} THEN transform(array({', '.join(by_hash)}), place -> place + n) ELSE CAST(array() AS ARRAY<BIGINT>) END))
            ELSE CAST(array() AS ARRAY<BIGINT>) END""")
    reach = f"get(array({', '.join(str(by_unit.get(n, 0)) for n in range(len(rules) + 1))}), CAST(shiftright(place, {_UNIT_BITS}) AS INT))"
    firsts = f"filter(places, (place, i) -> i = 0 OR place - get(places, i - 1) > 2 * {reach})"
    lasts = f"filter(places, (place, i) -> i = size(places) - 1 OR get(places, i + 1) - place > 2 * {reach})"
    unit_of = f"CAST({{}} & {(1 << _UNIT_BITS) - 1}L AS INT)"
    run = f"""named_struct('rule', CAST(shiftright(first, {_UNIT_BITS}) AS INT),
        'first', greatest({unit_of.format('first')} - {reach.replace('place', 'first')}, 0),
        'last', least({unit_of.format('last')} + {reach.replace('place', 'last')}, size({_UNITS}) - 1))"""
    plain = [n for n, rule in enumerate(rules, 1) if not rule.keywords]
    kind = "ARRAY<STRUCT<rule: INT, first: INT, last: INT>>"
    some = ", ".join(str(n in by_unit).upper() for n in range(len(rules) + 1))
    alone = f"{_DENSE_TEXT} AND get(array({some}), rule)"
    tried = f"filter({_RULES}, rule -> rule <= {len(rules)} AND NOT ({alone}))" if plain else "CAST(array() AS ARRAY<INT>)"
    on_whole = f"CAST(transform({tried}, rule -> named_struct('rule', rule, 'first', 0, 'last', -1)) AS {kind})"
    if not hits:
        return [(_DENSE_TEXT, "false"), (_UNITS, "CAST(NULL AS ARRAY<STRING>)"), (_WINDOWS, on_whole), *((name, "CAST(NULL AS ARRAY<INT>)") for name in (_STARTS, _LINES))]
    hits = f"concat({', '.join(hits)})" if len(hits) > 1 else hits[0]
    windows = f"""element_at(transform(array(sort_array(array_distinct({hits}))), places ->
        zip_with({firsts}, {lasts}, (first, last) -> {run})), 1)"""
    dense = f"size({_RULES}) > {_DENSE}"
    return [
        (_DENSE_TEXT, dense),
        (_UNITS, f"CASE WHEN {_DENSE_TEXT} THEN split({_TEXT}, {unit_end}, -1) END"),
        (_WINDOWS, f"concat({on_whole}, CASE WHEN {_DENSE_TEXT} THEN CAST({windows} AS {kind}) ELSE CAST(array() AS {kind}) END)"),
        (_STARTS, f"CASE WHEN {_DENSE_TEXT} THEN {before(sizes)} END"),
        (_LINES, f"CASE WHEN {_DENSE_TEXT} THEN {before(breaks)} END"),
    ]


def _by_unit(text: str, regex: str, group: int) -> str:
    """SQL for what ``regex`` finds in each unit of ``text``, with ``|`` between; it has to find the ends of units too."""
    return f"split(array_join(regexp_extract_all({text}, {literal(regex)}, {group}), '|'), '\\n', -1)"


def _check_literals(corpus: DataFrame) -> None:
    """Rules are written as SQL literals, whose escapes a session can turn off."""
    if corpus.sparkSession.conf.get("spark.sql.parser.escapedStringLiterals") == "true":
        raise ValueError("the scan needs spark.sql.parser.escapedStringLiterals=false")


def _check_user_rules(corpus: DataFrame, rules: Sequence[Rule]) -> None:
    """Let the JVM read users' patterns before a job starts; the driver folds each into a constant."""
    for rule in rules:
        if rule.family != "user":
            continue
        try:
            corpus.sparkSession.sql(f"SELECT rlike('', {literal(rule.java)})").collect()
        except PySparkException as refused:
            raise ValueError(f"the JVM refuses the pattern of rule {rule.name!r}") from refused


def _packed(rule: str, line: str, match: str, offset: str, whole: bool) -> str:
    """SQL for one finding as one string, fields as wide as ``_WIDTHS`` says."""
    shown = match if whole else f"substring({match}, 1, {SNIPPET_LENGTH})"
    return f"""concat(
        lpad({rule}, 5, '0'), lpad({line}, 10, '0'), md5(CAST({match} AS BINARY)), lpad({offset}, 10, '0'),
        md5(CAST({normalized_sql(match)} AS BINARY)), {shown}
    )"""


def _unpacked(finding: str, whole: bool = False) -> list[Column]:
    fields, at = [], 1
    for name, width in _WIDTHS.items():
        field = F.substring(finding, at, width)
        fields.append((field if width == 32 else field.cast("int")).alias(name))
        at += width
    rest = F.expr(f"substring({finding}, {at})")
    return [*fields, F.substring(rest, 1, SNIPPET_LENGTH).alias("snippet"), *([rest.alias("match")] if whole else [])]


def _chosen(number: str, branches: Sequence[tuple[int, str]]) -> str:
    """SQL for the branch of a number, found by halves: Spark takes long to walk down a long CASE."""
    if len(branches) < 4:
        return f"CASE {number} {' '.join(f'WHEN {n} THEN {value}' for n, value in branches)} END"
    middle = len(branches) // 2
    return f"IF({number} < {branches[middle][0]}, {_chosen(number, branches[:middle])}, {_chosen(number, branches[middle:])})"


def _once(findings: str) -> str:
    """SQL for one finding per rule, line and match, the first, of an array of packed ones."""
    return f"""element_at(transform(array(sort_array({findings})), sorted -> filter(
        sorted, (f, i) -> i = 0 OR substring(f, 1, {_SAME}) <> substring(get(sorted, i - 1), 1, {_SAME})
    )), 1)"""


def _running_sums(numbers: str, count: str) -> str:
    """SQL for the inclusive running sums of an array of ``count`` numbers, in as many passes as that has bits."""
    return f"""aggregate(
        sequence(0, CAST(ceil(log2(greatest({count}, 1))) AS INT)),
        {numbers},
        (sums, k) -> transform(sums, (x, i) -> x + coalesce(get(sums, i - shiftleft(1, k)), 0))
    )"""


def search(
    corpus: DataFrame, term: str, *, text: str = "text", file: str = "file", keep: Sequence[str] = ()
) -> DataFrame:
    """Every occurrence of one literal, exact and case-sensitive, repeats included.

    Takes the place of a rule scan.  The snippet is stripped but not cut, and
    ``hash`` is the md5 of the unstripped match.
    """
    if not term:
        raise ValueError("empty search term")
    _check_literals(corpus)
    ids = [F.col(file).cast("string").alias("file"), *keep]
    texts = corpus.select(*ids, F.col(text).alias(_TEXT)).where(F.col(_TEXT).contains(term))
    marked = f"transform(array({_marked('(?d)' + quote(term))}), marked -> {_located('marked', '0')})"
    # Not a bare column: Spark would infer a filter on it and push the search below
    # any exchange of the corpus, there to run a second time.
    found = _framed(texts.select("file", *keep, _TEXT)).selectExpr(
        "file", *keep, f"explode(flatten({marked})) AS _finding"
    )
    rows = found.select("file", *keep, *_unpacked("_finding"))
    return rows.select(
        "file",
        *keep,
        F.lit(SEARCH_TYPE).alias("type"),
        "line",
        strip(F.lit(term)).alias("snippet"),
        F.lit(SEARCH_SEVERITY).alias("severity"),
        "match_offset",
        "match_md5",
        "match_key",
        F.col("match_md5").alias("hash"),
    )


def distinct_findings(findings: DataFrame) -> DataFrame:
    """One row per (type, file, line, whole match), for corpora with several rows a file."""
    return findings.dropDuplicates(["type", "file", "line", "match_md5"])


def union_findings(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Findings of several scans under one schema; fields one kind lacks are null."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def _candidates(
    texts: DataFrame,
    rules: Sequence[Rule],
    ids: Sequence[str],
    mark_scanned: bool = False,
    beside: Sequence[tuple[str, str]] = (),
) -> DataFrame:
    """The texts with the 1-based positions of the rules that can hit in them.

    ``beside`` names columns to add, as SQL over the text, its folded form and those positions, each of which may use those before it.

    The expressions are written as SQL: hundreds of them parse at once, where
    hundreds of Column calls take seconds to put together.
    """
    plain = [(n, r) for n, r in enumerate(rules, 1) if not r.keywords]
    used = Counter(test for _, rule in plain for test in _tests(rule))
    # Tests that several rules use are columns of their own, computed once a text.
    shared = {test: f"_test{n}" for n, (test, times) in enumerate(used.items()) if times > 1}
    # The numbers of a text are few, so tests on them cost next to nothing.
    numbers = f"array_join(regexp_extract_all({_TEXT}, {literal('(?U)' + NUMBER)}, 0), '{NUMBER_END}') AS {_NUMBERS}"
    folded = texts.select("*", fold_case(F.col(_TEXT)).alias(_FOLDED)).selectExpr("*", numbers)
    prepared = folded.selectExpr("*", *(f"{test} AS {name}" for test, name in shared.items()))

    def candidate(n: int, rule: Rule) -> str:
        # Those already computed come first, then those on the numbers, which are few.
        tests = sorted(_tests(rule), key=lambda test: (test not in shared, f"rlike({_NUMBERS}," not in test))
        gates = [shared.get(test, test) for test in tests]
        return f"CASE WHEN {' AND '.join(gates)} THEN {n} END" if gates else str(n)

    lists = [f"array({len(rules) + _MARK})"] if mark_scanned else []
    if plain:
        lists.append(f"array_compact(array({', '.join(candidate(n, rule) for n, rule in plain)}))")
    if any(rule.keywords for rule in rules):
        known = ", ".join(literal(keyword) for rule in rules for keyword in rule.keywords)
        holds_one = f"arrays_overlap({_words_before_equals(_TEXT)}, array({known}))"
        gated = f"CASE WHEN contains({_TEXT}, '=') THEN {holds_one} ELSE false END"
        lists.append(f"array_compact(array(CASE WHEN {gated} THEN {len(rules) + _KEYWORDS} END))")
    found = f"concat({', '.join(lists)})" if len(lists) > 1 else lists[0] if lists else "CAST(array() AS ARRAY<INT>)"
    prepared = prepared.select("*", F.expr(found).alias(_RULES))
    for name, value in beside:
        prepared = prepared.selectExpr("*", f"{value} AS {name}")
    return prepared.select(*ids, _TEXT, _RULES, *(name for name, _ in beside))


def _tests(rule: Rule) -> list[str]:
    """SQL conditions every match of the rule implies, cheapest first."""
    tests = []
    for literals in rule.needs:
        # A mark has no case, so every rule can share its test.
        mark = all(len(text) == 1 for text in literals)
        sought, texts = (_TEXT, literals)
        if rule.ignore_case and not mark:
            sought, texts = (_FOLDED, [text.upper() for text in literals])
        tests.append("(" + " OR ".join(f"contains({sought}, {literal(text)})" for text in texts) + ")")
    if rule.needs_number:
        tests.append(f"rlike({_NUMBERS}, {literal('(?U)' + rule.needs_number)})")
    regexes = [HASH_RUN_JVM] if rule.needs_hash_run else []
    regexes += [rule.needs_regex] if rule.needs_regex else []
    return [*tests, *(f"rlike({_TEXT}, {literal(regex)})" for regex in regexes)]


def _words_before_equals(text: str) -> str:
    return f"regexp_extract_all({text}, {literal(_WORD_BEFORE_EQUALS)}, 1)"


def _keyword_findings(rules: Sequence[Rule], whole: bool) -> str:
    """SQL for the packed findings of all ``keyword=value`` rules of one text.

    Such a match never leaves a run of non-blank characters, and a run holds at
    most one per rule, because its value takes the rest of the run.  So the runs
    with a ``=`` are listed with their place, their words before ``=`` looked up,
    and only the rules found that way tried on them: one pass over the text,
    however many rules there are and however many of them hit.  A match ends with
    the last word of its run, so it is the last of its kind there.
    """
    by_keyword: dict[str, list[int]] = {}
    for n, rule in enumerate(rules, 1):
        for keyword in rule.keywords:
            by_keyword.setdefault(keyword, []).append(n)
    patterns = ", ".join(literal(rule.searched) if rule.keywords else "NULL" for rule in rules)
    lengths = "transform({}, piece -> length(piece) + 1)"
    line_ends = _running_sums(lengths.format("texts"), "size(texts)")
    run_ends = _running_sums(lengths.format("runs"), "size(runs)")
    # Lines with a "=", their number and the place they begin at; then their runs, likewise.
    lines = f"""flatten(transform(array(split({_TEXT}, '\\n', -1)), texts -> filter(
        transform(
            zip_with(texts, {line_ends}, (line, end) ->
                named_struct('line', line, 'start', end - length(line) - 1)),
            (x, n) -> named_struct('n', n + 1, 'line', x.line, 'start', x.start)
        ),
        x -> contains(x.line, '=')
    )))"""
    runs = f"""flatten(transform(array(split(x.line, '(?U)\\\\s', -1)), runs -> filter(
        zip_with(runs, {run_ends}, (run, end) ->
            named_struct('n', x.n, 'run', run, 'start', x.start + end - length(run) - 1)),
        r -> contains(r.run, '=')
    )))"""
    start = "run.start + length(run.run) - instr(reverse(run.run), reverse(match)) - length(match) + 1"
    # Of a run with one word before "=" every rule of that word finds the same, by one regex.
    by_rule = f"regexp_extract(run.run, element_at(array({patterns}), rule), 0)"
    match = f"CASE WHEN size(words) = 1 THEN regexp_extract(run.run, {literal(_KEYWORD_MATCH)}, 0) ELSE {by_rule} END"
    rules_of = f"array_distinct(flatten(transform(words, word -> {_rules_of(by_keyword, 'word')})))"
    return f"""
        flatten(transform(
            flatten(transform({lines}, x -> {runs})),
            run -> flatten(transform(array({_words_before_equals('run.run')}), words -> flatten(transform(
                {rules_of},
                rule -> transform(
                    filter(array({match}), m -> m <> ''),
                    match -> {_packed('rule', 'run.n', 'match', start, whole)}
                )
            ))))
        ))
    """


def _rules_of(by_keyword: dict[str, list[int]], word: str, kind: str = "INT") -> str:
    """SQL for the rules of a word, looked up by its hash; none for words that are no keyword."""
    size = len(by_keyword)
    places: list[list[str]] = [[] for _ in range(size)]
    for keyword, numbers in by_keyword.items():
        listed = ", ".join(f"CAST({number} AS {kind})" for number in numbers)
        places[zlib.crc32(keyword.encode()) % size].append(f"named_struct('keyword', {literal(keyword)}, 'rules', array({listed}))")
    empty = f"CAST(array() AS ARRAY<STRUCT<keyword: STRING, rules: ARRAY<{kind}>>>)"
    table = ", ".join(f"array({', '.join(place)})" if place else empty for place in places)
    at = f"CAST(crc32(CAST({word} AS BINARY)) % {size} AS INT) + 1"
    return f"flatten(transform(filter(element_at(array({table}), {at}), k -> k.keyword = {word}), k -> k.rules))"


def _framed(texts: DataFrame) -> DataFrame:
    """Adds the markers ``_open`` and ``_close`` that frame matches in a text."""
    text = F.col(_TEXT)
    holds_marker = text.contains(_OPEN) | text.contains(_CLOSE)
    own_tag = F.concat(F.lit(_OPEN), F.md5(text.cast("binary")))
    return texts.select(
        "*",
        F.when(holds_marker, F.concat(own_tag, F.lit("<"))).otherwise(F.lit(_OPEN)).alias("_open"),
        F.when(holds_marker, F.concat(own_tag, F.lit(">"))).otherwise(F.lit(_CLOSE)).alias("_close"),
    )


def _marked(regex: str, text: str = _TEXT) -> str:
    """SQL for the text with every match of ``regex`` between two markers."""
    return f"regexp_replace({text}, {literal(regex)}, concat(_open, '$0', _close))"


def _located(marked: str, rule: str, whole: bool = False, line: str = "0", start: str = "0") -> str:
    """SQL for the packed matches of a marked text, or of a marked part of one that begins at ``line`` and ``start``.

    Cutting at the opening markers gives the matches and, summed up, their places and
    the line ends before them.  Every step is linear in the text, however many matches it
    has, but for the running sums.
    """
    of_piece = {
        "length": "length(piece) - CASE WHEN i = 0 THEN 0 ELSE length(_close) END",
        "lines": "octet_length(piece) - octet_length(replace(piece, '\\n', ''))",
    }
    # Every match starts where the piece before it ends.
    starts, lines = (
        f"slice({_running_sums(f'transform(pieces, (piece, i) -> {number})', 'size(pieces)')}, 1, size(pieces) - 1)"
        for number in of_piece.values()
    )
    places = f"zip_with({lines}, {starts}, (n, start) -> named_struct('n', n + 1 + {line}, 'start', start + {start}))"
    packed = f"transform(array(substring(piece, 1, instr(piece, _close) - 1)), match -> {_packed(rule, 'place.n', 'match', 'place.start', whole)})"
    zipped = f"zip_with(slice(pieces, 2, size(pieces)), {places}, (piece, place) -> {packed})"
    return f"""CASE WHEN contains({marked}, _open) THEN flatten(transform(array(split({marked}, _open, -1)), pieces ->
        flatten({zipped}))) ELSE CAST(array() AS ARRAY<STRING>) END"""
