"""How many line ends a match of a rule can hold, and what a line tells of the rules that match there.

A rule whose matches cross few line ends is tried on the lines round what it needs, not on whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from leaksieve.rules.model import Rule, quote

#: What a repeated class may hold beside white space.  Lines of nothing else belong to the line in front of them, so a
#: run of such characters never crosses more than one end of a unit.
_BESIDE_BLANKS = ":="
#: Where a text is cut into units, each a line and the blank ones that follow it.
UNIT_END = rf"\n(?!(?U:[\s{_BESIDE_BLANKS}&&[^\n]])*+(?:\n|\z))"

#: First letters that are looked at together.
_GROUPED = 6

_QUANTIFIER = re.compile(r"([?*+]|\{\d+(?:,\d*)?\})([?+]?)")
_GROUP = re.compile(r"\((\?:|\?<?[=!]|(?!\?))")
_IN_CLASS = re.compile(r"\\([sSwd])|\\([^A-Za-z0-9])|((?!&&)[^\]\[\\\x00-\x1f])")


class _Unknown(Exception):
    pass


def crossings(rule: Rule) -> int | None:
    """The most ends of units that a match can hold; None if that is not known to be bounded.

    Nothing else of the pattern may tell a line end from the end of the text, so that it means the same in a part of it.
    """
    if rule.family == "user" or rule.flags:
        return None
    pattern = re.sub(r"\A\(\?[a-zU]+\)", "", rule.searched)
    try:
        most, at = _choices(pattern, 0)
        return most if at == len(pattern) else None
    except (_Unknown, IndexError):
        return None


def _choices(pattern: str, at: int) -> tuple[int, int]:
    most = here = 0
    while at < len(pattern) and pattern[at] != ")":
        if pattern[at] == "|":
            most, here, at = max(most, here), 0, at + 1
            continue
        crossed, only_blanks, at = _atom(pattern, at)
        quantifier = _QUANTIFIER.match(pattern, at)
        if quantifier:
            at = quantifier.end()
            if crossed and (quantifier[2] or not (only_blanks or quantifier[1] == "?")):
                raise _Unknown
        here += crossed
    return max(most, here), at


def _atom(pattern: str, at: int) -> tuple[int, bool, int]:
    """What one atom crosses, whether it is of blanks only, and where it ends."""
    c = pattern[at]
    if c == "\\":
        if pattern[at + 1] == "s":
            return 1, True, at + 2
        if pattern[at + 1].isalnum() and pattern[at + 1] not in "Swdb":
            raise _Unknown
        return 0, False, at + 2
    if c == "[":
        return _char_class(pattern, at)
    if c == "(":
        group = _GROUP.match(pattern, at)
        if not group:
            raise _Unknown
        crossed, at = _choices(pattern, group.end())
        if crossed and group[1] not in ("", "?:"):
            raise _Unknown
        if pattern[at] != ")":
            raise _Unknown
        return crossed, False, at + 1
    if c in "^$\n" or c in "*+?{":
        raise _Unknown
    return 0, False, at + 1


def _char_class(pattern: str, at: int) -> tuple[int, bool, int]:
    negated = pattern[at + 1] == "^"
    at += 2 if negated else 1
    blank, others = False, ""
    while pattern[at] != "]":
        item = _IN_CLASS.match(pattern, at)
        if not item:
            raise _Unknown
        blank |= item[1] == "s"
        others += "" if item[1] == "s" else item[0]
        at = item.end()
    if negated:
        if not blank:
            raise _Unknown
        return 0, False, at + 1
    return int(blank), not set(others) - set(_BESIDE_BLANKS), at + 1


def sought(rule: Rule) -> tuple[str, ...]:
    """The upper case of the literals of which every match holds one, those that say most; none if there are none to go by."""
    groups = [g for g in rule.needs if all(len(text) > 1 or text in "@№" for text in g) and not any(set(text) & {"\n", "|"} for text in g)]
    best = max(groups, key=lambda g: min(map(len, g)), default=())
    return tuple(text.upper() for text in best)


def unit_number(rule: Rule) -> str | None:
    """A regex found in the numbers of one line of every match, if the rule's numbers say so much."""
    gate = rule.needs_number or ""
    if r"\s" in gate:
        gate = gate.split(r"\s*")[0]
        try:
            re.compile(gate)
        except re.error:
            return None
    return gate if gate and r"\s" not in gate else None


def tokens_regex(literals: Iterable[str]) -> str:
    """A regex of the JVM for the longest literal that begins at a place, without taking it, or a unit's end.

    The literals are told apart by groups of first letters: that fails sooner than a choice of all, and than halving it.
    """
    words = sorted(set(literals))
    letters = sorted({word[0] for word in words})
    plain = [letter for letter in letters if letter.isascii()]
    groups = [(f"[{''.join(map(quote, some))}]", some) for some in (plain[at : at + _GROUPED] for at in range(0, len(plain), _GROUPED))]
    if len(plain) < len(letters):
        groups.append((r"[^\x00-\x7F]", letters[len(plain) :]))
    choices = [f"(?={first}){_trie([word for word in words if word[0] in some])}" for first, some in groups]
    return rf"(?=({UNIT_END}|{'|'.join(choices)}))"


def _trie(words: list[str]) -> str:
    """A regex for the longest of the sorted words that begins at a place, read letter by letter."""
    ends, by_letter = False, {}
    for word in words:
        if word:
            by_letter.setdefault(word[0], []).append(word[1:])
        else:
            ends = True
    if not by_letter:
        return ""
    if len(by_letter) == 1 and not ends:
        ((letter, rest),) = by_letter.items()
        return quote(letter) + _trie(rest)
    branches = "|".join(quote(letter) + _trie(rest) for letter, rest in by_letter.items())
    return f"(?:{branches})?" if ends else f"(?:{branches})"
