"""What a detection rule is, and how users make their own."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from leaksieve.functions.severity import severity_of

CUSTOM_DOMAIN_TYPE = "Custom Domain URL"


@dataclass(frozen=True)
class Rule:
    """One named regex.

    ``pattern`` is the canonical regex.  ``jvm_pattern`` is set where Java's
    backtracking matcher would recurse once per repetition on long input; it
    accepts exactly the same matches without the recursion.

    ``needs`` lists conditions every match implies: each inner tuple names
    literals of which at least one has to occur in the text (case-folded for an
    ``ignore_case`` rule).  ``needs_regex`` is the same idea for rules without a
    literal: a cheaper regex that is found in every match, in Java's syntax.
    ``needs_number`` is a regex found in the numbers of the text, and ``needs_hash_run`` asks for
    a word as long as a hash, in either engine.
    ``keywords`` marks a ``keyword=value`` rule, found by looking up the words in front of ``=``.
    ``fast_pattern`` is what the JVM searches for in place of ``java``, as it accepts
    exactly the same matches sooner.
    They only ever save work; the findings are those of ``pattern``.
    """

    name: str
    pattern: str
    ignore_case: bool = False
    multiline: bool = False
    family: str = "user"
    needs: tuple[tuple[str, ...], ...] = ()
    needs_regex: str | None = None
    needs_number: str | None = None
    needs_hash_run: bool = False
    keywords: tuple[str, ...] = ()
    jvm_pattern: str | None = None
    fast_pattern: str | None = None
    severity: str = ""
    flags: int = 0  # of ``re``, beside those above

    def __post_init__(self) -> None:
        if not self.severity:
            object.__setattr__(self, "severity", severity_of(self.name))

    @property
    def java(self) -> str:
        """The regex as the JVM reads it: Unicode classes, LF as only line end."""
        return self._java_flags + (self.jvm_pattern or self.pattern)

    @property
    def searched(self) -> str:
        """The regex as the JVM runs it.  Stored findings are named by ``java``, which stays as it is."""
        if self.fast_pattern:
            return self._java_flags + self.fast_pattern
        firsts = first_letters(self.pattern) if self.jvm_pattern is None and not self.flags & re.VERBOSE else ""
        # A class of letters is tried much sooner than a word edge.
        return self._java_flags + (f"(?=[{firsts}])" if firsts else "") + (self.jvm_pattern or self.pattern)

    @property
    def _java_flags(self) -> str:
        flags = "d" + ("iu" if self.ignore_case else "") + ("m" if self.multiline else "") + "U"
        if self.flags & re.ASCII:
            flags = flags.replace("u", "").replace("U", "")
        if self.flags & re.DOTALL:
            flags += "s"
        return f"(?{flags})"

    def compile(self) -> re.Pattern[str]:
        flags = (re.IGNORECASE if self.ignore_case else 0) | (re.MULTILINE if self.multiline else 0)
        return re.compile(self.pattern, flags | self.flags)


_ALTERNATIVES = re.compile(r"\\b\((?:\?:)?((?:[^()\[\]\\{}]|\\.)+)\)(?![?*{])[^|]*")
_LITERAL_START = re.compile(r"[^\W_](?![?*{])|[_/](?![?*{])")


def first_letters(pattern: str) -> str:
    """Letters of which every match begins with one, of a pattern that begins with a word edge; empty if not known."""
    group = _ALTERNATIVES.fullmatch(pattern)
    if group:
        choices = group[1].split("|")
    elif pattern.startswith("\\b") and "|" not in pattern:
        choices = [pattern[2:]]
    else:
        return ""
    firsts = [_LITERAL_START.match(choice) for choice in choices]
    return "".join(sorted({first[0] for first in firsts})) if all(firsts) else ""


def quote(literal: str) -> str:
    """Escape every ASCII character that is neither letter, digit nor underscore."""
    return "".join(
        "\\" + c if c.isascii() and not (c.isalnum() or c == "_") and c not in "\n\r\t\f\v" else c
        for c in literal
    )


def literal(text: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


_REPEAT = re.compile(r"\{(\d*),(\d*)\}|\{(\d+)\}")
_GROUP_FLAGS = re.compile(r"\(\?([a-zA-Z]*)(-[a-z]+)?([:)])")

# Word edges of the JVM are not ASCII in every version.
_ASCII_EDGES = {"b": r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))", "B": r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))"}


def java_syntax(regex: re.Pattern[str]) -> str:
    """A Python pattern in the syntax of the JVM, without its flags; what has no equivalent raises ``ValueError``."""
    text, out, at, in_class, class_start = regex.pattern, [], 0, False, 0
    while at < len(text):
        rest = text[at:]
        took, put = 1, text[at]
        if rest[0] == "\\":
            took, put = _escape(rest, in_class, bool(regex.flags & re.ASCII))
        elif in_class:
            put = "\\" + put if put in "[&" or (put == "]" and at == class_start) else put
            in_class = not (put == "]")
        elif rest[0] == "[":
            took = 2 if rest.startswith("[^") else 1
            put, in_class, class_start = rest[:took], True, at + took
        elif rest[0] == "{":
            repeat = _REPEAT.match(rest)
            took, put = (repeat.end(), f"{{{repeat[1] or 0},{repeat[2]}}}" if repeat[3] is None else repeat[0]) if repeat else (1, "\\{")
        elif rest.startswith("(?P<"):
            took, put = rest.index(">") + 1, "("
        elif rest.startswith("(?P="):
            took = rest.index(")") + 1
            put = f"(?:\\{regex.groupindex[rest[4:took - 1]]})"
        elif rest.startswith("(?#"):
            took, put = rest.index(")") + 1, ""
        elif rest.startswith("(?("):
            raise ValueError(f"conditional group in {text!r}")
        elif (group := _GROUP_FLAGS.match(rest)) and (group[1] or group[2]):
            if group[3] == ":" and set(group[1] + (group[2] or "")) - set("ims-"):
                raise ValueError(f"flags {group[0]!r} of a group in {text!r}")
            took, put = group.end(), group[0] if group[3] == ":" else ""
        elif regex.flags & re.VERBOSE and rest[0].isspace():
            put = ""
        elif regex.flags & re.VERBOSE and rest[0] == "#":
            took, put = len(rest.split("\n", 1)[0]), ""
        out.append(put)
        at += took
    return "".join(out)


def _escape(rest: str, in_class: bool, ascii_only: bool) -> tuple[int, str]:
    """How long the escape at the beginning of ``rest`` is, and what the JVM calls it."""
    if rest[1] in "NU" or re.match(r"\\[1-7][0-7]{2}", rest) or (in_class and rest[1] in "123456789"):
        raise ValueError(f"escape {rest[:4]!r} in a rule")
    if number := re.match(r"\\([1-9]\d?)", rest):
        return number.end(), f"(?:{number[0]})"
    if octal := re.match(r"\\0[0-7]{0,2}", rest):
        return octal.end(), f"\\x{int(octal[0][1:], 8):02x}"
    if rest[1] == "b" and in_class:
        return 2, "\\x08"
    if ascii_only and rest[1] in _ASCII_EDGES:
        return 2, _ASCII_EDGES[rest[1]]
    return 2, {"Z": "\\z", "v": "\\x0B"}.get(rest[1], rest[:2])


def user_rules(rules: Mapping[str, str | re.Pattern[str]]) -> list[Rule]:
    """Rules given as ``name -> regex``, in the syntax of ``re``.

    Plain strings ignore case and are multi-line; compiled patterns keep their
    own flags.  A rule that matches the empty string is refused, and so is one
    that the JVM has no equivalent for.
    """
    made = []
    for name, regex in rules.items():
        if isinstance(regex, str):
            regex = re.compile(regex, re.IGNORECASE | re.MULTILINE)
        if not isinstance(regex.pattern, str):
            raise ValueError(f"rule {name!r} is a pattern of bytes")
        if regex.search(""):
            raise ValueError(f"rule {name!r} matches the empty string")
        translated = java_syntax(regex)
        made.append(
            Rule(
                name,
                regex.pattern,
                ignore_case=bool(regex.flags & re.IGNORECASE),
                multiline=bool(regex.flags & re.MULTILINE),
                jvm_pattern=translated if translated != regex.pattern else None,
                flags=int(regex.flags & (re.ASCII | re.DOTALL | re.VERBOSE)),
            )
        )
    return made


def extend(base: Sequence[Rule], more: Iterable[Rule]) -> list[Rule]:
    """``base`` with ``more`` on top; a repeated name replaces, keeping its place."""
    merged = {rule.name: rule for rule in base}
    for rule in more:
        merged[rule.name] = rule
    return list(merged.values())


def custom_domain_rule(domains: Iterable[str]) -> Rule | None:
    """One rule for URLs on any of the given domains or their sub-domains."""
    names = [d.strip() for d in domains if d.strip()]
    if not names:
        return None
    hosts = "|".join(quote(d) for d in names)
    tail = rf"(?:{hosts})(?::\d+)?(?:/\S*)?"
    return Rule(
        CUSTOM_DOMAIN_TYPE,
        rf"https?://(?:[\w-]+\.)*{tail}",
        ignore_case=True,
        multiline=True,
        family="custom domains",
        severity="medium",
        # Same sub-domain prefixes as one flat run that ends in a dot and has
        # no empty label, so that a long dotted host cannot exhaust the stack.
        jvm_pattern=rf"https?://(?:(?!\.)(?:[\w.-](?<!\.\.))*(?<=\.))?{tail}",
        needs=(("http",), tuple(d.lower() for d in names if d.isascii())) if all(d.isascii() for d in names) else (("http",),),
    )
