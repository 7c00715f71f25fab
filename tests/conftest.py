from __future__ import annotations

import re
from collections.abc import Iterable

import pytest

from leaksieve.rules.model import Rule
from leaksieve.session import local_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tests")


def by_hand(texts: Iterable[tuple[str, str]], rules: Iterable[Rule]) -> set[tuple]:
    """Findings by plain Python regexes, for comparison."""
    found = set()
    for file, text in texts:
        for rule in rules:
            for match in re.finditer(rule.compile(), text):
                line = text.count("\n", 0, match.start()) + 1
                found.add((file, rule.name, line, match[0][:100], rule.severity))
    return found


def as_tuples(findings) -> list[tuple]:
    return [tuple(row) for row in findings.select("file", "type", "line", "snippet", "severity").collect()]


def corpus(spark, *texts: str):
    return spark.createDataFrame([(str(n), t) for n, t in enumerate(texts)], "file string, text string")
