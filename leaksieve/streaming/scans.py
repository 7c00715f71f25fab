"""The scan over a stream of texts."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame

from leaksieve.operators.scan import scan
from leaksieve.rules.model import Rule


def scan_stream(
    texts: DataFrame,
    rules: Sequence[Rule],
    *,
    file: str = "file",
    text: str = "text",
    keep: Sequence[str] = (),
    domains: Iterable[str] = (),
) -> DataFrame:
    """Findings of a streaming DataFrame, copies of a text under their own names.

    The scan keeps no state; ``keep`` names columns to carry, such as the event time.
    """
    return scan(texts, rules, file=file, text=text, keep=keep, domains=domains)
