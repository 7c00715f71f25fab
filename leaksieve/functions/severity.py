"""Severity of a rule by its name, and the order severities are shown in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of rule names, compared without regard to case.
CRITICAL_NAME_PARTS = ("private key pem", "password", "credit card", "api key")
HIGH_NAME_PARTS = ("jwt token", "certificate", "bank account")

# Display rank; any other severity comes last.
SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}
OTHER_RANK = 99


def severity_of(rule_name: str) -> str:
    lowered = rule_name.lower()
    if any(part in lowered for part in CRITICAL_NAME_PARTS):
        return "critical"
    return "high" if any(part in lowered for part in HIGH_NAME_PARTS) else "medium"


def severity_column(rule_name: Column) -> Column:
    """The same decision for rule names held in a column."""
    lowered = F.lower(rule_name)

    def holds_one_of(parts: tuple[str, ...]) -> Column:
        return F.lower(rule_name).rlike("|".join(parts)) if len(parts) > 1 else lowered.contains(parts[0])

    return (
        F.when(holds_one_of(CRITICAL_NAME_PARTS), "critical")
        .when(holds_one_of(HIGH_NAME_PARTS), "high")
        .otherwise("medium")
    )


def severity_rank(severity: Column) -> Column:
    rank = F.lit(OTHER_RANK)
    for name, position in reversed(SEVERITY_RANK.items()):
        rank = F.when(severity == name, F.lit(position)).otherwise(rank)
    return rank
