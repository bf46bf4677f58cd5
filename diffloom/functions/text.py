"""Column helpers for text, ranks and JSON-like rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The shared scale of severity and confidence.
RANKS = ("low", "medium", "high")
CATEGORIES = (
    "auth_perms",
    "input_validation",
    "injection",
    "hardcoded_secrets",
    "sensitive_logging",
    "unsafe_redirects",
    "dependency_change",
    "crypto_misuse",
)


def rank(c: Column) -> Column:
    """0, 1, 2 for low, medium, high; null for anything else."""
    return F.when(c == "low", 0).when(c == "medium", 1).when(c == "high", 2)


def unrank(c: Column) -> Column:
    return F.when(c == 0, "low").when(c == 1, "medium").when(c == 2, "high")


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def flatten(c: Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def tokens(c: Column) -> Column:
    """Estimated tokens: four code points each, rounded up."""
    return F.ceil(F.length(c) / 4).cast("long")


def json_list(c: Column) -> Column:
    """An array of numbers as `[1, 2]`."""
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ", "), F.lit("]"))


def found_in(c: Column, words) -> Column:
    """Those of the words that c contains, in their order."""
    return F.filter(F.array(*(F.when(c.contains(w), F.lit(w)) for w in words)), lambda x: x.isNotNull())
