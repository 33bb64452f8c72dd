"""Vocabularies and the columns that test text against them: a term counts wherever it occurs as a substring."""

from __future__ import annotations

from functools import cache, reduce
from importlib import resources

from pyspark.sql import Column, functions as F


@cache
def vocabulary() -> dict[str, tuple[str, ...]]:
    """list name -> terms, in file order."""
    found: dict[str, list[str]] = {}
    for line in (resources.files(__package__) / "vocabulary.txt").read_text("utf-8").splitlines():
        if line.startswith("[") and line.endswith("]"):
            terms = found.setdefault(line[1:-1], [])
        elif line and not line.startswith("#"):
            terms.append(line[1:-1] if line[0] == line[-1] == '"' else line)
    return {k: tuple(v) for k, v in found.items()}


def any_of(low: Column, name: str) -> Column:
    """Does any term of the list occur?"""
    return reduce(Column.__or__, [low.contains(t) for t in vocabulary()[name]])


def hits(low: Column, name: str) -> Column:
    """Number of different terms of the list that occur."""
    return reduce(Column.__add__, [low.contains(t).cast("int") for t in vocabulary()[name]])
