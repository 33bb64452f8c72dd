"""Text columns: cleaning, counting and patterns, with Unicode classes as most languages define them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

# Patterns that decide results. (?U) gives Java's classes their Unicode meaning.
SPACE = r"(?U)[\s\x1c-\x1f]+"
SENTENCE_END = r"(?U)(?<=[.!?])\s+"
QUANTITY = (
    r"(?iU)\d+(?:[.,]\d+)?\s*%"
    r"|\b\d{1,3}(?:[,. ]\d{3})*(?:\.\d+)?\s*(?:t\b|tonnes?|tco2e?|ktco2e?|mtco2e?|kt\b|mt\b|kg\b|kwh|mwh|gwh|twh|m3|m³|litres?|liters?|million|billion|bn\b)"
)
NUMBER = r"(?U)\b\d[\d,.]*\b"
NATURE = r"(?iU)\bnature\b(?!\s+of\b)"
WORKPLACE = r"(?iU)\b(work|working|business|regulatory|operating|control|team|inclusive|safe)\s+environment"
CAPTION = r"(?iU)^\s*(Figure|Table|Chart|Exhibit)\s+\d"
LIST_ITEM = r"(?U)^\s*(?:[-•·●▪◦*]|\d+[.)]|[a-zA-Z][.)])\s+"
PAGE_NUMBER = r"(?U)^\s*(?:[-–—]\s*)?\d{1,4}(?:\s*[-–—])?\s*$"
TOKEN = r"[a-z0-9_]+|[^a-z0-9_\s]"
PIECE = r"(?:[a-zA-Z0-9_]+|[^a-zA-Z0-9_\s])\s*"  # a token in any case, with the white space after it


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, also where it is used often or inside a lambda."""
    return F.transform(F.array(value), then)[0]


def clean(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def stripped(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def blank(text: Column) -> Column:
    """Whether nothing is left once stripped; ends at the first sign that isn't white space."""
    return ~F.rlike(text, F.lit(r"(?U)[^\s\x1c-\x1f]"))


def sentences(text: Column) -> Column:
    """The pieces between sentence ends and the white space after them."""
    return F.split(text, SENTENCE_END)


def splitter(make: Callable[[], Callable[[str], list[str]]]) -> Callable[[Column], Column]:
    """A column function for another sentence splitter; ``make`` is called once in each task and may load a model."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        split = make()
        for batch in batches:
            yield batch.map(lambda text: None if text is None else split(text))

    return F.pandas_udf(run, "array<string>")


def word_count(cleaned: Column) -> Column:
    return F.size(F.split(cleaned, " "))


def has_quantity(text: Column) -> Column:
    return F.rlike(text, F.lit(QUANTITY))


def number_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(NUMBER))


def page_mentions(low: Column) -> Column:
    return F.regexp_count(low, F.lit("page "))


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def is_caption(line: Column) -> Column:
    return F.rlike(line, F.lit(CAPTION))


def cells_of(row: Column) -> Column:
    """A row's cells as they are shown: no nulls, no line breaks, no white space at the ends."""
    return F.transform(row, lambda c: stripped(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" "))))


def is_list_item(line: Column) -> Column:
    return F.rlike(line, F.lit(LIST_ITEM))


def is_page_number(text: Column) -> Column:
    return F.rlike(text, F.lit(PAGE_NUMBER))


def chunk_id(number: Column) -> Column:
    """chunk_0001, and wider from chunk_10000 on."""
    return F.format_string("chunk_%04d", number)
