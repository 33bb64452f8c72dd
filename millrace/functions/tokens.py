"""Token counting. The default splits lower-cased text into letter or digit runs and single signs with built-in
functions; it counts fewer tokens than a subword vocabulary does, which is a known deviation. A ``WordPiece`` strategy
gives exact counts where a vocabulary file is at hand.

A counter has ``count`` and ``over`` for a text, ``measure`` for the sentences of one, ``rows`` for a grid and ``sign`` for a short
constant. Those take whole arrays, so a Python counter needs no place inside a lambda, where Spark allows none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, functions as F

from millrace.functions.text import PIECE, TOKEN, cells_of, let, stripped

MEASURED = "array<struct<s:string,n:int,windows:array<string>>>"


@dataclass(frozen=True)
class SignTokens:
    """Runs of letters, digits and underscores, and every other sign by itself."""

    def count(self, text: Column) -> Column:
        return F.regexp_count(F.lower(text), F.lit(TOKEN))

    def over(self, text: Column, most: int) -> Column:
        """Whether a text has more tokens; one with no more signs than that isn't counted."""
        return (F.length(F.lower(text)) > most) & (self.count(text) > most)

    def windows(self, text: Column, most: int, overlap: int) -> Column:
        """Overlapping windows of a text's tokens, as it has them; the last one is the first that reaches the end."""
        step = most - overlap

        def cut(pieces: Column) -> Column:
            last = F.greatest(F.lit(0), F.ceil((F.size(pieces) - most) / step).cast("int"))
            return F.transform(F.sequence(F.lit(0), last), lambda k: stripped(F.array_join(F.slice(pieces, k * step + 1, most), "")))

        return let(F.regexp_extract_all(text, F.lit(f"({PIECE})"), F.lit(1)), cut)

    def measure(self, texts: Column, most: int, overlap: int) -> Column:
        """(s, n, windows) of each text of an array; windows are null where it fits."""

        def one(s: Column) -> Column:
            return let(self.count(s).cast("int"), lambda n: F.struct(s.alias("s"), n.alias("n"), F.when(n > most, self.windows(s, most, overlap)).alias("windows")))

        return F.transform(texts, one)

    def rows(self, grid: Column) -> Column:
        """Tokens of the cells of each row of a grid."""
        return F.transform(grid, lambda row: F.aggregate(cells_of(row), F.lit(0), lambda n, cell: n + self.count(cell).cast("int")))

    def sign(self, text: str) -> int:
        return len(text)  # of signs only


@dataclass(frozen=True)
class WordPiece:
    """Subwords of a vocabulary file with a word a line, by way of the tokenizers library, in Arrow batches."""

    vocabulary_file: str

    def _tokenizer(self):
        from tokenizers import BertWordPieceTokenizer

        return BertWordPieceTokenizer(self.vocabulary_file, lowercase=True)

    def count(self, text: Column) -> Column:
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            t = self._tokenizer()
            for batch in batches:
                yield pd.Series([len(e.ids) for e in t.encode_batch(batch.fillna("").tolist(), add_special_tokens=False)])

        return F.pandas_udf(run, "int")(text)

    def over(self, text: Column, most: int) -> Column:
        return self.count(text) > most

    def measure(self, texts: Column, most: int, overlap: int) -> Column:
        def windows(text: str, offsets: list[tuple[int, int]]) -> list[str] | None:
            if len(offsets) <= most:
                return None
            starts = range(0, max(1, len(offsets) - overlap), most - overlap)
            return [text[offsets[i][0] : offsets[min(i + most, len(offsets)) - 1][1]] for i in starts]

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            t = self._tokenizer()
            for batch in batches:
                out = []
                for texts in batch:
                    texts = [] if texts is None else list(texts)
                    found = t.encode_batch(texts, add_special_tokens=False) if texts else []
                    out.append([{"s": s, "n": len(e.ids), "windows": windows(s, e.offsets)} for s, e in zip(texts, found, strict=True)])
                yield pd.Series(out)

        return F.pandas_udf(run, MEASURED)(texts)

    def rows(self, grid: Column) -> Column:
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            t = self._tokenizer()
            for batch in batches:
                out = []
                for rows in batch:
                    rows = [] if rows is None else list(rows)
                    flat = [c or "" for r in rows for c in r]
                    n = iter([len(e.ids) for e in t.encode_batch(flat, add_special_tokens=False)] if flat else [])
                    out.append([sum(next(n) for _ in r) for r in rows])
                yield pd.Series(out)

        return F.pandas_udf(run, "array<int>")(F.transform(grid, cells_of))

    def sign(self, text: str) -> int:
        return len(self._tokenizer().encode(text, add_special_tokens=False).ids)
