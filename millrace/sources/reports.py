"""PDF reports as tables. A Python data source reads files packed into partitions by their bytes and gives a row for each
page, block span or table; the parser is optional and pluggable, and everything downstream works on the tables.

A parser is a function from a file's bytes to a ``Parsed``. The default uses PyMuPDF and pdfplumber where they are
installed and says what is missing where they aren't.
"""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from millrace.functions import text as T
from millrace.sources.paths import opened

PAGES = "path string, page_number int, text string, page_height double, status string, error string"
SPANS = "path string, page_number int, block int, line int, span int, text string, size double, x0 double, y0 double, x1 double, y1 double, page_height double"
TABLES = "path string, page_number int, src_idx int, data array<array<string>>, x0 double, y0 double, x1 double, y1 double"
MOST_PARTITIONS = 2000  # of a batch of reports
SCHEMAS = {"pages": PAGES, "spans": SPANS, "tables": TABLES}


@dataclass
class Parsed:
    """Pages as (text, height, error); spans as (page, block, line, span, text, size, box); tables as (page, grid, box)."""

    pages: list[tuple[str, float, str | None]] = field(default_factory=list)
    spans: list[tuple] = field(default_factory=list)
    tables: list[tuple] = field(default_factory=list)


def parse_pdf(raw: bytes) -> Parsed:
    try:
        import fitz
    except ImportError as e:
        raise RuntimeError("reading PDF needs PyMuPDF; give the source another parser or load its tables from Parquet") from e
    doc, out = fitz.open(stream=raw, filetype="pdf"), Parsed()
    try:
        if doc.needs_pass and not doc.authenticate(""):
            raise RuntimeError("encrypted")
        for k, page in enumerate(doc):
            height = 0.0
            try:
                height = float(page.rect.height)
                found = [
                    (k + 1, b, n, s, span.get("text", ""), span.get("size"), tuple(block["bbox"]))
                    for b, block in enumerate(x for x in page.get_text("dict")["blocks"] if x.get("type") == 0)
                    for n, line in enumerate(block.get("lines", []))
                    for s, span in enumerate(line.get("spans", []))
                ]
                out.pages.append((page.get_text("text"), height, None))
                out.spans += found
            except Exception as e:  # a page that can't be read has no blocks and is told of
                out.pages.append(("", height, str(e)))
    finally:
        doc.close()
    out.tables = parse_tables(raw)
    return out


def parse_tables(raw: bytes) -> list[tuple]:
    """(page, grid, box or None) of the tables that can be found; none where the library is missing or fails.

    A page or a table that can't be read doesn't end the search.
    """
    out: list[tuple] = []
    try:
        import pdfplumber

        with pdfplumber.open(io.BytesIO(raw)) as pdf:
            for k, page in enumerate(pdf.pages, 1):
                for found in _or_nothing(page.find_tables):
                    if grid := _or_nothing(found.extract):
                        out.append((k, grid, tuple(found.bbox) if getattr(found, "bbox", None) else None))
    except Exception:  # tables are an extra; the text is read without them
        return out
    return out


def _or_nothing(read: Callable[[], list]) -> list:
    try:
        return read() or []
    except Exception:
        return []


class ReportSource(DataSource):
    """``spark.read.format("report").option("part", "pages" | "spans" | "tables").load(folder)`` after ``register``.

    ``readStream`` takes reports up as they come into the folder; it keeps what it has seen in the folder of the option ``log``,
    which driver restarts must find again. A report is to be put in place whole, by a rename, as with Spark's file streams.
    """

    parser: Callable[[bytes], Parsed] = staticmethod(parse_pdf)

    @classmethod
    def name(cls) -> str:
        return "report"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("part", "pages")]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options), type(self).parser)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802  Spark's name
        return _StreamReader(dict(self.options), type(self).parser)


@dataclass
class _Files(InputPartition):
    paths: list[str]


def listed(folder: str) -> list[tuple[str, int]]:
    """(path, bytes) of the reports in a folder, or of the one file given, by path."""
    from pyarrow import fs

    where, root = opened(folder)
    info = where.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(folder)
    found = [info] if info.is_file else where.get_file_info(fs.FileSelector(root))
    return sorted((f.path, f.size or 0) for f in found if f.is_file and f.path.lower().endswith(".pdf"))


def packed(files: list[tuple[str, int]], most: int, opening: int) -> list[_Files]:
    """Files in runs of about ``most`` bytes, each counted as its size and ``opening`` bytes more; a larger one is by itself."""
    out, held = [], 0
    for path, size in files:
        if not out or held + size + opening > most:
            out.append(_Files([]))
            held = 0
        out[-1].paths.append(path)
        held += size + opening
    return out


class _Parsing:
    """What batch and stream share: options, packing, and the rows of files."""

    def __init__(self, options: dict, parser: Callable[[bytes], Parsed]):
        self.path, self.part, self.parser = options["path"], options.get("part", "pages"), parser
        self.strict = options.get("strict", "false").lower() == "true"
        self.most, self.opening = int(options.get("partitionbytes", 32 << 20)), int(options.get("openingbytes", 256 << 10))

    def read(self, partition: _Files) -> Iterator[tuple]:
        where = opened(self.path)[0]
        for path in partition.paths:
            yield from self.rows(where, path)

    def rows(self, where, path: str) -> Iterator[tuple]:
        try:
            with where.open_input_stream(path) as f:
                found = self.parser(f.read())
        except Exception as e:
            if self.strict:
                raise
            if self.part == "pages":  # one bad file doesn't end the run
                yield (path, None, None, None, "failed", str(e))
            return
        heights = [h for _, h, _ in found.pages]
        if self.part == "pages":
            for k, (text, height, error) in enumerate(found.pages, 1):
                yield (path, k, text, height, "failed" if error else "ok", error)
        elif self.part == "spans":
            for page, block, line, span, text, size, box in found.spans:
                yield (path, page, block, line, span, text, float(size) if size else None, *map(float, box), heights[page - 1])
        else:
            for k, (page, grid, box) in enumerate(found.tables):
                if grid and any((c or "").strip() for row in grid for c in row):
                    yield (path, page, k, [[None if c is None else str(c) for c in row] for row in grid], *(map(float, box) if box else [None] * 4))


class _Reader(_Parsing, DataSourceReader):
    def partitions(self) -> list[_Files]:
        files = listed(self.path)
        whole = sum(size + self.opening for _, size in files)
        return packed(files, max(self.most, whole // MOST_PARTITIONS), self.opening)  # rows stream, so a large partition takes no more memory


class _StreamReader(_Parsing, DataSourceStreamReader):
    """Offsets count listings: listing n is the file ``n.json`` of the log, with the reports that were new then."""

    def __init__(self, options: dict, parser: Callable[[bytes], Parsed]):
        super().__init__(options, parser)
        if "log" not in options:
            raise ValueError("a stream of reports needs the option log, a folder that outlives the driver")
        self.log, self.at, self.seen = options["log"].rstrip("/"), None, set()

    def recover(self) -> None:
        """What earlier listings saw, once."""
        from pyarrow import fs

        if self.at is None:
            where, root = opened(self.log)
            where.create_dir(root, recursive=True)
            numbers = sorted(int(f.base_name[:-5]) for f in where.get_file_info(fs.FileSelector(root)) if f.base_name.endswith(".json"))
            self.at = numbers[-1] if numbers else 0
            self.seen = {path for n in numbers for path, _ in self.listing(n)}

    def listing(self, n: int) -> list[tuple[str, int]]:
        where, root = opened(self.log)
        with where.open_input_stream(f"{root}/{n}.json") as f:
            return [tuple(x) for x in json.loads(f.read())]

    def initialOffset(self) -> dict:  # noqa: N802
        return {"listing": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        self.recover()
        if new := [f for f in listed(self.path) if f[0] not in self.seen]:
            where, root = opened(self.log)
            with where.open_output_stream(f"{root}/.{self.at + 1}") as f:
                f.write(json.dumps(new).encode())
            where.move(f"{root}/.{self.at + 1}", f"{root}/{self.at + 1}.json")  # whole or not at all
            self.at += 1
            self.seen.update(path for path, _ in new)
        return {"listing": self.at}

    def partitions(self, start: dict, end: dict) -> list[_Files]:
        return packed([f for n in range(start["listing"] + 1, end["listing"] + 1) for f in self.listing(n)], self.most, self.opening)


def register(spark: SparkSession, parser: Callable[[bytes], Parsed] | None = None) -> None:
    """Make the format "report" known, with another parser if one is given."""
    source = type("ReportSource", (ReportSource,), {"parser": staticmethod(parser)}) if parser else ReportSource
    spark.dataSource.register(source)


def _pieces(batches: Iterator) -> Iterator:
    """Spans of a block that come one after the other as one row: texts of neighbouring spans of a line as one piece."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys, (line, span, text, size), boxes = batch.columns[:3], batch.columns[3:7], batch.columns[7:]

        def breaks(column, step: int = 0) -> np.ndarray:
            """Where a value isn't that of the row before and ``step``; nulls are like nothing."""
            same = pc.equal(column.slice(1), pc.add(column.slice(0, n - 1), step) if step else column.slice(0, n - 1))
            return np.concatenate([[True], ~pc.fill_null(same, False).to_numpy(zero_copy_only=False)])

        new_row = np.logical_or.reduce([breaks(k) for k in keys])
        new_piece = new_row | breaks(line) | breaks(span, 1)
        rows, pieces = np.flatnonzero(new_row), np.flatnonzero(new_piece)
        text = pc.fill_null(text, "").cast(pa.string())
        ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + n + 1]
        bounds = np.append(pieces, n).astype(np.int32)
        joined = pa.StringArray.from_buffers(len(pieces), pa.py_buffer(ends[bounds].tobytes()), text.buffers()[2] or pa.py_buffer(b""))
        lengths = pa.ListArray.from_arrays(pa.array(bounds), pc.utf8_length(text))
        at = pa.array(pieces)
        parts = pa.StructArray.from_arrays([line.take(at), span.take(at), joined, lengths], ["line", "span", "text", "lengths"])
        of = np.append(np.cumsum(new_piece)[rows] - 1, len(pieces)).astype(np.int32)
        # Sizes of each row in order, equal ones counted.
        sizes, row = size.to_numpy(zero_copy_only=False), np.cumsum(new_row) - 1
        given = np.flatnonzero(pc.fill_null(pc.not_equal(size, 0.0), False).to_numpy(zero_copy_only=False))
        given = given[np.lexsort((sizes[given], row[given]))]
        sizes, row = sizes[given], row[given]
        first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (sizes[1:] != sizes[:-1]))[: len(given)])
        counted = pa.StructArray.from_arrays([pa.array(sizes[first], pa.float64()), pa.array(np.diff(np.append(first, len(given))), pa.int32())], ["size", "n"])
        size_of = np.searchsorted(row[first], np.arange(len(rows) + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [*(k.take(pa.array(rows)) for k in keys), pa.ListArray.from_arrays(pa.array(of), parts), pa.ListArray.from_arrays(pa.array(size_of), counted), *(x.take(pa.array(rows)) for x in boxes)],
            [*batch.schema.names[:3], "pieces", "sizes", *batch.schema.names[7:]],
        )


def blocks(spans: DataFrame) -> DataFrame:
    """Text blocks with their fonts from spans (doc_id, …): lines without text don't show but their sizes count.

    Tasks first put together what lies together, so texts are shuffled by line and not by span, once, by page: a block's
    pieces are gathered in order and joined in the row, and blocks are numbered where they are. Where pieces of a line
    interleave, which takes spans with the same number, they are taken apart again.
    """
    keys, boxes = ["doc_id", "page_number", "block"], ["x0", "y0", "x1", "y1", "page_height"]
    kind = {f.name: f.dataType.simpleString() for f in spans.schema}
    schema = ", ".join([*(f"{k} {kind[k]}" for k in keys), "pieces array<struct<line:bigint,span:bigint,text:string,lengths:array<int>>>, sizes array<struct<size:double,n:int>>", *(f"{x} {kind[x]}" for x in boxes)])
    narrow = spans.select(*keys, F.col("line").cast("long").alias("line"), F.col("span").cast("long").alias("span"), F.col("text").cast("string").alias("text"), F.col("size").cast("double").alias("size"), *boxes)
    found = narrow.mapInArrow(_pieces, schema).repartition("doc_id", "page_number").groupBy(*keys).agg(
        F.sort_array(F.flatten(F.collect_list("pieces"))).alias("s"), F.flatten(F.collect_list("sizes")).alias("sizes"), *[F.first(c).alias(c) for c in boxes],
    )
    over = F.transform("s", lambda p, i: T.let(F.get("s", i - 1), lambda b: F.coalesce((p["line"] == b["line"]) & (p["span"] < b["span"] + F.size(b["lengths"])), F.lit(False))))
    part = lambda line, span, text: F.struct(line.alias("line"), span.alias("span"), text.alias("text"))
    before = lambda p, i: F.aggregate(F.slice(p["lengths"], F.lit(1), i), F.lit(0), lambda a, n: a + n)
    apart = F.flatten(F.transform("s", lambda p: F.transform(p["lengths"], lambda n, i: part(p["line"], p["span"] + i, p["text"].substr(before(p, i) + 1, n)))))
    whole = F.transform("s", lambda p: part(p["line"], p["span"], p["text"]))
    told = found.withColumn("s", F.when(F.array_contains(over, True), F.sort_array(apart)).otherwise(whole))
    numbers = F.array_distinct(F.transform("s", lambda p: p["line"]))
    # A line is one piece as a rule.
    each = F.transform("s", lambda p: F.when(p["line"].isNotNull(), p["text"]).otherwise(""))
    joined = F.transform(numbers, lambda n: F.array_join(F.transform(F.filter("s", lambda p: p["line"] == n), lambda p: p["text"]), ""))
    lines = F.when(F.size(numbers) == F.size("s"), each).otherwise(joined)
    shown = F.filter(lines, lambda x: F.rlike(x, F.lit(r"(?U)[^\s\x1c-\x1f]")))
    told = told.withColumn("text", T.stripped(F.array_join(shown, "\n"))).where("text <> ''")
    sizes = F.sort_array(F.flatten(F.transform("sizes", lambda x: F.array_repeat(x["size"], x["n"]))))
    middle = T.let(sizes, lambda a: F.get(a, F.floor((F.size(a) - 1) / 2).cast("int")) * 0.5 + F.get(a, F.floor(F.size(a) / 2).cast("int")) * 0.5)
    fonts = [F.coalesce(F.array_max(F.transform("sizes", lambda x: x["size"])), F.lit(0.0)).alias("max_font"), F.coalesce(middle, F.lit(0.0)).alias("median_font")]
    return told.select("doc_id", "page_number", F.row_number().over(Window.partitionBy("doc_id", "page_number").orderBy("block")).alias("src_idx"), "text", "x0", "y0", "x1", "y1", *fonts, "page_height")
