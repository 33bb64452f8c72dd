"""A file for each report, all or none of a run: a Python data source that writes.

Rows are (name, content); the rows of a name become one file ``name + suffix``, in their order, and must come together in
one partition. Each task attempt writes in folders of its own below ``_writing-RUN``, ``FILES`` in each. When all tasks are
done the driver moves what the attempts that count have written to its place, a rename for each file, and marks the
run with ``_SUCCESS``; when the job fails that folder is removed. So a failed or repeated task leaves nothing behind, and a
re-run replaces each report's file as a whole. In mode overwrite, files of reports that are no longer written go as well.
The driver goes through the names a folder at a time and keeps 64 bits of each; tasks don't send them. ``texts`` reads
the files back without a list of them on the driver.

    spark.dataSource.register(ReportFiles)
    rows.write.format("report-files").option("suffix", ".json").option("indent", "2").mode("append").save(folder)

``indent`` reads the content as JSON and lays it out with so many blanks. A null content counts as empty. A null or empty
name, one with a slash, or one that two tasks write fails the run.
"""

from __future__ import annotations

import json
import os
import uuid
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from millrace.sources.paths import opened

SCHEMA = "name string, content string"
READ = 4 << 20  # bytes of texts handed on at once
FILES = 10_000  # in a folder that a task writes
MOVES = 16  # renames at once where each is a request; a local file system takes one at a time, threads only wait for each other


class ReportFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "report-files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), schema.names, overwrite)


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    files: int = 0

    def part(self, k: int) -> str:
        """The folder of file k."""
        return f"{self.folder}/{k // FILES}"


def listed(where, folder: str, suffix: str) -> Iterator[str]:
    """Names of the files of a folder, without the suffix; on a local file system one after the other."""
    from pyarrow import fs

    if where.type_name == "local":
        with os.scandir(folder) as found:
            yield from (f.name[: len(f.name) - len(suffix)] for f in found if f.name.endswith(suffix) and f.is_file())
    else:
        yield from (f.base_name[: len(f.base_name) - len(suffix)] for f in where.get_file_info(fs.FileSelector(folder)) if f.is_file and f.base_name.endswith(suffix))


def _hashes(names: Iterator[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(n.encode("utf-8", "surrogateescape")) for n in names), np.uint64)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, names: list[str], overwrite: bool):
        if sorted(names) != ["content", "name"]:
            raise ValueError(f"report files are written from the columns name and content, not {', '.join(names)}")
        self.path, self.suffix, self.overwrite = options["path"].rstrip("/"), options.get("suffix", ".txt"), overwrite
        self.indent = int(options["indent"]) if "indent" in options else None
        self.run = f"{self.path}/_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> _Written:
        where, root = opened(self.run)
        done = _Written(f"{root}/{uuid.uuid4().hex}")
        where.create_dir(done.folder, recursive=True)
        out, at, seen = None, None, set()
        try:
            for batch in iterator:
                for name, content in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("name", "content")), strict=True):
                    if name != at or out is None:
                        if not name or "/" in name or name in seen:
                            raise ValueError(f"not a report's name, or its rows aren't together: {name!r}")
                        if out is not None:
                            out.close()
                        if done.files % FILES == 0:
                            where.create_dir(done.part(done.files), recursive=True)
                        out, at = where.open_output_stream(f"{done.part(done.files)}/{name}{self.suffix}"), name
                        seen.add(name)
                        done.files += 1
                    elif self.indent is not None:
                        raise ValueError(f"two objects for report {name!r}")
                    out.write(self.laid_out(content or "").encode())
        finally:
            if out is not None:
                out.close()
        return done

    def laid_out(self, content: str) -> str:
        return content if self.indent is None else json.dumps(json.loads(content), indent=self.indent, ensure_ascii=False)

    def commit(self, messages: list[_Written | None]) -> None:
        where, root = opened(self.path)
        parts = [m.part(k) for m in messages if m is not None for k in range(0, m.files, FILES)]
        new = np.sort(np.concatenate([np.empty(0, np.uint64), *(_hashes(listed(where, p, self.suffix)) for p in parts)]))
        same = set(new[1:][new[1:] == new[:-1]][:1000].tolist())
        if same:
            count = Counter(n for p in parts for n in listed(where, p, self.suffix) if _hashes([n])[0] in same)
            if twice := [n for n, k in count.items() if k > 1]:
                self.abort(messages)
                raise ValueError(f"written by two tasks: {', '.join(sorted(twice)[:5])}")
        where.create_dir(root, recursive=True)
        if self.overwrite:
            for n in listed(where, root, self.suffix):
                own = _hashes([n])[0]
                at = np.searchsorted(new, own)
                if at == len(new) or new[at] != own:
                    where.delete_file(f"{root}/{n}{self.suffix}")
        for p in parts:
            moves = [(f"{p}/{n}{self.suffix}", f"{root}/{n}{self.suffix}") for n in listed(where, p, self.suffix)]
            if where.type_name == "local":
                for move in moves:
                    where.move(*move)
            else:
                with ThreadPoolExecutor(MOVES) as pool:
                    list(pool.map(lambda m: where.move(*m), moves))
        self.abort(messages)  # what attempts that don't count have left
        with where.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[_Written | None]) -> None:
        from pyarrow import fs

        where, root = opened(self.run)
        if where.get_file_info(root).type != fs.FileType.NotFound:
            where.delete_dir(root)


def texts(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """name, text of the report files of a folder: one task lists them, many read them.

    Spark's own readers list all files on the driver, which takes about a kilobyte of it for each.
    """

    def names(batches):
        import pyarrow as pa

        where, root = opened(folder)
        held = []
        for _ in batches:
            pass
        for n in listed(where, root, suffix):
            held.append(n)
            if len(held) == FILES:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["name"])
                held = []
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["name"])

    def read(batches):
        import pyarrow as pa

        where, root = opened(folder)
        for batch in batches:
            held, size = ([], []), 0
            for n in batch.column(0).to_pylist():
                with where.open_input_stream(f"{root}/{n}{suffix}") as f:
                    raw = f.read()
                held[0].append(n)
                held[1].append(raw.decode("utf-8", "replace"))
                size += len(raw)
                if size > READ:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in held], ["name", "text"])
                    held, size = ([], []), 0
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in held], ["name", "text"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a number, as names are too short to be dealt out by their bytes
    return spark.range(0, 1, 1, 1).mapInArrow(names, "name string").repartition(parts, F.col("name")).mapInArrow(read, "name string, text string")
