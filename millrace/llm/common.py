"""Small helpers that the text operators share: the cluster's shared folder, word ids, table reads."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

_MASK = (1 << 63) - 1


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; on one machine our own where that is unset, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", named)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/millrace/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a URI, for tasks that write or range-read files of their own."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


def remove_folder(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Memo(dict):
    """word -> value, computed once by ``make``; emptied between documents when it holds ``most`` words, so memory is bounded."""

    def __init__(self, make, most: int = 400_000):
        self.make, self.most = make, most

    def __missing__(self, word):
        value = self[word] = self.make(word)
        return value

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()


def text_slices(column, most: int):
    """(start, end) of runs of an Arrow string column's rows of about ``most`` bytes, or of one longer text."""
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    low = 0
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + most, "right")))
        yield low, high
        low = high


def split_words(texts, ascii_only: bool = False) -> tuple[list, np.ndarray, np.ndarray]:
    """(distinct words, place of each word among them, words of each text) of an Arrow string array.

    Words lie between white space: Unicode's as in ``str.split``, or ASCII's as in ``bytes.split``, and then are bytes.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "")
    lists = (pc.ascii_split_whitespace if ascii_only else pc.utf8_split_whitespace)(texts)
    coded = lists.flatten().dictionary_encode()
    places, words, sizes = coded.indices.to_numpy(), coded.dictionary, lists.value_lengths().to_numpy()
    if (blank := pc.index(words, "").as_py()) >= 0:  # what white space at the ends leaves
        gone = places == blank
        sizes = sizes - np.bincount(np.repeat(np.arange(len(sizes)), sizes)[gone], minlength=len(sizes))
        places = places[~gone]
        places = places - (places > blank)
        words = pa.concat_arrays([words[:blank], words[blank + 1 :]])
    return (words.cast(pa.binary()) if ascii_only else words).to_numpy(zero_copy_only=False).tolist(), places, sizes


def word_hash(word: str) -> int:
    """A stable non-negative 63-bit id of a word."""
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) & _MASK


def as_ids(memo: Memo, words: list[str]) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.int64, len(words))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser over uint64 values: well-spread bits from structured input."""
    x = x.astype(np.uint64, copy=True) + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingles(ids: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of each run of ``size`` word ids; a shorter text is one shingle, an empty one has none."""
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64)
    k, x = min(size, n), mix(ids.view(np.uint64) if ids.dtype == np.int64 else ids)
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x100000001B3) + x[i : n - k + 1 + i]
    return mix(out, k)


def as_items(rows: np.ndarray) -> np.ndarray:
    """A view of a matrix whose rows are single items, which numpy puts in place faster than rows."""
    return rows.view(np.dtype((np.void, rows.shape[1] * rows.itemsize))).ravel()


def run_sums(rows: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of rows[order] over the runs that begin at ``first``: each turn adds up pairs of all runs not done."""
    length = np.diff(first, append=len(order))
    out = np.empty((len(first), rows.shape[1]), rows.dtype)
    put = as_items(out)
    one = np.flatnonzero(length == 1)
    put[one] = as_items(rows.take(order[first[one]], axis=0, mode="clip"))
    run = np.flatnonzero(length > 1)
    length, start, at = length[run], first[run], order
    while len(run):
        pairs = length // 2
        begin = np.cumsum(pairs) - pairs
        left = np.repeat(start - 2 * begin, pairs) + 2 * np.arange(int(pairs.sum()))
        half = rows.take(at[left], axis=0, mode="clip")
        half += rows.take(at[left + 1], axis=0, mode="clip")
        odd = np.flatnonzero(length % 2)
        as_items(half)[begin[odd]] = as_items(half.take(begin[odd], axis=0, mode="clip") + rows.take(at[start[odd] + length[odd] - 1], axis=0, mode="clip"))
        done, more = np.flatnonzero(pairs == 1), np.flatnonzero(pairs > 1)
        put[run[done]] = as_items(half.take(begin[done], axis=0, mode="clip"))
        rows, at, run, length, start = half, np.arange(len(half)), run[more], pairs[more], begin[more]
    return out


def limit_threads() -> None:
    """One native thread for each task: Spark owns the cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("OMP_NUM_THREADS", "1")


def with_columns(df: DataFrame, column: str, fields: list, make) -> DataFrame:
    """``df`` with new columns computed from one column a batch at a time.

    ``make()`` is called once in each task and returns a function from the column's values (a list) to one
    Arrow-convertible list for each of ``fields`` (StructFields). The new names must not be in ``df``.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType([*df.schema.fields, *fields])
    at, types = df.columns.index(column), [f.type for f in to_arrow_schema(StructType(fields))]

    def run(batches):
        step = make()
        for batch in batches:
            new = step(batch.column(at).to_pylist())
            arrays = [pa.array(x, t) for x, t in zip(new, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], schema=pa.schema([*batch.schema, *(pa.field(f.name, t) for f, t in zip(fields, types, strict=True))]))

    return df.mapInArrow(run, schema)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one where the table has a column of that name already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
