"""Reports whose pages arrive apart: rows of a report are kept as state until no more have come for a while, then passed on
together, so that first uses and repeated headers are found over the whole report by the same operators as in batch.

A report's rows make a session of Spark's own: it ends when the watermark passes its last arrival by ``gap``. State
lives in Spark's state store, a list for each open report, and survives restarts with the checkpoint. Rows that come
after the watermark has passed their report's end are dropped by Spark (and counted in the query's progress as rows
dropped by watermark) if they are older than it, and otherwise begin a report of their own under the same id.

A row that comes again (same document and ``key``) replaces the one before, the later arrival winning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators import claims as K, layout as L

PAGE, BLOCK = ("page_number",), ("page_number", "src_idx")


def whole_reports(stream: DataFrame, key: tuple[str, ...] = PAGE, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows (doc_id, arrived, key.., others..) of reports that are complete; the same rows without ``arrived``.

    ``gap`` is how long a report may pause, ``late`` how far rows may come out of the order of their arrival times.
    """
    others = [c for c in stream.columns if c not in ("doc_id", "arrived", *key)]
    row = F.struct(*key, "arrived", *others)
    held = stream.withWatermark("arrived", late).groupBy("doc_id", F.session_window("arrived", gap).alias("session")).agg(F.sort_array(F.collect_list(row)).alias("r"))
    same = lambda a, b: F.struct(*[a[c] for c in key]).eqNullSafe(F.struct(*[b[c] for c in key]))
    last = F.filter("r", lambda x, i: (i + 1 == F.size("r")) | ~same(x, F.get("r", i + 1)))
    return held.select("doc_id", F.explode(last).alias("x")).select("doc_id", *[f"x.{c}" for c in (*key, *others)])


def write_claims(pages: DataFrame, folder: str, checkpoint: str, gap: str = "10 minutes", late: str = "10 minutes") -> StreamingQuery:
    """Claims of pages (doc_id, arrived, page_number, text), each report's once it is whole."""

    def write(batch: DataFrame, number: int) -> None:
        K.claims(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return _started(whole_reports(pages, PAGE, gap, late), write, checkpoint)


def write_body_blocks(blocks: DataFrame, folder: str, checkpoint: str, gap: str = "10 minutes", late: str = "10 minutes") -> StreamingQuery:
    """Layout blocks without repeated headers, footers and page numbers, each report's once it is whole.

    Pages are known by their blocks here, so a page without any counts only if it isn't the last.
    """

    def write(batch: DataFrame, number: int) -> None:
        L.without_headers(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return _started(whole_reports(blocks, BLOCK, gap, late), write, checkpoint)


def _started(stream: DataFrame, write, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
