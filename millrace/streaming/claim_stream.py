"""Claims of files as they arrive. A file's pages come in one micro-batch, so the batch operators serve as they are
and no state is kept between batches: repeated claims are told apart within a report only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from millrace.operators import claims as K

PAGES = "doc_id long, page_number int, text string"


def pages(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """Parquet files of pages, read as they appear in the folder."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def write_claims(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's claims under its number; a batch that is run again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        K.claims(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_drop_counts(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Each batch's counts of dropped sentences."""

    def write(batch: DataFrame, number: int) -> None:
        K.drop_counts(K.with_reason(K.features(K.sentences(batch)))).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
