"""An extension: new page texts are taken in as a stream and become chunks, document by document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunking

PAGES = "document_id BIGINT, page_number INT, text STRING"


def page_stream(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """Page texts from Parquet files as they appear in a folder."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def run(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Packs each batch's pages into chunks. A batch has a folder of its own, so one that is run again replaces itself.

    A document's pages must come in one batch, as an upload does.
    """

    def take_in(batch: DataFrame, number: int) -> None:
        chunking.pack(chunking.explode_paragraphs(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pages.writeStream.foreachBatch(take_in).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
