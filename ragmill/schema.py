"""Row types of the stored tables and of the layout inputs that stand for a PDF reader's output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DOCUMENT = (
    "id BIGINT, external_id STRING, title STRING, description STRING, source_type STRING, source_uri STRING, checksum STRING, "
    "total_pages INT, metadata MAP<STRING,STRING>, created_at TIMESTAMP, updated_at TIMESTAMP"
)
PAGE = "id BIGINT, document_id BIGINT, page_number INT, image_uri STRING, metadata MAP<STRING,STRING>, created_at TIMESTAMP"
CHUNK = (
    "id BIGINT, document_id BIGINT, chunk_index INT, page_start INT, page_end INT, content STRING, heading STRING, "
    "chunk_type STRING, embedding ARRAY<FLOAT>, metadata MAP<STRING,STRING>, created_at TIMESTAMP"
)
FIGURE = (
    "id BIGINT, document_id BIGINT, figure_label STRING, page_number INT, caption STRING, image_uri STRING, "
    "metadata MAP<STRING,STRING>, created_at TIMESTAMP"
)
RUN = "id STRING, document_id BIGINT, status STRING, error_message STRING, started_at TIMESTAMP, finished_at TIMESTAMP"

LAYOUT_PAGE = "document_id BIGINT, page_number INT, width DOUBLE, height DOUBLE"
WORD = "document_id BIGINT, page_number INT, text STRING, x0 DOUBLE, top DOUBLE, x1 DOUBLE, bottom DOUBLE"
SHAPE = "document_id BIGINT, page_number INT, kind STRING, x0 DOUBLE, top DOUBLE, x1 DOUBLE, bottom DOUBLE"
ANNOTATION = "document_id BIGINT, page_number INT, subtype STRING, rect ARRAY<DOUBLE>, quadpoints ARRAY<DOUBLE>"
TABLE_CELLS = "document_id BIGINT, page_number INT, table_index INT, rows ARRAY<ARRAY<STRING>>"

KEYS = {
    "document": ("external_id",),
    "page": ("document_id", "page_number"),
    "chunk": ("document_id", "chunk_index"),
    "figure": ("document_id", "figure_label"),
    "run": ("id",),
}


def key_violations(rows: DataFrame, table: str) -> DataFrame:
    """Keys of a stored table that occur more than once; empty when its unique constraint holds."""
    return rows.groupBy(*KEYS[table]).agg(F.count("*").alias("n")).where("n > 1")


def orphans(children: DataFrame, documents: DataFrame) -> DataFrame:
    """Child rows whose document doesn't exist; what a cascading delete would have removed."""
    return children.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_anti")
