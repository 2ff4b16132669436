"""Removal of boilerplate phrases and of what stands before a document's start heading."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels

#: Where the body of a document begins.
START = r"(?i)\b1[.]?\s+overview\b"


def phrase_pattern(phrase: str) -> str | None:
    """A pattern for a phrase in any case with any white space between its words; null for a blank one."""
    words = phrase.split()
    return "(?i)" + r"\s+".join(re.sub(r"([^\w])", r"\\\1", w) for w in words) if words else None


def strip_phrases(text: Column, headers: list[str], footers: list[str] = ()) -> Column:
    """Each phrase becomes one space, headers first and in order, then the ends are trimmed."""
    out = F.coalesce(text, F.lit(""))
    for pattern in filter(None, map(phrase_pattern, [*headers, *footers])):
        out = F.regexp_replace(out, pattern, " ")
    return labels.strip(out)


def clean_chunks(chunks: DataFrame, headers: list[str], footers: list[str] = (), start: str = START) -> DataFrame:
    """chunks(id, document_id, chunk_index, content) without phrases; blank ones go.

    In each document the first chunk, in order, that holds the start heading loses what stands before it.
    """
    rows = chunks.withColumn("content", strip_phrases(F.col("content"), headers, footers)).where("content <> ''")
    order = F.struct(F.coalesce(F.col("chunk_index").cast("long"), F.col("id")), "id")
    rows = rows.withColumn("_at", order)
    # Only the chunks that match are grouped, so the window of a whole document is not needed.
    first = rows.where(F.col("content").rlike(start)).groupBy("document_id").agg(F.min("_at").alias("_first"))
    trimmed = F.regexp_extract(F.col("content"), f"(?s)^.*?({start}.*)$", 1)
    content = F.when(F.col("_at") == F.col("_first"), labels.strip(trimmed)).otherwise(F.col("content"))
    return rows.join(first, "document_id", "left").withColumn("content", content).where("content <> ''").select(*chunks.columns)
