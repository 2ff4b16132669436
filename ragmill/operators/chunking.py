"""Paragraphs, greedy packing into chunks across pages, and table chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels

MOST_CHARS = 1800


def paragraphs(text: Column) -> Column:
    """Texts between blank lines, or the whole text where there are none, each with its white space collapsed; no blanks."""
    parts = F.split(F.coalesce(text, F.lit("")), "\n\n", -1)
    return F.filter(F.transform(parts, labels.clean_text), lambda p: p != "")


def explode_paragraphs(pages: DataFrame, breaks: str = "\n\n") -> DataFrame:
    """(document_id, page_number, seq, text) of pages(document_id, page_number, text), seq from 0 within a page."""
    parts = paragraphs(F.col("text")) if breaks == "\n\n" else F.filter(F.transform(F.split("text", breaks), labels.clean_text), lambda p: p != "")
    return pages.select("document_id", "page_number", F.posexplode(parts).alias("seq", "text"))


def pack(rows: DataFrame, most: int = MOST_CHARS) -> DataFrame:
    """Body chunks (document_id, chunk_index, page_start, page_end, content) of paragraphs(document_id, page_number, seq, text).

    Paragraphs fill a chunk, a space between them, until the next would make it longer than `most`; one that is
    longer itself stays whole. A chunk that the next paragraph didn't fit ends on that paragraph's page.

    Paragraphs are dealt by document and sorted, and each task walks them batch by batch. Within a batch the start of
    the next chunk is found by bisection of running sums of lengths, so the work is linear; from one batch to the next
    a task holds the paragraphs of the chunk that is still open, and no more. Texts move as buffers, never one by one.

    Defined cases: a null document_id is a document like others; rows with a null text are left out, empty texts count
    as paragraphs without characters; rows with equal places follow each other by text; columns besides the four are ignored.
    """
    kinds = rows.select("document_id", "page_number").schema
    schema = f"document_id {kinds[0].dataType.simpleString()}, chunk_index int, page_start {kinds[1].dataType.simpleString()}, page_end {kinds[1].dataType.simpleString()}, content string"
    order = ["document_id", "page_number", "seq", "text"]
    dealt = rows.where("text IS NOT NULL").select(*order).repartition("document_id").sortWithinPartitions(*order)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number, last = None, 0, True
        batches = iter(batches)
        batch = next(batches, None)
        while batch is not None:
            following = next(batches, None)
            last = following is None
            table = pa.Table.from_batches([batch])
            table = (table if held is None else pa.concat_tables([held, table])).combine_chunks()
            if table.num_rows:
                made, held, number = _packed(table, most, number, last)
                if made.num_rows:
                    yield made
            batch = following

    return dealt.mapInArrow(walk, schema)


def _packed(table: pa.Table, most: int, number: int, last: bool) -> tuple[pa.RecordBatch, pa.Table, int]:
    """The chunks of sorted paragraphs that are certain, the paragraphs of the one that isn't (none if `last`), and its number in its document.

    number: that of the table's first chunk.
    """
    ids = table.column("document_id").combine_chunks()
    pages = table.column("page_number").combine_chunks()
    texts = table.column("text").combine_chunks()
    n = len(ids)
    # Where documents begin; nulls are equal to each other.
    coded = ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    begins = np.flatnonzero(np.r_[True, coded[1:] != coded[:-1]])
    ends = np.r_[begins[1:], n]
    # A paragraph from `reach[k]` to `reach[k + 1]`, its separator counted with it.
    reach = np.r_[0, np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)]
    starts, numbers = [], []
    for begin, end in zip(begins.tolist(), ends.tolist(), strict=True):
        at, k = begin, number if begin == 0 else 0
        while at < end:
            starts.append(at)
            numbers.append(k)
            fits = int(np.searchsorted(reach, reach[at] + most + 1, "right")) - 1
            at, k = min(max(fits, at + 1), end), k + 1
    whole = len(starts) if last else len(starts) - 1
    edges = np.array([*starts, n][: whole + 1])
    first, after = edges[:-1], edges[1:]
    ends_document = np.isin(after, ends)
    # The next paragraph's page, if it is of the same document; the last page of a document otherwise.
    ends_on = pages.take(pa.array(np.where(ends_document, after - 1, np.minimum(after, n - 1)).astype(np.int64)))
    content = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), texts.cast(pa.string())), " ") if whole else pa.array([], pa.string())
    made = pa.RecordBatch.from_arrays(
        [ids.take(pa.array(first)), pa.array(numbers[:whole], pa.int32()), pages.take(pa.array(first)), ends_on, content], names=["document_id", "chunk_index", "page_start", "page_end", "content"]
    )
    return made, table.slice(starts[whole]) if not last else table.slice(n), numbers[whole] if not last else 0


def table_text(rows: Column) -> Column:
    """A table as lines: header, dashes of its length, rows; cells stripped and joined by ' | ', null cells empty."""
    line = lambda r: F.array_join(F.transform(r, lambda c: labels.strip(F.coalesce(c, F.lit("")))), " | ")
    head = line(F.get(rows, 0))
    header = F.when(F.size(F.get(rows, 0)) > 0, F.array(head, F.repeat(F.lit("-"), F.length(head)))).otherwise(F.array().cast("array<string>"))
    body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), line)
    return labels.strip(F.array_join(F.concat(header, body), "\n"))


def table_chunks(cells: DataFrame, body: DataFrame) -> DataFrame:
    """Chunks of tables(document_id, page_number, table_index from 0, rows), numbered after each document's body chunks."""
    texts = cells.where(F.size("rows") > 0).withColumn("content", table_text(F.col("rows"))).where("content <> ''")
    after = body.groupBy("document_id").agg(F.count("*").alias("n"))
    order = Window.partitionBy("document_id").orderBy("page_number", "table_index")
    return texts.join(after, "document_id", "left").select(
        "document_id",
        (F.coalesce("n", F.lit(0)) + F.row_number().over(order) - 1).cast("int").alias("chunk_index"),
        F.col("page_number").alias("page_start"),
        F.col("page_number").alias("page_end"),
        "content",
        F.create_map(F.lit("table_index_on_page"), (F.col("table_index") + 1).cast("string")).alias("metadata"),
    )
