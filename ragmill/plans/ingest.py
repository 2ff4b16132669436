"""Ingestion as one plan: from what a page reader gives to the new state of the stored tables."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..operators import chunking, layout, store, structure
from ..schema import CHUNK, DOCUMENT, FIGURE, PAGE
from ..sources.snapshots import Change, Snapshots
from .providers import Embedder
from .retrieval import backfill

#: Fixed value: dots per inch at which pages are drawn.
PAGE_RESOLUTION = 180


@dataclass(frozen=True)
class Stored:
    """The stored tables, with the columns of schema.DOCUMENT, CHUNK, PAGE and FIGURE."""

    documents: DataFrame
    chunks: DataFrame
    pages: DataFrame
    figures: DataFrame


@dataclass(frozen=True)
class Upload:
    """What a page reader gives of whole documents, by external_id; each is replaced by what comes here.

    files(external_id, title, description, source_uri, checksum, total_pages); texts(external_id, page_number,
    text), struck text left out already; tables(external_id, page_number, table_index, rows); pages(external_id,
    page_number, width, height, rotation); words and shapes as in layout, with external_id for document_id.
    """

    files: DataFrame
    texts: DataFrame
    tables: DataFrame
    pages: DataFrame
    words: DataFrame
    shapes: DataFrame


def object_uri(base: str, folder: str, prefix: Column, name: Column) -> Column:
    """Where an image is kept: base, folder, and a safe name after a prefix that tells equal names apart."""
    return F.concat(F.lit(base.rstrip("/") + "/"), labels.folder_name(F.lit(folder)), F.lit("/"), prefix, F.lit("_"), labels.object_name(name))


def documents(stored: DataFrame, files: DataFrame, now: datetime, everything: DataFrame | None = None) -> DataFrame:
    """stored with files put in by external_id; documents that are new get the next ids, after those of everything if stored is a part of it."""
    rows = files.withColumn("source_type", F.lit("pdf")).withColumn("metadata", F.create_map().cast("map<string,string>"))
    known = rows.join(stored.select("external_id", "id"), "external_id")
    new = store.with_ids(rows.join(stored.select("external_id"), "external_id", "left_anti"), stored if everything is None else everything, "external_id")
    return store.upsert_documents(stored, known.unionByName(new), now).select(*stored.columns)


def chunk_rows(texts: DataFrame, tables: DataFrame, now: datetime) -> DataFrame:
    """Body chunks of texts and, numbered after them, table chunks of tables; both by document_id."""
    body = chunking.pack(chunking.explode_paragraphs(texts))
    cells = chunking.table_chunks(tables, body).withColumn("chunk_type", F.lit("table"))
    body = body.withColumn("metadata", F.create_map().cast("map<string,string>")).withColumn("chunk_type", F.lit("body"))
    rows = body.unionByName(cells).withColumn("heading", F.lit(None).cast("string")).withColumn("embedding", F.lit(None).cast("array<float>"))
    return rows.withColumn("id", store.child_id("document_id", "chunk_index")).withColumn("created_at", F.lit(now))


def page_rows(pages: DataFrame, images: str, now: datetime) -> DataFrame:
    """Stored pages of pages(document_id, page_number, width, height, rotation), with where their images are kept."""
    name = labels.page_image_name(F.col("document_id"), F.col("page_number"))
    facts = F.create_map(
        *(x for c in ("width", "height", "rotation") for x in (F.lit(c), F.col(c).cast("string"))), F.lit("resolution"), F.lit(str(PAGE_RESOLUTION))
    )
    uri = object_uri(images, "pages", F.md5(name), name)
    return pages.select(
        store.child_id("document_id", "page_number").alias("id"), "document_id", "page_number", uri.alias("image_uri"), facts.alias("metadata"), F.lit(now).alias("created_at")
    )


def figure_rows(found: DataFrame, images: str) -> DataFrame:
    """Rows for store.upsert_figures of what layout.extract_figures found, with where their images are kept."""
    name = labels.figure_file_name(F.col("document_id"), F.col("page_number"), F.col("figure_label"))
    uri = object_uri(images, "figures", F.md5(name), name)
    return found.select(
        "document_id", "figure_label", "page_number", labels.strip(F.col("caption")).alias("caption"), uri.alias("image_uri"),
        F.create_map().cast("map<string,string>").alias("metadata"), F.col("page_number").alias("position"),
    )


def embedded(chunks: DataFrame, embedder: Embedder, headers: list[str] = (), footers: list[str] = (), missing_only: bool = True, folder: str | None = None) -> DataFrame:
    """chunks after a backfill of all, or of those without an embedding only; folder as in backfill."""
    made = backfill(chunks, embedder, headers, footers, missing_only, folder).withColumnRenamed("metadata", "new_metadata")
    return store.update_chunks(chunks, made, structure.merge_metadata(F.col("metadata"), F.col("new_metadata")))


def ingest(
    stored: Stored, upload: Upload, embedder: Embedder, now: datetime, images: str, missing_only: bool = True, docs: DataFrame | None = None, folder: str | None = None
) -> Stored:
    """The stored tables after an upload: documents upserted, their chunks and pages replaced, figures upserted, chunks embedded.

    Chunks and pages of an uploaded document go even if nothing comes in their place; figures stay. docs: the documents
    after the upload, where they are made already; folder: where finished vectors are kept. ingest_into writes the result.
    """
    docs = documents(stored.documents, upload.files, now) if docs is None else docs
    ids = docs.select("external_id", F.col("id").alias("document_id"))
    own = lambda rows: rows.join(ids, "external_id").drop("external_id")
    touched = own(upload.files.select("external_id"))
    pages = own(upload.pages)
    chunks = store.replace(stored.chunks, chunk_rows(own(upload.texts), own(upload.tables), now), touched)
    # Words, by far the most rows, stay with the names that they come by; figures get their documents' ids.
    by_name = lambda rows: rows.withColumnRenamed("external_id", "document_id")
    found = layout.extract_figures(by_name(upload.pages), by_name(upload.words), by_name(upload.shapes)).withColumnRenamed("document_id", "external_id")
    found = figure_rows(own(found), images)
    return replace(
        stored,
        documents=docs,
        chunks=embedded(chunks, embedder, missing_only=missing_only, folder=folder),
        pages=store.replace(stored.pages, page_rows(pages, images, now), touched),
        figures=store.upsert_figures(stored.figures, store.figure_ids(found, stored.figures), now),
    )


def ingest_into(tables: Snapshots, upload: Upload, embedder: Embedder, now: datetime, images: str, missing_only: bool = True) -> int:
    """Ingests an upload into stored tables and gives the new version: all tables change in one commit, or none does.

    Only the buckets that hold uploaded documents, or their chunks, pages and figures, are read and written anew. Vectors
    are kept by text as they are made, so an upload that failed half-way embeds the rest only when it comes again.
    """
    named = tables.buckets_of(upload.files, "external_id")
    everything = tables.read("document", DOCUMENT)
    docs = documents(tables.read("document", DOCUMENT, named), upload.files, now, everything).checkpoint()
    touched = tables.buckets_of(docs.join(upload.files, "external_id", "left_semi"), "id")
    part = Stored(docs, tables.read("chunk", CHUNK, touched), tables.read("page", PAGE, touched), tables.read("figure", FIGURE, touched))
    new = ingest(part, upload, embedder, now, images, missing_only, docs, f"{tables.folder}/vectors")
    children = {"chunk": new.chunks, "page": new.pages, "figure": new.figures}
    return tables.commit({"document": Change(docs, "external_id", named)} | {name: Change(rows, "document_id", touched) for name, rows in children.items()})
