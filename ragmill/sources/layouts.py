"""Page layouts from dumps: what a page reader found on pages, one JSON object for each page, one to a line.

A page: external_id, page_number, width, height, rotation, and lists words (text and box), rects, images (boxes), lines
(box, y0, y1), curves (pts), annotations (subtype, rect, quadpoints) and tables (rows of cells). Any of them may be
missing. Spark reads the dumps, from any store it knows, in parts by file and offset, compressed ones by file; each reader below names only the
fields that it gives, so the others are skipped by the parser, and page ranges are filtered as lines are read.

Defined cases: a line that is no JSON object, or has no external_id or page_number, is no page (broken() gives such lines, blank ones aside);
a missing or null list is empty; of several objects for a page all count; an empty folder has no pages.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout
from ..plans.ingest import Upload
from .tables import work_folder

BOX = "x0 double, top double, x1 double, bottom double"
FIELDS = {
    "width": "double",
    "height": "double",
    "rotation": "int",
    "words": f"array<struct<text string, {BOX}>>",
    "rects": f"array<struct<{BOX}>>",
    "images": f"array<struct<{BOX}>>",
    "lines": f"array<struct<{BOX}, y0 double, y1 double>>",
    "curves": "array<struct<pts array<array<double>>>>",
    "annotations": "array<struct<subtype string, rect array<double>, quadpoints array<double>>>",
    "tables": "array<array<array<string>>>",
}
KEY = ["external_id", "page_number"]


@dataclass(frozen=True)
class Dumps:
    """Dumps in a folder, of all pages or of those from first to last."""

    spark: SparkSession
    folder: str
    first: int | None = None
    last: int | None = None

    def _read(self, *fields: str) -> DataFrame:
        kinds = ", ".join(f"{f} {FIELDS[f]}" for f in fields)
        rows = self.spark.read.schema(f"external_id string, page_number int{', ' if fields else ''}{kinds}").json(self.folder)
        rows = rows.where("external_id IS NOT NULL AND page_number IS NOT NULL")
        rows = rows if self.first is None else rows.where(F.col("page_number") >= self.first)
        return rows if self.last is None else rows.where(F.col("page_number") <= self.last)

    def pages(self) -> DataFrame:
        """(external_id, page_number, width, height, rotation), once for a page."""
        return self._read("width", "height", "rotation").dropDuplicates(KEY)

    def words(self) -> DataFrame:
        return self._read("words").select(*KEY, F.explode("words").alias("w")).select(*KEY, "w.*")

    def shapes(self) -> DataFrame:
        """(external_id, page_number, kind, box) of rects, lines, curves and images."""
        number = F.lit(None).cast("double")
        points = F.lit(None).cast("array<array<double>>")
        one = lambda kind, o, **own: F.struct(
            F.lit(kind).alias("kind"), *[own.get(c, o[c] if "pts" not in own else number).alias(c) for c in layout.BOX],
            own.get("y0", number).alias("y0"), own.get("y1", number).alias("y1"), own.get("pts", points).alias("pts"),
        )
        rows = self._read("rects", "images", "lines", "curves")
        of = lambda c: F.coalesce(F.col(c), F.array().cast(FIELDS[c]))
        found = F.concat(
            F.transform(of("rects"), lambda o: one("rect", o)), F.transform(of("images"), lambda o: one("image", o)),
            F.transform(of("lines"), lambda o: one("line", o, y0=o["y0"], y1=o["y1"])), F.transform(of("curves"), lambda o: one("curve", o, pts=o["pts"])),
        )
        objects = rows.select(F.col("external_id").alias("document_id"), "page_number", F.explode(found).alias("o")).select("document_id", "page_number", "o.*")
        return layout.shape_boxes(objects).withColumnRenamed("document_id", "external_id")

    def annotations(self) -> DataFrame:
        return self._read("annotations").select(*KEY, F.explode("annotations").alias("a")).select(*KEY, "a.*")

    def tables(self) -> DataFrame:
        """(external_id, page_number, table_index from 0, rows)."""
        return self._read("tables").select(*KEY, F.posexplode("tables").alias("table_index", "rows"))

    def broken(self) -> DataFrame:
        """(line) of what is in the dumps and no page."""
        rows = self.spark.read.text(self.folder).select(F.col("value").alias("line")).where(F.trim("value") != "")
        parsed = F.from_json("line", "external_id string, page_number int")
        return rows.where(F.coalesce(parsed["external_id"].isNull() | parsed["page_number"].isNull(), F.lit(True)))

    def readable_words(self) -> DataFrame:
        """Words that lie inside the page's margins and aren't struck out."""
        pages, named = self.pages().withColumnRenamed("external_id", "document_id"), lambda rows: rows.withColumnRenamed("external_id", "document_id")
        strikes = layout.strike_boxes(named(self.annotations()), pages)
        words = layout.without_struck(layout.crop_margins(named(self.words()), pages), strikes)
        return words.withColumnRenamed("document_id", "external_id")

    def texts(self) -> DataFrame:
        """(external_id, page_number, text): the lines of readable words from the top, each on its own.

        The text of each object is made from it alone and stored, as a dump takes long to read. Where each page is one object,
        as the keys of these show, that is all; else words meet by page.
        """
        folder = work_folder(self.spark)
        found = layout.page_texts(self._read("width", "height", "words", "annotations"), KEY, every=True)
        found.write.parquet(folder)
        found = self.spark.read.schema(found.schema).parquet(folder)
        if not found.groupBy(*KEY).count().where("count > 1").limit(1).count():
            return found.where("text IS NOT NULL")
        lines = layout.lines_by(self.readable_words(), KEY)
        joined: Column = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
        return lines.groupBy(*KEY).agg(joined.alias("text"))

    def upload(self, files: DataFrame) -> Upload:
        """What plans.ingest takes, for the documents in files (see Upload)."""
        known = files.select("external_id")
        only = lambda rows: rows.join(known, "external_id", "left_semi")
        return Upload(files, only(self.texts()), only(self.tables()), only(self.pages()), only(self.words()), only(self.shapes()))


def written(pages: DataFrame, folder: str) -> None:
    """Writes pages(external_id, page_number, and any of FIELDS) as dumps, compressed: a file for each part of pages, which is read by one task."""
    pages.select(*[c for c in pages.columns if c in FIELDS or c in KEY]).write.option("compression", "gzip").json(folder)
