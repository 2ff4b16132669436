"""Headings, sections and page numbers carried from chunk to chunk within a document, as window functions.

A heading event sets its level and clears those below. So the heading in force is the last one of the first
level, or before any of those what the first event makes up from its number; a section is the same within the
stretch since the last heading of the first level; a subsection stands only until the next event. Pages are
the last value seen, and the span of pages starts anew in every chunk whose text names a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import WHITE

# The forms that count as headings and page numbers. Digits are ASCII digits.
NUMBERED = r"(?i)^\s*(?:Section\s+)?(\d+(?:\.\d+){0,3})[\.)]?\s+([A-Za-z0-9][^\n]*)$"
CAPITALS = r"^[A-Z][A-Z0-9 /&'\-]{3,}$"
PAGES = (r"(?i)\bpage\s+(\d{1,4})\b", r"(?i)\bpg\.\s*(\d{1,4})\b", r"(?i)\bp\.\s*(\d{1,4})\b", r"^\s*-{0,3}\s*(\d{1,4})\s*-{0,3}\s*$")
# End of the fixed values.

LINE_ENDS = r"\R|[\x1c-\x1e]"
#: The forms of PAGES as one, to pass over the many texts and lines that hold none of them.
NAMES = r"(?im)\bp(?:age\s+|g\.\s*|\.\s*)\d{1,4}\b|^\s*-{0,3}\s*\d{1,4}\s*-{0,3}\s*$"


def _stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def _lines(text: Column) -> Column:
    """Lines without white space around them, blank ones left out."""
    return F.filter(F.transform(F.split(text, LINE_ENDS), _stripped), lambda line: line != "")


def _pages(text: Column) -> Column:
    """Every page number that a text names, in any form."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(form), F.lit(1)) for form in PAGES])
    found = F.array_distinct(F.transform(found, lambda n: n.cast("int")))
    return F.when(text.rlike(NAMES), found).otherwise(F.array().cast("array<int>"))


def _page(line: Column) -> Column:
    """The page that a line names by the first form that it holds; for lines that NAMES picks."""
    return F.coalesce(*[F.try_element_at(F.transform(F.regexp_extract_all(line, F.lit(form), F.lit(1)), lambda n: n.cast("int")), F.lit(1)) for form in PAGES])


def _titled(line: Column) -> Column:
    """Each run of letters with a capital first and small letters after."""
    runs = F.regexp_extract_all(line, F.lit("[A-Z]+|[^A-Z]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda run: F.concat(F.substring(run, 1, 1), F.lower(F.substr(run, F.lit(2))))), "")


def _event(line: Column) -> Column:
    """(level, label, heading and section to make up from the number) of a heading line."""
    number = F.regexp_extract(line, NUMBERED, 1)
    title = F.rtrim(_stripped(F.regexp_extract(line, NUMBERED, 2)), F.lit(". "))
    parts = F.split(number, r"\.")
    label = F.trim(F.concat_ws(" ", number, title))
    event = lambda level, label, heading, section: F.struct(level.alias("level"), label.alias("label"), heading.alias("heading"), section.alias("section"))
    none = F.lit(None).cast("string")
    level = F.least(F.size(parts), F.lit(3))
    over = F.when(level == 2, label).when(level == 3, F.concat_ws(" ", parts[0], label))
    numbered = event(level, label, over, F.when(level == 3, F.trim(F.concat_ws(" ", F.concat_ws(".", F.slice(parts, 1, 2)), title))))
    capitals = event(F.lit(1), _titled(line), none, none)
    return F.when(line.rlike(NUMBERED), numbered).otherwise(capitals)


def track(chunks: DataFrame) -> DataFrame:
    """(id, document_id, updates as JSON) of chunks(id, document_id, chunk_index, content): what holds after each chunk.

    All windows share one sort by document and place, which spills; a document is not held as one value. A null
    content changes nothing; chunks without an index are ordered by id.
    """
    at = F.coalesce(F.col("chunk_index").cast("long"), F.col("id"))
    rows = chunks.select("id", "document_id", at.alias("at"), F.coalesce("content", F.lit("")).alias("text")).withColumn("lines", _lines(F.col("text")))
    # Few lines are looked at closely: those that name a page, and of the others those that are headings.
    names = lambda line: line.rlike(NAMES)
    heads = F.filter("lines", lambda line: (line.rlike(NUMBERED) | line.rlike(CAPITALS)) & ~names(line))
    named = F.transform(F.filter("lines", names), _page)
    rows = rows.select(
        "id",
        "document_id",
        "at",
        _pages(F.col("text")).alias("found"),
        F.when(F.col("text").rlike(NAMES), named).otherwise(F.array().cast("array<int>")).alias("named"),
        F.transform(heads, _event).alias("events"),
    )
    chunk = Window.partitionBy("document_id").orderBy("at", "id")
    page = F.coalesce(F.try_element_at("named", F.lit(-1)), F.array_min("found"))
    rows = rows.withColumn("page", F.last(page, True).over(chunk)).withColumn("span", F.sum((F.size("found") > 0).cast("int")).over(chunk))
    own = F.array_union("found", "named")
    since = Window.partitionBy("document_id", "span").orderBy("at", "id")
    rows = rows.withColumn("pages", F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.size(own) > 0, own)).over(since)))))

    rows = rows.select("*", F.posexplode_outer("events").alias("k", "event")).withColumn("k", F.coalesce("k", F.lit(-1)))
    line = Window.partitionBy("document_id").orderBy("at", "id", "k")
    is_level = lambda n: F.col("event.level") == n
    rows = rows.withColumn("block", F.sum(F.coalesce(is_level(1).cast("int"), F.lit(0))).over(line))
    within = Window.partitionBy("document_id", "block").orderBy("at", "id", "k")
    last = F.last(F.when(F.col("event").isNotNull(), F.col("event")), True).over(line)
    rows = rows.select(
        "id",
        "document_id",
        "events",
        "k",
        "page",
        "pages",
        F.coalesce(F.last(F.when(is_level(1), F.col("event.label")), True).over(line), F.first("event.heading", True).over(line)).alias("heading"),
        F.coalesce(F.last(F.when(is_level(2), F.col("event.label")), True).over(within), F.first("event.section", True).over(within)).alias("section"),
        F.when(last["level"] == 3, last["label"]).alias("subsection"),
    )
    held = rows.where(F.col("k") == F.size("events") - 1)
    levels = F.array_compact(F.array("heading", "section", "subsection"))
    updates = F.struct(
        "heading",
        "section",
        "subsection",
        F.when(F.size(levels) > 0, levels).alias("section_hierarchy"),
        F.col("page").alias("page_number"),
        F.when(F.size("pages") > 0, F.col("pages")).alias("page_numbers"),
    )
    return held.select("id", "document_id", F.to_json(updates).alias("updates"))


def merge_metadata(existing: Column, updates: Column) -> Column:
    """Maps merged key by key: a new value that isn't null replaces the old one."""
    empty = F.create_map().cast("map<string,string>")
    return F.map_zip_with(F.coalesce(existing, empty), F.coalesce(updates, empty), lambda _, old, new: F.coalesce(new, old))


def updates_map(updates: Column) -> Column:
    """The tracker's JSON as a map of text; lists stay JSON."""
    return F.try_variant_get(F.parse_json(updates), "$", "map<string,string>")


def with_structure(chunks: DataFrame, missing_only: bool = False) -> DataFrame:
    """chunks with merged metadata. missing_only keeps chunks without an embedding, after all have been tracked."""
    tracked = track(chunks).select("id", updates_map(F.col("updates")).alias("_updates"))
    out = chunks.join(tracked, "id").withColumn("metadata", merge_metadata(F.col("metadata"), F.col("_updates"))).drop("_updates")
    return out.where(F.col("embedding").isNull()) if missing_only else out
