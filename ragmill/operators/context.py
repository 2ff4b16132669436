"""Context budgets, snippets, prompts, related pages and figures, and the answer's payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels

SEPARATOR = "\n\n---\n\n"


def budget(chunks: DataFrame, most: int, mode: str = "api") -> DataFrame:
    """The first chunks by rank whose summed length is within `most`; the first always.

    mode api: bodies are stripped, blank ones dropped, and most <= 0 means no limit. mode cli: bodies count as
    they are, blank ones too. Lengths only grow, so stopping at the first overflow is a filter.
    """
    rows = chunks.withColumn("body", F.coalesce("content", F.lit("")))
    if mode == "api":
        rows = rows.withColumn("body", labels.strip(F.col("body"))).where("body <> ''")
        if most <= 0:
            return rows
    upto = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_sum", F.sum(F.length("body")).over(upto)).withColumn("_n", F.count("*").over(upto))
    return rows.where((F.col("_sum") <= most) | (F.col("_n") == 1)).drop("_sum", "_n")


def _meta(*keys: str) -> list[Column]:
    return [F.get(F.array(F.try_element_at("metadata", F.lit(k))), 0) for k in keys]


def snippet(mode: str = "api") -> Column:
    """A source's header and body; the number is the rank before blank ones are dropped, plus 1."""
    heading = labels.first_truthy(*_meta("section", "heading", "title", "heading_override", "section_title"))
    if mode == "api":
        first, last = labels.first_truthy(*_meta("page_start", "page", "page_number")), labels.first_truthy(*_meta("page_end"))
        name = labels.first_truthy(*_meta("document_external_id", "document_title", "file_name"))
    else:
        first, last = labels.first_truthy(F.col("page_start"), *_meta("page_start", "page")), labels.first_truthy(F.col("page_end"), *_meta("page_end"))
        name = labels.first_truthy(F.col("external_id"), F.col("title"))
    name = F.coalesce(name, F.concat(F.lit("doc-"), F.col("document_id").cast("string")))
    pages = F.when(first.isNotNull() & last.isNotNull() & (first != last), F.concat(F.lit("Pages: "), first, F.lit("-"), last)).when(
        first.isNotNull(), F.concat(F.lit("Page: "), first)
    )
    place = F.concat_ws(" | ", F.concat(F.lit("Document: "), name), F.concat(F.lit("Section: "), heading), pages)
    return F.concat(F.lit("[Source "), (F.col("rank") + 1).cast("string"), F.lit("] "), place, F.lit("\n"), labels.strip(F.col("body")))


def context(chunks: DataFrame, most: int, mode: str = "api") -> DataFrame:
    """One row: `context`, the snippets of the chunks within the budget, in order."""
    parts = budget(chunks, most, mode).select("rank", snippet(mode).alias("s"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "s"))), lambda x: x["s"])
    return parts.agg(F.array_join(ordered, SEPARATOR).alias("context"))


def rerank_prompt(candidates: DataFrame, query: str) -> DataFrame:
    """One row: `prompt`, which asks for a relevance from 0 to 10 of each candidate, as JSON."""
    line = F.concat(F.lit("["), F.col("id").cast("string"), F.lit("] "), F.replace(labels.strip(F.col("content")), F.lit("\n"), F.lit(" ")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("s")))), lambda x: x["s"])
    head = f'Rate from 0 to 10 how well each passage answers the query. Reply with JSON: {{"ranking": [{{"id": ..., "score": ...}}]}}.\nQuery: {query.strip()}\nPassages:\n'
    return candidates.agg(F.concat(F.lit(head), F.array_join(ordered, "\n")).alias("prompt"))


def answer_prompt(context_rows: DataFrame, question: str) -> DataFrame:
    """One row: `prompt` for the answering model."""
    head = "Answer from the numbered sources only and cite them as [Source n]; say so if they don't hold the answer.\n\n"
    return context_rows.select(F.concat(F.lit(head), F.col("context"), F.lit(f"\n\nQuestion: {question.strip()}\n")).alias("prompt"))


def pages_for_chunks(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Stored pages that ranked chunks(id, document_id, rank, page_start, page_end) cover, with rank and chunk_ids by rank."""
    known = lambda c: F.when(F.col(c) != 0, F.col(c))
    start = F.coalesce(known("page_start"), F.col("page_end"))
    end = F.coalesce(known("page_end"), known("page_start"), start)
    spans = chunks.select("id", "document_id", "rank", start.alias("s"), end.alias("e")).where("s IS NOT NULL")
    wanted = spans.select("id", "document_id", "rank", F.explode(F.sequence("s", F.greatest("s", "e"))).alias("page_number"))
    need = wanted.groupBy("document_id", "page_number").agg(
        F.min("rank").alias("rank"), F.transform(F.array_sort(F.collect_set(F.struct("rank", "id"))), lambda x: x["id"]).alias("chunk_ids")
    )
    # What is wanted follows the few ranked chunks; the optimizer broadcasts it by its size.
    return pages.join(need, ["document_id", "page_number"]).orderBy("rank", "document_id", "page_number")


def figures_for_chunks(chunks: DataFrame, figures: DataFrame) -> DataFrame:
    """Stored figures that the chunks' texts name, by document and label."""
    named = chunks.select("document_id", F.explode(labels.figure_labels(F.col("content"))).alias("figure_label")).distinct()
    return figures.join(named, ["document_id", "figure_label"]).orderBy("document_id", "figure_label")


def page_labels(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """For each page with chunk_ids the sorted numbers (rank + 1) of the sources that cite it."""
    ranks = chunks.select(F.col("id").alias("chunk_id"), (F.col("rank") + 1).alias("source"))
    cited = pages.select("document_id", "page_number", F.explode("chunk_ids").alias("chunk_id")).join(ranks, "chunk_id")
    return cited.groupBy("document_id", "page_number").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def screen(rows: DataFrame, order: str, page: int, size: int = 4, number: str | None = None) -> DataFrame:
    """One screen of rows, with their places from 0 in `number` if named; a page number beyond either end is moved to it.

    Only the rows up to the end of the screen are numbered, after a top-k; the others are counted.
    """
    first = rows.orderBy(order).limit((max(page, 0) + 1) * size)
    numbered = first.withColumn("_n", F.row_number().over(Window.orderBy(order)) - 1)
    last = F.greatest(F.lit(0), F.ceil(F.count("*") / size) - 1)
    at = rows.agg(F.greatest(F.lit(0), F.least(F.lit(page), last)).alias("_at"))
    kept = numbered.join(F.broadcast(at)).where(F.floor(F.col("_n") / size) == F.col("_at")).drop("_at")  # one row
    return kept.withColumnRenamed("_n", number) if number else kept.drop("_n")


def payload(chunks: DataFrame, pages: DataFrame, figures: DataFrame, answer: str | None, error: str | None = None) -> DataFrame:
    """One row: `payload`, JSON of the answer (or the error in its place), chunks, pages and figures; nulls are kept."""
    # Rows go as JSON while they are put in order: maps can't be compared.
    row = lambda df: F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    listed = lambda df, key: df.agg(F.array_sort(F.collect_list(F.struct(key, row(df).alias("row")))).alias("x")).select(
        F.array_join(F.transform("x", lambda e: e["row"]), ",").alias("x")
    )
    head = F.to_json(F.struct(F.lit(error).alias("error") if error is not None else F.lit(answer).alias("answer")), {"ignoreNullFields": "false"})
    parts = [listed(df, key).withColumnRenamed("x", name) for name, df, key in (("chunks", chunks, "rank"), ("pages", pages, "rank"), ("figures", figures, "figure_label"))]
    joined = parts[0].join(parts[1]).join(parts[2])  # one row each
    lists = [F.concat(F.lit(f', "{name}": ['), F.col(name), F.lit("]")) for name in ("chunks", "pages", "figures")]
    return joined.select(F.concat(head.substr(F.lit(1), F.length(head) - 1), *lists, F.lit("}")).alias("payload"))
