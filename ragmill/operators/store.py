"""Keyed upserts, replacement and run status over tables without row updates: each gives the table's new state."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_of_each(rows: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """Of rows with one key the last by order."""
    latest = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return rows.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n", order)


def upsert(table: DataFrame, rows: DataFrame, keys: tuple[str, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """table with rows put in by key. A row that exists keeps its columns in `keep` and takes the others from rows."""
    t, r = table.alias("t"), rows.alias("r")
    same = [F.col(f"t.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    joined = t.withColumn("_t", F.lit(True)).alias("t").join(r.withColumn("_r", F.lit(True)).alias("r"), same, "full_outer")
    out = []
    for c in table.columns:
        if c in keys:
            value = F.when(F.col("r._r"), F.col(f"r.{c}")).otherwise(F.col(f"t.{c}"))
        elif c not in rows.columns:
            value = F.col(f"t.{c}")
        elif c in keep:
            value = F.when(F.col("t._t"), F.col(f"t.{c}")).otherwise(F.col(f"r.{c}"))
        else:
            value = F.when(F.col("r._r"), F.col(f"r.{c}")).otherwise(F.col(f"t.{c}"))
        out.append(value.alias(c))
    return joined.select(*out)


#: Rows of a partition are numbered within this many bits by monotonically_increasing_id.
_PART_BITS = 33


def numbered(rows: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """rows with dense numbers from 0 in the given order, which must be total; no task holds more than a range of it.

    Rows are sorted by ranges and kept (in the checkpoint folder, as another run might cut the ranges elsewhere); the
    rows of each range are counted, and the sums of the counts before it are added to the places inside it.
    """
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_at", _PART_BITS)
    sizes = sorted({r["part"]: r["n"] for r in sorted_rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}.items())
    before, offsets = 0, []
    for k, n in sizes:
        offsets.append((k, before))
        before += n
    # One row for each partition.
    places = F.broadcast(rows.sparkSession.createDataFrame(offsets, "_part long, _before long"))
    inside = F.col("_at") - F.shiftleft("_part", _PART_BITS)
    return sorted_rows.withColumn("_part", part).join(places, "_part").withColumn(name, F.col("_before") + inside).drop("_at", "_part", "_before")


def with_ids(rows: DataFrame, table: DataFrame, *order: str) -> DataFrame:
    """rows with ids after the table's largest, in the given order; the order must be total. The maximum is one value."""
    base = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("base")).first()["base"]
    return numbered(rows.drop("id"), *order, name="id").withColumn("id", F.col("id") + F.lit(base + 1))


#: A document's rows in a table of chunks, pages or figures are numbered within this many ids.
CHILDREN = 1 << 24


#: Documents whose rows' ids fit into a long.
DOCUMENTS = 1 << 39


def child_id(document_id: str, number: str) -> Column:
    """An id of a document's row by its number: total over a table without counting it, and the same when a job is run again.

    Ids are told apart for documents from -DOCUMENTS to DOCUMENTS - 1 (with_ids counts from 1) and numbers from 0 to CHILDREN - 1;
    others raise an error, as their ids would overflow or run into those of the next document. Null gives null.
    """
    document, nth = F.col(document_id).cast("long"), F.col(number).cast("long")
    outside = (document < -DOCUMENTS) | (document >= DOCUMENTS) | (nth < 0) | (nth >= CHILDREN)
    told = F.concat(F.lit("no id for row "), nth.cast("string"), F.lit(" of document "), document.cast("string"))
    return F.when(outside, F.raise_error(told).cast("long")).otherwise(document * CHILDREN + nth)


def figure_ids(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows(document_id, figure_label, position) with ids after the largest that their document has in the table; errors as in child_id."""
    base = table.groupBy("document_id").agg(F.max("id").alias("_base"))
    nth = F.row_number().over(Window.partitionBy("document_id").orderBy("position", "figure_label"))
    used = F.coalesce(F.col("_base") - F.col("document_id") * CHILDREN, F.lit(0))
    counted = rows.withColumn("_n", nth).join(base, "document_id", "left").withColumn("_n", F.greatest(used, F.lit(0)) + F.col("_n"))
    return counted.withColumn("id", child_id("document_id", "_n")).drop("_base", "_n")


def upsert_documents(table: DataFrame, rows: DataFrame, now: datetime) -> DataFrame:
    """By external_id. Ids, source type and creation time stay; updated_at is now for what rows touch."""
    stamped = rows.withColumn("created_at", F.lit(now)).withColumn("updated_at", F.lit(now))
    return upsert(table, stamped, ("external_id",), keep=("id", "source_type", "created_at"))


def upsert_figures(table: DataFrame, rows: DataFrame, now: datetime) -> DataFrame:
    """By document and label; of several rows with one key the last by `position`. Figures that rows don't name stay."""
    latest = last_of_each(rows, ("document_id", "figure_label"), "position").withColumn("created_at", F.lit(now))
    return upsert(table, latest, ("document_id", "figure_label"), keep=("id", "created_at"))


def replace(table: DataFrame, rows: DataFrame, documents: DataFrame) -> DataFrame:
    """table with all rows of documents(document_id) replaced by rows, which may be none."""
    return table.join(documents.select("document_id").distinct(), "document_id", "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def start_run(runs: DataFrame, run_id: str, document_id: int, now: datetime) -> DataFrame:
    row = runs.sparkSession.createDataFrame([(run_id, document_id, "processing", None, now, None)], runs.schema)
    return runs.unionByName(row)


def set_statuses(runs: DataFrame, changes: DataFrame, now: datetime) -> DataFrame:
    """Status and error of the runs in changes(id, status, error_message), one row each; the end is set for completed and failed ones and else stays."""
    r, c = runs.alias("r"), changes.select("id", "status", "error_message", F.lit(True).alias("hit")).alias("c")
    over = F.col("c.status").isin("completed", "failed")
    new = {
        "status": F.when(F.col("c.hit"), F.col("c.status")).otherwise(F.col("r.status")),
        "error_message": F.when(F.col("c.hit"), F.col("c.error_message")).otherwise(F.col("r.error_message")),
        "finished_at": F.when(over, F.lit(now)).otherwise(F.col("r.finished_at")),
    }
    joined = r.join(c, F.col("r.id") == F.col("c.id"), "left")
    return joined.select(*[new.get(x, F.col(f"r.{x}")).alias(x) for x in runs.columns])


def set_status(runs: DataFrame, run_id: str, status: str, now: datetime, error: str | None = None) -> DataFrame:
    """set_statuses for one run."""
    return set_statuses(runs, runs.sparkSession.createDataFrame([(run_id, status, error)], "id string, status string, error_message string"), now)


def get_run(runs: DataFrame, run_id: str) -> DataFrame:
    return runs.where(F.col("id") == run_id)


def update_chunks(chunks: DataFrame, updates: DataFrame, merge: Column) -> DataFrame:
    """chunks with embedding, content and metadata from updates(id, embedding, content, new_metadata); merge: the new map."""
    u = updates.select("id", F.col("embedding").alias("_e"), F.col("content").alias("_c"), F.col("new_metadata"), F.lit(True).alias("_u"))
    joined = chunks.join(u, "id", "left")
    pick = lambda new, old: F.when(F.col("_u"), new).otherwise(F.col(old)).alias(old)
    values = {"embedding": pick(F.col("_e"), "embedding"), "content": pick(F.col("_c"), "content"), "metadata": pick(merge, "metadata")}
    return joined.select(*[values.get(c, F.col(c)) for c in chunks.columns])


def documents_to_update(chunks: DataFrame, missing_only: bool, limit: int | None = None) -> DataFrame:
    """Chunks in document order with needs_update; missing_only: only documents that lack an embedding, but these whole.

    limit counts rows after the sort, so it may cut a document; 0 or None means none.
    """
    rows = chunks.withColumn("needs_update", F.col("embedding").isNull())
    if missing_only:
        lacking = chunks.where(F.col("embedding").isNull()).select("document_id").distinct()
        rows = rows.join(lacking, "document_id", "left_semi").select(*chunks.columns, "needs_update")
    rows = rows.withColumn("order_index", F.coalesce(F.col("chunk_index").cast("long"), F.col("id")))
    rows = rows.orderBy("document_id", "order_index", "id")
    return rows.limit(limit) if limit else rows
