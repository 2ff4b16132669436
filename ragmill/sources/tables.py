"""Reading tables, and the driver tables in the roles of stored ones."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """Defaults of retrieval and of the backfill."""

    vector_k: int = 20
    lexical_k: int = 20
    top_k: int = 10
    context_chars: int = 8000
    batch_size: int = 200

    @classmethod
    def from_environment(cls, environment: Mapping[str, str] = os.environ) -> Settings:
        """The defaults, but for what the environment sets; a value that isn't a whole number is an error."""
        return cls(**{name: int(environment[variable]) for name, variable in VARIABLES.items() if variable in environment})


#: The environment's names of the settings.
VARIABLES = {
    "vector_k": "DEFAULT_VECTOR_K",
    "lexical_k": "DEFAULT_LEXICAL_K",
    "top_k": "DEFAULT_TOP_K",
    "context_chars": "MAX_CONTEXT_CHARS",
    "batch_size": "CHUNK_UPDATE_BATCH_SIZE",
}


def work_folder(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir; where that is unset, a local session gets a temporary one and a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = kept.get() if kept.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all machines share")
        base = tempfile.mkdtemp(prefix="ragmill-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/work-{uuid.uuid4().hex}"


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def text_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """documents as chunks (id, document_id, content, page_start, page_end, metadata) with made-up page ranges."""
    docs = read(spark, folder, "documents")
    start = (F.col("doc_id") % 7 + 1).cast("int")
    return docs.select(
        F.col("doc_id").alias("id"),
        F.col("doc_id").alias("document_id"),
        F.col("text").alias("content"),
        start.alias("page_start"),
        (start + (F.col("doc_id") % 3).cast("int")).alias("page_end"),
        F.create_map(F.lit("section"), F.concat(F.lit("S"), (F.col("doc_id") % 5).cast("string"))).alias("metadata"),
    )


def embedded_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """embeddings as chunk vectors: vec_id is the chunk's id."""
    return read(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def query_vector(spark: SparkSession, folder: str, vec_id: int = 0) -> list[float]:
    row = read(spark, folder, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row["embedding"]]


def document_rows(spark: SparkSession, folder: str) -> DataFrame:
    """documents as stored ones (id, external_id, title, source_type, checksum)."""
    docs = read(spark, folder, "documents")
    return docs.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("ext-"), F.col("doc_id").cast("string")).alias("external_id"),
        F.concat("source", F.lit("/"), "lang").alias("title"),
        F.lit("text").alias("source_type"),
        F.sha2("text", 256).alias("checksum"),
    )


def upload_folder(spark: SparkSession, folder: str, suffix: str = ".pdf") -> DataFrame:
    """Uploaded files: name, path, content, size, checksum; empty files and other suffixes are refused.

    Names that collide get a counter before their suffix, in the order of their paths.
    """
    from pyspark.sql import Window

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    kept = files.withColumn("name", name).where((F.col("length") > 0) & F.lower("name").endswith(suffix))
    nth = F.row_number().over(Window.partitionBy("name").orderBy("path")) - 1
    numbered = F.when(nth == 0, F.col("name")).otherwise(F.concat(F.regexp_replace("name", r"\.[^.]*$", ""), F.lit("_"), nth.cast("string"), F.lit(suffix)))
    return kept.select(numbered.alias("name"), "path", "content", F.col("length").alias("size"), F.sha2("content", 256).alias("checksum"))
