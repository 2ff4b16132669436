"""Embedding every distinct text once, in batches that are kept.

Texts are told apart by SHA-256 after their ends are stripped. Distinct texts are asked for in calls of a bounded number
of texts, from each partition; blank ones get a zero vector without a call. With a folder, finished vectors are kept in
it by digest: texts are cut into PARTS by digest, each part is one job that appends its vectors, and a run passes over
digests that are there. A run that fails leaves the parts before it, so the next one asks for the rest.

Defined cases: a null text is a blank one; equal rows get equal vectors; an empty table makes no call; with a folder a
digest that two runs at once both made is taken once; columns besides content are kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from .providers import Chain, Embedder

#: Jobs that a run with a folder is cut into.
PARTS = 16
MADE = "digest string, model string, embedding array<float>"


def digest(text: Column) -> Column:
    return F.sha2(labels.strip(F.coalesce(text, F.lit(""))), 256)


def asked(texts: DataFrame, embedder: Embedder, batch_size: int) -> DataFrame:
    """(digest, model, embedding) of texts(digest, content), which are distinct: a call for every batch_size of a partition."""
    chain = embedder if isinstance(embedder, Chain) else Chain([embedder], tries=1)

    def call(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, batch_size):
                part = batch.slice(at, batch_size)
                names, vectors, full = [chain.model] * part.num_rows, [[0.0] * chain.dimension] * part.num_rows, []
                contents = part.column(1).to_pylist()
                full = [i for i, t in enumerate(contents) if t]
                if full:
                    model, made = chain.named([contents[i] for i in full])
                    for i, v in zip(full, made, strict=True):
                        names[i], vectors[i] = model, [float(x) for x in v]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(vectors, pa.list_(pa.float32()))], names=["digest", "model", "embedding"])

    return texts.select("digest", "content").mapInArrow(call, MADE)


def kept(texts: DataFrame, folder: str) -> DataFrame:
    """The vectors that a folder holds, one for each digest; none where there is no folder yet."""
    try:
        return texts.sparkSession.read.schema(MADE).parquet(f"{folder}/made").dropDuplicates(["digest"])
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return texts.sparkSession.createDataFrame([], MADE)


def embedded(rows: DataFrame, embedder: Embedder, folder: str | None = None, batch_size: int = 200, parts: int = PARTS) -> DataFrame:
    """rows(content, ...) with embedding and model. Without a folder nothing is kept and the calls are part of the plan."""
    named = rows.withColumn("digest", digest(F.col("content")))
    distinct = named.groupBy("digest").agg(F.first(labels.strip(F.coalesce("content", F.lit("")))).alias("content"))
    if folder is None:
        made = asked(distinct, embedder, batch_size)
    else:
        part = F.pmod(F.xxhash64("digest"), F.lit(parts)).cast("int")
        open_ = distinct.join(kept(rows, folder).select("digest"), "digest", "left_anti").withColumn("part", part).checkpoint()
        for k in [r["part"] for r in open_.select("part").distinct().orderBy("part").collect()]:  # `parts` at most
            asked(open_.where(F.col("part") == k), embedder, batch_size).write.mode("append").parquet(f"{folder}/made")
        made = kept(rows, folder)
    return named.join(made, "digest", "left").drop("digest")
