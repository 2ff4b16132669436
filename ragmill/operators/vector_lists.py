"""Stored vector lists: an approximate index that reads codes first and few vectors.

Vectors are dealt to the nearest of some centroids, fitted on a bounded sample, and written in a folder for each list:
id, a code of one byte a component, and the vector, sorted by id. A search takes a stated set of queries. For each it
picks the nearest lists; only their folders are listed, and of them only ids and codes are read, a quarter of the
vectors' bytes. Each task keeps the best few rows by code for each query. The best of all tasks are then looked up by
list and id, and their exact distances decide.

A code divides the range that a component takes over all vectors into 255 steps, so it is off by half a step at most;
a component outside that range (of a vector added later) takes the nearest end. The number of lists read, and of rows
that are looked up for each result, are parameters; recall is measured in the tests and in the README.

Defined cases: rows with a null vector, or with null or non-finite components, aren't indexed; ids are unique; ties go to
the smaller id; with no more vectors than lists each centroid is a vector; an index without vectors finds nothing; a
vector or query of another length is an error.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Lists, vectors on which they are fitted, lists that a search reads, and rows looked up for each result.
LISTS, SAMPLE, PROBES, LOOKED_UP = 100, 20_000, 75, 2
#: Vectors in one file of a list, about, and bytes of a page of vectors, the least that a lookup reads.
FILE_ROWS, PAGE_BYTES = 200_000, 8192
STEPS = 255
MODEL = "centroids array<array<double>>, low array<double>, step array<double>"
#: Queries of one search; more are searched for in several.
MOST_QUERIES = 500


class VectorLists:
    """The index in a folder that all machines share, once it is built."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        row = spark.read.schema(MODEL).parquet(f"{self.folder}/model").first()
        self.centroids = np.array(row["centroids"], float).reshape(len(row["centroids"]), len(row["low"]))
        self.low, self.step = np.array(row["low"], float), np.array(row["step"], float)

    @classmethod
    def build(cls, vectors: DataFrame, folder: str, lists: int = LISTS, sample: int = SAMPLE, seed: int = 42) -> VectorLists:
        """From vectors(id, embedding): centroids of at most `sample` vectors, chosen by a hash of their ids; every vector is then dealt."""
        spark = vectors.sparkSession
        whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        rows = vectors.where(F.col("embedding").isNotNull() & whole).select("id", F.col("embedding").cast("array<float>").alias("embedding"))
        fitted = rows.orderBy(F.xxhash64("id"), "id").limit(sample).withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
        few = fitted.limit(lists + 1).collect()
        if len(few) <= lists:
            centroids = [[float(x) for x in r["embedding"]] for r in few]
        else:
            centroids = [c.tolist() for c in KMeans(k=lists, seed=seed, maxIter=10).fit(fitted).clusterCenters()]
        ends = rows.select(F.posexplode("embedding").alias("place", "x")).groupBy("place").agg(F.min("x").alias("low"), F.max("x").alias("high")).orderBy("place").collect()
        low = [float(r["low"]) for r in ends]
        step = [(float(r["high"]) - float(r["low"])) / STEPS or 1.0 for r in ends]
        spark.createDataFrame([(centroids, low, step)], MODEL).coalesce(1).write.mode("errorifexists").parquet(f"{folder}/model")
        index = cls(spark, folder)
        index.add(rows, "errorifexists")
        return index

    def add(self, rows: DataFrame, mode: str = "append") -> None:
        """Deals rows(id, embedding), whose ids are new, to the lists that there are."""
        centroids, low, step = self.centroids, self.low, self.step

        def dealt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = _matrix(batch.column(1), len(low))
                near = ((centroids * centroids).sum(1) - 2 * v @ centroids.T).argmin(1)
                code = np.clip(np.rint((v - low) / step), 0, STEPS).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0), _binary(code), batch.column(1), pa.array(near.astype(np.int32))], names=["id", "code", "embedding", "list"])

        made = rows.select("id", "embedding").mapInArrow(dealt, "id long, code binary, embedding array<float>, list int")
        # A list may hold much of the table, so each is cut by ids, into files of FILE_ROWS if all are alike.
        files = max(1, rows.count() // (FILE_ROWS * len(centroids))) if len(centroids) else 1
        spread = F.pmod(F.xxhash64("id"), F.lit(files))
        page = max(8, PAGE_BYTES // (4 * max(1, len(low))))
        made.repartition("list", spread).sortWithinPartitions("list", "id").write.mode(mode).partitionBy("list").option("parquet.page.row.count.limit", page).parquet(f"{self.folder}/lists")

    def _rows(self) -> DataFrame:
        return self.spark.read.schema("id long, code binary, embedding array<float>, list int").parquet(f"{self.folder}/lists")

    def coded(self, queries: list[tuple[int, list[float]]], k: int, probes: int = PROBES, looked_up: int = LOOKED_UP) -> DataFrame:
        """(query, id, list) of the looked_up * k rows nearest to each query by code, from its lists."""
        points = np.array([v for _, v in queries], float).reshape(len(queries), len(self.low))
        names = np.array([q for q, _ in queries], np.int64)
        order = np.argsort(((self.centroids * self.centroids).sum(1) - 2 * points @ self.centroids.T), axis=1, kind="stable")[:, :probes]
        wanted = np.zeros((len(queries), len(self.centroids)), bool)
        np.put_along_axis(wanted, order, True, axis=1)
        # |low + step * code - point| ** 2, with the parts that don't hang on the code taken out.
        low, step, most = self.low, self.step, looked_up * k
        scaled, shift = 2 * (points - low) * step, ((points - low) ** 2).sum(1)

        def best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept = [(np.empty(0), np.empty(0, np.int64), np.empty(0, np.int32))] * len(names)
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, lists = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1).astype(float)
                squares = ((code * step) ** 2).sum(1)
                for q in np.flatnonzero(wanted[:, np.unique(lists)].any(1)):
                    at = np.flatnonzero(wanted[q][lists])
                    away = np.concatenate([kept[q][0], squares[at] - code[at] @ scaled[q] + shift[q]])
                    id_, list_ = np.concatenate([kept[q][1], ids[at]]), np.concatenate([kept[q][2], lists[at]])
                    first = np.lexsort((id_, away))[:most]
                    kept[q] = away[first], id_[first], list_[first]
            for q, (away, id_, list_) in enumerate(kept):
                if len(id_):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(id_), names[q])), pa.array(id_), pa.array(list_), pa.array(away)], names=["query", "id", "list", "away"])

        folders = np.flatnonzero(wanted.any(0)).tolist()
        rows = self._rows().where(F.col("list").isin(folders)).select("id", "code", "list").mapInArrow(best, "query long, id long, list int, away double")
        place = F.row_number().over(Window.partitionBy("query").orderBy("away", "id"))
        return rows.withColumn("_place", place).where(F.col("_place") <= most).select("query", "id", "list")

    def search(self, queries: list[tuple[int, list[float]]], k: int, probes: int = PROBES, looked_up: int = LOOKED_UP) -> DataFrame:
        """(query, rank from 0, id, distance): for each of queries (number, vector) the k nearest rows by Euclidean distance among those found by code."""
        kind = "query long, rank int, id long, distance double"
        if len({q for q, _ in queries}) < len(queries):
            raise ValueError("queries need numbers of their own")
        if not len(self.low) or not queries:
            return self.spark.createDataFrame([], kind)
        found = None
        for at in range(0, len(queries), MOST_QUERIES):
            part = self._searched(queries[at : at + MOST_QUERIES], k, probes, looked_up)
            found = part if found is None else found.unionByName(part)
        return found

    def _searched(self, queries: list[tuple[int, list[float]]], k: int, probes: int, looked_up: int) -> DataFrame:
        # At most looked_up * k rows for each of MOST_QUERIES queries.
        some = self.coded(queries, k, probes, looked_up).collect()
        if not some:
            return self.spark.createDataFrame([], "query long, rank int, id long, distance double")
        pairs = self.spark.createDataFrame([(r["query"], r["id"]) for r in some], "query long, id long")
        asked = self.spark.createDataFrame([(q, [float(x) for x in v]) for q, v in queries], "query long, point array<double>")
        pairs = pairs.join(F.broadcast(asked), "query")
        exact = self._rows().where(F.col("list").isin(sorted({r["list"] for r in some})) & _among(sorted({r["id"] for r in some}))).select("id", "embedding")
        distance = F.sqrt(F.aggregate(F.zip_with("embedding", "point", lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda a, x: a + x))
        scored = exact.join(F.broadcast(pairs), "id").select("query", "id", distance.alias("distance"))
        rank = (F.row_number().over(Window.partitionBy("query").orderBy("distance", "id")) - 1).cast("int")
        return scored.withColumn("rank", rank).where(F.col("rank") < k).select("query", "rank", "id", "distance")

    def topk(self, query: list[float], k: int, probes: int = PROBES, looked_up: int = LOOKED_UP) -> DataFrame:
        """(id, distance) of one query, nearest first."""
        return self.search([(0, query)], k, probes, looked_up).orderBy("rank").select("id", "distance")


#: Ids up to this many are asked for one by one, so that pages without them are skipped; more are one list.
ONE_BY_ONE = 200


def _among(ids: list[int]) -> Column:
    if len(ids) > ONE_BY_ONE:
        return F.col("id").isin(ids)
    terms = [F.col("id") == x for x in ids]
    while len(terms) > 1:  # a shallow tree
        terms = [a | b for a, b in zip(terms[::2], terms[1::2], strict=False)] + ([terms[-1]] if len(terms) % 2 else [])
    return terms[0]


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != size * len(column) or np.diff(column.offsets.to_numpy()).tolist() != [size] * len(column):
        raise ValueError(f"a vector hasn't {size} components")
    return flat.reshape(-1, size).astype(float)


def _binary(codes: np.ndarray) -> pa.Array:
    n, size = codes.shape
    offsets = np.arange(n + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(codes))])
