"""The stored vector lists against exact search: recall, what is read, and odd rows."""

import pathlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ragmill.operators import search
from ragmill.operators.vector_lists import VectorLists
from ragmill.plans import registry
from ragmill.sources.tables import embedded_chunks

FOLDER = "/root/testdata/sf0.1"


def exact(ids, matrix, point, k):
    return ids[np.lexsort((ids, ((matrix - point) ** 2).sum(1)))[:k]].tolist()


def test_recall_and_bytes_of_the_registered_parameters(spark, tmp_path):
    rows = embedded_chunks(spark, FOLDER)
    index = VectorLists.build(rows, str(tmp_path / "index"), lists=registry.LISTS)
    table = rows.toPandas()
    ids, matrix = table["id"].to_numpy(), np.array(table["embedding"].tolist(), float)
    picked = np.random.default_rng(3).choice(len(ids), 200, replace=False)
    queries = [(int(p), matrix[p].tolist()) for p in picked]
    found = {}
    for r in index.search(queries, 20, probes=registry.PROBES).orderBy("query", "rank").collect():
        found.setdefault(r.query, []).append(r.id)
    recall = np.mean([len(set(found[q]) & set(exact(ids, matrix, v, 20))) / 20 for q, v in queries])
    assert recall >= 0.9
    everything = index.search(queries[:50], 20, probes=registry.LISTS, looked_up=3).orderBy("query", "rank").collect()
    for q, v in queries[:50]:
        assert [r.id for r in everything if r.query == q] == exact(ids, matrix, v, 20)
    # Codes and ids of the lists that are read, and the vectors that are looked up, against ids and vectors of all.
    size, least = {"id": 0, "code": 0, "embedding": 0}, 0
    for file in pathlib.Path(tmp_path / "index" / "lists").rglob("*.parquet"):
        for group in (pq.ParquetFile(file).metadata.row_group(i) for i in range(pq.ParquetFile(file).metadata.num_row_groups)):
            for c in (group.column(i) for i in range(group.num_columns)):
                size[c.path_in_schema.split(".")[0]] += c.total_compressed_size
    least = (size["id"] + size["code"]) * registry.PROBES / registry.LISTS + 40 * 64 * 4
    assert 3 * least <= size["id"] + size["embedding"]


def test_a_search_lists_and_reads_only_its_folders(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, (rng.normal(0, 0.1, 6) + 5 * (i % 4)).tolist()) for i in range(400)], "id long, embedding array<float>")
    index = VectorLists.build(rows, str(tmp_path / "index"), lists=4)
    coded = index.coded([(0, [5.0] * 6)], 10, probes=1)
    plan = coded._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list" in plan and "embedding" not in plan.split("ReadSchema")[1]
    assert len({r.list for r in coded.collect()}) == 1
    top = index.topk([5.0] * 6, 10, probes=1)
    assert [r.id for r in top.collect()] == [r.id for r in search.vector_topk(rows, [5.0] * 6, 10, "l2").collect()]
    assert "EqualTo(id," in top._jdf.queryExecution().executedPlan().toString()


def test_added_and_odd_vectors(spark, tmp_path):
    kind = "id long, embedding array<float>"
    rows = [(i, [float(i), 0.0]) for i in range(10)] + [(50, None), (51, [None, 1.0]), (52, [float("nan"), 1.0])]
    index = VectorLists.build(spark.createDataFrame(rows, kind), str(tmp_path / "few"), lists=20)
    index.add(spark.createDataFrame([(90, [2.0, 0.0]), (91, [500.0, 0.0])], kind))
    again = VectorLists(spark, str(tmp_path / "few"))
    assert [(r.id, r.distance) for r in again.topk([2.0, 0.0], 3, probes=20).collect()] == [(2, 0.0), (90, 0.0), (1, 1.0)]
    assert [r.id for r in again.topk([400.0, 0.0], 1, probes=20, looked_up=5).collect()] == [91]
    both = again.search([(1, [0.0, 0.0]), (2, [9.0, 0.0])], 2, probes=20).orderBy("query", "rank").collect()
    assert [(r.query, r.rank, r.id) for r in both] == [(1, 0, 0), (1, 1, 1), (2, 0, 9), (2, 1, 8)]
    with pytest.raises(ValueError):
        again.search([(1, [0.0, 0.0]), (1, [0.0, 0.0])], 2)
    with pytest.raises(Exception, match="components"):
        again.add(spark.createDataFrame([(1, [1.0])], kind))
    empty = VectorLists.build(spark.createDataFrame([], kind), str(tmp_path / "none"))
    assert empty.search([(0, [])], 3).count() == 0 and spark.createDataFrame(rows, kind).where(F.col("id") == 50).count() == 1
