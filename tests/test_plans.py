"""Plans: ingestion, answers and reranking, with models that fail."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from ragmill.functions import labels
from ragmill.operators import store
from ragmill.plans import registry
from ragmill.plans.ingest import embedded, figure_rows
from ragmill.plans.providers import NO_ANSWER, NOTHING_FOUND, ModelReranker, OfflineEmbedder, rerank
from ragmill.plans.retrieval import Retriever, document_answer
from ragmill.schema import CHUNK
from ragmill.sources.tables import Settings

FOLDER = "/root/testdata/sf0.001"
NOW = datetime.datetime(2024, 1, 1)


def raising(error):
    def call(prompt):
        raise error

    return call


def chunks(spark):
    embed = OfflineEmbedder(8)
    rows = [(i, 1, i, 1, 1, f"alpha {i}", None, "body", embed.one(f"alpha {i}"), {"kept": "x"}, NOW) for i in range(2)]
    return spark.createDataFrame([*rows, (2, 1, 2, 1, 1, "5 Frames", None, "body", None, {"kept": "x"}, NOW)], CHUNK)


def documents(spark):
    return spark.createDataFrame([(1, "e1", "one"), (2, "e2", "two")], "id long, external_id string, title string")


def test_settings_from_environment():
    assert Settings.from_environment({}) == Settings()
    assert Settings.from_environment({"DEFAULT_TOP_K": "3", "MAX_CONTEXT_CHARS": "9"}) == Settings(top_k=3, context_chars=9)
    with pytest.raises(ValueError):
        Settings.from_environment({"DEFAULT_VECTOR_K": "many"})


def test_model_reranker_and_its_failures(spark):
    candidates = spark.createDataFrame([(1, "a\nb", 0.9, None), (2, "c", 0.1, 0.5), (3, "d", 0.5, 0.1)], "id long, content string, vector_score double, lexical_score double")
    asked = []

    def call(prompt):
        asked.append(prompt)
        return '{"ranking": [{"id": 3, "score": 7}, {"id": "1", "score": "8"}]}'

    order = lambda call: [r.id for r in rerank(candidates, "why", ModelReranker(call), 3).orderBy("rank").collect()]
    assert order(call) == [1, 3, 2]
    assert "why" in asked[0] and "[1] a b" in asked[0]
    weighted = order(raising(OSError("down")))
    assert weighted == order(lambda prompt: "no json") == order(lambda prompt: '{"ranking": [{"id": 99, "score": 1}]}') == [1, 2, 3]
    with pytest.raises(RuntimeError):
        order(raising(RuntimeError("no model")))


class Failing:
    def answer(self, prompt):
        raise OSError("down")


class Echo:
    def answer(self, prompt):
        return " " + prompt + " "


def test_answers_when_nothing_is_found_or_the_model_fails(spark):
    none = spark.createDataFrame([], "document_id long, page_number int"), spark.createDataFrame([], "document_id long, figure_label string")
    said = lambda rows, model: json.loads(Retriever(rows, *none, OfflineEmbedder(8), answerer=model).answer("alpha").first()["payload"])
    assert said(chunks(spark), Failing())["answer"] == NO_ANSWER and len(said(chunks(spark), Failing())["chunks"]) == 2
    assert said(chunks(spark).where("id > 9"), Echo())["answer"] == NOTHING_FOUND


def test_command_line_answer(spark):
    ask = lambda **more: document_answer("alpha 1", chunks(spark), documents(spark), OfflineEmbedder(8), Echo(), **more)
    assert "[Source 1] Document: e1 | Page: 1\nalpha 1\n\n---\n\n[Source 2]" in ask()
    assert ask(external_id="e2") == NOTHING_FOUND
    with pytest.raises(ValueError):
        document_answer(" ", chunks(spark), documents(spark), OfflineEmbedder(8))


def test_backfill_that_writes(spark):
    after = {r.id: r for r in embedded(chunks(spark), OfflineEmbedder(4)).collect()}
    assert [len(after[i].embedding) for i in range(3)] == [8, 8, 4]
    assert after[2].metadata["heading"] == "5 Frames" and after[2].metadata["kept"] == "x" and after[0].metadata == {"kept": "x"}
    assert {len(r.embedding) for r in embedded(chunks(spark), OfflineEmbedder(4), missing_only=False).collect()} == {4}


def test_figures_keep_their_ids_and_get_new_ones(spark):
    table = spark.createDataFrame([(1 << 24 | 5, 1, "FIGURE 1")], "id long, document_id long, figure_label string")
    rows = spark.createDataFrame([(1, "FIGURE 2", 1), (1, "FIGURE 3", 2), (2, "FIGURE 1", 1)], "document_id long, figure_label string, position int")
    assert sorted(r.id for r in store.figure_ids(rows, table).collect()) == [1 << 24 | 6, 1 << 24 | 7, 2 << 24 | 1]


def test_ids_of_rows_are_told_apart_or_refused(spark):
    make = lambda *rows: spark.createDataFrame(rows, "d long, n int").select(store.child_id("d", "n").alias("id"))
    most = (1 << 39) - 1
    assert [r.id for r in make((1, 0), (most, (1 << 24) - 1), (-(1 << 39), 0), (None, 1), (1, None)).collect()] == [1 << 24, (1 << 63) - 1, -(1 << 63), None, None]
    for row in ((1 << 39, 0), (-(1 << 39) - 1, 0), (1, 1 << 24), (1, -1)):
        with pytest.raises(Exception, match="no id for row"):
            make(row).collect()
    table = spark.createDataFrame([((2 << 24) - 1, 1, "FIGURE 1")], "id long, document_id long, figure_label string")
    rows = spark.createDataFrame([(1, "FIGURE 2", 1)], "document_id long, figure_label string, position int")
    with pytest.raises(Exception, match="no id for row"):
        store.figure_ids(rows, table).collect()


def test_image_names(spark):
    one = spark.createDataFrame([(3, 7, "FIGURE 9-2", " c ")], "document_id long, page_number int, figure_label string, caption string")
    names = one.select(labels.page_image_name(F.col("document_id"), F.col("page_number")), labels.figure_file_name(F.col("document_id"), F.col("page_number"), F.lit("—"))).first()
    assert tuple(names) == ("doc3_page_0007.png", "doc3_p7_figure.png")
    row = figure_rows(one, "gs://b/").first()
    assert row.caption == "c" and row.image_uri.startswith("gs://b/figures/") and row.image_uri.endswith("_doc3_p7_figure_9_2.png")


def test_all_tables_of_an_ingestion(spark):
    found = registry._ingested(spark, FOLDER)
    n = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    docs = found.documents.collect()
    assert len(docs) == len({d.id for d in docs}) == 2 * n
    assert {(d.title, d.created_at == NOW) for d in docs if d.external_id.startswith("ext")} == {("new", True), ("new", False)}
    for rows, key in ((found.chunks, "chunk_index"), (found.pages, "page_number"), (found.figures, "figure_label")):
        assert rows.count() == rows.select("id").distinct().count() == rows.select("document_id", key).distinct().count()
        assert rows.join(found.documents.select(F.col("id").alias("document_id")), "document_id", "left_anti").count() == 0
    assert found.figures.where("figure_label = 'FIGURE 0'").count() == n + sum(d.external_id.startswith("ext") and d.created_at == NOW for d in docs)
