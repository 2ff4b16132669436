"""Small inputs with results worked out by hand."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from ragmill.functions import labels, vectors
from ragmill.operators import chunking, cleaning, context, fusion, layout, search, store, structure
from ragmill.plans.providers import NO_ANSWER, OfflineEmbedder
from ragmill.plans.retrieval import Retriever, backfill
from ragmill.schema import CHUNK, DOCUMENT, FIGURE, RUN, key_violations, orphans
from ragmill.sources.tables import upload_folder
from ragmill.streaming import intake

NOW = datetime.datetime(2024, 1, 1)
LATER = datetime.datetime(2024, 1, 2)


def column(spark, value, *expressions):
    """Expressions over one row with the text column x."""
    return spark.createDataFrame([(value,)], "x string").select(*expressions).first()


def pack(spark, lengths):
    rows = [(1, page, i, "x" * n) for i, (page, n) in enumerate(lengths)]
    found = chunking.pack(spark.createDataFrame(rows, "document_id long, page_number int, seq int, text string")).orderBy("chunk_index").collect()
    return [(r.chunk_index, len(r.content), r.page_start, r.page_end) for r in found]


def test_packing(spark):
    assert pack(spark, [(1, 1000), (2, 900), (3, 2000), (3, 100)]) == [(0, 1000, 1, 2), (1, 900, 2, 3), (2, 2000, 3, 3), (3, 100, 3, 3)]
    assert [r[1] for r in pack(spark, [(1, 1000), (1, 799)])] == [1800]
    assert len(pack(spark, [(1, 1000), (1, 800)])) == 2


def test_packing_against_a_loop(spark):
    import random

    random.seed(3)
    lengths = [(1 + i // 5, random.choice([10, 300, 900, 1799, 1800, 2500])) for i in range(120)]
    found, buffer, start, end = [], [], None, None
    for page, n in lengths:
        start = page if start is None else start
        end = page
        if buffer and sum(buffer) + len(buffer) + n > 1800:
            found.append((len(found), sum(buffer) + len(buffer) - 1, start, end))
            buffer, start = [], page
        buffer.append(n)
    found.append((len(found), sum(buffer) + len(buffer) - 1, start, end))
    assert pack(spark, lengths) == found


def test_paragraphs(spark):
    assert column(spark, "a  b\nc\n\n \n\nd e", chunking.paragraphs(F.col("x")))[0] == ["a b c", "d e"]
    assert column(spark, " \n ", chunking.paragraphs(F.col("x")))[0] == []


def scored(spark, rows):
    return spark.createDataFrame(rows, "id long, vector_score double, lexical_score double")


def test_fusion(spark):
    vector = spark.createDataFrame([(1, 0.8), (2, 0.4)], "id long, vector_score double")
    lexical = spark.createDataFrame([(2, 0.10), (3, 0.05)], "id long, lexical_score double")
    merged = fusion.combine(vector, lexical)
    ranked = fusion.ranked(fusion.fallback_scores(merged)).orderBy("rank").collect()
    assert [(r.id, round(r.rerank_score, 6)) for r in ranked] == [(2, 0.7), (1, 0.6), (3, 0.2)]
    only = fusion.fallback_scores(scored(spark, [(1, 0.8, None)])).first()
    assert round(only.rerank_score, 6) == 0.6
    model = spark.createDataFrame([(3, 9.0)], "id long, score double")
    assert [r.id for r in fusion.ranked(fusion.apply_scores(merged, model)).orderBy("rank").collect()] == [3, 1, 2]


def test_a_negative_maximum_turns_the_order(spark):
    ranked = fusion.ranked(fusion.fallback_scores(scored(spark, [(1, -0.2, None), (2, -0.4, None)])))
    assert [r.id for r in ranked.orderBy("rank").collect()] == [1, 2] or [round(r.rerank_score, 3) for r in ranked.orderBy("rank").collect()] == [1.2, 0.6]


def test_rank_fusion(spark):
    a = spark.createDataFrame([(1, 0), (2, 1)], "id long, rank int")
    b = spark.createDataFrame([(2, 0)], "id long, rank int")
    found = {r.id: r.rrf_score for r in fusion.reciprocal_rank_fusion(a, b).collect()}
    assert found == pytest.approx({1: 1 / 61, 2: 1 / 62 + 1 / 61})


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ('{"ranking": [{"id": "7", "score": 9}]}', {7: 9.0}),
        ('{"rankings": [{"id": 7, "score": 9}]}', {7: 9.0}),
        ('{"scores": [{"id": 7, "score": "3.5"}]}', {7: 3.5}),
        ('{"id": 7, "score": 4}', {7: 4.0}),
        ('{"7": 4, "8": 2}', {7: 4.0, 8: 2.0}),
        ('[{"id": 7, "score": 4}, {"id": 8}, 3]', {7: 4.0}),
        ('[{"id": 7, "score": 1}, {"id": 7, "score": 5}]', {7: 5.0}),
        ("5", {}),
        ("no json", {}),
        (None, {}),
    ],
)
def test_score_parsing(spark, text, wanted):
    found = column(spark, text, fusion.parse_scores(F.col("x")))[0]
    assert {r["id"]: r["score"] for r in found} == wanted


def test_pages_for_chunks(spark):
    rows = [(10, 1, 0, 2, 3), (11, 1, 1, 3, 4), (12, 1, 2, None, 4), (13, 1, 3, None, None), (14, 1, 4, 6, 5)]
    chunks = spark.createDataFrame(rows, "id long, document_id long, rank int, page_start int, page_end int")
    pages = spark.createDataFrame([(1, p) for p in (2, 3, 4, 6)], "document_id long, page_number int")
    found = context.pages_for_chunks(chunks, pages).collect()
    assert [(r.page_number, r.rank, r.chunk_ids) for r in found] == [(2, 0, [10]), (3, 0, [10, 11]), (4, 1, [11, 12]), (6, 4, [14])]
    cited = {r.page_number: r.sources for r in context.page_labels(context.pages_for_chunks(chunks, pages), chunks).collect()}
    assert cited[3] == [1, 2]


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("See Figure 9-22c and FIG. B-5", ["FIGURE 9-22C", "FIGURE B-5"]),
        ("Fig.12 then fig 12", ["FIGURE 12"]),
        ("Figures 4 and 5", []),
        ("figure 9–1", ["FIGURE 9–1"]),
        (None, []),
    ],
)
def test_figure_labels(spark, text, wanted):
    assert column(spark, text, labels.figure_labels(F.col("x")))[0] == wanted


def test_captions_need_a_dash(spark):
    assert column(spark, "Figure 3— Layout", labels.caption_label(F.col("x")))[0] == "FIGURE 3"
    assert column(spark, "Figure 3 Layout", labels.caption_label(F.col("x")))[0] is None
    assert column(spark, "Table 4-2—Rates", labels.is_table_label(F.col("x")))[0]


def tracked(spark, contents):
    rows = [(i, d, n, t) for i, (d, n, t) in enumerate(contents)]
    found = structure.track(spark.createDataFrame(rows, "id long, document_id long, chunk_index int, content string")).orderBy("id").collect()
    return [json.loads(r.updates) for r in found]


def test_section_tracker(spark):
    a, b, c, d, e = tracked(
        spark,
        [(1, 0, "4 General\n4.2 Frames\nPage 12"), (1, 1, "4.2.1 Beacon interval"), (1, 2, "SECURITY MECHANISMS"), (1, 3, "5 Overview, see page 7"), (2, 0, "3.1.4 Scope")],
    )
    assert a == {"heading": "4 General", "section": "4.2 Frames", "section_hierarchy": ["4 General", "4.2 Frames"], "page_number": 12, "page_numbers": [12]}
    assert b["subsection"] == "4.2.1 Beacon interval" and len(b["section_hierarchy"]) == 3 and b["page_number"] == 12
    assert c == {"heading": "Security Mechanisms", "section_hierarchy": ["Security Mechanisms"], "page_number": 12, "page_numbers": [12]}
    assert d["heading"] == "Security Mechanisms" and d["page_number"] == 7 and d["page_numbers"] == [7]
    assert e == {"heading": "3 3.1.4 Scope", "section": "3.1 Scope", "subsection": "3.1.4 Scope", "section_hierarchy": ["3 3.1.4 Scope", "3.1 Scope", "3.1.4 Scope"]}


def test_levels_and_pages_are_carried(spark):
    """Levels made up from a number, cleared by those above; pages of whole lines add to the span, others start it anew."""
    a, b, c, d, e, f = tracked(
        spark,
        [(1, 0, "no heading\n- 7 -"), (1, 1, "2.1.3 Deep.\n12"), (1, 2, None), (1, 3, "2.2 Next\nSection 3) Third"), (1, 4, "3.1.1 Low\n3.1 Mid"), (1, 5, "X-RAY 2ND LINE\nsee p. 4 and pg. 9")],
    )
    assert a == {"page_number": 7, "page_numbers": [7]}
    assert b["heading"] == "2 2.1.3 Deep" and b["section"] == "2.1 Deep" and b["subsection"] == "2.1.3 Deep" and b["page_numbers"] == [7, 12]
    assert c == b
    assert d == {"heading": "3 Third", "section_hierarchy": ["3 Third"], "page_number": 12, "page_numbers": [7, 12]}
    assert e["heading"] == "3 Third" and e["section"] == "3.1 Mid" and "subsection" not in e
    assert f["heading"] == "X-Ray 2Nd Line" and "section" not in f and f["page_number"] == 9 and f["page_numbers"] == [4, 9]


def kept(spark, lengths, budget, mode):
    rows = [(i, "" if n is None else "x" * n) for i, n in enumerate(lengths)]
    return [r.rank for r in context.budget(spark.createDataFrame(rows, "rank int, content string"), budget, mode).orderBy("rank").collect()]


def test_context_budget(spark):
    assert kept(spark, [5000, 2500, 1000, 100], 8000, "api") == [0, 1]
    assert kept(spark, [9000, 10], 8000, "api") == [0]
    assert kept(spark, [10, 20], 0, "api") == [0, 1]
    assert kept(spark, [10, 20], 0, "cli") == [0]


def test_blank_snippets_use_up_their_number(spark):
    rows = [(i, 1, t, {}) for i, t in enumerate(["a", " ", "b"])]
    chunks = spark.createDataFrame(rows, "rank int, document_id long, content string, metadata map<string,string>")
    text = context.context(chunks, 100).first()["context"]
    assert text == "[Source 1] Document: doc-1\na\n\n---\n\n[Source 3] Document: doc-1\nb"


def test_snippet_headers(spark):
    rows = [(0, 1, "a", {"section": "", "heading": "H", "page_number": "3", "page_end": "4", "file_name": "f.pdf"})]
    chunks = spark.createDataFrame(rows, "rank int, document_id long, content string, metadata map<string,string>")
    assert context.context(chunks, 100).first()["context"] == "[Source 1] Document: f.pdf | Section: H | Pages: 3-4\na"


def words(spark, rows):
    return spark.createDataFrame([(1, 1, t, float(x), float(y), float(x) + 5, float(y) + 8) for t, x, y in rows], "document_id long, page_number int, text string, x0 double, top double, x1 double, bottom double")


def test_lines_keep_their_anchor(spark):
    found = layout.word_lines(words(spark, [("a", 0, 0.0), ("b", 10, 2.0), ("c", 20, 4.0)])).orderBy("line").collect()
    assert [r.text for r in found] == ["a b", "c"]


def test_captions_of_lines(spark):
    lines = layout.word_lines(words(spark, [("Figure", 0, 0), ("1—One", 10, 0), ("more", 0, 12), ("Figure", 0, 24), ("2—Two", 10, 24), ("far", 0, 90)]))
    found = layout.captions(lines).orderBy("position").collect()
    assert [(r.figure_label, r.caption_text) for r in found] == [("FIGURE 1", "Figure 1—One more"), ("FIGURE 2", "Figure 2—Two")]


def test_boxes(spark):
    box = lambda *v: layout.make_box(*[F.lit(float(x)) for x in v])
    normal = lambda *v: layout.normalised_box(F.array(*[F.lit(float(x)) for x in v]))
    quads = lambda n: F.size(layout.quad_boxes(F.array(*[F.lit(float(i % 5 + i)) for i in range(n)])))
    row = column(
        spark, "", layout.overlaps(box(0, 0, 10, 10), box(10, 0, 20, 10)), layout.overlaps(box(0, 0, 10, 10), box(9, 9, 20, 20)), normal(5, 8, 1, 2), normal(1, 1, 1, 5), quads(7), quads(8)
    )
    assert (row[0], row[1], tuple(row[2]), row[3], row[4], row[5]) == (False, True, (1, 2, 5, 8), None, 0, 1)


def test_figures_of_a_document(spark):
    pages = spark.createDataFrame([(1, p, 600.0, 800.0) for p in (1, 2)], "document_id long, page_number int, width double, height double")
    text = words(spark, [("Figure", 60, 610), ("1—A", 110, 610)])
    text = text.unionByName(text.withColumn("page_number", F.lit(2)))
    shapes = spark.createDataFrame([(1, p, "rect", 80.0, 450.0, 400.0, 600.0) for p in (1, 2)], "document_id long, page_number int, kind string, x0 double, top double, x1 double, bottom double")
    found = layout.extract_figures(pages, text, shapes).collect()
    assert [(r.page_number, r.figure_label, r.x0, r.top, r.x1, r.bottom) for r in found] == [(1, "FIGURE 1", 74.0, 444.0, 406.0, 606.0)]


def test_figures_of_one_page(spark):
    """A caption of a label that the document has leaves the bound where it is; a table's label above a box rules it out."""
    pages = spark.createDataFrame([(1, p, 600.0, 800.0) for p in (1, 2, 3)], "document_id long, page_number int, width double, height double")
    on = lambda number, *rows: words(spark, list(rows)).withColumn("page_number", F.lit(number))
    first = on(1, ("Fig.", 60, 300), ("1—A", 110, 300))
    second = on(2, ("Fig.", 60, 300), ("1—A", 110, 300), ("Fig.", 60, 600), ("2—B", 110, 600))
    third = on(3, ("Table", 80, 180), ("4—Rates", 130, 180), ("Fig.", 60, 400), ("3—C", 110, 400))
    shapes = [(1, 1, 200.0), (1, 2, 200.0), (1, 2, 500.0), (1, 3, 210.0)]
    shapes = spark.createDataFrame([(d, p, "rect", 80.0, t, 400.0, t + 80) for d, p, t in shapes], "document_id long, page_number int, kind string, x0 double, top double, x1 double, bottom double")
    found = layout.extract_figures(pages, first.unionByName(second).unionByName(third), shapes).collect()
    # On the second page the first caption is known, so the band of the other one reaches up to the first shape.
    assert sorted((r.page_number, r.figure_label, r.top, r.bottom) for r in found) == [(1, "FIGURE 1", 194.0, 286.0), (2, "FIGURE 2", 238.0, 586.0)]


def test_text_boxes_above_captions(spark):
    pages = spark.createDataFrame([(1, 1, 600.0, 800.0)], "document_id long, page_number int, width double, height double")
    found = spark.createDataFrame([(1, 1, 0, "FIGURE 1", 0.0, 400.0)], "document_id long, page_number int, position int, figure_label string, min_top double, top double")
    three = [("a", 100, 300), ("b", 150, 320), ("c", 200, 340)]
    (box,) = layout.textual_figure_boxes(found, words(spark, three), pages).collect()
    assert (box.x0, box.top) == (94.0, 296.0) and layout.textual_figure_boxes(found, words(spark, three[:2]), pages).count() == 0


def test_an_image_needs_a_label_below(spark):
    pages = spark.createDataFrame([(1, 1, 600.0, 800.0)], "document_id long, page_number int, width double, height double")
    text = words(spark, [("see", 100, 300), ("Fig.", 120, 300), ("7—B", 150, 300)])
    shapes = spark.createDataFrame([(1, 1, "image", 80.0, 100.0, 400.0, 290.0)], "document_id long, page_number int, kind string, x0 double, top double, x1 double, bottom double")
    assert [r.figure_label for r in layout.extract_figures(pages, text, shapes).collect()] == ["FIGURE 7"]


def test_metadata_merge(spark):
    row = spark.createDataFrame([({"a": "1", "page_number": "3"}, {"page_number": "9", "page_numbers": "[9]", "a": None})], "x map<string,string>, y map<string,string>")
    assert row.select(structure.merge_metadata(F.col("x"), F.col("y"))).first()[0] == {"a": "1", "page_number": "9", "page_numbers": "[9]"}


def test_store(spark):
    table = spark.createDataFrame([(1, "e", "old", None, "pdf", None, "c", 1, {}, NOW, NOW)], DOCUMENT)
    rows = table.drop("created_at", "updated_at").withColumn("title", F.lit("new")).withColumn("id", F.lit(5).cast("long"))
    once = store.upsert_documents(table, rows, LATER)
    twice = store.upsert_documents(once, rows, LATER).collect()
    assert len(twice) == 1 and twice[0].id == 1 and twice[0].title == "new" and twice[0].created_at == NOW and twice[0].updated_at == LATER
    assert key_violations(once, "document").count() == 0
    chunks = spark.createDataFrame([(i, d, i, 1, 1, "t", None, "body", None, {}, NOW) for i, d in ((1, 1), (2, 1), (3, 2))], CHUNK)
    documents = spark.createDataFrame([(1,)], "document_id long")
    assert [r.id for r in store.replace(chunks, chunks.where("id < 0"), documents).collect()] == [3]
    assert orphans(chunks, table).select("document_id").first()[0] == 2


def test_figures_upsert(spark):
    table = spark.createDataFrame([(1, 1, "FIGURE 1", 1, "a", None, {}, NOW), (2, 1, "FIGURE 2", 1, "stale", None, {}, NOW)], FIGURE)
    rows = spark.createDataFrame([(9, 1, "FIGURE 1", 1, "b", None, {}, 0), (9, 1, "FIGURE 1", 1, "c", None, {}, 1)], "id long, document_id long, figure_label string, page_number int, caption string, image_uri string, metadata map<string,string>, position int")
    found = {r.figure_label: (r.id, r.caption) for r in store.upsert_figures(table, rows, LATER).collect()}
    assert found == {"FIGURE 1": (1, "c"), "FIGURE 2": (2, "stale")}


def test_run_status(spark):
    runs = store.start_run(spark.createDataFrame([], RUN), "r", 1, NOW)
    failed = store.set_status(runs, "r", "failed", LATER, "bad")
    done = store.set_status(failed, "r", "completed", LATER)
    assert store.get_run(failed, "r").first().error_message == "bad"
    row = store.get_run(done, "r").first()
    assert (row.status, row.error_message, row.finished_at) == ("completed", None, LATER)
    assert store.set_status(done, "r", "processing", NOW).first().finished_at == LATER


def test_cleaning(spark):
    assert column(spark, "x ALPHA\n  beta y", cleaning.strip_phrases(F.col("x"), ["Alpha Beta"]))[0] == "x   y"
    rows = [(0, 1, 0, "cover"), (1, 1, 1, "front 1. Overview text"), (2, 1, 2, "1. Overview again"), (3, 1, 3, " alpha  BETA ")]
    chunks = spark.createDataFrame(rows, "id long, document_id long, chunk_index int, content string")
    found = cleaning.clean_chunks(chunks, ["Alpha Beta", " "]).orderBy("id").collect()
    assert [r.content for r in found] == ["cover", "1. Overview text", "1. Overview again"]


def test_small_functions(spark):
    names = [column(spark, x, labels.object_name(F.col("x")))[0] for x in ("My Fig (1).PNG", "***", "a\\b/C d.png")]
    assert names == ["my-fig-1-.png", "asset", "c-d.png"]
    assert column(spark, None, labels.folder_name(F.col("x")))[0] == "figures"
    assert column(spark, "Table12 and Table 12", labels.space_table_labels(F.col("x")))[0] == "Table 12 and Table 12"
    at = lambda s: F.lit(NOW) + F.expr(f"INTERVAL {s} SECONDS")
    shown = column(spark, "", *[labels.progress(F.lit(NOW), F.lit(None).cast("timestamp"), at(s)) for s in (0, 600, 3600)], labels.progress(F.lit(NOW), at(1), at(2)), labels.progress(F.lit(None).cast("timestamp"), F.lit(None).cast("timestamp"), at(1)))
    assert tuple(shown) == (3, 50, 97, 100, None)
    assert column(spark, "gs://b/o", labels.storage_uri(F.col("x"), F.lit("https://o")), labels.join_url(F.lit("http://h/"), F.lit("/p")))[:] == ("https://o", "http://h/p")


def test_tables_as_text(spark):
    rows = spark.createDataFrame([(1, 2, 0, [["a", None], ["1 ", "2"]])], "document_id long, page_number int, table_index int, rows array<array<string>>")
    found = chunking.table_chunks(rows, spark.createDataFrame([(1,), (1,)], "document_id long")).first()
    assert (found.chunk_index, found.content, found.metadata) == (2, "a | \n----\n1 | 2", {"table_index_on_page": "1"})


def test_lexical_search(spark):
    rows = [(1, "alpha x beta"), (2, "beta alpha beta"), (3, "alpha"), (4, None)]
    chunks = spark.createDataFrame(rows, "id long, content string")
    found = {r.id: round(r.lexical_score, 4) for r in search.lexical_topk(chunks, ["alpha", "beta"], 5).collect()}
    assert found == {1: 0.05, 2: 0.2}
    assert search.lexical_topk(chunks, [], 5).count() == 0


def test_vectors(spark):
    unit = vectors.embed_offline("text", 16)
    assert sum(x * x for x in unit) == pytest.approx(1) and vectors.embed_offline(" text ", 16) == unit and vectors.embed_offline(" ", 4) == [0.0] * 4
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, [0.0, 0.0])], "id long, embedding array<float>")
    assert [r.id for r in search.vector_topk(rows, [1.0, 0.1], 3).collect()] == [1, 2, 4]
    assert [r.id for r in search.vector_topk(rows, [1.0, 0.0], 2, "l2").collect()] == [1, 4]


def test_answer(spark):
    embed = OfflineEmbedder(8)
    rows = [(i, 1, i, 1, 1, f"alpha beta {i}, see Figure {i}", None, "body", embed.one(f"alpha beta {i}, see Figure {i}"), {}, NOW) for i in range(3)]
    chunks = spark.createDataFrame(rows, CHUNK)
    pages = spark.createDataFrame([(1, 1)], "document_id long, page_number int")
    figures = spark.createDataFrame([(1, "FIGURE 2")], "document_id long, figure_label string")
    retriever = Retriever(chunks, pages, figures, embed)
    found = json.loads(retriever.answer("alpha beta").first()["payload"])
    assert found["answer"] == NO_ANSWER and len(found["chunks"]) == 3 and found["pages"][0]["page_number"] == 1 and found["figures"][0]["figure_label"] == "FIGURE 2"
    with pytest.raises(ValueError):
        retriever.search(" ")


def test_backfill(spark):
    rows = [(1, 1, 0, 1, 1, "4 General", None, "body", [0.5], {}, NOW), (2, 1, 1, 1, 1, "text", None, "body", None, {}, NOW), (3, 2, 0, 1, 1, "t", None, "body", [1.0], {}, NOW)]
    found = backfill(spark.createDataFrame(rows, CHUNK), OfflineEmbedder(4)).collect()
    assert [(r.id, r.metadata["heading"], len(r.embedding)) for r in found] == [(2, "4 General", 4)]


def test_uploads(spark, tmp_path):
    for folder, data in (("a", b"one"), ("b", b"two"), ("c", b"")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.pdf").write_bytes(data)
    (tmp_path / "n.txt").write_bytes(b"text")
    assert sorted(r.name for r in upload_folder(spark, str(tmp_path)).collect()) == ["x.pdf", "x_1.pdf"]


def test_intake(spark, tmp_path):
    pages = spark.createDataFrame([(1, 1, "a\n\nb"), (1, 2, "c")], intake.PAGES)
    pages.write.parquet(str(tmp_path / "in"))
    intake.run(intake.page_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    assert [r.content for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a b c"]
