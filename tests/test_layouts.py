"""Dumps of page layouts: what is read, what is passed over, and an ingestion that starts from them."""

import datetime
import json

from pyspark.sql import functions as F

from ragmill.plans.ingest import ingest_into
from ragmill.plans.providers import OfflineEmbedder
from ragmill.schema import CHUNK, FIGURE, PAGE
from ragmill.sources.layouts import Dumps, written
from ragmill.sources.snapshots import Snapshots


def word(text, x0, top):
    return {"text": text, "x0": x0, "top": top, "x1": x0 + 30, "bottom": top + 10}


def box(x0, top, x1, bottom, **more):
    return {"x0": x0, "top": top, "x1": x1, "bottom": bottom} | more


PAGES = [
    {
        "external_id": "a", "page_number": 1, "width": 600, "height": 800, "rotation": 0,
        "words": [word("struck", 300, 100), word("One", 100, 100), word("two", 200, 101), word("three", 100, 120), word("margin", 10, 100), word("Fig.", 100, 500), word("1—A", 140, 500)],
        "images": [box(100, 300, 400, 480)], "rects": [box(1, 2, 3, 4)], "lines": [box(9, 0, 5, 0, y0=7, y1=3)], "curves": [{"pts": [[1, 5], [4, 2]]}, {"pts": []}],
        "annotations": [{"subtype": "StrikeOut", "rect": [300, 98, 340, 112]}, {"subtype": "Link", "rect": [0, 0, 600, 800]}], "tables": [[["h", "i"], ["1", None]]], "unknown": 7,
    },
    {"external_id": "a", "page_number": 2, "width": 600, "height": 800, "words": [word("last", 100, 100)], "tables": None},
    {"external_id": "b", "page_number": 1, "width": 600, "height": 800},
]


def dumps(spark, folder, **more):
    folder.mkdir(exist_ok=True)
    lines = [json.dumps(p, ensure_ascii=False) for p in PAGES]
    (folder / "one.json").write_text("\n".join([*lines[:2], "no json", '{"page_number": 4}', '{"external_id": "c", "page_number": "x"}', "[]"]))
    (folder / "two.json").write_text(lines[2] + "\n\n")
    return Dumps(spark, str(folder), **more)


def test_what_is_on_pages(spark, tmp_path):
    source = dumps(spark, tmp_path / "d")
    assert sorted((r.external_id, r.page_number, r.rotation) for r in source.pages().collect()) == [("a", 1, 0), ("a", 2, None), ("b", 1, None)]
    assert source.words().count() == 8 and source.tables().collect()[0].rows == [["h", "i"], ["1", None]]
    shapes = {r.kind: (r.x0, r.top, r.x1, r.bottom) for r in source.shapes().collect()}
    assert shapes == {"rect": (1, 2, 3, 4), "image": (100, 300, 400, 480), "line": (5, 3, 9, 7), "curve": (1, 2, 4, 5)}
    assert sorted((r.external_id, r.page_number, r.text) for r in source.texts().collect()) == [("a", 1, "One two\nthree\nFig. 1—A"), ("a", 2, "last")]
    assert sorted(r.line for r in source.broken().collect()) == sorted(["no json", '{"page_number": 4}', '{"external_id": "c", "page_number": "x"}', "[]"])


def test_only_named_fields_and_pages_are_read(spark, tmp_path):
    part = dumps(spark, tmp_path / "d", first=2, last=9)
    assert [r.text for r in part.words().collect()] == ["last"]
    plan = part.words()._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema:")[1].split("\n")[0]
    assert "words" in schema and "images" not in schema and "GreaterThanOrEqual(page_number,2)" in plan
    assert Dumps(spark, str(tmp_path / "d"), first=5).pages().count() == 0


def test_dumps_that_spark_wrote(spark, tmp_path):
    source = dumps(spark, tmp_path / "d")
    written(source._read("words", "images", "width", "height"), str(tmp_path / "again"))
    again = Dumps(spark, str(tmp_path / "again"))
    assert sorted(map(tuple, again.words().collect())) == sorted(map(tuple, source.words().collect()))


def test_an_ingestion_from_dumps(spark, tmp_path):
    files = spark.createDataFrame([("a", "t", None, None, "c", 2)], "external_id string, title string, description string, source_uri string, checksum string, total_pages int")
    tables = Snapshots(spark, str(tmp_path / "t"), buckets=2)
    ingest_into(tables, dumps(spark, tmp_path / "d").upload(files), OfflineEmbedder(4), datetime.datetime(2024, 1, 1), "gs://b")
    chunks = tables.read("chunk", CHUNK).orderBy("chunk_index").collect()
    assert [(c.content, c.chunk_type, c.page_start, c.page_end) for c in chunks] == [("One two three Fig. 1—A last", "body", 1, 2), ("h | i\n-----\n1 |", "table", 1, 1)]
    assert sorted(r.page_number for r in tables.read("page", PAGE).collect()) == [1, 2]
    assert tables.read("figure", FIGURE).select("figure_label", F.col("caption")).first()[0] == "FIGURE 1"
